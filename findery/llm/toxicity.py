"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs.  Each word has a row of numbers of two kinds:

- learned embeddings, back-propagated with the rest of the network: the sum of the
  rows of the word's own bucket and of its character n-grams' (prefixes of several
  lengths) in one hashed table.  They begin at zero, so that what is rare in training
  hardly moves them, and are left out at random while training;
- odds: how much oftener the word, its prefixes and its inner character n-grams
  occur in toxic than in clean training texts, as signed roots of z-scores from
  hashed tables, so that what was seen once says little.

Network.  Overlapping windows of ``WINDOW`` words, every ``STRIDE`` words, cover the
whole text.  A GRU reads each window in both directions, attention pools its
states, and a logistic unit scores the window.  A text's score is that of its
highest window.  A text without a word, so a NULL or empty one, has one window without words.

Training, in numpy.  Labels are of texts, not of windows: in turns, the network
picks each training text's highest window, then learns from those (and from
random windows of clean texts) by back-propagation through time with Adam.  Last,
logits are shifted so that the best cut by F1 lies at ``THRESHOLD``; the cut is found by
cross-validation in two folds of the training texts, each scored by a model of the other fold.  The
sample is bounded: at most about ``toxic_docs`` and ``clean_docs`` labelled texts of at most
``most_chars`` characters, chosen by a hash of the id, one for each id (the least by hash of its texts).

Each row is scored by its text alone, so repeated rows score alike, ids may be NULL or
repeat, and other columns play no part, whatever their names.  A score equal to ``THRESHOLD`` is a 1.  Without labels
of both kinds all scores are one constant; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import codepoints as cp
from findery.llm.common import bounded_batches, give_back, id_crc, sample_fraction, share, slices, table

WINDOW, STRIDE, HIDDEN = 16, 8, 8
PREFIXES, INNER = (3, 4, 5, 6), 4
ODDS, LEARNED = 2 + len(PREFIXES) + 2, 8
FEATURES = ODDS + LEARNED
THRESHOLD = 0.7
WORD_BITS, CHAR_BITS = 19, 18
ROW_BITS = 14  # rows of the learned table: so many for words, as many for character n-grams, and one for none
LEFT_OUT = 0.3  # share of training windows without the learned part


@dataclass
class Model:
    words: list[np.ndarray]  # two tables by word hash
    prefixes: list[np.ndarray]  # one by prefix length
    inner: np.ndarray
    net: dict[str, np.ndarray]  # E: the learned table


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


class Keys:
    """Of a text's distinct words the buckets: two of the word, its prefixes (-1 if shorter), its inner n-grams with their owners; and each word's place among them."""

    __slots__ = ("own", "prefixes", "inner", "owner", "which")

    def __init__(self, words: cp.Words):
        _, firsts, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        h, starts, lengths = words.hashes[firsts], words.starts[firsts], words.lengths[firsts]
        self.own = [_buckets(h, WORD_BITS), _buckets(cp.mix(h ^ cp.MULT), WORD_BITS)]
        chars = words.chars.astype(np.uint64) + np.uint64(1)
        rolled, self.prefixes = np.zeros(len(firsts), dtype=np.uint64), []
        for n in range(1, PREFIXES[-1] + 1):
            has = lengths >= n
            rolled = np.where(has, rolled * cp.CHAR + chars[np.where(has, starts + n - 1, 0)], rolled) if len(firsts) else rolled
            if n in PREFIXES:
                self.prefixes.append(np.where(has, _buckets(cp.mix(rolled + np.uint64(n)), CHAR_BITS), np.int32(-1)))
        many = np.maximum(lengths - INNER + 1, 0)
        self.owner = np.repeat(np.arange(len(firsts), dtype=np.int32), many)
        at = np.repeat(starts, many) + np.arange(len(self.owner)) - np.repeat(np.cumsum(many) - many, many)
        g = np.zeros(len(at), dtype=np.uint64)
        for j in range(INNER):
            g = g * cp.CHAR + chars[at + j]
        self.inner, self.which = _buckets(cp.mix(g), CHAR_BITS), which.astype(np.int32)


def odds(model: Model, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the distinct words, and their rows in the learned table (word, then prefixes)."""
    x = np.zeros((len(keys.own[0]), ODDS), dtype=np.float32)
    for k, (t, own) in enumerate(zip(model.words, keys.own)):
        x[:, k] = t[own]
    for k, (t, own) in enumerate(zip(model.prefixes, keys.prefixes)):
        x[:, 2 + k] = np.where(own >= 0, t[own], 0)
    if len(keys.owner):
        edges = np.flatnonzero(np.diff(keys.owner, prepend=-1))
        values, at = model.inner[keys.inner], keys.owner[edges]
        x[at, -2] = np.maximum.reduceat(values, edges)
        x[at, -1] = np.add.reduceat(values, edges) / np.diff(np.append(edges, len(keys.owner)))
    rows = [keys.own[0] >> (WORD_BITS - ROW_BITS), *(np.where(k >= 0, (1 << ROW_BITS) + (k >> (CHAR_BITS - ROW_BITS)), 2 << ROW_BITS) for k in keys.prefixes)]
    return x, np.stack(rows, axis=1).astype(np.int32)


def joined(net: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    learned = net["E"][rows[..., 0]]
    for k in range(1, rows.shape[-1]):
        learned = learned + net["E"][rows[..., k]]
    return np.concatenate([x, learned], axis=-1)


def windows(n: int) -> np.ndarray:
    """First word of each window; the last one ends with the text or behind it."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gates(net: dict[str, np.ndarray], x: np.ndarray, side: str) -> np.ndarray:
    return x @ net[f"W{side}"] + net[f"b{side}"]


def run(net: dict[str, np.ndarray], inputs: dict[str, np.ndarray], rows: np.ndarray, keep: bool = False):
    """Logits of windows.  ``inputs``: gate inputs of the distinct words by direction, the last row for no word.

    ``rows``: windows x WINDOW row numbers.  States pass unchanged over places without a word.
    """
    n, h = len(rows), HIDDEN
    states = {s: np.zeros((WINDOW, n, h), dtype=np.float32) for s in "fb"}
    there = rows >= 0
    trace: dict = {}
    for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        state = np.zeros((n, h), dtype=np.float32)
        u, un = net[f"U{side}"], net[f"V{side}"]
        for t in order:
            a = inputs[side][rows[:, t]]
            zr = _sigmoid(a[:, : 2 * h] + state @ u)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + (r * state) @ un)
            new = np.where(there[:, t, None], state + z * (c - state), state)
            if keep:
                trace[side, t] = (state, z, r, c)
            states[side][t] = state = new
    both = np.concatenate([states["f"], states["b"]], axis=2)  # WINDOW x n x 2h
    energy = np.where(there.T, both @ net["v"], -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, both)
    logit = pooled @ net["w"] + net["c"]
    return (logit, pooled, weight, both, trace) if keep else logit


def learn(net: dict[str, np.ndarray], odds_: np.ndarray, embed: np.ndarray, y: np.ndarray, there: np.ndarray, weights: np.ndarray, used: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients for a batch of windows: ``odds_`` is windows x WINDOW x ODDS, ``embed`` windows x WINDOW x rows of the learned table.

    ``used``: in which windows the learned part takes part (1 or 0).
    """
    n, h = len(odds_), HIDDEN
    x = joined(net, odds_, embed)
    x[..., ODDS:] *= (there if used is None else there & used[:, None].astype(bool))[..., None]
    rows = np.where(there, np.arange(n * WINDOW).reshape(n, WINDOW), -1)
    flat = x.reshape(-1, FEATURES)
    inputs = {s: np.concatenate([gates(net, flat, s), np.zeros((1, 3 * h), dtype=np.float32)]) for s in "fb"}
    logit, pooled, weight, both, trace = run(net, inputs, rows, keep=True)
    p = _sigmoid(logit)
    loss = float(-(weights * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / weights.sum())
    g = {k: np.zeros_like(v) for k, v in net.items()}
    d = (weights * (p - y) / weights.sum()).astype(np.float32)
    g["w"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
    dpool = d[:, None] * net["w"]
    dweight = np.einsum("nh,tnh->tn", dpool, both)
    denergy = weight * (dweight - (weight * dweight).sum(axis=0))
    dboth = weight[:, :, None] * dpool + denergy[:, :, None] * net["v"]
    g["v"] = np.einsum("tn,tnh->h", denergy, both)
    dx = np.zeros_like(x)
    for side, order, part in (("f", range(WINDOW - 1, -1, -1), slice(0, h)), ("b", range(WINDOW), slice(h, 2 * h))):
        u, un = net[f"U{side}"], net[f"V{side}"]
        dnext = np.zeros((n, h), dtype=np.float32)
        for t in order:
            state, z, r, c = trace[side, t]
            dnew = dboth[t, :, part] + dnext
            on = there[:, t, None]
            live = np.where(on, dnew, 0)
            dc = live * z * (1 - c * c)
            drs = dc @ un.T
            dz = live * (c - state) * z * (1 - z)
            dr = drs * state * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            dnext = np.where(on, dnew * (1 - z) + drs * r + dzr @ u.T, dnew)
            g[f"U{side}"] += state.T @ dzr
            g[f"V{side}"] += (r * state).T @ dc
            da = np.concatenate([dzr, dc], axis=1)
            g[f"W{side}"] += x[:, t].T @ da
            g[f"b{side}"] += da.sum(axis=0)
            dx[:, t] += da @ net[f"W{side}"].T
    live = there if used is None else there & used[:, None].astype(bool)
    dlearned = dx[..., ODDS:][live]
    for k in range(embed.shape[-1]):
        np.add.at(g["E"], embed[..., k][live], dlearned)
    g["E"][-1] = 0  # no n-gram
    return loss, g


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    net = {}
    for s in "fb":
        net |= {f"W{s}": make(FEATURES, 3 * HIDDEN), f"b{s}": np.zeros(3 * HIDDEN, np.float32), f"U{s}": make(HIDDEN, 2 * HIDDEN), f"V{s}": make(HIDDEN, HIDDEN)}
    return net | {"v": make(2 * HIDDEN), "w": make(2 * HIDDEN), "c": np.zeros(1, np.float32), "E": np.zeros(((2 << ROW_BITS) + 1, LEARNED), np.float32)}


def window_logits(model: Model, text: str) -> np.ndarray:
    """Logits of all windows of a text."""
    return next(_of_many(model.net, iter([_item(model, Keys(cp.Words(text)))])))


def _logits(net: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray, block: int = 4096) -> np.ndarray:
    inputs = {s: np.concatenate([gates(net, x, s), np.zeros((1, 3 * HIDDEN), dtype=np.float32)]).astype(np.float32) for s in "fb"}
    return np.concatenate([run(net, inputs, rows[i : i + block]) for i in range(0, len(rows), block)])


def _of_many(net: dict[str, np.ndarray], items: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], block: int = 4096) -> Iterator[np.ndarray]:
    """Logits of the windows of each text; those of many texts go through the network together.  ``items``: odds, rows and windows."""

    def run_(part: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        base = np.cumsum([0, *(len(x) for x, _, _ in part)])
        x = joined(net, np.concatenate([x for x, _, _ in part]), np.concatenate([rows for _, rows, _ in part]))
        at = np.concatenate([np.where(at >= 0, at + n, -1) for (_, _, at), n in zip(part, base)])
        return np.split(_logits(net, x, at), np.cumsum([len(at) for _, _, at in part])[:-1])

    held, n = [], 0
    for item in items:
        held.append(item)
        n += len(item[2])
        if n >= block:
            yield from run_(held)
            held, n = [], 0
    if held:
        yield from run_(held)


def _item(model: Model, keys: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's odds and rows of the learned table, by distinct word, and the words of its windows."""
    n = len(keys.which)
    if not n:
        return np.zeros((0, ODDS), np.float32), np.zeros((0, 1 + len(PREFIXES)), np.int32), np.full((1, WINDOW), -1, dtype=np.int32)
    at = windows(n)[:, None] + np.arange(WINDOW)
    return *odds(model, keys), np.where(at < n, keys.which[np.minimum(at, n - 1)], np.int32(-1))


def _tables(texts: list[Keys], labels: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    share, out = labels.mean(), []
    for k, bits in enumerate([WORD_BITS] * 2 + [CHAR_BITS] * (len(PREFIXES) + 1)):
        seen = np.zeros((2, 1 << bits), dtype=np.float32)
        for x, y in zip(texts, labels):
            keys = [*x.own, *x.prefixes, x.inner][k]
            seen[y][keys[keys >= 0]] += 1  # once for each text, however often it has the bucket
        both = seen.sum(axis=0)
        z = (seen[1] - both * share) / np.sqrt(both * share * (1 - share) + 1)
        out.append((np.sign(z) * np.sqrt(np.abs(z)) / 2).astype(np.float32))
    return out[:2], out[2:-1], out[-1]


def _fit(texts: list[Keys], labels: np.ndarray, turns: int, epochs: int, rate: float, seed: int) -> Model:
    """Tables and network of texts with labels of both kinds."""
    rng = np.random.default_rng(seed)
    # tables from one half score the other, so that the network learns what they are worth on new texts
    half = rng.permutation(len(texts)) % 2
    sides = [labels[half != side] for side in (0, 1)]
    if any(len(x) == 0 or x.min() == x.max() for x in sides):
        parts = [Model(*_tables(texts, labels), fresh(seed))] * 2
    else:
        parts = [Model(*_tables([x for x, k in zip(texts, half) if k != side], sides[side]), fresh(seed)) for side in (0, 1)]
    data = [_item(parts[k], x) for x, k in zip(texts, half)]
    model = Model(*_tables(texts, labels), fresh(seed))
    del parts
    net, state, step = model.net, {k: [np.zeros_like(v)] * 2 for k, v in fresh().items()}, 0
    nothing = np.zeros((1, ODDS), np.float32), np.full((1, 1 + len(PREFIXES)), 2 << ROW_BITS, dtype=np.int32)
    for turn in range(turns):
        chosen, ys = [], []
        if turn == 0:
            highest = [int(np.append(x[:, :2].sum(axis=1), 0)[at].max(axis=1).argmax()) for x, _, at in data]
        else:
            highest = [int(x.argmax()) for x in _of_many(net, iter(data))]
        for (x, rows, at), best, y in zip(data, highest, labels):
            for k in [best] if y else {best, int(rng.integers(len(at)))}:
                chosen.append((np.concatenate([x, nothing[0]])[at[k]], np.concatenate([rows, nothing[1]])[at[k]], at[k] >= 0))
                ys.append(y)
        x, rows, there = (np.array([c[k] for c in chosen]) for k in range(3))
        y = np.array(ys, dtype=np.float32)
        weights = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for part in np.array_split(order, max(1, len(x) // 128)):
                _, g = learn(net, x[part], rows[part], y[part], there[part], weights[part], rng.random(len(part)) >= LEFT_OUT)
                step += 1
                for k in net:
                    m, v = state[k]
                    state[k] = [m, v] = [0.9 * m + 0.1 * g[k], 0.99 * v + 0.01 * g[k] ** 2]
                    net[k] -= (rate / (1 + step / 400)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def train(texts: list[str], labels: np.ndarray, turns: int = 3, epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Model:
    """A model from texts with labels 0 and 1; with one kind of label only, a constant."""
    if len(labels) == 0 or labels.min() == labels.max():
        net = {k: np.zeros_like(v) for k, v in fresh().items()}
        net["c"][:] = 10 * (2 * (float(labels.mean()) if len(labels) else 0.0) - 1)
        return Model([np.zeros(1 << WORD_BITS, np.float32)] * 2, [np.zeros(1 << CHAR_BITS, np.float32)] * len(PREFIXES), np.zeros(1 << CHAR_BITS, np.float32), net)
    keys = [Keys(cp.Words(t)) for t in texts]
    model = _fit(keys, labels, turns, epochs, rate, seed)
    # two folds, each with its share of both kinds
    order = np.random.default_rng(seed + 1).permutation(len(labels))
    fold = np.zeros(len(labels), dtype=int)
    for y in (0, 1):
        fold[order[labels[order] == y]] = np.arange((labels == y).sum()) % 2
    logits = np.zeros(len(labels))
    for side in (0, 1):
        known = labels[fold != side]
        if len(known) == 0 or known.min() == known.max():
            return model  # too few labels to find a cut
        other = _fit([x for x, k in zip(keys, fold) if k != side], known, turns, epochs, rate, seed + 2)
        own = np.flatnonzero(fold == side)
        logits[own] = [x.max() for x in _of_many(other.net, (_item(other, keys[k]) for k in own))]
    model.net["c"] -= np.float32(cut(logits, labels) - np.log(THRESHOLD / (1 - THRESHOLD)))
    return model


def cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where to part the logits for the best F1: of equally good gaps between neighbours the middle of the widest."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    toxic = y[::-1].cumsum()[::-1]  # at or above each place
    f1 = 2 * toxic / (np.arange(len(y), 0, -1) + y.sum())
    gap = np.diff(x, prepend=x[0] - 1.0)
    f1 = np.where(gap > 0, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[gap[best].argmax()])
    return float(x[k] - gap[k] / 2)


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1000, clean_docs: int = 2000, most_chars: int = 50_000) -> Model:
    """Learn from labelled texts.  A document with several labels is toxic if one says so; NULL labels and ids are left out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [sample_fraction(known.filter(F.col("toxic") == k), "doc_id", sizes.get(k, 0), most) for k, most in ((1, toxic_docs), (0, clean_docs))]
    sample = parts[0].unionByName(parts[1])  # bounded, so it may be broadcast
    usable = docs.filter(F.col("text").isNotNull() & (F.length("text") <= most_chars)).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = usable.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    rows = one.select("doc_id", "toxic", "x.text").orderBy("doc_id").toPandas()
    model = train(rows["text"].tolist(), rows["toxic"].to_numpy(dtype=np.int64))
    del rows
    give_back()  # the driver goes on for long
    return model


def predict(model: Model, texts: list[str | None]) -> np.ndarray:
    """Scores of texts."""
    items = (_item(model, Keys(cp.Words(x or ""))) for x in texts)
    return _sigmoid(np.array([x.max() for x in _of_many(model.net, items)], dtype=np.float64))


def toxicity(spark: SparkSession, model: Model, text: Column) -> Column:
    """A column with each text's score, 0 to 1."""
    shared = share(spark, model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])
            yield pd.Series(np.concatenate([np.empty(0), *(predict(shared.value, x.column(0).to_pylist()) for x in slices(iter([texts]), size=1 << 20))]))

    return score.asNondeterministic()(text)  # never evaluated twice


def held_out() -> Column:
    return F.coalesce(id_crc() % 3 == 1, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
