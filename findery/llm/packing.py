"""Operator 10: best-fit packing by linear grouping.

Lengths are whole numbers of at most ``capacity`` tokens, so the packing problem is
its histogram: at most ``capacity`` counts, whatever the corpus.  The plan is made
from the histogram alone:

1. Pieces of full length take a sequence each.
2. Large lengths are sorted and cut into groups of equal cardinality; each piece
   counts as long as the longest of its group.
3. The configurations of these few sizes are optimised by column generation
   (a simplex over configurations, priced by a knapsack), and rounded down.
4. Actual pieces take the places of their groups, longest first; the room that
   rounding up had wasted comes back.
5. What is left, large pieces first, goes where it fits best, then to new sequences.

The plan is a list of runs: "the pieces of length L with ranks a to b stand in
sequences s, s + 1, ... at offset o, k to a sequence".  Ranks are dealt without a
global sort: each task numbers its pieces of a length, and the counts per (task,
length) are summed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.llm.common import Scratch, bounded_batches, share, slices, table
from findery.llm.tokens import default_tokenizer, encoder, ids_crc32, read_spec

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, chunk int, ordinal long"


# ---------------------------------------------------------------- the plan


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the largest value that fits."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    least = int(sizes.min())
    for room in range(least, capacity + 1):
        fits = sizes <= room
        gain = np.where(fits, values + best[np.where(fits, room - sizes, 0)], -1.0)
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], pick[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room >= least:
        if best[room] == best[room - 1]:
            room -= 1
            continue
        counts[pick[room]] += 1
        room -= sizes[pick[room]]
    return best[capacity], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used (fractions), covering the demand with nearly the fewest sequences."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, column = _knapsack(np.ones(len(sizes)) @ inverse, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        use, change = inverse @ demand, inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, k].astype(np.int64), float(x)) for k, x in enumerate(use) if x > 0]


def plan(counts: np.ndarray, capacity: int, groups: int, least_large: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces in each}) for a histogram, ``counts[length]``."""
    left = counts.copy()
    made: list[tuple[int, dict[int, int]]] = []
    if left[capacity]:
        made.append((int(left[capacity]), {capacity: 1}))
        left[capacity] = 0
    open_: dict[int, dict[tuple, int]] = {}  # by room left: sequences by their contents

    def put(room: int, held: dict[int, int], n: int) -> None:
        key = tuple(sorted(held.items()))
        open_.setdefault(room, {}).setdefault(key, 0)
        open_[room][key] += n

    large = np.arange(least_large, capacity)
    total = int(left[large].sum())
    if total:
        k = max(1, min(groups, total // 8, int((left[large] > 0).sum())))
        lengths = large[::-1][left[large[::-1]] > 0]
        ends = np.cumsum(left[lengths])
        bounds = [total * i // k for i in range(k + 1)]
        queues, sizes, demand = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            run, first = [], int(np.searchsorted(ends, a, side="right"))
            at = a
            while at < b:
                n = min(b, int(ends[first])) - at
                run.append([int(lengths[first]), n])
                at, first = at + n, first + 1
            queues.append(run)
            sizes.append(run[0][0])
            demand.append(b - a)
        for column, use in configurations(np.array(sizes), np.array(demand), capacity):
            n = int(use + 1e-7)
            slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
            supply = {g: sum(x[1] for x in queues[g]) for g in set(slots)}
            n = min([n, *(supply[g] // int(column[g]) for g in supply)])
            if not n:
                continue
            takes = []  # for each slot, runs of lengths for the n sequences
            for g in slots:
                need, run = n, []
                while need:
                    length, have = queues[g][0]
                    m = min(need, have)
                    run.append((length, m))
                    left[length] -= m
                    need -= m
                    queues[g][0][1] -= m
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                takes.append(run)
            edges = sorted({0, n}.union(*(np.cumsum([m for _, m in run]).tolist() for run in takes)))
            places = [np.cumsum([m for _, m in run]) for run in takes]
            for a, b in zip(edges, edges[1:]):
                held: dict[int, int] = {}
                for run, place in zip(takes, places):
                    length = run[int(np.searchsorted(place, a, side="right"))][0]
                    held[length] = held.get(length, 0) + 1
                put(capacity - sum(x * y for x, y in held.items()), held, b - a)
    for length in range(capacity - 1, 0, -1):
        need = int(left[length])
        room = length
        while need:
            while room < capacity and not open_.get(room):
                room += 1
            if room == capacity:  # new sequences
                each = min(capacity // length, need)
                n = need // each
                put(capacity - each * length, {length: each}, n)
                need -= n * each
                room = length
                continue
            key, n = next(iter(open_[room].items()))
            each = min(room // length, need)
            m = min(n, need // each)
            if m == n:
                del open_[room][key]
            else:
                open_[room][key] -= m
            held = dict(key)
            held[length] = held.get(length, 0) + each
            put(room - each * length, held, m)
            need -= m * each
            room = max(length, min(room, room - each * length))
    made += [(n, dict(key)) for kinds in open_.values() for key, n in kinds.items()]
    return made


def best_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The best of a few numbers of groups and bounds between large and small, up to the first within a sequence or 0.05 % of the least possible."""
    least, best = -(-int(counts @ np.arange(capacity + 1)) // capacity), None
    for k, part in ((32, 2), (48, 3), (48, 4), (96, 8)):
        tried = plan(counts, capacity, k, max(1, capacity // part + 1))
        if best is None or sum(n for n, _ in tried) < sum(n for n, _ in best):
            best = tried
        if sum(n for n, _ in best) <= least + max(1, least // 2000):
            break
    return best


def runs(made: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length and rank, sorted: where each run of pieces begins."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for n, held in made:
        offset = 0
        for length, each in sorted(held.items(), reverse=True):
            rows.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    rows.sort()
    names = ("length", "rank", "sequence", "each", "offset")
    return {x: np.array(v, dtype=np.int64) for x, v in zip(names, zip(*rows))} if rows else {x: np.zeros(0, dtype=np.int64) for x in names}


# ---------------------------------------------------------------- the documents


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cached_words: int) -> DataFrame:
    """Every document's pieces; ``ordinal`` numbers a task's (``chunk``'s) pieces of one length."""
    spec = share(docs.sparkSession, read_spec(tokenizer))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk = encoder(spec.value, cached_words), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype=np.uint32)
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "chunk", "ordinal")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                ids = np.concatenate([ids, end])
                first = (len(ids) - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if k == 0 else at + capacity]
                    rows.append((doc_id, k, at, len(part), ids_crc32(part), chunk, int(seen[len(part)])))
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, cached_words: int = 260_000, scratch: Scratch | None = None) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Rows with a NULL or repeated ``doc_id``, and repeated rows, are documents of their own and keep the
    id they have; a NULL text is empty, a long one is cut into pieces and never shortened; no documents give no
    rows; columns besides ``doc_id`` and ``text`` play no part.  Pieces of equal length are interchangeable:
    which of them takes which place depends on how the input is split into tasks.  The pieces are
    written once to the shared folder, since their task-wise numbers must not
    change; the driver gets at most ``capacity`` counts, and the broadcast plan is
    bounded by the capacity, not by the corpus.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    cut = scratch.keep(pieces(docs, tokenizer, capacity, end_id, cached_words), "pieces")
    by_chunk = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    by_chunk = scratch.keep(by_chunk.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    laid = share(spark, runs(best_plan(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = laid.value
        key = x["length"] << 44 | x["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - x["rank"][k]
            sequence, offset = x["sequence"][k] + nth // x["each"][k], x["offset"][k] + nth % x["each"][k] * length
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            kept[3] = kept[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # a row for each task and length: it grows with the corpus, so it is never broadcast
    ranked = cut.join(by_chunk.drop("n").hint("merge"), ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("ordinal"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, kind)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
