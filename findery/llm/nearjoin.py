"""Operator 6: n-gram Jaccard self-join by MinHash banding.

Documents are sets of word n-grams (five words: runs of letters and digits of the
lower-cased text; a shorter text is one n-gram).  Two documents are linked if the
Jaccard similarity of their sets is at least the threshold.  A document's class is
its connected component; ``class_id`` is the least ``doc_id`` in it and ``n_links``
the number of other documents it is linked to, copies included.

1. Texts with the same words in the same order are one node (a 128-bit key), so
   copies cost no more than a count.
2. Bands and rows are chosen for the target recall at the threshold.  Band hashes
   are shuffled; only buckets with two nodes or more matter, and of buckets with
   the same members one.  A sieve keeps nodes that are in none of these, and the texts of
   documents that are not needed, out of the joins.
3. A bucket's texts are compared within one task, on their full n-gram sets, by
   products of membership matrices.  A bucket with more than ``tile`` texts, or more than
   ``tile_words`` words, is dealt in
   tiles, and each pair of tiles is a group of its own, so that no task's memory
   grows with a bucket, nor with the texts in it but for a single one.  A pair that shares several buckets is counted in the
   first only.  No pairs leave the task: just each node's number of links, and a
   forest of edges that connects what is linked.  So no cap is set on partners.
4. Components of these edges.

Nulls and oddities: texts that are NULL or have no words have no n-grams and are
linked to nothing; each is a class of its own.  Rows with a NULL id are not
returned and link nothing.  Rows that repeat an id are rows of their own, with the same class
if their texts are linked.  A similarity equal to the threshold is a link.  An empty table gives an
empty result.  Columns besides ``doc_id`` and ``text`` play no part.  A text of any
length is compared whole; a task holds the word hashes (8 bytes each) of two tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import codepoints as cp
from findery.llm.common import Scratch, bounded_batches, sieve, slices, table
from findery.llm.components import components


SALTS = 32


def choose_bands(threshold: float, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, whose bands reach the recall within so many hashes."""
    for rows in range(most_hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    return most_hashes, 1


def node_key(hashes: np.ndarray) -> bytes | None:
    """The same for texts with the same words in order; None without words."""
    return hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Band hashes, signed 64-bit; bands never share a hash but by chance."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 512):
            t = self.a * x[None, i : i + 512]
            t += self.b
            np.minimum(low, t.min(axis=1), out=low)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in low.reshape(self.bands, self.rows).T.astype(np.uint64):
            h = cp.mix(h * cp.MULT + column)
        return h.view(np.int64)


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, n_words, bands): no band hashes where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in slices(batches):
            nodes, sizes, found = [], [], []
            for text in batch.column(1).to_pylist():
                h = cp.Words(text).hashes if text else ()
                nodes.append(node_key(h) if len(h) else None)
                sizes.append(len(h))
                found.append(signer(cp.shingles(h, width)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "n_words", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node binary, n_words long, bands array<long>")


def linked(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Boolean matrix: are set i (of the first ``split``) and set j (of the others, or of the first if there are none) similar enough?

    Only members of two sets or more can be shared, so the others just count for the sizes.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.flatnonzero(np.bincount(column) > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    row, column = np.repeat(np.arange(len(sets)), sizes), place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, split), slice(split, None)) if split < len(sets) else (slice(None), slice(None))
    n = len(sets)
    shared = np.zeros((len(sizes[left]), len(sizes[right])), dtype=np.float32)
    step = max(64, (16 << 20) // (4 * n))
    for at in range(0, len(common), step):  # in blocks of n-grams: memory stays the same for long texts
        a, b = np.searchsorted(column, [at, at + step])
        member = np.zeros((n, min(step, len(common) - at)), dtype=np.float32)
        member[row[a:b], column[a:b] - at] = 1
        shared += member[left] @ member[right].T
    total = sizes[left][:, None] + sizes[right][None, :] - shared
    return shared >= threshold * total - 1e-6  # sizes are whole numbers


def forest(matrix: np.ndarray, split: int) -> list[tuple[int, int]]:
    """Edges that connect what the matrix links (as rows and columns of one numbering)."""
    one = split < 0
    n = matrix.shape[0] if one else matrix.shape[0] + matrix.shape[1]
    todo, edges = np.ones(n, dtype=bool), []
    for start in range(n):
        if not todo[start]:
            continue
        todo[start], wave = False, [start]
        while wave:
            i = wave.pop()
            if one:
                near = np.flatnonzero(matrix[i] & todo)
            elif i < split:
                near = split + np.flatnonzero(matrix[i] & todo[split:])
            else:
                near = np.flatnonzero(matrix[:, i - split] & todo[:split])
            todo[near] = False
            edges += [(i, int(j)) for j in near]
            wave += near.tolist()
    return edges


def _compare(threshold: float, width: int):
    """One pair of tiles (or one tile) of a bucket: each node's links, weighed by copies, and a forest."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = key
        pdf = pdf.sort_values(["side", "node"]).reset_index(drop=True)
        split = int((pdf["side"] == 0).sum())
        if i != j and split in (0, len(pdf)):
            return pd.DataFrame(columns=["u", "v", "links"])
        sets = [np.unique(cp.shingles(np.frombuffer(x, dtype=np.uint64), width)) for x in pdf["words"]]
        match = linked(sets, split, threshold)
        one = i == j
        if one:
            np.fill_diagonal(match, False)
        # a pair belongs to the first of the buckets that both are in
        held = [np.sort(x[x < bucket]) for x in (np.asarray(x, dtype=np.int64) for x in pdf["buckets"])]
        firsts, seconds = held[:split], held if one else held[split:]
        names, code = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_inverse=True)
        if len(names):
            def members(parts: list[np.ndarray]) -> np.ndarray:
                out = np.zeros((len(parts), len(names)), dtype=np.float32)
                for k, part in enumerate(parts):
                    out[k, np.searchsorted(names, part)] = 1
                return out

            match &= (members(firsts) @ members(seconds).T) == 0
        copies = pdf["copies"].to_numpy(dtype=np.int64)
        if one:
            links = match @ copies
            edges = forest(match, -1)
        else:
            links = np.concatenate([match @ copies[split:], match.T @ copies[:split]])
            edges = forest(match, split)
        nodes = pdf["node"].tolist()
        rows = [(nodes[k], None, int(n)) for k, n in enumerate(links) if n] + [(nodes[a], nodes[b], 0) for a, b in edges]
        return pd.DataFrame(rows, columns=["u", "v", "links"])

    return run


def words_of(docs: DataFrame) -> DataFrame:
    """(node, words): word hashes of texts, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [cp.Words(x).hashes for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_key(h) for h in hashes], pa.binary()), pa.array([h.tobytes() for h in hashes], pa.binary())], ["node", "words"])

    return docs.select("text").mapInArrow(run, "node binary, words binary")


def near_classes(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, most_hashes: int = 128, tile: int = 256, tile_words: int = 1 << 19, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of ``docs`` with an id."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.filter(F.col("doc_id").isNotNull())
    bands, rows = choose_bands(threshold, recall, most_hashes)
    signed = scratch.keep(sign(docs, width, bands, rows), "signed")
    nodes = (
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    )
    nodes = scratch.keep(nodes, "nodes")
    in_bucket = nodes.select("node", "n_words", F.explode(F.array_distinct("bands")).alias("bucket"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"x{k}") for k in (1, 2)]
    buckets = in_bucket.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), *same).filter("n > 1")
    # buckets with the same members find the same links: the least stands for all
    buckets = scratch.keep(buckets.groupBy("n", "words", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "words"), "buckets")
    shared = sieve(in_bucket.drop("n_words"), buckets, "bucket", "shared").filter("shared").drop("shared")
    members = scratch.keep(shared.join(buckets, "bucket"), "members")
    scratch.drop(buckets)
    of_node = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # at most one for each band
    found = scratch.keep(nodes.select("node", "copies", "first_id").join(of_node, "node"), "found")
    # one row of the documents for each such node; its text once more
    ids = found.select(F.col("first_id").alias("doc_id")).distinct()
    texts = sieve(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id", "wanted").filter("wanted").drop("wanted").join(ids, "doc_id", "left_semi")
    texts = words_of(texts.filter(F.col("text").isNotNull())).dropDuplicates(["node"])
    full = found.select("node", "copies", "buckets").join(texts, "node")
    tiles = F.greatest(F.ceil(F.col("n") / F.lit(tile)), F.ceil(F.col("words") / F.lit(tile_words))).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    pairs = members.withColumn("t", tiles).withColumn("k", own).select(
        "node", "bucket", F.explode(F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda x: F.struct(F.least(x, "k").alias("i"), F.greatest(x, "k").alias("j"), (F.col("k") > x).cast("int").alias("side")))).alias("p")
    )
    work = pairs.select("node", "bucket", "p.*").join(full, "node")
    out = scratch.keep(work.groupBy("bucket", "i", "j").applyInPandas(_compare(threshold, width), "u binary, v binary, links long"), "links")
    scratch.drop(members, found)
    links = out.filter(F.col("v").isNull()).groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(out.filter(F.col("v").isNotNull()).select("u", "v"), scratch)
    classes = (
        nodes.select("node", "copies", "first_id")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("node", "first_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    classes = scratch.keep(classes, "classes")
    scratch.drop(nodes, out)
    # a node without an edge is its own class; one class may hold very many nodes
    edged = classes.filter(F.col("root").isNotNull())
    least = edged.groupBy("root").agg(F.min("first_id").alias("class_id"))
    salted = least.select("root", "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    by_node = edged.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"]).select("node", "class_id", "n_links")
    by_node = by_node.unionByName(classes.filter(F.col("root").isNull()).select("node", F.col("first_id").alias("class_id"), "n_links"))
    wordless = F.col("node").isNull()
    alone = signed.filter(wordless).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return signed.filter(~wordless).join(by_node, "node").select("doc_id", "class_id", "n_links").unionByName(alone)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_classes(table(spark, sf_dir, "documents"))
