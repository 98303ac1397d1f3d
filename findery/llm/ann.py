"""Operator 2: nearest neighbours by an adaptive scan of dimensions within probed lists.

Index.  Vectors are scaled to length 1 and rotated by a random orthogonal matrix, so
that the first columns are a fair sample of a distance.  An inverted file deals them
to lists by the nearest of some centroids, which are fitted to a bounded sample.
How many lists a query probes is chosen on that sample, for the target recall.

Search.  A cell of a list holds its rotated vectors as blocks of columns, and is scanned
for a block of queries at once.  Distances grow block by block.  After each block the
nearest candidates so far, measured in full, tighten each query's bound, and
a hypothesis test abandons a candidate whose partial distance, scaled up,
exceeds the bound by more than chance allows.  Every query's nearest list is scanned
first; what it finds there bounds the search of its other lists from the start.  Survivors are
scored on the original vectors, in double precision.

Equal vectors are one candidate with its ``k + 1`` least ids, so thousands of copies
cost no more than one; equal queries are searched once.  Lists are cut into cells of
about ``cell`` vectors and the queries of a list into blocks: no task grows with a
list.

Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor
do rows without an id, nor those of another dimension than most have (ties: the
smaller).  A row that repeats an id and a vector counts once; an id with several
vectors is searched with each, and found by its best one.  Of candidates with equal
scores the smaller ids are returned.  Other columns play no part; an empty table, or one without
a usable vector, gives an empty result.  Any dimension will do: a vector is read as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.llm.common import Scratch, sample_fraction, table

SALTS = 16


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with that of y, on original values in double precision."""
    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Index:
    centroids: np.ndarray
    probes: int
    rotate: np.ndarray


def fit(sample: np.ndarray, rows: int, k: int, recall: float, lists: int | None = None, seed: int = 5) -> Index:
    """Centroids from a sample of vectors, and the number of probes whose recall among the sample is enough."""
    x = unit(sample)
    rng = np.random.default_rng(seed)
    lists = min(len(x), lists or int(np.clip(np.sqrt(rows) / 2, 1, 4096)))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=lists) > 0
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(filled[:, None] & (norm > 1e-12), sums / np.maximum(norm, 1e-12), centroids)
    near = (x @ centroids.T).argmax(axis=1)
    asked = rng.choice(len(x), min(len(x), 300), replace=False)
    likeness = x[asked] @ x.T
    likeness[np.arange(len(asked)), asked] = -2
    best = np.argsort(-likeness, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)  # rank of each list for each query
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if needed.size else lists
    return Index(centroids, probes, rotation(x.shape[1], seed))


def _full(columns: list[np.ndarray], turned: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of pairs (query, vector)."""
    out, at = np.zeros(len(q)), 0
    for x in columns:
        d = x[:, v] - turned[q, at : at + len(x)].T
        out += np.einsum("ij,ij->j", d, d)
        at += len(x)
    return out


def scan(columns: list[np.ndarray], turned: np.ndarray, bounds: np.ndarray, k: int, doubt: float = 2.1) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, vector) that may be among each query's k nearest, and how many pairs were left after the first block.

    ``columns``: blocks of columns of the cell's rotated unit vectors, (columns in the block) x vectors; ``turned``: the
    rotated queries; ``bounds``: squared distances that a query's k nearest are known not to exceed (infinite if unknown).
    """
    n, dim, bounds = columns[0].shape[1], turned.shape[1], bounds.copy()
    first = columns[0]
    end = len(first)
    # the first block for all pairs, as one product
    near = (turned[:, :end] ** 2).sum(axis=1)[:, None] + (first**2).sum(axis=0) - 2 * (turned[:, :end] @ first)
    if n > k:
        lead = np.argpartition(near, k - 1, axis=1)[:, :k]
    else:
        lead = np.broadcast_to(np.arange(n), (len(turned), n))
    if lead.shape[1] == k:
        whole = _full(columns, turned, np.repeat(np.arange(len(turned)), k), lead.ravel()).reshape(-1, k)
        bounds = np.minimum(bounds, whole.max(axis=1))

    def limit(end: int) -> np.ndarray:
        # H0: the full distance is within the bound; rejected where the scaled partial one is too far off
        return bounds * (end / dim) * (1 + doubt / np.sqrt(end)) ** 2 if end < dim else bounds + 1e-9

    q, v = np.nonzero(near <= limit(end)[:, None] + 1e-12)
    partial, begun = near[q, v], len(q)
    for x in columns[1:]:
        d = x[:, v] - turned[q, end : end + len(x)].T
        partial = partial + np.einsum("ij,ij->j", d, d)
        end += len(x)
        if end < dim and len(q) > 4 * k * len(turned):  # many are left: measure the leaders in full
            order = np.lexsort((partial, q))
            starts = np.searchsorted(q[order], np.arange(len(turned)))
            place = np.arange(len(q)) - starts[q[order]]
            lead = order[place < k]
            whole = _full(columns, turned, q[lead], v[lead])
            worst = np.zeros(len(turned))
            np.maximum.at(worst, q[lead], whole)
            bounds = np.where(np.bincount(q[lead], minlength=len(turned)) == k, np.minimum(bounds, worst), bounds)
        keep = partial <= limit(end)[q]
        q, v, partial = q[keep], v[keep], partial[keep]
    return q, v, begun


def in_columns(rotated: np.ndarray, block: int = 16) -> list[np.ndarray]:
    return [np.ascontiguousarray(rotated[:, i : i + block].T) for i in range(0, rotated.shape[1], block)]


def _search_cell(rotate: np.ndarray, k: int, pairs: int = 1 << 20):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        qids, found, scores = [], [], []
        if len(vectors) and len(queries):
            x = np.stack([np.frombuffer(v, dtype=np.float64) for v in vectors["vec"]])
            asked = np.stack([np.frombuffer(v, dtype=np.float64) for v in queries["vec"]])
            columns, ids, known = in_columns(unit(x) @ rotate), vectors["ids"].tolist(), queries["bound"].to_numpy(dtype=np.float64)
            names = queries["qid"].tolist()
            step = max(1, pairs // len(x))
            for at in range(0, len(asked), step):
                part = asked[at : at + step]
                q, v, _ = scan(columns, unit(part) @ rotate, known[at : at + step], k)
                score = cosine(x[v], part[q]) if len(q) else np.zeros(0)
                order = np.lexsort((-score, q))
                edges = np.searchsorted(q[order], np.arange(len(part) + 1))
                for r in range(len(part)):
                    top = order[edges[r] : edges[r + 1]]
                    if not len(top):
                        continue
                    top = top[score[top] >= score[top[min(k, len(top)) - 1]]]
                    best = sorted((-score[j], int(i)) for j in top for i in ids[v[j]])[:k]
                    qids += [int(names[at + r])] * len(best)
                    found += [i for _, i in best]
                    scores += [-s for s, _ in best]
        return pd.DataFrame({"qid": np.array(qids, dtype=np.int64), "vec_id": np.array(found, dtype=np.int64), "score": np.array(scores, dtype=np.float64)})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            vectors = batch.column("vec")
            yield batch, np.asarray(vectors.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def search(
    vectors: DataFrame, is_query, k: int = 5, recall: float = 0.97, sample_rows: int = 10_000, cell: int = 4096, query_block: int = 1024, scratch: Scratch | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; ``is_query`` is a condition on ``vec_id``.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    usable = scratch.keep(usable.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(whole, F.lit(False))), "usable")
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return nothing
    usable = usable.filter(F.size("vec") == dims["d"])
    # equal vectors: one candidate with its least ids (as many as could be returned, and the query itself)
    order = W.partitionBy("vec").orderBy("vec_id")
    few = usable.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= k + 1)
    classes = few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    drawn = sample_fraction(usable, "vec", dims["count"], sample_rows).select("vec").distinct().limit(2 * sample_rows).collect()
    sample = np.array([r["vec"] for r in drawn or usable.select("vec").limit(sample_rows).collect()])
    index = fit(np.unique(sample, axis=0), dims["count"], k, recall)
    shared = spark.sparkContext.broadcast(index)  # bounded: 4096 lists

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _packed(batches):
            near = (unit(x) @ shared.value.centroids.T).argmax(axis=1).astype(np.int32)
            packed = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near), batch.column("ids"), packed], ["list", "ids", "vec"])

    listed = scratch.keep(classes.mapInArrow(assign, "list int, ids array<long>, vec binary"), "listed")
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for row in listed.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    cells = np.maximum(1, -(-sizes // cell))
    queries = usable.filter(is_query).select("vec_id", "vec")
    distinct = queries.groupBy("vec").agg(F.min("vec_id").alias("qid"))
    laid = spark.sparkContext.broadcast((sizes, cells))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, cells = laid.value
        for batch, x in _packed(batches):
            order = np.argsort(-(unit(x) @ shared.value.centroids.T), axis=1, kind="stable")
            # at least the chosen number of lists, and enough of them to hold 4 k vectors
            enough = (np.cumsum(sizes[order], axis=1) < 4 * k).sum(axis=1) + 1
            rows, lists, subs, nths = [], [], [], []
            for r, n in enumerate(np.maximum(enough, shared.value.probes)):
                for nth, c in enumerate(order[r, :n]):
                    for s in range(cells[c]):
                        rows.append(r)
                        lists.append(c)
                        subs.append(s)
                        nths.append(nth)
            take = pa.array(rows, pa.int64())
            packed = pa.array([v.tobytes() for v in x], pa.binary()).take(take)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(subs, pa.int32()), pa.array(nths, pa.int32()), batch.column("qid").take(take), packed], ["list", "sub", "nth", "qid", "vec"])

    probed = scratch.keep(distinct.mapInArrow(probe, "list int, sub int, nth int, qid long, vec binary"), "probed")
    asked = np.zeros(len(sizes), dtype=np.int64)
    for row in probed.filter("sub = 0").groupBy("list").count().collect():
        asked[row["list"]] = row["count"]
    blocks = np.maximum(1, -(-asked // query_block))
    plan = spark.createDataFrame([(i, int(c), int(b)) for i, (c, b) in enumerate(zip(cells, blocks))], "list int, cells int, blocks int")
    bounded = F.broadcast(plan)  # a row for each list
    left = listed.join(bounded, "list").select("list", F.pmod(F.xxhash64("vec"), "cells").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "ids", "vec")
    right = probed.join(bounded, "list").select("list", "sub", F.pmod(F.xxhash64("qid"), "blocks").cast("int").alias("part"), "nth", "qid", "vec")
    keys = ["list", "sub", "part"]
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame) -> DataFrame:
        return left.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search_cell(index.rotate, k + 1), "qid long, vec_id long, score double")

    # each query's nearest list, then the others within the bound that it gave: the distance of the (k + 1)th found
    first = scratch.keep(searched(right.filter("nth = 0").withColumn("bound", F.lit(float("inf")))), "first")
    known = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k + 1).select("qid", (2 - 2 * F.col("score") + 1e-9).alias("bound"))
    others = right.filter("nth > 0").join(known, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    near = first.unionByName(searched(others))
    near = near.groupBy("qid", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    near = scratch.keep(near.select("qid", "vec_id", "score"), "near")
    # back to every query with that vector; salted, as one vector may be that of a third of them
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")
    of = queries.select("vec_id", "vec", salt).join(distinct.select("vec", "qid", salts), ["vec", "salt"]).select(F.col("vec_id").alias("query_id"), "qid", "salt").distinct()
    pairs = of.join(near.select("*", salts), ["qid", "salt"]).filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
