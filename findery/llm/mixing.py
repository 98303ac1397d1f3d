"""Operator 7: mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order given by a hash of the row, form blocks of
``block_docs``.  With weight w (weights sum to 1) the k-th block of a source may run from slot
floor(k / w) and must run by slot ceil((k + 1) / w).  Each slot takes, among the
released blocks, the one with the earliest deadline (ties: the source that comes
first).  Then after t slots each source has had more than w t - 1 and fewer than
w t + 1 blocks.  All arithmetic is in whole numbers.

With whole-number weights that sum to T such a schedule has the period T: in every T
slots a source of weight w has w blocks, at the same places.  So one period is made
by earliest deadline first, and a block's slot follows from its number, whatever the
size of the corpus: blocks do not grow with it, and what is broadcast is one period.

A source that has no blocks left gives its slots up: the others move up and keep
their weights in proportion to each other, and the bound holds in slots that are
counted before they do.  So every document gets exactly one position.

Up to ``groups`` sources are scheduled against each other.  If there are more, they are
dealt to so many groups by a hash; groups are scheduled against each other, and on
the executors each group's sources share its slots, by the same rule.  Then a source
deviates by less than two blocks.  The driver holds a row for each group at most.

Weights are rounded to whole numbers that sum to about ``period`` (each 1 at least), unless they
are whole numbers whose sum, without a common factor, is no more than that.

Ranks within a source come from counts per (source, hash range), never from one task per
source, as a source may hold a third of all rows.  A NULL source is a source of its
own; a source without a weight, or with weight 0, runs after all others.  Rows with a NULL or repeated
id, and repeated rows, are rows like others.  Texts are only hashed; columns besides
``doc_id`` and ``source`` may have any names but those that begin with ``_mix_``.  An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.llm.common import Scratch, table

EXPONENT, PERIOD, GROUPS, RANGES, SALTS = 0.7, 16_384, 1024, 1024, 16


def whole(weights: Sequence[float], period: int = PERIOD) -> list[int]:
    """Whole-number weights in the same proportions: exact, or rounded to sum to about ``period``."""
    if len(weights) == 1:
        return [1]
    if all(float(w).is_integer() and w > 0 for w in weights):
        common = math.gcd(*map(int, weights))
        if sum(map(int, weights)) // common <= period:
            return [int(w) // common for w in weights]
    total = math.fsum(weights)
    return [max(1, round(w * period / total)) for w in weights]


def one_period(weights: Sequence[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period, by earliest deadline first among released blocks."""
    total = sum(weights)
    waiting = [(0, k, 0) for k in range(len(weights))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    slots: list[list[int]] = [[] for _ in weights]
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, k, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(n + 1) * total // weights[k]), k, n))
        _, k, n = heapq.heappop(ready)
        slots[k].append(t)
        heapq.heappush(waiting, ((n + 1) * total // weights[k], k, n + 1))
    return slots


def ranked(docs: DataFrame, ranges: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_mix_nth``, a row's number in its source (from 0), and (source, n), the sources' sizes."""
    shift = 64 - int(math.log2(ranges))
    names = [c for c, kind in docs.dtypes if "map<" not in kind]
    keyed = docs.withColumn("_mix_h", F.xxhash64("doc_id", F.xxhash64(*names)))
    keyed = keyed.withColumn("_mix_range", F.shiftright(F.col("_mix_h"), shift).cast("int"))
    counts = scratch.keep(keyed.groupBy("source", "_mix_range").agg(F.count("*").alias("n")), "counts")
    before = W.partitionBy("source").orderBy("_mix_range").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("source", "_mix_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_base"))
    within = W.partitionBy("source", "_mix_range").orderBy("_mix_h")
    numbered = keyed.withColumn("_mix_in", F.row_number().over(within) - 1)
    joined = numbered.alias("x").join(base.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x._mix_range") == F.col("y._mix_range")))
    return joined.select("x.*", (F.col("y._mix_base") + F.col("x._mix_in")).alias("_mix_nth")), counts.groupBy("source").agg(F.sum("n").alias("n"))


def _inner(period: int):
    """A group's sources: for each of a source's blocks in the group's period the place."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        weights = whole(pdf["weight"].tolist(), max(period, 4 * len(pdf)))
        slots = one_period(weights)
        many = [len(x) for x in slots]
        out = {"source": np.repeat(pdf["source"].to_numpy(dtype=object), many), "late": bool(key[0]), "grp": int(key[1])}
        out |= {"w": np.repeat(weights, many), "total": sum(weights), "within": np.concatenate([np.arange(n) for n in many]), "place": np.concatenate(slots)}
        return pd.DataFrame(out)

    return run


def _weighed(sizes: DataFrame, weights: Mapping[str | None, float] | None) -> DataFrame:
    """(source, late, weight) for every source."""
    if weights is None:
        found = sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(EXPONENT)).alias("weight"))
    else:
        given = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        found = sizes.alias("x").join(given.alias("y"), _same_source(), "left").select("x.source", F.coalesce("y.weight", F.lit(0.0)).alias("weight"))
    late = ~(F.col("weight") > 0)
    return found.select("source", late.alias("late"), F.when(late, F.lit(1.0)).otherwise(F.col("weight")).alias("weight"))


def _same_source() -> Column:
    return F.col("x.source").eqNullSafe(F.col("y.source"))


def _of_groups(rows: DataFrame, sizes: DataFrame, weights: Mapping[str | None, float] | None, period: int, groups: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_mix_late``, ``_mix_grp`` and ``_mix_nth_of_group``, the number of a row's block in its group; (late, grp, weight) of the groups."""
    spark = sizes.sparkSession
    weighed = scratch.keep(_weighed(sizes, weights), "weights")
    if weighed.count() <= groups:  # each source is a group of its own, in order of name
        found = sorted(weighed.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        weighed = spark.createDataFrame([(r["source"], r["late"], r["weight"], k) for k, r in enumerate(found)], "source string, late boolean, weight double, grp int")
        joined = rows.alias("x").join(F.broadcast(weighed).alias("y"), _same_source())  # ``groups`` rows at most
        return joined.select("x.*", F.col("y.late").alias("_mix_late"), F.col("y.grp").alias("_mix_grp"), F.col("x._mix_block").alias("_mix_nth_of_group")), weighed
    weighed = weighed.withColumn("grp", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int"))
    kind = "source string, late boolean, grp int, w long, total long, within long, place long"
    inner = scratch.keep(weighed.groupBy("late", "grp").applyInPandas(_inner(period), kind), "inner")
    salted = inner.filter("within = 0").select("source", "w", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.alias("x").join(salted.alias("y"), _same_source() & (F.expr(f"x._mix_block % {SALTS}") == F.col("y.salt"))).select("x.*", F.col("y.w").alias("_mix_w"))
    joined = joined.alias("x").join(inner.alias("y"), _same_source() & (F.expr("x._mix_block % x._mix_w") == F.col("y.within")))
    number = F.expr("(x._mix_block div y.w) * y.total + y.place")
    return joined.select("x.*", F.col("y.late").alias("_mix_late"), F.col("y.grp").alias("_mix_grp"), number.alias("_mix_nth_of_group")).drop("_mix_w"), weighed


def placed(docs: DataFrame, weights: Mapping[str | None, float] | None, block_docs: int, period: int, groups: int, ranges: int, scratch: Scratch) -> DataFrame:
    """``docs`` with the number in its source, block, slot, release and deadline of each row, and whether its source runs late, all named ``_mix_...``."""
    rows, sizes = ranked(docs, ranges, scratch)
    rows = rows.withColumn("_mix_block", F.expr(f"_mix_nth div {int(block_docs)}L"))
    rows, weighed = _of_groups(rows, sizes, weights, period, groups, scratch)
    totals = weighed.groupBy("late", "grp").agg(F.sum("weight").alias("weight")).collect()  # a row for each group
    outer = []
    for tier in (False, True):
        own = sorted((r["grp"], r["weight"]) for r in totals if r["late"] == tier)
        shares = whole([w for _, w in own], period) if own else []
        for (grp, _), share, slots in zip(own, shares, one_period(shares)):
            outer += [(tier, grp, share, sum(shares), k, slot) for k, slot in enumerate(slots)]
    kind = "late boolean, grp int, share long, slots long, nth long, place long"
    plan = docs.sparkSession.createDataFrame(outer, kind)
    one = F.broadcast(plan.filter("nth = 0").select(F.col("late").alias("_mix_late"), F.col("grp").alias("_mix_grp"), F.col("share").alias("_mix_share"), F.col("slots").alias("_mix_slots")))
    places = F.broadcast(plan.select(F.col("late").alias("_mix_late"), F.col("grp").alias("_mix_grp"), F.col("nth").alias("_mix_k"), F.col("place").alias("_mix_place")))  # a period and a row for each group at most
    rows = rows.join(one, ["_mix_late", "_mix_grp"]).withColumn("_mix_k", F.expr("_mix_nth_of_group % _mix_share")).join(places, ["_mix_late", "_mix_grp", "_mix_k"])
    return rows.withColumns(
        {
            "_mix_slot": F.expr("(_mix_nth_of_group div _mix_share) * _mix_slots + _mix_place"),
            "_mix_release": F.expr("_mix_nth_of_group * _mix_slots div _mix_share"),
            "_mix_deadline": F.expr("((_mix_nth_of_group + 1) * _mix_slots + _mix_share - 1) div _mix_share"),
        }
    )


ORDER = ("_mix_late", "_mix_slot", "_mix_nth_of_group", "_mix_nth")


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = 16, period: int = PERIOD, groups: int = GROUPS, ranges: int = RANGES, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, source, block, late, slot, release, deadline, position) for every row; position is dense from 0.

    ``weights``: by source; by default the sources' sizes tempered.  Slots, releases and deadlines are counted
    among the sources that are not ``late``, or among those that are, as if no source ran out.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = placed(docs, weights, block_docs, period, groups, ranges, scratch)
    names = ("doc_id", "source", "block", "late", "slot", "release", "deadline")
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *(F.col(f"_mix_{c}").alias(c) for c in names[2:]), F.col("_mix_nth_of_group").alias("nth_of_group"), F.col("_mix_nth").alias("nth"))
    order = ("late", "slot", "nth_of_group", "nth")
    kind = pa.schema([("part", pa.int32()), ("place", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            more = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(seen, seen + n))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *kind.names])
            seen += n

    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    numbered = scratch.keep(ordered.mapInArrow(number, "doc_id long, source string, block long, late boolean, slot long, release long, deadline long, part int, place long"), "numbered")
    sizes = sorted((r["part"], r["count"]) for r in numbered.groupBy("part").count().collect())  # a row for each task
    before = np.cumsum([0, *(n for _, n in sizes)])
    starts = docs.sparkSession.createDataFrame([(part, int(x)) for (part, _), x in zip(sizes, before)], "part int, start long")
    return numbered.join(F.broadcast(starts), "part").select(*names, (F.col("start") + F.col("place")).alias("position"))


def mixture(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = 16, period: int = PERIOD, groups: int = GROUPS, ranges: int = RANGES, scratch: Scratch | None = None
) -> DataFrame:
    """All rows of ``docs`` in the order of the schedule: partition by partition, and so file by file once written."""
    rows = placed(docs, weights, block_docs, period, groups, ranges, scratch or Scratch(docs.sparkSession))
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
