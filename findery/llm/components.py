"""Connected components of a graph given as a DataFrame of edges, by alternating star steps.

Each round replaces the edges by smaller stars around the least neighbour; the
number of edges never grows beyond a small multiple and the rounds are few
(logarithmic in practice).  Rounds go on until nothing changes, however many that
takes.  Every round is written to the shared folder, which cuts
the lineage; nothing but counts reaches the driver.  Joins on a star's root, which may have
very many edges, are sort-merge joins of which AQE splits what is uneven.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the least of the node and its neighbours."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge; ``edges`` has columns u and v.  The root is the least node.

    No edges give no rows; repeated edges and those from a node to itself change nothing.
    """
    now = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in itertools.count():
        large = _least(now).filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: each node's smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, now = now, scratch.keep(small.filter("u <> v").distinct(), "edges")
        scratch.drop(last)
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if was == mark:
            return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
