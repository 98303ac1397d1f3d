"""The link graph: edges (src, dst), each once; loops stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.config import DEFAULTS
from findery.session import snapshot

LIST = 4096


def ready_links(links: DataFrame, ready: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``ready`` (column node)."""
    src, dst = ready.select(F.col("node").alias("src")), ready.select(F.col("node").alias("dst"))
    return links.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst")


def out_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.count("*").alias("n_out"))


def link_lists(edges: DataFrame) -> DataFrame:
    """(src, n_out, dsts): each source's targets in lists of about LIST at most, with its out-degree."""
    weighed = edges.join(out_degree(edges), "src")
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n_out") / LIST)).alias("part")
    return weighed.groupBy("src", "n_out", part).agg(F.collect_list("dst").alias("dsts")).select("src", "n_out", "dsts")


def pagerank_step(lists: DataFrame, ranks: DataFrame, nodes: DataFrame, n: int, damping: float) -> DataFrame:
    """(node, rank) after one round; ``lists`` are as from ``link_lists``, so a join row is a source, not an edge.

    Contributions are summed before the shuffle on their target.  Rank that flows
    into nodes without links is not handed out again.
    """
    handed = lists.join(ranks, lists["src"] == ranks["node"]).select(F.explode("dsts").alias("node"), (F.col("rank") / F.col("n_out")).alias("part"))
    given = handed.groupBy("node").agg(F.sum("part").alias("given"))
    rank = F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("given", F.lit(0.0))
    return nodes.join(given, "node", "left").select("node", rank.alias("rank"))


def pagerank(links: DataFrame, nodes: DataFrame, iterations: int = DEFAULTS.iterations, damping: float = DEFAULTS.damping, cut: int = 5) -> DataFrame:
    """Ranks after so many rounds from 1/N.  Each round reads the last one's ranks once; every ``cut`` rounds they are written.

    Nodes and edges are written before the rounds, which would make them anew each.
    """
    nodes = snapshot(nodes.select("node").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    lists = snapshot(link_lists(snapshot(ready_links(links, nodes), "edges")), "lists")
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    for i in range(1, iterations + 1):
        ranks = pagerank_step(lists, ranks, nodes, n, damping)
        if i % cut == 0 and i < iterations:
            ranks = snapshot(ranks, "ranks")
    return ranks
