"""The frontier and the documents' states: each change gives a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.config import CACHED, ERROR, PENDING, QUEUED, READY, SKIPPED


def offer(documents: DataFrame, offered: DataFrame) -> DataFrame:
    """Documents (url, depth, status) with the offered ones (url, depth, nth) whose url is new; the first offer's depth stays."""
    first = offered.groupBy("url").agg(F.min_by("depth", "nth").alias("depth"))
    new = first.join(documents.select("url"), "url", "left_anti")
    return documents.select("url", "depth", "status").unionByName(new.select("url", "depth", F.lit(PENDING).alias("status")))


def insert_links(links: DataFrame, source: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with those from each source (src, url) to the documents with these urls; a set, loops included."""
    found = source.join(documents.select("url", F.col("doc_id").alias("dst")), "url").select("src", "dst")
    return links.unionByName(found).distinct()


def count(documents: DataFrame, depth: int) -> DataFrame:
    return documents.filter((F.col("status") == PENDING) & (F.col("depth") == depth)).agg(F.count("*").alias("n"))


def poll(documents: DataFrame, most: int, depth: int) -> DataFrame:
    """The next pending documents by depth, then id."""
    return documents.filter((F.col("status") == PENDING) & (F.col("depth") <= depth)).orderBy("depth", "doc_id").limit(most)


def set_status(documents: DataFrame, delta: DataFrame) -> DataFrame:
    """New states (doc_id, status) over old ones."""
    new = delta.select("doc_id", F.col("status").alias("_new"))
    return documents.join(new, "doc_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def poll_and_queue(documents: DataFrame, most: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The polled documents, and all documents with those queued."""
    taken = poll(documents, most, depth)
    return taken, set_status(documents, taken.select("doc_id", F.lit(QUEUED).alias("status")))


def reset(documents: DataFrame) -> DataFrame:
    """What a restart does: queued and failed documents are pending again."""
    return documents.withColumn("status", F.when(F.col("status").isin(QUEUED, ERROR), F.lit(PENDING)).otherwise(F.col("status")))


def after_download(code):
    """The state of a queued document by the response's code (NULL: it could not be fetched; 0: wrong type)."""
    return F.when(code.isNull(), F.lit(ERROR)).when(code.isin(0, 401, 403, 404), F.lit(SKIPPED)).when(code.between(200, 299), F.lit(CACHED)).otherwise(F.lit(QUEUED))


def after_index(indexed):
    """The state of a cached document: ready, skipped if false, failed if NULL."""
    return F.when(indexed, F.lit(READY)).when(~indexed, F.lit(SKIPPED)).otherwise(F.lit(ERROR))


def cached(documents: DataFrame, depth: int) -> DataFrame:
    return documents.filter((F.col("status") == CACHED) & (F.col("depth") <= depth)).orderBy("depth", "doc_id")


def counts(documents: DataFrame) -> DataFrame:
    """(status, n)."""
    return documents.groupBy("status").agg(F.count("*").alias("n"))
