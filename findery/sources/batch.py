"""Query files in, ranked lists out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^\s*(\p{Nd}+)\s+(\S[\s\S]*?)\s*$"


def parse_queries(lines: DataFrame) -> DataFrame:
    """(query_id, query) from lines (``value``) of a number, white space and a query; other lines are dropped."""
    return lines.filter(F.col("value").rlike(LINE)).select(F.regexp_extract("value", LINE, 1).cast("int").alias("query_id"), F.regexp_extract("value", LINE, 2).alias("query"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return parse_queries(spark.read.text(path))


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines to warn about: neither blank nor a query."""
    return lines.filter((F.trim("value") != "") & ~F.col("value").rlike(LINE))


def format_results(results: DataFrame) -> DataFrame:
    """(line): query, rank from 1, url and score to three places, between tabs."""
    return results.select("query_id", "rank", F.format_string("%d\t%d\t%s\t%.3f", "query_id", "rank", "url", "score").alias("line"))


def write_results(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Sorted lines without a head; an existing output is an error unless it may be replaced."""
    ordered = format_results(results).repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank")
    ordered.select("line").write.mode("overwrite" if overwrite else "errorifexists").text(path)
