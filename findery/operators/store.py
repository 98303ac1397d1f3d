"""Stored content, postings and embeddings: upserts as anti-joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.config import READY


def update(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``delta``'s non-NULL values over ``base``'s, row by row."""
    names = [c for c in delta.columns if c != key]
    new = delta.select(key, *(F.col(c).alias(f"_{c}") for c in names))
    return base.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in base.columns))


def replace_postings(postings: DataFrame, new: DataFrame) -> DataFrame:
    """A document's new postings take the place of all its old ones."""
    old = postings.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    return old.select("term", "doc_id", "tf").unionByName(new.select("term", "doc_id", "tf"))


def add_first(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not there yet (ON CONFLICT DO NOTHING)."""
    return base.unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti").select(*base.columns))


def missing_embeddings(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ready documents without a vector."""
    return documents.filter(F.col("status") == READY).join(embeddings.select("doc_id"), "doc_id", "left_anti")


def missing_scores(content: DataFrame) -> DataFrame:
    return content.filter(F.col("ai_score").isNull())


def present(results: DataFrame) -> DataFrame:
    """What a reader sees: titles and descriptions for those that have none, and a score of 0."""
    text = F.coalesce(F.nullif("description", F.lit("")), F.lit("No description provided"))
    shown = F.when(text == "[No description]", F.lit("No description provided")).otherwise(text)
    return results.withColumns({"title": F.coalesce("title", F.lit("[Untitled]")), "description": shown, "ai_score": F.coalesce("ai_score", F.lit(0.0))})
