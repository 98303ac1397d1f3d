"""From documents to an index: relevance, near copies, content, postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.config import DEFAULTS, READY, SKIPPED, Settings
from findery.functions import hashing
from findery.functions import text as T
from findery.operators import dedup, index
from findery.session import snapshot

MOST_IDS = 1 << 20  # English documents whose ids are sent to all tasks, so that texts aren't shuffled


@dataclass
class Indexed:
    documents: DataFrame  # doc_id, status, content_id, length
    content: DataFrame  # content_id, sim_hash, data, ai_score
    postings: DataFrame  # term, doc_id, tf


def relevant(documents: DataFrame, vocabulary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents (doc_id, text, tokens) with tokens that are on topic and mostly words of ``vocabulary`` (column word).

    Words are counted in ``input``, the text with its title and description, if there is such a column.
    """
    counted = documents.select("doc_id", F.col("input" if "input" in documents.columns else "text").alias("text"))
    english = T.words_share(counted, vocabulary).filter((F.col("share") >= settings.english_share) & (F.col("n_words") > 0)).select("doc_id")
    on_topic = lambda t: (F.size(t) > 0) & T.on_topic(t, settings.any_topic, settings.all_topics)
    topical = documents.filter(F.exists(F.array("tokens"), on_topic))  # so that tokens are made once for the whole condition
    english = snapshot(english, "english")
    return topical.join(F.broadcast(english) if english.count() <= MOST_IDS else english, "doc_id", "left_semi")


def index_documents(documents: DataFrame, vocabulary: DataFrame, settings: Settings = DEFAULTS) -> Indexed:
    """All stages for documents (doc_id, text, tokens); those that are not relevant do not appear.

    Near copies of an earlier document get its content, no postings, and are skipped.  Content with
    the same digest is stored once.  With no documents all three tables are empty.
    """
    chosen = snapshot(relevant(documents, vocabulary, settings).select("doc_id", "text", "tokens", hashing.simhash(F.col("tokens")).alias("sim_hash")), "relevant")
    sets, members = dedup.classes(chosen, chosen)
    verdict = snapshot(dedup.verdicts(members, snapshot(dedup.jaccard_pairs(sets, settings.jaccard_below, settings.hamming_below), "pairs")), "verdicts")
    kept = chosen.join(verdict.filter("kept").select("doc_id"), "doc_id", "left_semi")
    stored = kept.select("doc_id", T.content_id(F.coalesce("text", F.lit(""))).alias("content_id"), "sim_hash", "text")
    first = stored.groupBy("content_id").agg(F.min_by(F.struct("sim_hash", "text"), "doc_id").alias("x"))
    content = first.select("content_id", "x.sim_hash", F.col("x.text").alias("data"), F.lit(None).cast("double").alias("ai_score"))
    ids = stored.select(F.col("doc_id").alias("content_of"), "content_id")
    status = F.when(F.col("kept"), F.lit(READY)).otherwise(F.lit(SKIPPED))
    lengths = chosen.select("doc_id", F.size("tokens").alias("length"))
    done = verdict.join(ids, "content_of").join(lengths, "doc_id").select("doc_id", status.alias("status"), "content_id", "length")
    return Indexed(done, content, index.postings(kept))


def with_content(documents: DataFrame, content: DataFrame) -> DataFrame:
    """Documents that have content, with it: what results and scores are taken from."""
    return documents.join(content, "content_id")


def results(documents: DataFrame, content: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, url, title, description, length, depth, rank, ai_score) of the documents in ``ids`` (doc_id); none for no ids."""
    wanted = documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    names = ("doc_id", "url", "title", "description", "length", "depth", "rank", "ai_score")
    return with_content(wanted, content.select("content_id", "ai_score")).select(*names)
