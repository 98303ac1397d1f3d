"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` (or
any other caller) writes as Parquet and reads again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``, whatever further ones there are and
whatever their names.  Every row is judged for itself: ids may be NULL or repeat, texts
may be NULL, empty or very long, and no documents give no rows.  Since a stage's result has
been written before the next begins, each stage first deletes the tables and
broadcasts that the stage before it had left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import langid, mixing, nearjoin, packing, toxicity
from findery.llm.common import Scratch, bounded_batches, forget_shared, shared_so_far, sieve, table
from findery.llm.tokens import default_tokenizer

LEAST_LANGUAGE_SCORE = 0.5
#: Words that an encoder remembers: few, as executors have grown by the time the last stage begins.
CACHED_WORDS = 60_000
#: A text's n-grams are at least so likely, as a geometric mean, as is usual for training texts of the language.
LEAST_LIKELIHOOD = 1 / 16

_left: list[tuple[Scratch, int]] = []  # of the stage before: its tables, and how many broadcasts there were before it


def _scratch(spark: SparkSession) -> Scratch:
    bounded_batches(spark)
    while _left:
        old, broadcasts = _left.pop()
        if old.spark is spark:
            old.release()
            forget_shared(broadcasts)
    _left.append((Scratch(spark), shared_so_far()))
    return _left[-1][0]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on: those without a letter, in no learned language or with an undecided posterior go.

    If no row has a language and a text with a letter, there is nothing to judge by, and all go on.
    """
    _scratch(spark)
    train = langid.train_rows(docs)
    model = langid.fit(train)
    if not model.langs:
        return docs
    name = _unused(docs, "_language")
    lang, score, evidence = (F.col(f"{name}.{x}") for x in ("lang_pred", "score", "evidence"))
    least = [F.when(lang == k, F.lit(v + math.log(LEAST_LIKELIHOOD))) for k, v in langid.usual(train, model).items()]
    found = docs.withColumn(name, langid.identify(spark, model, F.col("text")))
    told = (lang != langid.UNKNOWN) & (score >= LEAST_LANGUAGE_SCORE)
    return found.filter(told & (evidence >= F.coalesce(*least, F.lit(0.0)))).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; without labels of both kinds none is."""
    _scratch(spark)
    model, name = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out())), _unused(docs, "_toxicity")
    scored = docs.withColumn(name, toxicity.toxicity(spark, model, F.col("text")))
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least id stays, one without an id only if no other has one.

    Rows are written with a key of their own first, so that those with a NULL or repeated id are judged by their own texts.
    Rows without a word are no copies of each other and stay.
    """
    scratch, row = _scratch(spark), _unused(docs, "_row")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = nearjoin.near_classes(rows.select(F.col(row).alias("doc_id"), "text"), scratch=scratch).filter("n_links > 0")
    linked = classes.select(F.col("doc_id").alias(row), "class_id").join(rows.select(row, "doc_id"), row)
    linked = scratch.keep(linked, "linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")).select(F.col("first")[row].alias(row))
    others = scratch.keep(linked.select(row).join(first, row, "left_anti"), "others")
    mark = _unused(rows, "_other")
    marked = sieve(rows, others, row, mark)  # the texts of rows that stay are not shuffled, but for a few
    return marked.filter(~F.col(mark)).unionByName(marked.filter(mark).join(others, row, "left_anti")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule: at the target weights of the sources that still have documents."""
    return mixing.mixture(docs, scratch=_scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, default_tokenizer(), cached_words=CACHED_WORDS, scratch=_scratch(spark))


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Learned models and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = Scratch(spark)
    for name, stage in STAGES:
        last, docs = docs, out.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if name != STAGES[0][0]:
            out.drop(last)
    _scratch(spark)
    return docs
