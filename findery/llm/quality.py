"""Operator 4: quality rules with verdicts on whole hosts (DataFrame functions only).

Words are runs of characters other than ASCII white space.  Each document's counts
come from its own text, without a shuffle.  Then failures of the rules are summed
up by host (``source``), each host's failure rate is shrunk towards all hosts' by a
beta prior fitted to the hosts' rates (method of moments), and the hosts' verdicts
are joined back to the documents.

Rules.  The base: too few words, too many words in repeated windows of five.  The
soft ones: too many symbols, too many of the lines repeated, words too short or too
long on average.  A document that fails the base goes.  What becomes of the others is for
their host to say, by its shrunk rate of documents that fail any rule:

- ``rejected``, above ``most_failing``: all its documents go;
- ``strict``, above the prior's mean by more than ``margin`` (as a share of the mean):
  documents that fail a soft rule go;
- ``trusted``: all stay.

A NULL or empty text has no words and fails the base.  Documents without a source share one
host.  Rows with NULL or repeated ids are rows like others, repeated rows are each
counted and returned; an empty table gives an empty result; other columns of the
input play no part, whatever their names.  Texts of any length are counted whole,
each within one row.  A rate equal to a bound is not above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm.common import Scratch, table

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WIDTH = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTHS = 0.1, 0.3, (2.0, 12.0)
MOST_FAILING, MARGIN = 0.5, 0.1
SALTS = 32


def split_words(text: Column) -> Column:
    """Words in order."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: within a lambda, an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def windows(words: Column) -> Column:
    """Hashes of the windows of five words, in order; ``words``: the words' hashes, bound by ``let``."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - WIDTH + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, WIDTH)))
    )


def _repeated(numbered: Column) -> Column:
    """Places of the windows that occur twice or more, from (hash, place) in order of hash."""
    last = F.size(numbered) - 1
    twice = F.transform(
        numbered,
        lambda s, k: F.when(((k > 0) & (F.get(numbered, k - 1)["x"] == s["x"])) | ((k < last) & (F.get(numbered, k + 1)["x"] == s["x"])), s["i"]),
    )
    return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))


def _covered(at: Column) -> Column:
    """How many words the windows at these places cover: each adds those up to the next, at most its own."""
    step = F.transform(at, lambda i, k: F.least(F.lit(WIDTH), F.coalesce(F.get(at, k + 1) - i, F.lit(WIDTH))))
    return F.aggregate(step, F.lit(0), lambda a, b: a + b)


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more; ``words``: the words' hashes."""

    def count(keys: Column) -> Column:
        numbered = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(let(numbered, _repeated), _covered))

    return let(let(words, windows), count)


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + BLANKS, "") != "")
    words = F.transform(split_words(text), lambda w: F.xxhash64(w))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.length(F.translate(text, " " + BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        let(words, lambda x: F.struct(F.size(x).cast("long").alias("n"), repeated_words(x).cast("long").alias("r"))).alias("w"),
    )
    return found.select(
        "doc_id", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words")
    )


def rules(counts: DataFrame) -> DataFrame:
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    soft = (
        (F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
        | (mean < WORD_LENGTHS[0]) | (mean > WORD_LENGTHS[1])
    )
    return counts.withColumns({"base_failed": failed, "soft_failed": soft})


def host_verdicts(ruled: DataFrame, most_failing: float = MOST_FAILING, margin: float = MARGIN) -> DataFrame:
    """(source, host_rate, host_verdict): failure rates shrunk by the beta prior that fits all hosts."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = ruled.groupBy("source").agg(F.count("*").alias("n"), F.sum(failed).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    # strength alpha + beta = m (1 - m) / v - 1, between one document and a thousand
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), spread / F.col("v") - 1))).otherwise(F.lit(1000.0))
    shrunk = hosts.crossJoin(F.broadcast(prior.select("m", strength.alias("k"))))  # one row
    found = shrunk.select("source", "m", ((F.col("f") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("host_rate"))
    strict = F.col("host_rate") > F.col("m") * (1 + margin)
    return found.select("source", "host_rate", F.when(F.col("host_rate") > most_failing, "rejected").when(strict, "strict").otherwise("trusted").alias("host_verdict"))


def judge(docs: DataFrame, most_failing: float = MOST_FAILING, margin: float = MARGIN, scratch: Scratch | None = None) -> DataFrame:
    """The counts, ``base_failed``, ``soft_failed``, ``host_rate``, ``host_verdict`` and ``kept`` for every row.

    The counts are written once (a few numbers for each document) and read for both
    the hosts and the verdicts.  A host's verdict is repeated ``SALTS`` times so that
    a host with a third of the documents is joined by many tasks.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    ruled = scratch.keep(rules(document_counts(docs)), "counts")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hosts = host_verdicts(ruled, most_failing, margin).select(F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("none"), "host_rate", "host_verdict", salts)
    rows = ruled.withColumns(
        {"host": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "salt": F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")}
    )
    judged = rows.join(hosts, ["host", "none", "salt"])
    verdict = F.col("host_verdict")
    kept = ~F.col("base_failed") & ((verdict == "trusted") | ((verdict == "strict") & ~F.col("soft_failed")))
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed")
    return judged.select(*counts, "host_rate", "host_verdict", kept.alias("kept"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, source, text,
         list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws
  FROM d),
c AS (
  SELECT r, doc_id, source, ws, len(ws) AS n_words,
         list_aggregate(list_transform(ws, lambda x: length(x)), 'sum') AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS ls
  FROM w),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM c WHERE len(ws) >= 5)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE k > 1) GROUP BY r),
s AS (
  SELECT doc_id, source, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM c LEFT JOIN rep USING (r)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols > 0.1e0 * word_chars OR n_dup_lines > 0.3e0 * n_lines
         OR word_chars / greatest(n_words, 1)::DOUBLE < 2 OR word_chars / greatest(n_words, 1)::DOUBLE > 12 AS soft_failed
  FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n::DOUBLE) AS m, coalesce(var_samp(f / n::DOUBLE), 0) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1e0, least(1000e0, m * (1 - m) / v - 1)) ELSE 1000e0 END AS k FROM p),
x AS (SELECT source, m, (f + m * k) / (n + k) AS rate FROM h, q),
v AS (SELECT source, rate, CASE WHEN rate > 0.5e0 THEN 'rejected' WHEN rate > m * 1.1e0 THEN 'strict' ELSE 'trusted' END AS host_verdict FROM x)
SELECT b.doc_id, b.n_words::BIGINT AS n_words, b.word_chars::BIGINT AS word_chars, b.n_symbols::BIGINT AS n_symbols, b.n_lines::BIGINT AS n_lines,
       b.n_dup_lines::BIGINT AS n_dup_lines, b.n_repeat_words::BIGINT AS n_repeat_words, b.base_failed, b.soft_failed,
       round(v.rate, 6) AS host_rate, v.host_verdict,
       NOT b.base_failed AND (v.host_verdict = 'trusted' OR (v.host_verdict = 'strict' AND NOT b.soft_failed)) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
