"""The engine's tables, derived from the test tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.functions import text as T
from findery.operators import index
from findery.session import read

TOPIC_ANY, TOPIC_ALL = ("thing",), ("the", "and", "of")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.element_at(F.array(*map(F.lit, (0, 1, 2, 254, 255))), (F.floor(F.col("doc_id") / 5) % 5 + 1).cast("int"))
    status = F.when(F.col("doc_id") % 5 != 0, F.lit(3)).otherwise(other)
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", status.alias("status"), (F.col("doc_id") % 3).cast("int").alias("depth"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "status", T.tokens(F.col("text")).alias("tokens"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, term): the benchmark texts as queries."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.query_terms(items, T.tokens(F.col("text")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of parts: each order line's part to the next one's."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.filter("src is not null and dst is not null").distinct()


def nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's vector is the one whose id is the query's."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id")


def fill(sql: str, **values: object) -> str:
    """``sql`` with its named places filled; other braces stay."""
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", str(value))
    return sql


TOKENS_SQL = r"coalesce(regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]+)', 1), [])"
DOCS_SQL = r"""docs AS (
  SELECT doc_id, text, lang, source,
         CASE WHEN doc_id % 5 <> 0 THEN 3 ELSE ([0, 1, 2, 254, 255])[((doc_id // 5) % 5 + 1)::INT] END::INT AS status,
         (doc_id % 3)::INT AS depth
  FROM documents)"""
TOK_SQL = DOCS_SQL + ", tok AS (SELECT doc_id, status, " + TOKENS_SQL.format("text") + " AS tokens FROM docs)"
POST_SQL = TOK_SQL + r""", postings AS (
  SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY term, doc_id),
lens AS (SELECT doc_id, status, len(tokens)::INT AS length FROM tok),
meta AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM lens WHERE status = 3),
q AS (SELECT item_id AS query_id, unnest(list_distinct(""" + TOKENS_SQL.format("text") + r""")) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
found AS (
  SELECT q.query_id, p.doc_id, p.term, p.tf, df.df, meta.n_docs, meta.avg_length, lens.length
  FROM postings p JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id), meta WHERE lens.status = 3)"""
PRE_SQL = POST_SQL + r""", pre AS (
  SELECT * FROM (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, sum(tf * (n_docs // df))::BIGINT AS score FROM found GROUP BY query_id, doc_id))
  WHERE rank <= {pre})"""
BM25_SQL = PRE_SQL + r""", bm AS (
  SELECT * FROM (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (
      SELECT query_id, doc_id,
             round(sum(ln((n_docs - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / avg_length))), 9) AS score
      FROM found SEMI JOIN pre USING (query_id, doc_id) GROUP BY query_id, doc_id))
  WHERE rank <= {top})"""
LINKS_SQL = r"""links AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
  WHERE src IS NOT NULL AND dst IS NOT NULL),
nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links)),
outs AS (SELECT src, count(*) AS n_out FROM links GROUP BY src),
n AS (SELECT count(*) AS n FROM nodes),
r0 AS MATERIALIZED (SELECT node, 1e0 / n AS rank FROM nodes, n)"""


def rounds_sql(k: int) -> str:
    step = r""", r{b} AS MATERIALIZED (
  SELECT nodes.node, 0.15e0 / n.n + 0.85e0 * coalesce(g.given, 0e0) AS rank
  FROM nodes CROSS JOIN n LEFT JOIN (
    SELECT dst AS node, sum(r{a}.rank / outs.n_out) AS given FROM links JOIN outs USING (src) JOIN r{a} ON r{a}.node = links.src GROUP BY dst) g USING (node))"""
    return LINKS_SQL + "".join(fill(step, a=i, b=i + 1) for i in range(k))
