"""Level-by-level crawling, and indexing of pages as they arrive.

Each level is a handful of DataFrame jobs; the state is a snapshot that the next level reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findery.config import CACHED, DEFAULTS, PENDING, Settings
from findery.functions import html as H
from findery.functions import text as T
from findery.functions import urls
from findery.operators import frontier
from findery.session import snapshot
from findery.sources.web import allowed


def index_pages(pages: DataFrame, settings: Settings = DEFAULTS, relevant: Callable | None = None) -> DataFrame:
    """(page_id, url, title, description, content, hrefs, tokens, relevant) of raw pages."""
    parsed = H.parse(pages, settings.languages).withColumn("tokens", T.preprocess(F.col("content")))
    gate = relevant(parsed) if relevant else T.on_topic(F.col("tokens"), settings.any_topic, settings.all_topics)
    return parsed.withColumn("relevant", gate)


def url_id(url: Column) -> Column:
    """A document's id: the digest of its URL, so that no two URLs share one."""
    return F.sha2(url.cast("binary"), 256)


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    depth: int,
    settings: Settings = DEFAULTS,
    relevant: Callable | None = None,
    robots: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, links) after crawling to ``depth``.  ``fetch`` maps the frontier to (doc_id, url, depth, code, html).

    ``robots`` maps sites (host, site) to (host, rules); each host is asked once, and links that its rules forbid are
    never offered.  Pages off topic or not indexed still hand on their links at depth 0 and 1, but no deeper.
    """
    new = seeds.groupBy("url").agg(F.min_by("depth", "nth").alias("depth"))
    docs = snapshot(new.select(url_id(F.col("url")).alias("doc_id"), "url", "depth", F.lit(PENDING).alias("status")), "documents")
    rules = None
    links = docs.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst")).limit(0)
    for level in range(depth + 1):
        todo = docs.filter((F.col("status") == PENDING) & (F.col("depth") <= level))
        if todo.isEmpty():
            continue
        got = snapshot(fetch(todo).withColumn("status", frontier.after_download(F.col("code"))), "downloads")
        pages = got.filter(F.col("status") == CACHED).select(F.col("doc_id").alias("page_id"), "url", "html")
        done = snapshot(index_pages(pages, settings, relevant), "indexed")
        states = got.select("doc_id", "status").join(done.select(F.col("page_id").alias("doc_id"), "relevant"), "doc_id", "left")
        states = states.select("doc_id", F.when(F.col("status") == CACHED, frontier.after_index(F.col("relevant"))).otherwise(F.col("status")).alias("status"))
        out = done.filter(F.col("relevant") | F.lit(level <= 1)).select("page_id", "url", F.explode("hrefs").alias("href"))
        target = urls.clean(urls.resolve(F.col("url"), F.col("href")))
        offers = snapshot(out.select(F.col("page_id").alias("src"), target.alias("url")).filter("url is not null").distinct(), "offers")
        if robots:
            hosts = offers.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min(urls.site(F.col("url"))).alias("site")).filter("host is not null")
            asked = hosts if rules is None else hosts.join(rules.select("host"), "host", "left_anti")
            answers = snapshot(robots(asked).select("host", "rules"), "robots")
            rules = answers if rules is None else rules.unionByName(answers)
            offers = snapshot(allowed(offers, rules), "offers")
        docs = frontier.set_status(docs, states)
        fresh = offers.select("url").distinct().join(docs.select("url"), "url", "left_anti")
        added = fresh.select(url_id(F.col("url")).alias("doc_id"), "url", F.lit(level + 1).alias("depth"), F.lit(PENDING).alias("status"))
        docs = snapshot(docs.select("doc_id", "url", "depth", "status").unionByName(added), "documents")
        links = snapshot(frontier.insert_links(links, offers, docs), "links")
    return docs, links


def index_stream(pages: DataFrame, sink: str, checkpoint: str, settings: Settings = DEFAULTS, relevant: Callable | None = None) -> StreamingQuery:
    """Index a stream of pages: each batch's postings are appended to ``sink`` under its number, so a repeated batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        done = index_pages(batch, settings, relevant).filter("relevant")
        terms = done.select(F.col("page_id").alias("doc_id"), F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
        terms.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
