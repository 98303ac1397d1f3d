"""Pages and robots rules.  A fetcher is a plug-in; stored pages stand in for the network."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import urls

AGENT = "findery-bot"
# The largest page, the size of a read, the longest wait after a refusal, tries.
MOST_BYTES, READ_BYTES, MOST_WAIT, TRIES = 2 * 1024 * 1024, 16 * 1024, 30, 3

Fetch = Callable[[str], tuple[int | None, str | None]]


def http_fetch(timeout: float = 10, kind: str = "text/html") -> Fetch:
    """(status code, text) of a URL: code 0 for another content type, None if it can't be fetched or is too large.

    After 429 it waits as long as the server says, at most MOST_WAIT seconds (so also where it doesn't say), and tries again.
    """

    def fetch(url: str) -> tuple[int | None, str | None]:
        asked = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": "en"})
        for _ in range(TRIES):
            try:
                with urllib.request.urlopen(asked, timeout=timeout) as answer:
                    if kind not in answer.headers.get("Content-Type", "").lower():
                        return 0, None
                    length = answer.headers.get("Content-Length") or ""
                    if length.isdigit() and int(length) > MOST_BYTES:
                        return None, None
                    data = b""
                    while part := answer.read(READ_BYTES):
                        data += part
                        if len(data) >= MOST_BYTES:
                            return None, None
                    return answer.status, data.decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code != 429:
                    return e.code, None
                wait = e.headers.get("Retry-After", "")
                time.sleep(min(int(wait) if wait.isdigit() else MOST_WAIT, MOST_WAIT))
            except OSError:
                return None, None
        return 429, None

    return fetch


def download(frontier: DataFrame, fetch: Callable[[], Fetch]) -> DataFrame:
    """(doc_id, url, depth, code, html) of the frontier's URLs, fetched on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = fetch()
        for part in parts:
            found = [get(u) for u in part["url"]]
            yield part.assign(code=pd.array([c for c, _ in found], dtype="Int64"), html=[h for _, h in found])

    return frontier.select("doc_id", "url", "depth").mapInPandas(run, f"doc_id {dict(frontier.dtypes)['doc_id']}, url string, depth int, code long, html string")


def robots_rules(sites: DataFrame, fetch: Callable[[], Fetch] = lambda: http_fetch(kind="text/plain")) -> DataFrame:
    """(host, rules) of sites (host, site), fetched on the executors, one request each; where there are none, or none can be had, NULL: all is allowed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = fetch()
        for part in parts:
            found = [get(f"{x}/robots.txt") for x in part["site"]]
            yield part[["host"]].assign(rules=[text if code is not None and 200 <= code < 300 else None for code, text in found])

    return sites.select("host", "site").mapInPandas(run, "host string, rules string")


def stored(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """The same from a table of pages: a URL that isn't there answers 404."""
    html = pages.select(urls.clean(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    return frontier.select("doc_id", "url", "depth").join(html, "url", "left").select("doc_id", "url", "depth", F.when(F.col("html").isNull(), 404).otherwise(200).cast("long").alias("code"), "html")


def allowed(links: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """Links (with ``url``) that their host's rules (host, rules) let the agent fetch; a host without rules allows all.

    Rules are parsed once for each host and batch.
    """

    @F.pandas_udf("boolean")
    def may(url: pd.Series, rules: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(u: str, text: str | None) -> bool:
            if text is None:
                return True
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            return parsed[text].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(url, rules)])

    known = links.withColumn("host", urls.host(F.col("url"))).join(robots.select("host", "rules"), "host", "left")
    return known.filter(may("url", "rules")).drop("host", "rules")


def seeds(spark: SparkSession, urls_: list[str]) -> DataFrame:
    return spark.createDataFrame([(u, 0, i) for i, u in enumerate(urls_)], "url string, depth int, nth int")


def triplets(source: DataFrame) -> DataFrame:
    """Training rows: anchor, positive, negative."""
    return source.withColumnRenamed("query", "anchor").select("anchor", "positive", "negative")
