"""HTML: fields of regular pages as column expressions; a real parser for any page.

The expressions stay in the JVM and suit pages without nested boilerplate elements.
``parse`` walks the page with the standard library's parser and handles nested and
unclosed elements, image texts and entities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.config import DEFAULTS

# Elements that hold no content of their own page.
BOILERPLATE = ("nav", "header", "footer", "aside")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
SILENT = ("script", "style", "title", "template")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def unescape(text: Column) -> Column:
    """The five entities of markup, and the fixed space; the ampersand last."""
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def title(html: Column) -> Column:
    return F.nullif(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def description(html: Column) -> Column:
    return F.nullif(unescape(F.regexp_extract(html, r'(?is)<meta\s+name="description"\s+content="([^"]*)"', 1)), F.lit(""))


def strip_boilerplate(html: Column, elements: Sequence[str] = BOILERPLATE) -> Column:
    for x in elements:
        html = F.regexp_replace(html, rf"(?is)<{x}\b.*?</{x}>", "")
    return html


def image_texts(html: Column) -> Column:
    """An image becomes its text if that has a space or is a single word; others go."""
    worded = F.regexp_replace(html, r'(?i)<img\b[^>]*?\balt="([^">]* [^">]*|[\p{L}\p{N}]+)"[^>]*>', " $1 ")
    return F.regexp_replace(worded, r"(?i)<img\b[^>]*>", "")


def text(html: Column) -> Column:
    """Text nodes outside boilerplate, scripts and comments, joined by single spaces."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = strip_boilerplate(html, (*BOILERPLATE, "script", "style", "title"))
    html = F.regexp_replace(image_texts(html), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(html), r"[ \t\r\n]+", " "))


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(unescape(F.regexp_extract(tag, rf'(?is)\s{name}="([^"]*)"', 1)), F.lit(""))


def links(pages: DataFrame, languages: Sequence[str] = DEFAULTS.languages) -> DataFrame:
    """(page_id, url, href): a page's distinct references, boilerplate included, whose language attributes allow it."""
    tag = pages.select("page_id", "url", F.explode(anchors(F.col("html"))).alias("tag"))
    spoken = F.lit(True)
    for x in ("lang", "hreflang"):
        spoken = spoken & F.lower(F.coalesce(attribute(F.col("tag"), x), F.lit("en"))).isin(*languages)
    return tag.filter(spoken).select("page_id", "url", attribute(F.col("tag"), "href").alias("href")).filter("href is not null").distinct()


class _Page(HTMLParser):
    """Collects title, description, references and text in one walk."""

    def __init__(self, languages: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.languages = languages
        self.title: str | None = None
        self.description: str | None = None
        self.hrefs: dict[str, None] = {}
        self.texts: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "a" and own.get("href") is not None:
            if all((own.get(x) or "en").lower() in self.languages for x in ("lang", "hreflang")):
                self.hrefs[own["href"]] = None
        elif tag == "meta" and (own.get("name") or "").lower() == "description" and self.description is None:
            self.description = own.get("content")
        elif tag == "img" and not self._hidden():
            alt = own.get("alt") or ""
            if (" " in alt or alt.isalnum()) and alt.strip():
                self.texts.append(alt.strip())
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:  # an unclosed element ends with the one around it
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "title" and self.title is None:
            self.title = data
        elif data.strip() and not self._hidden():
            self.texts.append(data.strip())

    def _hidden(self) -> bool:
        return any(x in BOILERPLATE or x in SILENT for x in self.open)


def parse_page(html: str | None, languages: Sequence[str] = DEFAULTS.languages) -> tuple[str | None, str | None, str, list[str]]:
    page = _Page(languages)
    page.feed(html or "")
    page.close()
    return page.title, page.description, " ".join(page.texts), list(page.hrefs)


def parse(pages: DataFrame, languages: Sequence[str] = DEFAULTS.languages) -> DataFrame:
    """(page_id, url, title, description, content, hrefs) of any pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [parse_page(x, languages) for x in part["html"]]
            out = pd.DataFrame(found, columns=["title", "description", "content", "hrefs"])
            yield pd.concat([part[["page_id", "url"]].reset_index(drop=True), out], axis=1)

    kind = f"page_id {dict(pages.dtypes)['page_id']}, url string, title string, description string, content string, hrefs array<string>"
    return pages.select("page_id", "url", "html").mapInPandas(run, kind)
