"""URLs as column expressions, and the standard library's resolver to hold them against."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean(url: Column) -> Column:
    """Without query, fragment and trailing slashes; the scheme in lower case; NULL unless http or https."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), "/+$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z]+):", 1))
    return F.when(url.rlike("(?i)^https?:"), F.concat(scheme, F.substring(bare, F.length(scheme) + 1, F.length(bare))))


def host(url: Column) -> Column:
    """The authority: host and port."""
    return F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def site(url: Column) -> Column:
    """Scheme and authority."""
    return F.nullif(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit(""))


def resolve(base: Column, href: Column) -> Column:
    """A reference against its page's URL: absolute, of the same scheme, from the site's root, or relative to the page.

    Dot segments go.  NULL if either is, or the page's URL has no scheme and host.
    """
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(page == "", F.lit("/")).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    path, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_replace(href, "^[^?#]*", "")
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(path.startswith("/"), F.concat(site(base), without_dots(path), rest))
        .when(path != "", F.concat(site(base), without_dots(F.concat(folder, path)), rest))
        .when(rest.startswith("?"), F.concat(site(base), page, rest))
        .otherwise(F.concat(site(base), page, query, rest))
    )


def without_dots(path: Column) -> Column:
    """A path from the root without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    last = F.get(parts, F.size(parts) - 1)
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, start, step), "/")
    whole = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


@F.pandas_udf(StringType())
def resolve_any(base: pd.Series, href: pd.Series) -> pd.Series:
    """Any reference, by the standard library; NULL if it can't be parsed."""

    def one(a: str | None, b: str | None) -> str | None:
        try:
            return urljoin(a, b) if a is not None and b is not None else None
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(base, href)], dtype=object)
