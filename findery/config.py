"""Settings of the engine.  The defaults are the published ones of the search design that it follows."""

from __future__ import annotations

from dataclasses import dataclass, field

# States of a document.
PENDING, QUEUED, CACHED, READY, SKIPPED, ERROR = 0, 1, 2, 3, 254, 255


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    damping: float = 0.85
    iterations: int = 10
    skew: float = 0.3  # share of authority in the final score
    limit: int = 100  # results; 5 x as many come from BM25, 10 x as many from the prefilter
    hamming_below: int = 5
    jaccard_below: float = 0.02
    english_share: float = 0.5
    any_topic: tuple[str, ...] = ("tuebingen",)
    all_topics: tuple[str, ...] = ("university", "eberhard", "karls")
    languages: tuple[str, ...] = ("en", "en-us", "en-gb", "en-ca", "en-au")
    poll: int = 50
    shorten: dict[str, int] = field(default_factory=lambda: {"title": 100, "url": 80, "description": 150})


DEFAULTS = Settings()
