"""English suffix stripping by the published Porter2 rules, as a column function on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_KNOWN = 200_000

# The rules' word lists and suffixes.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
PLURAL_DONE = "inning outing canning herring earring proceed exceed succeed".split()
LONG_STARTS = r"gener|commun|arsen"
LI_AFTER, DOUBLES = "cdeghkmnrt", r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
IN_R1 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THEN_IN_R1 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
IN_R2 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

# Y is a y that acts as a consonant.
V, C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{V}{C}")
_SHORT_END = re.compile(rf"(?:{C}{V}[^aeiouywxY]|^{V}{C})$")


def _longest(word: str, suffixes: Sequence[str] | dict[str, str]) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of one lower-case word; up to two letters stay as they are."""
    if len(word) <= 2 or word in WHOLE:
        return WHOLE.get(word, word)
    word = re.sub(rf"(^|{V})y", r"\1Y", word.removeprefix("'"))
    start = re.match(LONG_STARTS, word) or _REGION.search(word)
    r1 = start.end() if start else len(word)
    second = _REGION.search(word, r1)
    r2 = second.end() if second else len(word)

    word = re.sub(r"(?:'s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(V, word[:-2]):
        word = word[:-1]
    if word in PLURAL_DONE:
        return word

    past = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if past:
        rest = word[: -len(past)]
        if past.startswith("ee"):
            word = rest + "ee" if len(rest) >= r1 else word
        elif re.search(V, rest):
            if rest.endswith(("at", "bl", "iz")):
                word = rest + "e"
            elif re.search(DOUBLES, rest):
                word = rest[:-1]
            else:
                word = rest + "e" if len(rest) <= r1 and _SHORT_END.search(rest) else rest
    word = re.sub(f"(.{C})[yY]$", r"\1i", word)

    for rules in (IN_R1, THEN_IN_R1):
        end = _longest(word, rules)
        if end and len(word) - len(end) >= r1:
            rest = word[: -len(end)]
            if (end == "ogi" and not rest.endswith("l")) or (end == "li" and rest[-1:] not in LI_AFTER) or (end == "ative" and len(rest) < r2):
                continue
            word = rest + rules[end]
    end = _longest(word, IN_R2)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        rest = word[:-1]
        if len(rest) >= r2 or (len(rest) >= r1 and not _SHORT_END.search(rest)):
            word = rest
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stems(tokens: Column) -> Column:
    """The stems of an array of lower-case tokens; NULL gives NULL.  A worker stems each distinct token once, and remembers so many."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str | None, str | None] = {None: None}
        for part in parts:
            for t in {t for ts in part if ts is not None for t in ts}.difference(known):
                known[t] = stem(t)
            yield part.map(lambda ts: None if ts is None else [known[t] for t in ts])
            if len(known) > MOST_KNOWN:
                known = {None: None}

    return run(tokens)
