"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# German letters and what stands for them.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))

# Common English function words.
STOPWORDS = """a about after all also am an and any are as at be because been before being below between both but by can did do does
doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me
more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them
then there these they this those through to too under until up very was we were what when where which while who whom why will with
you your yours""".split()  # fmt: skip

TOKEN = r"([\p{L}\p{N}]+)"
ALPHABETIC = r"(?<![\p{L}\p{N}])(\p{L}++)(?!\p{N})"  # tokens that have letters only
#: For texts of the web: addresses, handles and tags, emoticons, and words with their apostrophes and hyphens stay whole.
WEB_TOKEN = (
    r"(https?://[^\s<>\"]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[@#][\p{L}\p{N}_]+|[<>]?[:;=8][\-o*']?[)\](\[dp/:}{@|]|<3"
    r"|[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*)"
)


def umlaut_fold(text: Column) -> Column:
    for a, b in UMLAUTS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Runs of letters and digits, or what else the pattern's first group finds, lower-cased; a NULL text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def lemmatise(docs: DataFrame, lemmas: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens) with each token that ``lemmas`` (token, lemma) knows replaced; order and repeats stay.

    One join on the token, of the documents' distinct tokens only; Spark broadcasts the table if it is small.
    """
    known = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    found = docs.select(key, F.explode(F.array_distinct("tokens")).alias("token")).join(known, "token")
    maps = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas"))
    joined = docs.select(key, "tokens").join(maps, key, "left")
    return joined.select(key, F.transform("tokens", lambda t: F.coalesce(F.element_at("_lemmas", t), t)).alias("tokens"))


def preprocess(text: Column, stopwords: Sequence[str] = STOPWORDS, lemmas: Column | None = None) -> Column:
    """Tokens, those with a letter or digit, folded, without stopwords, lemmatised by a map column if given; order and repeats stay."""
    stop = F.array(*map(F.lit, stopwords))
    kept = F.filter(F.transform(tokens(text), umlaut_fold), lambda t: ~F.array_contains(stop, t))
    return kept if lemmas is None else F.transform(kept, lambda t: F.coalesce(F.element_at(lemmas, t), t))


def words_share(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, share): the share of a text's alphabetic tokens that are in ``vocabulary`` (column ``word``).

    The vocabulary is sent to all tasks, and only each task's counts by text are shuffled.
    """
    words = F.regexp_extract_all(umlaut_fold(F.lower(F.col("text"))), F.lit(ALPHABETIC), F.lit(1))
    known = vocabulary.select("word", F.lit(1).alias("known")).distinct()
    found = docs.select(key, F.explode(words).alias("word")).join(F.broadcast(known), "word", "left")
    counts = found.groupBy(key).agg(F.count("*").alias("n_words"), F.count("known").alias("n_known"))
    every = docs.select(key).join(counts, key, "left")
    return every.select(key, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce(F.col("n_known") / F.col("n_words"), F.lit(0.0)).alias("share"))


def on_topic(found: Column, any_of: Sequence[str], all_of: Sequence[str]) -> Column:
    """Has one of the first words, or every one of the second."""
    one = F.arrays_overlap(found, F.array(*map(F.lit, any_of)))
    every = F.size(F.array_intersect(found, F.array(*map(F.lit, all_of)))) == len(set(all_of))
    return F.coalesce(one, F.lit(False)) | every


def embed_input(title: Column, description: Column, content: Column) -> Column:
    """Non-empty parts joined by a full stop and a space."""
    return F.concat_ws(". ", *(F.nullif(x, F.lit("")) for x in (title, description, content)))


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def ai_label(score: Column) -> Column:
    return F.format_string("AI-probably: %.2f%%", score * 100)


def content_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hex_id(value: Column) -> Column:
    return F.lower(F.hex(value))
