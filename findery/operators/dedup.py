"""Near copies: SimHash candidates, Jaccard distance, and the verdict in order of arrival.

Documents with the same SimHash and the same words are one class, whose representative is the one
with the least id.  Pairs are of representatives only; ``members`` says who stands for whom.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.config import DEFAULTS
from findery.functions.hashing import BITS, hamming, word_set
from findery.session import delete_at_end, shared_folder, snapshot

GROWTH = 1.03  # sizes of word sets are dealt in classes that grow by this factor
MIX = np.uint64(0x9E3779B97F4A7C15)


def hamming_search(queries: DataFrame, hashes: DataFrame, below: int = DEFAULTS.hamming_below) -> DataFrame:
    """(a, b, distance) for each query a (doc_id, sim_hash) and each other document b closer than ``below``.

    Exact: of ``below`` bands one at least is equal if fewer than ``below`` bits
    differ.  So the join is on bands, and of distinct hashes only.
    """
    width = -(-BITS // below)

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        bands = F.array(*(F.shiftrightunsigned("sim_hash", i * width).bitwiseAND((1 << width) - 1) for i in range(below)))
        return frame.select("sim_hash").distinct().select(F.col("sim_hash").alias(name), F.posexplode(bands).alias("band", "key"))

    near = keyed(queries, "x").join(keyed(hashes, "y"), ["band", "key"]).filter(hamming(F.col("x"), F.col("y")) < below).select("x", "y").distinct()
    a = queries.select(F.col("doc_id").alias("a"), F.col("sim_hash").alias("x"))
    b = hashes.select(F.col("doc_id").alias("b"), F.col("sim_hash").alias("y"))
    return near.join(a, "x").join(b, "y").filter("a <> b").select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def classes(documents: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The representatives (rep, sim_hash, n, words) and the members (doc_id, rep); words are hashed, 8 bytes each.

    ``documents`` has doc_id and text, ``hashes`` doc_id and sim_hash.  Both results are written.
    """
    sets = documents.select("doc_id", F.array_sort(word_set(F.col("text"))).alias("words")).join(hashes.select("doc_id", "sim_hash"), "doc_id")
    keys = ["sim_hash", "n", "k1", "k2"]
    sets = snapshot(sets.select("doc_id", "sim_hash", F.size("words").alias("n"), F.xxhash64(F.lit(1), "words").alias("k1"), F.xxhash64(F.lit(2), "words").alias("k2"), "words"), "sets")
    reps = snapshot(sets.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "representatives")
    members = snapshot(sets.select("doc_id", *keys).join(reps, keys).select("doc_id", "rep"), "members")
    held = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return snapshot(held.select(F.col("doc_id").alias("rep"), "sim_hash", "n", "words"), "word_sets"), members


def _signatures(below: float):
    """Signatures of parts of each set, such that two sets closer than ``below`` agree in one at least.

    Sets x and y that differ in d words of u in both have the distance d / u, so d < below u.  Words are dealt
    by hash to as many parts as bound d, so one part at least is the same in both.  The number of parts
    follows a class of sizes; sizes of close sets differ by less than GROWTH, so each
    set takes part in its own class and the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, sizes, parts, marks = [], [], [], []
            words = batch.column(1)
            for rep, (a, b) in zip(batch.column(0).to_pylist(), zip(words.offsets.to_numpy(), words.offsets.to_numpy()[1:])):
                x = words.values.to_numpy()[a:b].view(np.uint64)
                if not len(x):
                    continue
                own = int(math.log(len(x)) / math.log(GROWTH))
                for size in (own, own + 1):
                    count = max(1, math.ceil(below * GROWTH ** (size + 1) / (1 - below)))
                    if count == 1:
                        continue  # sets as small as that are closer only if they are equal
                    h = (x ^ (x >> np.uint64(29))) * MIX
                    h ^= h >> np.uint64(32)
                    total = np.zeros(count, dtype=np.uint64)
                    np.add.at(total, ((h >> np.uint64(8)) % np.uint64(count)).astype(np.int64), h * MIX)
                    reps += [rep] * count
                    sizes += [size] * count
                    parts += range(count)
                    marks.append(total)
            flat = np.concatenate(marks).view(np.int64) if marks else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.int32()), pa.array(flat)], ["rep", "size", "part", "mark"])

    return run


def jaccard_pairs(sets: DataFrame, below: float = DEFAULTS.jaccard_below, hamming_below: int = DEFAULTS.hamming_below) -> DataFrame:
    """(a, b, jaccard), a < b, of representatives whose words are closer than ``below`` and whose hashes than ``hamming_below``.

    Exact.  Candidates agree in a part of their words; texts are not read again, only hashed words.
    """
    if not 0 < below < 1 - 1 / GROWTH:
        raise ValueError(f"the distance must be below {1 - 1 / GROWTH:.3f}")
    keys = ["size", "part", "mark"]
    marked = snapshot(sets.select(F.col("rep").cast("long").alias("rep"), "words").mapInArrow(_signatures(below), "rep long, size int, part int, mark long"), "signatures")
    shared = marked.groupBy(*keys).agg(F.count("*").alias("many")).filter("many > 1").select(*keys)
    marked = marked.join(shared, keys)
    found = marked.withColumnRenamed("rep", "a").join(marked.withColumnRenamed("rep", "b"), keys).filter("a < b").select("a", "b").distinct()
    x, y = (sets.select(F.col("rep").cast("long").alias(r), *(F.col(c).alias(f"{c}_{r}") for c in ("sim_hash", "n", "words"))) for r in "ab")
    near = found.join(x, "a").join(y, "b").filter(hamming(F.col("sim_hash_a"), F.col("sim_hash_b")) < hamming_below)
    # equal sets with other hashes have no signature in small classes: they are joined by all their words
    same = sets.select("rep", "sim_hash", "n", F.xxhash64(F.lit(1), "words").alias("k1"), F.xxhash64(F.lit(2), "words").alias("k2"))
    p, q = (same.select("n", "k1", "k2", F.col("rep").cast("long").alias(r), F.col("sim_hash").alias(f"h{r}")) for r in "ab")
    equal = p.join(q, ["n", "k1", "k2"]).filter((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) < hamming_below)).select("a", "b", F.lit(0.0).alias("jaccard"))
    shared_words = F.size(F.array_intersect("words_a", "words_b"))
    distance = 1 - shared_words / (F.col("n_a") + F.col("n_b") - shared_words)
    apart = near.select("a", "b", distance.alias("jaccard")).filter((F.col("jaccard") > 0) & (F.col("jaccard") < below))
    return apart.unionByName(equal)


def best_match(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, match, jaccard): each document's nearest earlier one, if there is one; ties go to the least id.

    The earliest document of a class is its representative, so only those can be matches.
    """
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("match"), "jaccard").unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("match"), "jaccard"))
    others = members.join(both, "rep").select("doc_id", "match", "jaccard")
    own = members.select("doc_id", F.col("rep").cast("long").alias("match"), F.lit(0.0).alias("jaccard"))
    earlier = others.unionByName(own).filter(F.col("match") < F.col("doc_id"))
    least = F.min(F.struct("jaccard", "match")).alias("m")
    return earlier.groupBy("doc_id").agg(least).select("doc_id", "m.match", "m.jaccard")


def verdicts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, kept, content_of): in order of id a document is kept unless an earlier kept one is its near copy.

    Greedy, in rounds on the graph of pairs: a representative none of whose earlier
    neighbours is undecided or kept is kept, and its later neighbours are dropped.  The rounds go on until
    none is undecided; a chain in which each is near the next only takes one for each two.
    Members that are no representatives are dropped: theirs is earlier, and near what they are near.
    A dropped one takes the content of its nearest kept earlier neighbour (ties: of the least id).
    """
    spark = pairs.sparkSession
    gone_at = f"{shared_folder(spark)}/gone-{uuid.uuid4().hex}"
    todo = snapshot(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "todo")
    todo.select(F.col("b").alias("n")).limit(0).write.parquet(f"{gone_at}/round=0")
    delete_at_end(spark, gone_at)
    for k in itertools.count(1):
        if todo.isEmpty():
            break
        free = todo.select(F.col("a").alias("n")).distinct().join(todo.select(F.col("b").alias("n")).distinct(), "n", "left_anti")
        todo.join(free.select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct().write.parquet(f"{gone_at}/round={k}")
        out = spark.read.schema("n long").parquet(f"{gone_at}/round={k}")
        rest = todo.join(free.select(F.col("n").alias("a")), "a", "left_anti")
        for end in "ab":
            rest = rest.join(out.select(F.col("n").alias(end)), end, "left_anti")
        todo = snapshot(rest.select("a", "b"), "todo")
    dropped = spark.read.schema("n long, round int").parquet(gone_at).select("n")  # each round's are its own
    gone = dropped.select(F.col("n").alias("rep"), F.lit(True).alias("gone"))
    every = members.select("doc_id", F.col("rep").cast("long").alias("rep")).join(gone, "rep", "left")
    kept = (F.col("doc_id") == F.col("rep")) & F.col("gone").isNull()
    # whose representative is gone takes the best of that one's kept neighbours
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("match"), "jaccard").unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("match"), "jaccard"))
    both = both.join(dropped.select(F.col("n").alias("match")), "match", "left_anti").join(dropped.select(F.col("n").alias("rep")), "rep", "left_semi")
    near = members.select("doc_id", "rep").join(both, "rep").filter(F.col("match") < F.col("doc_id"))
    match = near.groupBy("doc_id").agg(F.min(F.struct("jaccard", "match")).alias("m")).select("doc_id", F.col("m.match").alias("match"))
    found = every.join(match, "doc_id", "left")
    return found.select("doc_id", kept.alias("kept"), F.when(F.col("gone").isNull(), F.col("rep")).otherwise(F.col("match")).alias("content_of"))
