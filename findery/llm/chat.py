"""Operator 3: chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold a conversation several times, each time with more turns.  A rolling
hash of the turns so far (two 64-bit halves) gives every prefix of every
conversation a key.  Conversations with equal turns are one (the least ``conv_id``
stays); a conversation whose key is that of a proper prefix of a longer one is
dropped by an anti-join; what remains is maximal and is rendered.

Turns are ordered by (turn, role, text), nulls first; rows without a ``conv_id``
belong to no conversation.  A NULL role is rendered as ``unknown``, a NULL text as
empty; they count as different from those words when turns are compared.  Marks of
the template within a text are broken up by a space, so they can't end a turn.
Repeated rows are turns of their own, and count when conversations are compared; turns of
any length are hashed and rendered whole.  Other columns play no part; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    safe = [F.replace(F.coalesce(c, F.lit(d)), F.lit("<|im_"), F.lit("<| im_")) for c, d in ((role, "unknown"), (text, ""))]
    return F.concat(F.lit(OPEN), safe[0], F.lit("\n"), safe[1], F.lit(CLOSE + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place, the conversation's length and the rolling hash up to it (x1, x2)."""
    known = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    by_turn = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = by_turn.rowsBetween(W.unboundedPreceding, 0)
    placed = known.withColumn("place", F.row_number().over(by_turn)).withColumn("n_turns", F.count("*").over(W.partitionBy("conv_id")))
    # a place is part of what is hashed, so the xor of the hashes so far depends on the order
    parts = [F.lit(k) for k in ("a", "b")]
    hashed = [F.xxhash64(k, "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for k in parts]
    return placed.withColumns({f"x{i}": F.bit_xor(h).over(so_far) for i, h in enumerate(hashed, 1)})


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations; ``n_copies`` counts those with the same turns."""
    every = prefixes(turns)
    whole = every.filter("place = n_turns").groupBy("n_turns", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = every.filter("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "x1", "x2").distinct()
    return whole.join(proper, ["n_turns", "x1", "x2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def chat_documents(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): the maximal conversations, rendered."""
    kept = collapse(turns)
    text = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    one = F.struct("turn", "role", "text")
    rendered = F.concat_ws("", F.transform(F.array_sort(F.collect_list(one)), lambda x: render_turn(x["role"], x["text"])))
    return text.groupBy("conv_id", "n_turns", "n_copies").agg(rendered.alias("text"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_documents(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS one
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far FROM t),
w AS (
  SELECT n_turns, so_far, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n_turns GROUP BY n_turns, so_far),
k AS (
  SELECT conv_id, n_turns, n_copies FROM w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.place = w.n_turns AND p.so_far = w.so_far))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('<|im_start|>' || replace(coalesce(t.role, 'unknown'), '<|im_', '<| im_') || chr(10)
                  || replace(coalesce(t.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS text
FROM k JOIN t USING (conv_id) GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
