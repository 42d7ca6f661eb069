"""Preference formatting, with DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once as the prompt; what follows in each is rendered as a completion, with the spans of the
assistant's own words marked for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"  # fixed values of the ChatML layout
TRAINED_ROLE = "assistant"


def turns(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the conversation as an array of (turn, role, text), in order.

    Order is (turn, role, text), nulls first; fully repeated messages count once; messages without
    a conversation id are left out, as they belong to none. A conversation is one row of the
    result, so it has to fit in one row.
    """
    known = messages.where(F.col(key).isNotNull())
    message = F.struct("turn", "role", "text")
    return known.groupBy(key).agg(F.sort_array(F.collect_set(message)).alias("turns"))


def _same(x: Column, y: Column) -> Column:
    return F.coalesce(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]), F.lit(False))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; turns are equal if role and text are."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), _same)
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(shorter)


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def rendered(turns_: Column) -> Column:
    return F.array_join(F.transform(turns_, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns_: Column) -> Column:
    """Code-point spans [start, stop) of a rendered completion that count for the loss.

    They cover the assistant's text and its end mark; headers and other roles are masked.
    """
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        stop = begin + F.length(_body(t))
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((stop + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns_, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with ``prompt_turns``, ``prompt``, and text and ``_spans`` of both completions.

    ``chosen`` and ``rejected`` are arrays of (turn, role, text); they are replaced by the rendered
    completions. A null conversation is an empty one. If one conversation continues the other, the
    shorter one's completion is empty; for equal ones both are.
    """
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    held = pairs.withColumns({"_a": F.coalesce(chosen, none), "_b": F.coalesce(rejected, none)})
    held = held.withColumn("prompt_turns", common_turns(F.col("_a"), F.col("_b")))
    rest = {c: F.slice(F.col(a), F.col("prompt_turns") + 1, F.size(a)) for c, a in ((chosen, "_a"), (rejected, "_b"))}
    held = held.withColumn("prompt", rendered(F.slice("_a", F.lit(1), F.col("prompt_turns"))))
    held = held.withColumns({f"{c}_spans": trained_spans(r) for c, r in rest.items()} | {c: rendered(r) for c, r in rest.items()})
    return held.drop("_a", "_b")


def with_other_tails(messages: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation, against its own head with another one's tail.

    The conversations part after ``md5(conv_id) mod turns`` turns, so at any turn of theirs and before
    the last one's end; from there on ``rejected`` goes on as conversation ``conv_id + 1`` does after
    as many turns, and ends where that one is missing or has no more. Every conversation makes one
    pair, and both sides keep all their turns. The tails may begin alike; :func:`format_pairs` finds
    where the sides really part.
    """
    whole = turns(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    drawn = F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), 16, 10).cast("long")
    held = whole.select("conv_id", F.col("turns").alias("chosen"), (drawn % F.size("turns")).cast("int").alias("_shared"))
    other = whole.select((F.col("conv_id") - 1).alias("_before"), F.col("turns").alias("_other"))
    met = held.join(other, held["conv_id"] == other["_before"], "left")
    shared = F.col("_shared")
    tail = F.coalesce(F.slice("_other", shared + 1, F.size("_other")), F.slice("chosen", F.lit(1), F.lit(0)))
    return met.select("conv_id", "chosen", F.concat(F.slice("chosen", F.lit(1), shared), tail).alias("rejected"))


def op9_preference(messages: DataFrame) -> DataFrame:
    """conv_id, prompt, chosen, rejected, and the trained spans as "start-stop" lists."""

    def spans(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(name)

    out = format_pairs(with_other_tails(messages))
    return out.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


OP9_SQL = """
WITH said AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM said),
cuts AS (SELECT conv_id, count(*) AS n, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % count(*) AS d FROM said GROUP BY conv_id),
chosen AS (SELECT conv_id, i, role, text FROM numbered),
rejected AS (
  SELECT conv_id, i, role, text FROM numbered JOIN cuts USING (conv_id) WHERE i <= d
  UNION ALL SELECT c.conv_id, o.i, o.role, o.text FROM cuts c JOIN numbered o ON o.conv_id = c.conv_id + 1 AND o.i > c.d),
parted AS (
  SELECT conv_id, min(i) AS first FROM chosen c FULL JOIN rejected r USING (conv_id, i)
  WHERE c.text IS DISTINCT FROM r.text OR c.role IS DISTINCT FROM r.role OR (c.conv_id IS NULL) <> (r.conv_id IS NULL) GROUP BY conv_id),
shared AS (SELECT conv_id, CAST(coalesce(first - 1, n) AS INT) AS prompt_turns FROM cuts LEFT JOIN parted USING (conv_id)),
drawn AS (
  SELECT side, conv_id, i, prompt_turns, role, '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS body
  FROM (SELECT 'chosen' AS side, * FROM chosen UNION ALL SELECT 'rejected', * FROM rejected) JOIN shared USING (conv_id)),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY side, conv_id, i > prompt_turns ORDER BY i) - length(body) - 1 AS begins FROM drawn),
made AS (
  SELECT side, conv_id, string_agg(head || body || chr(10), '' ORDER BY i) FILTER (i <= prompt_turns) AS prompt,
    string_agg(head || body || chr(10), '' ORDER BY i) FILTER (i > prompt_turns) AS completion,
    string_agg(CAST(begins AS BIGINT) || '-' || CAST(begins + length(body) AS BIGINT), ',' ORDER BY i) FILTER (i > prompt_turns AND role = 'assistant') AS spans
  FROM placed GROUP BY side, conv_id)
SELECT s.conv_id, s.prompt_turns, coalesce(c.prompt, '') AS prompt, coalesce(c.completion, '') AS chosen, coalesce(r.completion, '') AS rejected,
  coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM shared s LEFT JOIN made c ON c.conv_id = s.conv_id AND c.side = 'chosen' LEFT JOIN made r ON r.conv_id = s.conv_id AND r.side = 'rejected'
"""
