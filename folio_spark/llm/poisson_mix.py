"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document is repeated a Poisson number of times whose mean is its source's repetition rate
(target share times corpus size over the source's own size). The number comes from inverting the
distribution at a uniform draw that hashes the seed and the doc_id, so any run, task retry or
partitioning repeats a document equally often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, own_names

HASH_BITS = 52  # 13 hex digits of an MD5


def uniform(*parts: Column) -> Column:
    """A draw inside (0, 1), fixed by ``parts``."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << HASH_BITS)


def rates(docs: DataFrame, targets: DataFrame | None = None, power: float = 0.5, size: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): mean repetitions of a document of each source.

    ``targets`` holds (source, weight): weights of 0 or more, scaled to sum to 1 over the sources
    that occur; a source it does not name, or names with null, gets 0. Without ``targets`` a
    source weighs its number of documents to ``power``. ``size`` is the wanted corpus size as a
    multiple of the present one. A null source is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if targets is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        named = targets.groupBy(F.col("source").alias("_named")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = counts.join(named, counts["source"].eqNullSafe(named["_named"]), "left").drop("_named").fillna(0.0, ["weight"])
    weighed = cut(weighed, "weights")  # one row per source
    total = weighed.agg(F.sum("weight").alias("_weights"), F.sum("n_docs").alias("_docs"))
    rate = F.when(F.col("_weights") > 0, F.col("weight") / F.col("_weights") * F.col("_docs") * F.lit(size) / F.col("n_docs")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(total)).select("source", "n_docs", rate.alias("rate"))  # total is one row


def cumulative(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until the rest is far below the draw's resolution.

    Probabilities are stepped in logarithms, so large rates do not underflow.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


@own_names
def replicate(docs: DataFrame, targets: DataFrame | None = None, power: float = 0.5, size: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` with every row repeated a Poisson number of times (perhaps never), in shuffled order.

    Adds ``copy_no`` (1 up) and ``shuffle_key``; rows are dealt to partitions and sorted inside
    them by hashes of seed, doc_id and copy, so sources and copies mix over the whole result. Rows
    with one doc_id are repeated equally often; a row without doc_id draws by its text. The rates
    are one row per source: Spark broadcasts them if the written table is under its threshold and
    otherwise joins by source with skew splitting.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    steps = cut(rates(docs, targets, power, size).select(F.col("source").alias("_of"), cumulative(F.col("rate")).alias("_steps")), "rates")
    held = docs.join(steps, docs["source"].eqNullSafe(steps["_of"])).drop("_of")
    draw = held.withColumn("_draw", uniform(F.lit(str(seed)), name))
    count = F.size(F.filter("_steps", lambda c: c < F.col("_draw")))
    copies = draw.withColumn("_count", count).where("_count > 0").drop("_steps", "_draw")
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count")
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, "copy_no")))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op10_mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy_no, shuffle_key and the length of the text that was carried along."""
    out = replicate(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "copy_no", "shuffle_key", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


OP10_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (
  SELECT source, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
steps AS (
  SELECT source, k, -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k) AS log_p
  FROM (SELECT source, rate, unnest(generate_series(0, ceil(rate + 10 * sqrt(rate) + 40)::INT)) AS k FROM rated)),
cdf AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
draws AS (
  SELECT doc_id, source, text, (('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, count(*) AS times FROM draws d JOIN cdf ON cdf.source = d.source AND cdf.c < d.u GROUP BY ALL),
copies AS (SELECT doc_id, source, text, unnest(generate_series(1, times))::INT AS copy_no FROM counted)
SELECT doc_id, source, copy_no, md5('order17:' || doc_id || ':' || copy_no) AS shuffle_key, length(text)::BIGINT AS n_chars FROM copies
"""
