"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k from a Poisson distribution whose mean is the target repetition
rate of s: (weight of s * wished size) / (size of s). The distribution is inverted at a uniform number hashed from
seed and document, so a lost task draws the same numbers again. Built from Spark expressions alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# means above this are drawn as a sum of independent parts, so exp(-mean) stays a normal number
PART_MEAN = 64.0
# terms of the distribution kept for a part: 64 + 14 standard deviations, the rest weighs less than 2**-60
TERMS = 180
# up to as many sources are broadcast with their distributions (about 1.5 kB each)
FEW_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) with 52 bits, from an md5 that other engines can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """Array of P(k <= j) for j = 0, 1, ... of a Poisson distribution with a mean up to ``PART_MEAN``."""
    first = F.exp(-mean)
    start = F.struct(F.array().cast("array<double>").alias("c"), first.alias("p"), first.alias("s"))

    def step(a, j):
        p = a["p"] * mean / j.cast("double")
        return F.struct(F.concat(a["c"], F.array(a["s"])).alias("c"), p.alias("p"), (a["s"] + p).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["c"])


def rates(docs: DataFrame, weights: Mapping[str | None, float] | DataFrame | None = None, total: float | None = None) -> DataFrame:
    """Per source: ``source, size, weight, rate``. Sizes are code points of whole texts, over all documents.

    ``weights`` maps sources to target weights (None: equal weights); they are scaled to one. ``total`` is the wished
    size, by default the size of the input. Sources without text have rate zero, as have sources without a weight.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        known = size.withColumn("weight", F.when(F.col("size") > 0, 1.0).otherwise(0.0))
    else:
        if not isinstance(weights, DataFrame):
            weights = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        w = weights.select(F.col("source").alias("_s"), "weight")
        known = size.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.when(F.col("size") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    wished = F.lit(float(total)) if total is not None else known.agg(F.sum("size")).scalar()
    share = F.col("weight") / known.agg(F.sum("weight")).scalar()
    return known.select("source", "size", "weight", F.when(F.col("weight") > 0, share * wished / F.col("size")).otherwise(0.0).alias("rate"))


def _small(r: DataFrame) -> DataFrame:
    """Rates ready to be broadcast, if they are few; else as they are, for Spark to join as it sees fit."""
    rows = r.limit(FEW_SOURCES + 1).collect()
    return F.broadcast(r.sparkSession.createDataFrame(rows, r.schema)) if len(rows) <= FEW_SOURCES else r


def mix(docs: DataFrame, weights: Mapping[str | None, float] | DataFrame | None = None, total: float | None = None, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (from 0) and ``shuffle_key``; a row per copy, globally shuffled.

    Each copy goes to the partition and the place in it that its own hash names. Rows are joined with the numbers of
    their source; up to ``FEW_SOURCES`` sources are broadcast, more are joined by a shuffle that splits a hot source.
    NULL source is a source of its own; NULL or empty texts have no size but are repeated like their source's others;
    rows with NULL key, or the same key, draw the same number. An empty table gives no rows. Columns of ``docs`` named
    ``copy`` or ``shuffle_key`` are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    r = rates(docs, weights, total)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN).cast("int"), F.lit(1))
    r = _small(r.where("rate > 0").select("source", "rate"))
    r = r.select(F.col("source").alias("_source"), parts.alias("_parts"), (F.col("rate") / parts).alias("_mean")).select("_source", "_parts", cumulative(F.col("_mean")).alias("_cdf"))
    id_ = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def drawn(j):
        u = uniform(F.lit(str(seed)), id_, j.cast("string"))
        return F.size(F.filter("_cdf", lambda c: c <= u))

    # the one uniform number of the usual case is worked out once a row, not once a term
    one = F.transform(F.array(uniform(F.lit(str(seed)), id_, F.lit("1"))), lambda u: F.size(F.filter("_cdf", lambda c: c <= u)))[0]
    several = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda a, j: a + drawn(j))
    k = F.when(F.col("_parts") == 1, one).otherwise(several)
    some = docs.join(r, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_k", k).where("_k > 0")
    copies = some.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long") - 1))).drop("_source", "_parts", "_cdf", "_k")
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:place"), id_, F.col("copy").cast("string"))), 1, 13), 16, 10).cast("long")
    return copies.withColumn("shuffle_key", place).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
