"""Order statistics without a single-task sort.

A plain ``Window.orderBy(x)`` with few or no partition keys sorts everything in
one task, and ``percentile`` keeps every distinct value of a group in one
buffer. Both break when one group holds most of the rows. Here every operator
is built on :func:`cumulate`:

1. equal values are merged first (map-side combine), so ties and hot values cost
   one row each;
2. the distinct values are dealt into ranges of about equal size, whatever their distribution; the
   ranges are stored, so every later step sees the same ones;
3. range totals (a small table: one row per range and group) give each range its starting rank;
4. ranks inside a range come from a window partitioned by (group, range).

Percentiles need no ranks of all values: they count coarse buckets first, cut the crowded ones among
those that hold a wanted rank into equal steps, and look only into the steps that hold one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.grid import as_col
from firegrid.session import cut_lineage

_STEPS_PER_OCTAVE = 256
_SHIFT = 1100 * _STEPS_PER_OCTAVE
# rows that one step of a crowded bucket should hold
_CROWD = 65_536


def value_bucket(col) -> Column:
    """Monotone coarse bucket of a double: sign and the leading bits of its logarithm."""
    c = as_col(col).cast("double")
    # infinities take the bucket beyond the largest number's
    size = F.when(F.abs(c) == float("inf"), F.lit(1025.0)).otherwise(F.log2(F.abs(c)))
    mag = F.floor(size * _STEPS_PER_OCTAVE) + F.lit(_SHIFT)
    return F.when(c == 0, F.lit(0)).otherwise(F.when(c > 0, mag).otherwise(-mag)).cast("long")


def _known(col: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def cumulate(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct values per group with ``n`` (count), ``w`` (weight), the weight
    ``before`` and ``upto`` each value, the group's ``total`` and range ``b``.

    The distinct values are computed here and stored, so costly inputs are not worked out again by each later step.
    """
    by = list(by)
    w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1))
    distinct = (
        df.where(_known(value))
        .groupBy(*by, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"), w.alias("w"))
    )
    # contiguous ranges of the sort order, numbered by the partition they landed in
    distinct = cut_lineage(distinct.repartitionByRange(*by, "v").withColumn("b", F.spark_partition_id()))
    buckets = _bucket_table(distinct, by, F.sum("w")).drop("bw")
    inner = Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        distinct.alias("l")
        .join(buckets.alias("r"), _same("l", "r", [*by, "b"]))
        .select(*[F.col(f"l.{c}").alias(c) for c in by], "v", "n", "w", "l.b", "start", "total")
        .withColumn("upto", F.col("start") + F.sum("w").over(inner))
        .withColumn("before", F.col("upto") - F.col("w"))
        .drop("start")
    )


def number_rows(df: DataFrame, order: Sequence[str], out: str = "row", total: str = "n_rows") -> DataFrame:
    """Rows numbered from 0 in ``order``, and how many there are. Equal keys are numbered in any order.

    Rows are dealt into stored ranges and numbered inside them; a table of one row per range tells where each begins.
    """
    order = list(order)
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))
    starts = _started(dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("bw")), [], ["_b"])
    starts = starts.select("_b", F.col("start").alias("_start"), F.col("total").cast("long").alias(total))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    rows = dealt.withColumn("_in", inner).join(starts, "_b")
    return rows.select(*df.columns, (F.col("_start") + F.col("_in") - 1).cast("long").alias(out), total)


def _started(table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``start``: the weight before each bucket of its group; ``total``: the group's."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    return table.withColumns(
        {
            "start": F.coalesce(F.sum("bw").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("bw").over(Window.partitionBy(*by)),
        }
    )


def _bucket_table(df: DataFrame, by: list[str], w: Column) -> DataFrame:
    """Weight of every occupied bucket with the weight before it and the group's total."""
    return _started(df.groupBy(*by, "b").agg(w.alias("bw")), by, ["b"])


def _select_buckets(df: DataFrame, value: str, by: list[str], weight: str | None, wanted: Column) -> DataFrame:
    """Cumulated distinct values of the buckets where ``wanted`` holds.

    Scans instead of a shuffle of the table: the first only counts buckets, the next cuts the few buckets a wanted
    rank falls into, and the last keeps the steps that hold one.
    """
    rows = df.where(_known(value)).withColumn("b", value_bucket(value))
    w = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1))
    v = F.col(value).cast("double")
    ends = rows.groupBy(*by, "b").agg(w.alias("bw"), F.count(F.lit(1)).alias("rows"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    hit = _started(ends, by, ["b"]).where(wanted)
    steps = F.ceil(F.col("rows") / _CROWD)
    step = F.when((steps > 1) & (F.col("hi") > F.col("lo")), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps), steps - 1)).otherwise(0)
    near = _beside(rows, hit.select(*by, "b", "lo", "hi", "rows", F.col("start").alias("first"), "total"), [*by, "b"]).withColumn("s", step)
    parts = near.groupBy(*by, "b", "s").agg(w.alias("bw"), F.first("first").alias("first"), F.first("total").alias("total"))
    before = Window.partitionBy(*by, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.col("first") + F.coalesce(F.sum("bw").over(before), F.lit(0))).where(wanted)
    kept = _beside(near.drop("first", "total"), parts.select(*by, "b", "s", "start", "total"), [*by, "b", "s"])
    distinct = kept.groupBy(*by, "b", "s", F.col(value).alias("v"), "start", "total").agg(w.alias("w"))
    inner = Window.partitionBy(*by, "b", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return distinct.withColumn("upto", F.col("start") + F.sum("w").over(inner)).withColumn(
        "before", F.col("upto") - F.col("w")
    )


def _beside(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL."""
    named = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one column ``q0..qN`` per probability."""
    by = list(by)
    pos = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    ranks = [r for h in pos for r in (F.floor(h), F.ceil(h))]
    wanted = _any([(F.col("start") <= r) & (r < F.col("start") + F.col("bw")) for r in ranks])
    cum = _select_buckets(df, value, by, None, wanted)
    aggs = []
    for i in range(len(probs)):
        lo, hi = ranks[2 * i], ranks[2 * i + 1]
        aggs += [
            F.max(F.when((F.col("before") <= lo) & (lo < F.col("upto")), F.col("v"))).alias(f"lo{i}"),
            F.max(F.when((F.col("before") <= hi) & (hi < F.col("upto")), F.col("v"))).alias(f"hi{i}"),
        ]
    out = cum.groupBy(*by).agg(F.max("total").alias("n"), *aggs)
    frac = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    return out.select(
        *by,
        "n",
        *[
            # equal neighbours need no sum, which two infinities do not have
            F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}").cast("double"))
            .when(h == F.floor(h), F.col(f"lo{i}").cast("double"))
            .otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (h - F.floor(h)))
            .alias(f"q{i}")
            for i, h in enumerate(frac)
        ],
    )


def percentile_rows(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles as rows: position ``i`` of the probability, ``n`` and ``q``. The plan does not grow with ``probs``."""
    by = list(by)
    every = F.lit([float(p) for p in probs])

    def near(p):
        h = (F.col("total") - 1) * p
        return F.floor(h), F.ceil(h)

    def inside(rank, low, high):
        return (low <= rank) & (rank < high)

    start, end = F.col("start"), F.col("start") + F.col("bw")
    cum = _select_buckets(df, value, by, None, F.exists(every, lambda p: inside(near(p)[0], start, end) | inside(near(p)[1], start, end)))
    before, upto = F.col("before"), F.col("upto")
    met = F.transform(every, lambda p, i: F.struct(i.alias("i"), p.alias("p"), inside(near(p)[0], before, upto).alias("_lo"), inside(near(p)[1], before, upto).alias("_hi")))
    hits = cum.select(*by, "v", "total", F.inline(F.filter(met, lambda m: m["_lo"] | m["_hi"])))
    ends = [F.max(F.when(F.col(c), F.col("v").cast("double"))).alias(c) for c in ("_lo", "_hi")]
    out = hits.groupBy(*by, "i", "p").agg(F.max("total").alias("n"), *ends)
    part = (F.col("n") - 1) * F.col("p")
    part = part - F.floor(part)
    # equal neighbours need no sum, which two infinities do not have
    q = F.when((F.col("_lo") == F.col("_hi")) | (part == 0), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part)
    return out.select(*by, "i", "n", q.alias("q"))


def weighted_quantiles(
    df: DataFrame, value: str, weight: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Weighted quantiles (A15): first value whose cumulative weight reaches p*W;
    where it equals p*W the midpoint with the next value is taken.
    """
    by = list(by)
    kept = df.where((F.col(weight) > 0) & _known(value) & _known(weight))
    # sums in another order differ in the last digits, so equality has a small tolerance
    slack = F.col("total") * F.lit(1e-12)
    targets = [F.col("total") * F.lit(float(p)) for p in probs]
    end = F.col("start") + F.col("bw")
    last = F.col("start") + F.col("bw") >= F.col("total") - slack
    wanted = _any([(F.col("start") <= t + slack * 2) & ((end >= t - slack * 2) | last) for t in targets])
    cum = _select_buckets(kept, value, by, weight, wanted)
    aggs = []
    for i, t in enumerate(targets):
        aggs += [
            F.min(F.when(F.col("upto") >= t - slack, F.col("v"))).alias(f"lo{i}"),
            F.min(F.when(F.col("upto") > t + slack, F.col("v"))).alias(f"hi{i}"),
        ]
    out = cum.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[((F.col(f"lo{i}") + F.coalesce(f"hi{i}", f"lo{i}")) / 2).alias(f"q{i}") for i in range(len(probs))],
    )


def attach_by_value(
    df: DataFrame, key: str, table: DataFrame, out: Sequence[str], spread: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Left join of a per-value table (one row per group and ``v``, with ``n`` and ``total``)
    back on the rows, safe against hot values.

    Values holding over a thousandth of a group's rows are at most a thousand per group, so that
    part is broadcast when there is one group, and small enough for Spark to do so otherwise; all other rows
    take the shuffle join. NULL and already matched rows get spread-out keys that match nothing.
    """
    by = list(by)
    hot = table.where(F.col("n") * 1000 > F.col("total")).select(
        *[F.col(c).alias(f"_hb_{c}") for c in by],
        F.col("v").alias("_hv"),
        F.lit(True).alias("_hot"),
        *[F.col(c).alias(f"_h_{c}") for c in out],
    )
    cold = table.where(F.col("n") * 1000 <= F.col("total")).select(
        *[F.col(c).alias(f"_cb_{c}") for c in by],
        F.lit(0).alias("_cs"),
        F.col("v").alias("_cv"),
        *[F.col(c).alias(f"_c_{c}") for c in out],
    )
    on_hot = F.col(key) == F.col("_hv")
    on_cold = (F.col("_ls") == F.col("_cs")) & (F.col("_lv") == F.col("_cv"))
    for c in by:
        on_hot = on_hot & F.col(c).eqNullSafe(F.col(f"_hb_{c}"))
        on_cold = on_cold & F.col(c).eqNullSafe(F.col(f"_cb_{c}"))
    done = ~_known(key) | F.col("_hot").isNotNull()
    # rows that are done get a NULL value, which matches nothing, under a number that spreads them
    salt = F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("int") + 1
    joined = (
        df.join(hot if by else F.broadcast(hot), on_hot, "left")
        .withColumns(
            {"_ls": F.when(done, salt).otherwise(0), "_lv": F.when(~done, F.col(key))}
        )
        .join(cold, on_cold, "left")
    )
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in out],
    )


def _raw_adjusted(cum: DataFrame, method: str) -> DataFrame:
    """p * m / rank at the largest rank of each tie, before the running minimum."""
    if method not in ("fdr_bh", "fdr_by"):
        raise ValueError(f"unknown method {method!r}")
    raw = F.col("v") * F.col("total") / F.col("upto")
    if method == "fdr_by":
        # sum of 1/i for i <= m: exact below 1000, asymptotic series above (error < 1e-15)
        m = F.col("total").cast("double")
        exact = F.aggregate(
            F.sequence(F.lit(1), F.least(F.col("total"), F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i
        )
        series = F.log(m) + 0.57721566490153286 + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * F.pow(m, 4))
        raw = raw * F.when(F.col("total") <= 1000, exact).otherwise(series)
    return cum.withColumn("raw", raw)


def adjust_p(
    df: DataFrame,
    p: str,
    method: str = "fdr_bh",
    alpha: float = 0.10,
    spread: Sequence[str] = ("lat_idx", "lon_idx"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Benjamini-Hochberg / Benjamini-Yekutieli adjusted p and reject flag over the
    whole table, or each group of ``by`` (T6). Adds ``p_adj`` and ``reject``; NULL p stays NULL.

    Tied p-values share the adjusted value of their largest rank, so the whole
    computation runs on distinct p-values. ``df`` is read twice: store costly trends first.
    """
    by = list(by)
    cum = _raw_adjusted(cumulate(df, p, by), method)
    after = Window.partitionBy(*by).orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # bucket minima: a bounded table per group, so this window stays small
    tails = cum.groupBy(*by, "b").agg(F.min("raw").alias("bmin"))
    tails = tails.select(*by, "b", F.min("bmin").over(after).alias("tail"))
    inner = Window.partitionBy(*by, "b").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    table = (
        cum.alias("l")
        .join(tails.alias("r"), _same("l", "r", [*by, "b"]))
        .select(*[F.col(f"l.{c}").alias(c) for c in (*by, "b")], "v", "n", "total", "raw", "tail")
        .withColumn("p_adj", F.least(F.lit(1.0), F.min("raw").over(inner), F.col("tail")))
        .select(*by, "v", "n", "total", "p_adj")
    )
    return attach_by_value(df, p, table, ["p_adj"], spread, by).withColumn("reject", F.col("p_adj") <= alpha)


def reject_p(df: DataFrame, p: str, method: str = "fdr_bh", alpha: float = 0.10) -> DataFrame:
    """Only the reject flag of :func:`adjust_p`; NULL where p is NULL or NaN.

    Rejection is a threshold on p, so the table itself is never shuffled: one number is
    sent to every task.
    """
    cum = _raw_adjusted(cumulate(df, p), method)
    limit = cum.where(F.col("raw") <= alpha).agg(F.max("v").alias("_limit"))
    flag = F.when(_known(p), F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False)))
    return df.join(F.broadcast(limit)).withColumn("reject", flag).drop("_limit")  # one row


def whole_table_rank(df: DataFrame, value: str, out: str = "rank_avg", spread: Sequence[str] = ()) -> DataFrame:
    """Average rank of a value over the whole table (W9 without a partition)."""
    table = cumulate(df, value).withColumn(out, F.col("before") + (F.col("n") + 1) / 2.0)
    return attach_by_value(df, value, table.select("v", "n", "total", out), [out], spread or df.columns)
