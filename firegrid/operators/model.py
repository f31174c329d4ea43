"""Drivers model and scenario prediction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.functions.decode import reciprocal_floor
from firegrid.grid import CELL, GridSpec
from firegrid.operators.aggregate import interval_shares, season_climatology, weighted_mean_std
from firegrid.operators.masks import drop_null_rows, model_domain
from firegrid.operators.ordered import number_rows, percentile_rows, weighted_quantiles
from firegrid.operators.regrid import enlarge
from firegrid.operators.reshape import SEASONS, lattice_sample
from firegrid.operators.windows import moving_mean
from firegrid.session import cut_lineage

FEATURES = tuple(f"{v}{s}" for v in ("ppt", "tmean") for s in SEASONS)


def climate_columns(climate: DataFrame, variables: Sequence[str] = ("ppt", "tmean"), keys=CELL) -> DataFrame:
    """Seasonal climatology of each variable as columns: one aggregate over the monthly table."""
    clim = season_climatology(climate, variables, keys)
    aggs = [F.max(F.when(F.col("season") == s, F.col(v))).alias(f"{v}{s}") for v in variables for s in SEASONS]
    return clim.groupBy(*keys).agg(*aggs)


def feature_table(
    burn: DataFrame,
    climate: DataFrame,
    mask: DataFrame,
    g: GridSpec,
    bf_min: float,
    sub_deg: float | None = None,
    sf: int | None = None,
    var: str = "AnBF",
) -> DataFrame:
    """Training rows (L1): burned fraction, eight seasonal climate columns and tree cover.

    ``sf`` smooths the climate like the burned fraction; ``sub_deg`` thins the cells to a lattice to
    limit autocorrelation.
    """
    clim = climate_columns(climate)
    if sf:
        clim = enlarge(clim, g)
        clim = moving_mean(clim, FEATURES, sf)
    rows = burn.join(clim, list(CELL)).join(mask, list(CELL))
    if sub_deg:
        rows = lattice_sample(rows, g, sub_deg)
    return drop_null_rows(model_domain(rows, var, bf_min))


HASH_PRIME = 2_147_483_629


def hash_bucket(keys: Sequence[str] = CELL, salt: int = 0) -> Column:
    """Stable number 0..99 of a row (the same on every engine): both halves of every whole-number key are mixed in.

    Negative keys count like others, and products stay below 2**62.
    """
    mixed = F.lit(salt).cast("long")
    for k in keys:
        key = F.col(k).cast("long")
        for half in (F.pmod(key, F.lit(HASH_PRIME)), F.pmod(F.shiftright(key, 31), F.lit(HASH_PRIME))):
            mixed = (mixed * 31 + half + 17) % HASH_PRIME
            mixed = (mixed * 48_271 + 104_729) % HASH_PRIME
    return mixed % 100


def hash_split(df: DataFrame, keys: Sequence[str] = CELL, train: int = 80, salt: int = 0) -> DataFrame:
    """Train/test flag by key hash (L2): independent of partitioning, row order and reruns."""
    return df.withColumn("is_train", hash_bucket(keys, salt) < train)


class QuantileUniform:
    """Monotone map of features to uniform [0, 1] by their quantiles (L3). NULL stays, and a column without any value becomes NULL."""

    def __init__(self, knots: dict[str, list[float]]):
        self.knots = knots

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], n_quantiles: int = 100) -> QuantileUniform:
        """Exact quantiles of all columns in one chain of exchanges; only ``n_quantiles`` numbers per column reach the driver."""
        probs = [i / (n_quantiles - 1) for i in range(n_quantiles)]
        pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
        knots: dict[str, list[float]] = {}
        for r in percentile_rows(df.select(F.inline(F.array(*pairs))), "value", probs, ["column"]).orderBy("column", "i").collect():
            knots.setdefault(r["column"], []).append(r["q"])
        return cls({c: knots.get(c, []) for c in cols})

    def _position(self, c: str, below) -> Column:
        """How many knots hold ``below``, found by strides that halve."""
        xs = F.lit([float(v) for v in self.knots[c]])
        strides = F.lit([1 << i for i in reversed(range(len(self.knots[c]).bit_length()))])
        return F.aggregate(strides, F.lit(0), lambda at, step: F.when(below(F.get(xs, at + step - 1)), at + step).otherwise(at))

    def _map(self, c: str, lower: Column, upper: Column) -> Column:
        q, n = self.knots[c], len(self.knots[c])
        xs, x = F.lit([float(v) for v in q]), F.col(c).cast("double")
        a, b = F.get(xs, F.greatest(upper - 1, F.lit(0))), F.get(xs, F.least(upper, F.lit(n - 1)))
        between = F.greatest(upper, F.lit(1)) - 1 + F.when(b > a, (x - a) / (b - a)).otherwise(0.0)
        # mean of the lower and upper position keeps repeated knots symmetric
        mid = F.when(lower == upper, between).otherwise((lower + upper - 1) / 2.0) / F.lit(float(n - 1))
        return F.when(x.isNotNull(), F.when(x <= q[0], 0.0).when(x >= q[-1], 1.0).otherwise(mid))

    def transform(self, df: DataFrame) -> DataFrame:
        found = [c for c in self.knots if self.knots[c]]
        value = {c: F.col(c).cast("double") for c in found}
        # searched once per row, in columns of their own
        lower = {f"_lower_{c}": self._position(c, lambda k, x=value[c]: k < x) for c in found}
        upper = {f"_upper_{c}": self._position(c, lambda k, x=value[c]: k <= x) for c in found}
        mapped = {c: self._map(c, F.col(f"_lower_{c}"), F.col(f"_upper_{c}")) for c in found}
        empty = {c: F.lit(None).cast("double") for c in self.knots if not self.knots[c]}
        return df.withColumns({**lower, **upper}).withColumns({**mapped, **empty}).drop(*lower, *upper)


def fit_models(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    kinds: Sequence[str] = ("linear", "gbt"),
    trees: int = 40,
    depth: int = 6,
    patience_tol: float = 0.001,
    seed: int = 42,
) -> dict[str, PipelineModel]:
    """Linear and boosted-tree regressors (L4, L5). A tenth of the training cells, chosen by
    hash, tells the booster when to stop.
    """
    out = {}
    for kind in kinds:
        assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
        data = train
        if kind == "linear":
            est = LinearRegression(featuresCol="_features", labelCol=target, predictionCol=f"pred_{kind}")
        elif kind == "gbt":
            data = train.withColumn("_valid", hash_bucket(CELL, salt=7) < 10)
            est = GBTRegressor(
                featuresCol="_features",
                labelCol=target,
                predictionCol=f"pred_{kind}",
                maxIter=trees,
                maxDepth=depth,
                stepSize=0.1,
                seed=seed,
                validationIndicatorCol="_valid",
                validationTol=patience_tol,
            )
        elif kind == "forest":
            est = RandomForestRegressor(
                featuresCol="_features",
                labelCol=target,
                predictionCol=f"pred_{kind}",
                numTrees=trees,
                maxDepth=depth,
                seed=seed,
            )
        else:
            raise ValueError(f"unknown model {kind!r}")
        out[kind] = Pipeline(stages=[assembler, est]).fit(data)
    return out


class BoostedForests:
    """A start value plus scaled forests, each fitted to what the ones before it left over."""

    def __init__(self, features: Sequence[str], start: float, rate: float, forests: Sequence, pred: str, errors: Sequence[float]):
        self.features, self.start, self.rate, self.forests, self.pred, self.errors = list(features), start, rate, list(forests), pred, list(errors)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction. Rows with a missing feature are left out, as by the other models."""
        out = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="skip").transform(df)
        out = out.withColumn(self.pred, F.lit(self.start))
        for forest in self.forests:
            out = _with_forest(out, forest, self.pred, self.rate)
        return out.drop("_features")


def _with_forest(df: DataFrame, forest, pred: str, rate: float) -> DataFrame:
    return forest.transform(df).withColumn(pred, F.col(pred) + rate * F.col("_forest")).drop("_forest")


def fit_boosted_forests(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    rounds: int = 2000,
    trees: int = 20,
    depth: int = 20,
    rate: float = 0.1,
    column_share: float = 0.3,
    patience: int = 15,
    seed: int = 42,
    pred: str = "pred_forests",
    keys: Sequence[str] = CELL,
) -> BoostedForests:
    """Boosting by a forest of ``trees`` trees per round.

    Each split sees a share of the columns. A tenth of the cells, chosen by hash, is never fitted to: when its squared
    error has not fallen for ``patience`` rounds, the rounds after the best are dropped. Without such cells all rounds are kept.
    The running prediction is stored every round, so a round costs the same however many came before. Rows with a
    missing feature or target are left out; a table without rows to fit is an error.
    """
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(train.where(F.col(target).isNotNull()))
    rows = rows.select("_features", F.col(target).cast("double").alias("_y"), (hash_bucket(keys, salt=7) < 10).alias("_valid"))
    start = rows.where("NOT _valid").agg(F.avg("_y")).first()[0]
    if start is None:
        raise ValueError("no rows to fit")
    state = cut_lineage(rows.withColumn(pred, F.lit(start)))
    forests, errors, best = [], [], 0
    for i in range(rounds):
        grower = RandomForestRegressor(
            featuresCol="_features",
            labelCol="_rest",
            predictionCol="_forest",
            numTrees=trees,
            maxDepth=depth,
            featureSubsetStrategy=str(column_share),
            seed=seed + i,
        )
        forests.append(grower.fit(state.where("NOT _valid").withColumn("_rest", F.col("_y") - F.col(pred))))
        state = cut_lineage(_with_forest(state, forests[-1], pred, rate))
        error = state.where("_valid").agg(F.avg(F.pow(F.col("_y") - F.col(pred), 2))).first()[0]
        errors.append(error)
        if error is None:
            best = i
        elif i == 0 or error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return BoostedForests(features, start, rate, forests[: best + 1], pred, errors)


def r2(df: DataFrame, y: str, yhat: str, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE/SST, optionally on a subset."""
    kept = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    if where is not None:
        kept = kept.where(where)
    sst = F.var_pop(y) * F.count(y)
    sse = F.sum(F.pow(F.col(y) - F.col(yhat), 2))
    return kept.groupBy(*by).agg((F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), F.count(y).alias("n"))


# rounds of the keyed order of rows
ROUNDS = 32


def moved_place(row: Column, n: Column, run: Column) -> Column:
    """Place 0..n-1 that row number ``row`` of ``n`` takes its value from in run ``run``: a permutation of all rows.

    A swap-or-not shuffle: in every round each place has one partner, the other end of a keyed sum, and a keyed bit
    of the pair decides whether the two change places. It needs no table, whatever ``n`` is.
    """
    p = HASH_PRIME

    def swapped(x, i):
        c = (run * 48_271 + i * 69_621 + 104_729) % p
        key = ((c * c + 16_807) % p * p + (c * 39_373 + i) % p) % n
        other = (key - x + n) % n
        top = F.greatest(x, other)
        bit = (top % p * ((c * 69_621 + 12_345) % p) + F.floor(top / p).cast("long") * 39_373 + c) % p
        return F.when((bit * bit + 16_807) % p % 2 == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), row.cast("long"), swapped)


def permuted_rows(df: DataFrame, features: Sequence[str], repeats: int = 5, keys: Sequence[str] = CELL) -> DataFrame:
    """Rows once per ``feature`` and ``rep``, that feature's values moved among all rows.

    Rows are numbered in order of ``keys``; run ``position of the feature * repeats + rep`` has its own keyed
    permutation of the numbers, and values come by one join on (run, number) for all runs.
    """
    rows = number_rows(df, keys, "_row", "_n")
    runs = [F.struct(F.lit(c).alias("feature"), F.lit(r).alias("rep"), F.lit(i * repeats + r).cast("long").alias("_run")) for i, c in enumerate(features) for r in range(repeats)]
    own = F.lit(None).cast("double")
    for c in features:
        own = F.when(F.col("feature") == c, F.col(c).cast("double")).otherwise(own)
    runs_of = F.inline(F.array(*runs))
    given = rows.select(F.col("_row").alias("_from"), *features, runs_of).select("_from", F.col("_run").alias("_for"), own.alias("_new"))
    taken = rows.select("*", runs_of).withColumn("_at", moved_place(F.col("_row"), F.col("_n"), F.col("_run")))
    moved = taken.join(given, (F.col("_run") == F.col("_for")) & (F.col("_at") == F.col("_from")))
    moved = moved.withColumns({c: F.when(F.col("feature") == c, F.col("_new")).otherwise(F.col(c).cast("double")) for c in features})
    return moved.select(*df.columns, "feature", "rep")


def permutation_importance(
    model: PipelineModel,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    pred: str,
    repeats: int = 5,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Loss of R2 when one feature is shuffled among all rows.

    Mean and spread over ``repeats`` runs; a run that moves nothing gives the base score. A table without rows gives none.
    """
    rows = test.select(*dict.fromkeys([*keys, *features, target]))
    scored = r2(model.transform(permuted_rows(rows, features, repeats, keys)), target, pred, by=["feature", "rep"])
    base = r2(model.transform(rows), target, pred).select(F.col("r2").alias("base"))
    # one row of base score against one row per feature and repeat
    drop = scored.join(F.broadcast(base)).withColumn("loss", F.col("base") - F.col("r2"))
    return drop.groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("spread"))


def tree_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Split-gain importance of a fitted tree model."""
    fit = model.stages[-1]
    rows = [(f, float(fit.featureImportances[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double")


def trend_scenario(
    clim: DataFrame,
    slopes: DataFrame,
    cols: Sequence[str],
    years: Sequence[int],
    sig_only: bool = False,
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Climate after N more years of its present trend.

    ``slopes`` holds ``slope_<col>`` and, for ``sig_only``, ``sig_<col>``. A missing slope
    counts as no change. Horizons are exploded per cell.
    """
    joined = clim.join(slopes, list(keys), "left").withColumn("horizon", F.explode(F.array(*[F.lit(y) for y in years])))
    out = {}
    for c in cols:
        s = F.coalesce(F.col(f"slope_{c}"), F.lit(0.0))
        if sig_only:
            s = F.when(F.coalesce(F.col(f"sig_{c}"), F.lit(False)), s).otherwise(0.0)
        out[c] = F.col(c) + s * F.col("horizon")
    return joined.withColumns(out).select(*keys, "horizon", *cols)


def given_scenario(clim_future: DataFrame, domain: DataFrame, cols: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Future climatology on the cells of a domain (L9), with the number of missing values per row."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])
    return domain.select(*keys).join(clim_future.select(*keys, *cols), list(keys), "left").withColumn("n_missing", missing)


def predict(models: dict[str, PipelineModel], df: DataFrame, floor: float) -> DataFrame:
    """Predictions of every model, not below ``floor`` (L10). Rows with missing features keep NULL."""
    features = models[next(iter(models))].stages[0].getInputCols()
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    out = df.where(complete)
    for kind, m in models.items():
        out = m.transform(out).drop("_features")
        out = out.withColumn(f"pred_{kind}", F.greatest(F.col(f"pred_{kind}"), F.lit(float(floor))))
    rest = df.where(~complete).withColumns({f"pred_{k}": F.lit(None).cast("double") for k in models})
    return out.unionByName(rest)


def prediction_stats(
    df: DataFrame, by: Sequence[str], x: str, w: Column, edges: Sequence[float], probs: Sequence[float] = (0.05, 0.5, 0.95)
) -> DataFrame:
    """Weighted mean, spread, quantiles and interval shares of predictions by run."""
    weighted = df.withColumn("_w", w)
    parts = [
        weighted_mean_std(weighted, x, "_w", by),
        weighted_quantiles(weighted, x, "_w", probs, by),
        interval_shares(weighted, x, edges, F.col("_w"), by),
    ]
    # one row per run on every side; NULL is a run like any other

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        named = b.withColumnsRenamed({c: f"_{c}" for c in by})
        return a.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])

    return reduce(beside, parts)


def prediction_frames(current: DataFrame, futures: DataFrame, x: str, floor: float = 1e-6) -> DataFrame:
    """Mean of the current runs with every future, as intervals.

    ``current``: cells with one row per run; ``futures``: cells with ``horizon``.
    """
    now = current.groupBy(*CELL).agg(F.avg(x).alias(x)).withColumn("horizon", F.lit(0))
    both = now.select(*CELL, "horizon", x).unionByName(futures.select(*CELL, "horizon", x))
    return both.withColumn("FRI", reciprocal_floor(x, floor))


def residuals(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """Residuals in burned-fraction and in interval space."""
    return df.withColumns(
        {
            "res_fraction": F.col(obs) - F.col(pred),
            "res_interval": F.lit(1.0) / F.nullif(F.col(obs), F.lit(0.0)) - F.lit(1.0) / F.nullif(F.col(pred), F.lit(0.0)),
        }
    )


