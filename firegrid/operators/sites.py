"""Site histories: observer forms, event groups and scoring against products.

A site's frames and years are bounded by its scene catalogue and the calendar, its
observations are not. So rows are first merged to distinct frames or years
(combinable aggregates); the order-dependent rules then run on those few values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec
from firegrid.operators.joins import lookup_points, resolve_dates
from firegrid.operators.reshape import unpivot_events
from firegrid.operators.windows import after_first

EVENT_CLASSES = (
    "CorrectDetection",
    "SpatialUnder",
    "SpatialOver",
    "FalseNegative",
    "FalsePositive",
    "CorrectNonDetection",
)


def event_seeds(df: DataFrame, tol: int = 5, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Seed frames of each (site, fire flag): the first frame, then every first frame at
    least ``tol`` beyond the last seed.
    """
    frames = F.sort_array(F.collect_set("frame"))
    fold = F.aggregate(
        F.col("_frames"),
        F.array().cast(f"array<{dict(df.dtypes)['frame']}>"),
        lambda acc, f: F.when(
            (F.size(acc) == 0) | (f - F.element_at(acc, -1) >= tol), F.concat(acc, F.array(f))
        ).otherwise(acc),
    )
    return (
        df.where(F.col("frame").isNotNull() & F.col("is_fire").isNotNull())
        .groupBy(*keys, "is_fire")
        .agg(frames.alias("_frames"))
        .select(*keys, "is_fire", fold.alias("seeds"))
    )


def group_events(df: DataFrame, tol: int = 5, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Events of several observers grouped by nearness in frames and equal fire flag.

    Adds ``seed`` (the group's seed frame) and ``overlap``: a row within reach of two
    seeds belongs to the later one, which took it over from the earlier.
    """
    seeds = event_seeds(df, tol, keys)
    near = F.filter("seeds", lambda s: F.abs(s - F.col("frame")) < tol)
    return (
        df.where(F.col("frame").isNotNull())
        .join(seeds, [*keys, "is_fire"])
        .withColumn("_near", near)
        .withColumns({"seed": F.element_at("_near", -1), "overlap": F.size("_near") > 1})
        .drop("_near", "seeds")
    )


def agreement(grouped: DataFrame, forms: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Share of a site's observers that saw each event."""
    seen = grouped.select(*keys, "is_fire", "seed", "observer").distinct()
    per_event = seen.groupBy(*keys, "is_fire", "seed").agg(F.count(F.lit(1)).alias("n_observers"))
    observers = forms.select(*keys, "observer").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_forms"))
    return per_event.join(observers, list(keys)).withColumn("agree", F.col("n_observers") / F.col("n_forms"))


def site_loss(events: DataFrame) -> DataFrame:
    """Stand loss at the site, per event: land use always, fire only when stand replacing, nothing when the
    site was not impacted.
    """
    hit = F.coalesce(F.col("site_impacted") == 1, F.lit(False))
    loss = (
        F.when(~hit, 0)
        .when((F.col("is_fire") == 1) & (F.col("stand_rep") == 1), 1)
        .when(F.col("is_fire") == 0, 1)
        .otherwise(0)
    )
    return events.withColumns({"s_imp": F.when(hit, 1).otherwise(0), "site_loss": loss})


def disturbance_series(
    forms: DataFrame, catalogue: DataFrame | None = None, n_events: int = 7, tol: int = 5
) -> DataFrame:
    """Disturbances of each site in frame order.

    From wide forms (``FrameNN, DateNN, IsFireNN, SiteImpactedNN, StandRepNN``): unpivot,
    check dates against the scene catalogue, derive stand loss, merge observers. Sites
    with one form keep their events as they are. Empty forms count as forms; a site whose forms are all empty
    has one row without an event.
    """
    prefixes = ("Frame", "Date", "IsFire", "SiteImpacted", "StandRep")
    long = unpivot_events(forms, ["site", "observer"], prefixes, n_events).withColumnsRenamed(
        {"isfire": "is_fire", "siteimpacted": "site_impacted", "standrep": "stand_rep"}
    )
    return series_from_events(long, catalogue, tol, forms)


def series_from_events(long: DataFrame, catalogue: DataFrame | None = None, tol: int = 5, forms: DataFrame | None = None) -> DataFrame:
    """The same from a long event table ``site, observer, frame, date, is_fire, site_impacted, stand_rep``.

    ``forms``: every (site, observer) that handed in a form, by default those of the table.
    """
    events = long.where(F.col("frame").isNotNull())
    if catalogue is not None:
        events = resolve_dates(events, catalogue).drop("date_ok")
    events = site_loss(events)
    forms = long if forms is None else forms
    counted = forms.select("site", "observer").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("n_forms"))
    events = events.join(counted, "site")
    many = group_events(events.where(F.col("n_forms") > 1), tol)
    merged = (
        many.groupBy("site", "is_fire", "seed", "n_forms", "observer")
        .agg(
            F.min("frame").alias("frame"),
            F.min("date").alias("date"),
            F.max("s_imp").alias("s_imp"),
            F.max("site_loss").alias("site_loss"),
        )
        .groupBy("site", "is_fire", "seed", "n_forms")
        .agg(
            F.min("frame").alias("frame"),
            F.min("date").alias("date"),
            F.max("s_imp").alias("s_imp"),
            F.max("site_loss").alias("site_loss"),
            F.count(F.lit(1)).alias("n_observers"),
        )
        .select("site", "frame", "date", "is_fire", "s_imp", "site_loss", (F.col("n_observers") / F.col("n_forms")).alias("agree"))
    )
    single = events.where(F.col("n_forms") == 1).select(
        "site", "frame", "date", "is_fire", "s_imp", "site_loss", F.lit(1.0).alias("agree")
    )
    # equal events of a single form are merged too, so a site's rows stay within its frames
    series = merged.unionByName(single).groupBy("site", "frame", "is_fire").agg(
        F.min("date").alias("date"),
        F.max("s_imp").alias("s_imp"),
        F.max("site_loss").alias("site_loss"),
        F.max("agree").alias("agree"),
    )
    series = counted.select("site").join(series, "site", "left")
    return after_first(series, "site_loss", ["site"], "frame", out="post_loss")


def observer_counts(events: DataFrame) -> DataFrame:
    """Disturbances and fires, overall and at the site, per form; then mean, least and most per site."""
    fire = F.coalesce(F.col("is_fire"), F.lit(0))
    hit = F.coalesce(F.col("site_impacted"), F.lit(0))
    per_form = events.groupBy("site", "observer").agg(
        F.count(F.lit(1)).alias("TotDist"),
        F.sum(fire).alias("TotFire"),
        F.sum(hit).alias("SiteDist"),
        F.sum(fire * hit).alias("SiteFire"),
    )
    names = ("TotDist", "TotFire", "SiteDist", "SiteFire")
    return per_form.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_forms"),
        *[F.avg(c).alias(f"Mean{c}") for c in names],
        *[F.min(c).alias(f"Min{c}") for c in names],
        *[F.max(c).alias(f"Max{c}") for c in names],
    )


def disturbance_counts(series: DataFrame) -> DataFrame:
    """Disturbances and fires after the first stand loss, that one excluded.

    Sites without an impact after a loss give NULL.
    """
    hit = (F.col("post_loss") == 1) & (F.col("s_imp") == 1)
    fire = hit & (F.col("is_fire") == 1)
    first = F.min_by(F.when(hit, F.col("is_fire")), F.when(hit, F.struct(F.col("frame"), F.col("is_fire"))))
    out = series.groupBy("site").agg(
        F.count_if(hit).alias("_n"), F.count_if(fire).alias("_f"), first.alias("_first"), F.count(F.lit(1)).alias("n_events")
    )
    some = F.col("_n") > 0
    return out.select(
        "site",
        "n_events",
        F.when(some, F.col("_n") - 1).alias("PostFLdist"),
        F.when(some, F.col("_f") - F.col("_first")).alias("PostFLfire"),
    )


# what counts as an event at the site, and at or next to it, for a product that maps ...
TRUTH_RULES = {
    "loss": ("s_imp = 1 AND site_loss = 1", "site_loss = 1"),
    "loss_with_fire": ("is_fire = 1 AND s_imp = 1 AND site_loss = 1", "is_fire = 1"),
    "burned_area": ("is_fire = 1 AND s_imp = 1", "is_fire = 1"),
}


def truth_lists(series: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """Site-years of a disturbance series that a product should show, and those that excuse it.

    ``rule``: what the product maps, one of ``TRUTH_RULES``. Events without a date have no year and are left out.
    """
    years = series.where("date IS NOT NULL").withColumn("year", F.year("date"))
    return tuple(years.where(r).select("site", "year").distinct() for r in TRUTH_RULES[rule])


def score_events(
    truth: DataFrame,
    site_hist: DataFrame,
    box_hist: DataFrame,
    start: int,
    end: int,
    adjacent: DataFrame | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Events of a product against the known ones, per site.

    ``truth``: site-years with an event at the site; ``adjacent``: with an event at or next to it
    (``truth`` by default); ``site_hist`` and ``box_hist``: the product's years at the
    site and in its box. Years in only one list may pair with the following year of
    the other; a pair uses up the later year. Since a year can only be used up by the
    one before it, the rule alternates along runs of consecutive candidate years. A site of
    ``sites`` without any such year is one correct non-detection; without that list only sites with a year are scored.
    """
    adjacent = truth if adjacent is None else adjacent

    def years(df, flag, bounded):
        out = df.where(F.col("year").isNotNull())
        if bounded:
            out = out.where(F.col("year").between(start, end))
        return out.select("site", "year", *[F.lit(1 if f == flag else 0).alias(f) for f in ("bn", "ab", "da", "ba")])

    stacked = (
        years(truth, "bn", True)
        .unionByName(years(adjacent, "ab", True))
        .unionByName(years(site_hist, "da", False))
        .unionByName(years(box_hist, "ba", False))
        .groupBy("site", "year")
        .agg(*[F.max(f).alias(f) for f in ("bn", "ab", "da", "ba")])
    )
    site = Window.partitionBy("site")
    order = site.orderBy("year")
    rows = stacked.withColumns({f"n_{f}": F.sum(f).over(site) for f in ("bn", "ab", "da", "ba")}).withColumns(
        {
            f"next_{f}": F.when(F.lead("year").over(order) == F.col("year") + 1, F.lead(f).over(order)).otherwise(0)
            for f in ("bn", "da")
        }
    )
    c = F.col
    both = (c("bn") == 1) & (c("da") == 1)
    only_truth = (c("bn") == 1) & (c("da") == 0)
    only_map = (c("bn") == 0) & (c("da") == 1)
    pairs = (only_truth & (c("ba") == 0) & (c("next_da") == 1)) | (only_map & (c("ab") == 0) & (c("next_bn") == 1))
    rows = rows.withColumn("pairs", pairs)
    run_start = ~(
        F.coalesce(F.lag("pairs").over(order), F.lit(False))
        & (F.coalesce(F.lag("year").over(order), F.lit(-1)) == c("year") - 1)
    )
    rows = rows.withColumn("_run", F.sum(run_start.cast("int")).over(order))
    rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy("site", "_run").orderBy("year")) - 1)
    # position in its run tells whether the year before used this one up
    rows = rows.withColumn("used", c("_pos") % 2 == 1)
    matched = c("pairs") & ~c("used")
    open_ = ~c("used")
    label = (
        F.when(both, "CorrectDetection")
        .when(only_truth & (c("ba") == 1), "SpatialUnder")
        .when(only_map & (c("ab") == 1), "SpatialOver")
        .when(matched, "CorrectDetection")
        .when(only_truth, "FalseNegative")
        .when(only_map, "FalsePositive")
    )
    rows = rows.withColumn("label", F.when(open_, label))
    none = (c("n_bn") == 0) & (c("n_da") == 0)
    no_truth = (c("n_ab") == 0) & (c("n_da") > 0)
    no_box = (c("n_bn") > 0) & (c("n_ba") == 0)

    def tally(name):
        return F.count_if(c("label") == name)

    free = ~(none | no_truth | no_box)
    flags = rows.withColumns({"_none": none, "_fp": no_truth & ~none, "_fn": no_box & ~none & ~no_truth, "_free": free})
    out = flags.groupBy("site", "_none", "_fp", "_fn", "_free", "n_bn", "n_da").agg(
        *[tally(k).alias(f"_{k}") for k in EVENT_CLASSES[:-1]]
    )
    cols = {k: F.when(c("_free"), c(f"_{k}")).otherwise(F.lit(0)) for k in EVENT_CLASSES[:-1]}
    cols["FalsePositive"] = F.when(c("_fp"), c("n_da")).otherwise(cols["FalsePositive"])
    cols["FalseNegative"] = F.when(c("_fn"), c("n_bn")).otherwise(cols["FalseNegative"])
    cols["CorrectNonDetection"] = F.when(c("_none"), 1).otherwise(0)
    scored = out.select("site", *[v.cast("long").alias(k) for k, v in cols.items()])
    if sites is not None:
        quiet = {k: F.coalesce(k, F.lit(int(k == "CorrectNonDetection")).cast("long")).alias(k) for k in cols}
        scored = sites.select("site").distinct().join(scored, "site", "left").select("site", *quiet.values())
    return scored.withColumn("TotalEvents", sum((c(k) for k in EVENT_CLASSES[1:]), c(EVENT_CLASSES[0])))


def accuracy_table(scores: DataFrame, n_years: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over sites of the percent of each event class, and of its yearly rate."""
    kinds = EVENT_CLASSES[:-1]
    events = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    pct = [F.avg(F.col(k) / F.nullif(events, F.lit(0)) * 100).alias(f"pct_{k}") for k in kinds]
    rate = [F.avg(F.col(k) / F.lit(float(n_years)) * 100).alias(f"annual_{k}") for k in kinds]
    cnd = F.avg((F.lit(n_years) - events) / F.lit(float(n_years)) * 100).alias("annual_CorrectNonDetection")
    return scores.groupBy(*by).agg(F.sum(events).alias("n_events"), *pct, *rate, cnd)


def extract_series(df: DataFrame, sites: DataFrame, g: GridSpec, value: str = "value") -> Mapping[str, DataFrame]:
    """Series of each site's cell, complete and as monthly and annual maxima.

    The raster is reduced to months and years of its cells before sites see it, so however many sites share a
    cell, its rows are read once; only ``complete`` pairs every row with every site. Maxima come with the number of their
    rows, ``n_rows``. A NULL time is a month and a year of its own.
    """
    places = sites.select("site", "lat", "lon")
    months = df.groupBy(*CELL, F.trunc("t", "MM").alias("month_start")).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("n_rows"))
    years = months.groupBy(*CELL, F.year("month_start").alias("year")).agg(F.max(value).alias(value), F.sum("n_rows").alias("n_rows"))

    def at_sites(cells: DataFrame, step: str) -> DataFrame:
        # a site may be listed more than once
        return lookup_points(cells, places, g).groupBy("site", step).agg(F.max(value).alias(value), F.sum("n_rows").alias("n_rows"))

    full = lookup_points(df, places, g).select("site", "t", value)
    return {"complete": full, "monthly": at_sites(months, "month_start"), "annual": at_sites(years, "year")}


def check_mosaic(tiles: DataFrame, mosaic: DataFrame, sites: DataFrame, g: GridSpec, value: str = "value") -> DataFrame:
    """Agreement of raw tiles and their mosaic at the sites, NULL equal to NULL."""
    a = lookup_points(tiles.withColumnRenamed(value, "tile_value"), sites, g, "left")
    b = lookup_points(mosaic.withColumnRenamed(value, "mosaic_value"), sites, g, "left").select("site", "mosaic_value")
    return a.join(b, "site").select(
        "site", "tile_value", "mosaic_value", F.col("tile_value").eqNullSafe(F.col("mosaic_value")).alias("same")
    )
