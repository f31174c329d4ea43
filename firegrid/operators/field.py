"""Field survey text and seedling counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.grid import as_col

# fixed values: words of the recruitment column and the class they stand for.
# Later rules win over earlier ones except that a class, once given, no longer
# contains a later rule's word.
RECRUITMENT_RULES = (
    ("poor", "RF"),
    ("no regeneration", "RF"),
    ("singular", "IR"),
    ("sufficient", "IR"),
    ("sufficent", "IR"),
    ("sifficient", "IR"),
    ("abundunt", "AR"),
    ("abundant", "AR"),
)
# fixed values: variant used for the study-area table
RECRUITMENT_RULES_AREA = tuple((w, "AR" if w in ("sufficient", "sufficent", "sifficient") else c) for w, c in RECRUITMENT_RULES)
# fixed values: phrases that carry no year
FIRE_YEAR_NOISE = (
    " crown fire",
    "?",
    "and",
    " ",
    "crownhigh-severity",
    "-crownfire",
    "-high-severitysurfacefire",
)
FIRE_YEAR_FIRST, FIRE_YEAR_LAST = 1980, 2018


def clean_field(col: Column | str, rules: Sequence[tuple[str, str]] = RECRUITMENT_RULES) -> Column:
    """Free recruitment text to its class by ordered word rules (D14); unknown text stays."""
    c = as_col(col)
    out = c
    for word, cls in reversed(rules):
        out = F.when(F.contains(c, F.lit(word)), F.lit(cls)).otherwise(out)
    return out


def parse_fire_years(col: Column | str) -> Column:
    """All plausible years of a fire-year text, in order (D14): noise out, then groups of four digits."""
    c = F.replace(as_col(col).cast("string"), F.lit("(03)"), F.lit("2003"))
    for noise in FIRE_YEAR_NOISE:
        c = F.replace(c, F.lit(noise), F.lit(""))
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{4})")), lambda y: y.cast("int"))
    return F.filter(years, lambda y: y.between(FIRE_YEAR_FIRST, FIRE_YEAR_LAST))


def parse_fire_year(col: Column | str, first: int = FIRE_YEAR_FIRST) -> Column:
    """Year of the part before the first " and " (D15), NULL below ``first``."""
    part = F.element_at(F.split(as_col(col).cast("string"), " and "), 1)
    year = F.nullif(F.regexp_extract(part, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(year >= first, year)


# fixed values: plot formats, their usual misspellings and area in square metres
PLOT_ALIASES = {
    "seedlings per 2 m x 2 plot": "seedlings per 2 m x 2 m plot",
    "seedlings per 2 x 2 m plot": "seedlings per 2 m x 2 m plot",
    "seedlings per 2 m x 30 m": "seedlings per 2 m x 30 m plot",
    "seedlings per 15-m radius plot": "seedlings per 15 m radius plot",
    "seedlings per 15-m radius circle": "seedlings per 15 m radius plot",
}
PLOT_AREAS = {
    "seedlings per 2 m x 2 m plot": 40.0,
    "seedlings per 2 m x 30 m plot": 180.0,
    "seedlings per 15 m radius plot": 706.5,
}
# fixed values: tall-seedling equivalents of short, medium and tall; vigor weights
HEIGHT_WEIGHTS = (0.5, 0.8, 1.0)
VIGOR_WEIGHTS = {"healthy": 1.0, "weakened": 0.5}
# fixed values: height classes of the categorical survey
SHORT_CLASSES = ("1 yr sdlng", "0.11-0.25", "0.26-0.50")
MEDIUM_CLASSES = ("gte 0.1", "0.51-1.00", "1.01-2.00")
TALL_CLASSES = ("gt 2.01",)


def height_weight(height: Column | str) -> Column:
    """Tall-seedling equivalent by measured height in metres; exactly 1.5 m belongs to no class."""
    h = as_col(height)
    return (
        F.when(h <= 0.5, HEIGHT_WEIGHTS[0])
        .when((h > 0.5) & (h < 1.5), HEIGHT_WEIGHTS[1])
        .when(h > 1.5, HEIGHT_WEIGHTS[2])
        .otherwise(0.0)
    )


def height_class_weight(category: Column | str) -> Column:
    c = as_col(category)
    return (
        F.when(c.isin(*SHORT_CLASSES), HEIGHT_WEIGHTS[0])
        .when(c.isin(*MEDIUM_CLASSES), HEIGHT_WEIGHTS[1])
        .when(c.isin(*TALL_CLASSES), HEIGHT_WEIGHTS[2])
        .otherwise(0.0)
    )


def vigor_weight(vigor: Column | str) -> Column:
    v = F.when(as_col(vigor) == "heaithy", "healthy").otherwise(as_col(vigor))
    return F.when(v == "healthy", VIGOR_WEIGHTS["healthy"]).when(v == "weakened", VIGOR_WEIGHTS["weakened"]).otherwise(0.0)


def plot_area(fmt: Column | str) -> Column:
    f = F.trim(as_col(fmt))
    for bad, good in PLOT_ALIASES.items():
        f = F.when(f == bad, good).otherwise(f)
    out = F.lit(None).cast("double")
    for name, area in PLOT_AREAS.items():
        out = F.when(f == name, area).otherwise(out)
    return out


def stocking_density(seedlings: DataFrame, height: Column, vigor: Column, area: Column, key: str = "site") -> DataFrame:
    """Stocking density per site in thousands per hectare (A26): weighted seedlings over plot area, times ten."""
    weighted = seedlings.withColumns({"_w": height * vigor, "_a": area})
    return weighted.groupBy(key).agg((F.sum("_w") / F.max("_a") * 10).alias("density"), F.count(F.lit(1)).alias("n"))


# fixed values: quadrats of the categorical survey in square metres, whole transect and its first plots
TRANSECT_AREA, NEAR_AREA, NEAR_PLOTS = 10.0, 4.0, 30
# fixed values: classes that the first plots leave out
NOT_NEAR = ("1 yr sdlng", "gte 0.1")


def categorical_density(seedlings: DataFrame, category: Column, vigor: Column, plot: Column, key: str = "site") -> DataFrame:
    """Stocking density of the survey by height classes (A26): over the whole transect, and over its first plots.

    Quadrats without a seedling count as area without regrowth, so both areas are fixed.
    """
    w = height_class_weight(category) * vigor_weight(vigor)
    near = F.coalesce((plot <= NEAR_PLOTS) & ~category.isin(*NOT_NEAR), F.lit(False))
    return seedlings.withColumns({"_w": F.coalesce(w, F.lit(0.0)), "_near": near}).groupBy(key).agg(
        (F.sum("_w") / TRANSECT_AREA * 10).alias("density"), (F.sum(F.when(F.col("_near"), F.col("_w")).otherwise(0.0)) / NEAR_AREA * 10).alias("density_near")
    )


def fraction_of_threshold(density: DataFrame, thresholds: DataFrame, key: str = "site") -> DataFrame:
    """Density over the site's sufficiency threshold (A27); sites without one give NULL."""
    return density.join(thresholds, key, "left").withColumn(
        "fraction", F.col("density") / F.nullif(F.col("threshold"), F.lit(0.0))
    )
