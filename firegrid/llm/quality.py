"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to a in is that it for on with as be at by this from or are was not "
    "der die das und den von zu mit ist im ein eine nicht auf für "
    "le la les de des du et un une en que qui dans pour est "
    "el los las y por con se su al del"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes where ``lo * denominator <= numerator <= hi * denominator``; a bound of None is open."""

    name: str
    numerator: str
    denominator: str
    lo: float | None = None
    hi: float | None = None


# base rules come first: too short, or made of repeated passages
BASE = (
    Rule("few_words", "n_words", "one", lo=20),
    Rule("repeated_passages", "n_repeat_words", "n_words", hi=0.30),
)
THRESHOLDS = (
    Rule("many_words", "n_words", "one", hi=1_000_000),
    Rule("word_length", "word_chars", "n_words", lo=2, hi=15),
    Rule("symbols", "n_symbols", "n_words", hi=0.20),
    Rule("stop_words", "n_stop_words", "one", lo=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", hi=0.50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", hi=0.90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", hi=0.30),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows found twice or more, from the words' hashes."""
    n = F.size(hashes)

    def covered(windows: Column) -> Column:
        # (hash, place) in order: equal windows are neighbours
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            m = F.size(s)
            same = lambda a, b: s[a]["h"] == s[b]["h"]
            hit = lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < m - 1, same(k, k + 1)).otherwise(False)
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), m - 1), hit), lambda k: s[k]["i"]))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), p[k + 1] - x)).otherwise(WINDOW))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(placed, places), width)

    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
    some = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(n > WINDOW, some).otherwise(0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the counts that the rules speak of (long).

    Words are runs of characters other than space and \\t \\n \\v \\f \\r. NULL and empty texts have none, all counts
    are zero. Texts of any length are measured whole; windows of eight words are compared by 64-bit hashes of them.
    Columns of ``docs`` with the same names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda c: F.size(c).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    firsts = docs.withColumns(
        {
            "_words": F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
            "_lines": lines,
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        }
    )
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return firsts.withColumns(
        {
            "n_words": count("_words"),
            "n_lines": count("_lines"),
            "n_dup_lines": _let(F.col("_lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _let(F.transform("_words", lambda w: F.xxhash64(w)), _repeat_words).cast("long"),
            "n_stop_words": count(F.array_intersect(F.transform("_words", lambda w: F.lower(w)), stop)),
            "n_bullet_lines": count(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))),
            "n_ellipsis_lines": count(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        }
    ).drop("_words", "_lines")


def verdict(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that fail, as an array; a ratio with a denominator of zero fails no rule."""

    def fails(r: Rule) -> Column:
        part = F.col(r.numerator)
        whole = F.lit(1) if r.denominator == "one" else F.col(r.denominator)
        bad = F.lit(False)
        # in thousandths, whole numbers: no rounding decides
        if r.lo is not None:
            bad = bad | (part * 1000 < whole * round(r.lo * 1000))
        if r.hi is not None:
            bad = bad | (part * 1000 > whole * round(r.hi * 1000))
        return F.when(bad & (whole > 0), F.lit(r.name))

    return F.array_compact(F.array(*[fails(r) for r in rules]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``failed`` (names of failing rules) and ``kept``."""
    m = measures(docs, text).withColumns({"_base": verdict(base), "_own": verdict(rules)})
    out = m.withColumns({"base_failed": F.size("_base") > 0, "failed": F.concat("_base", "_own"), "kept": F.size("_base") + F.size("_own") == 0})
    return out.drop("_base", "_own")
