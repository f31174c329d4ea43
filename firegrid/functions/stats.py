"""Test probabilities as Spark expressions (no scipy on the executors)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from firegrid.grid import as_col


def t_pvalue_from_r(r, nu) -> Column:
    """Two-sided p of a correlation ``r`` with integer ``nu`` degrees of freedom.

    Finite trigonometric series of Student's t (Abramowitz & Stegun 26.7.3-4)
    with sin(theta)=|r|: about nu/2 terms, folded in place.
    """
    # every piece appears once or twice: the expression is inlined wherever p is used
    s = F.least(F.abs(as_col(r)), F.lit(1.0))
    n = as_col(nu).cast("int")
    c2 = F.greatest(F.lit(1.0) - F.pow(s, 2), F.lit(0.0))
    odd = (n % 2) == 1
    steps = ((n - 2 - n % 2) / 2).cast("int")
    shift = (1 - n % 2).cast("double")
    first = F.when(odd, F.sqrt(c2)).otherwise(F.lit(1.0))
    ks = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.alias("total"), first.alias("term"), c2.alias("c2"))

    def step(acc, k):
        term = acc["term"] * acc["c2"] * (k * 2 - shift) / (k * 2 + 1 - shift)
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"), acc["c2"].alias("c2"))

    total = F.when(n == 1, F.lit(0.0)).otherwise(F.aggregate(ks, start, step, lambda a: a["total"]))
    area = F.when(odd, F.asin(s)).otherwise(F.lit(0.0)) + s * total
    area = area * F.when(odd, F.lit(2 / math.pi)).otherwise(F.lit(1.0))
    return F.when((n >= 1) & as_col(r).isNotNull(), F.least(F.greatest(F.lit(1.0) - area, F.lit(0.0)), F.lit(1.0)))


def f_pvalue_df1_2(f, d2) -> Column:
    """Upper tail of F(2, d2), which has a closed form."""
    d = as_col(d2).cast("double")
    return F.when(d > 0, F.pow(F.lit(1.0) + as_col(f) * 2 / d, -d / 2))


def f_pvalue_df1_1(f, d2) -> Column:
    """Upper tail of F(1, d2): the two-sided t tail of sqrt(F)."""
    d = as_col(d2).cast("double")
    return t_pvalue_from_r(F.sqrt(as_col(f) / (as_col(f) + d)), d2)


def correlation(x, y) -> Column:
    """Pearson correlation as an aggregate; NULL where a side does not vary.

    Built on the ``regr_*`` sums, since ``corr`` divides by zero on constant input.
    """
    xc, yc = as_col(x), as_col(y)
    scale = F.sqrt(F.regr_sxx(yc, xc)) * F.sqrt(F.regr_syy(yc, xc))
    varies = (F.min(xc) < F.max(xc)) & (F.min(yc) < F.max(yc))
    return F.when(varies, F.try_divide(F.regr_sxy(yc, xc), scale))
