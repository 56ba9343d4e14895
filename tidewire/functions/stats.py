"""Closed-form two-sample t-tests from counts, means and variances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.lookup import bind

SIMPSON_STEPS = 2000


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t.

    With t = sqrt(df)*tan(angle) the density becomes cos(angle)^(df-1), so the
    tail is the ratio of two integrals over a bounded range. Both are cut
    where the integrand has vanished, which keeps the step fine for large df.
    Meant for one row per event, not for article rows.
    """
    half_pi = F.lit(1.5707963267948966)
    root = F.when(df > 0, F.sqrt(df))
    start = F.atan(F.abs(t) / root)
    reach = F.lit(12.0) / root

    def integral(lo: Column, hi: Column) -> Column:
        def over(range_: Column) -> Column:
            """Simpson's rule; bound first, or each step would compute its bounds anew."""

            def add(total: Column, i: Column) -> Column:
                ends = (i == 0) | (i == SIMPSON_STEPS)
                weight = F.when(ends, 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
                height = F.greatest(F.cos(range_["lo"] + i * range_["width"]), F.lit(0.0))
                return total + weight * F.pow(height, range_["power"])

            steps = F.sequence(F.lit(0), F.lit(SIMPSON_STEPS))
            return F.aggregate(steps, F.lit(0.0), add) * range_["width"] / 3.0

        width = (hi - lo) / F.lit(float(SIMPSON_STEPS))
        return bind(F.struct(lo.alias("lo"), width.alias("width"), (df - 1).cast("double").alias("power")), over)

    tail = integral(start, F.least(half_pi, start + reach))
    whole = integral(F.lit(0.0), F.least(half_pi, reach))
    # least() would skip a NULL, so an absent test is kept apart.
    return F.when(t.isNotNull() & (df > 0), F.least(tail / whole, F.lit(1.0)))


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column):
    """t and degrees of freedom without assuming equal variances; NULL when both are zero."""
    a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
    spread = F.when(a + b > 0, a + b)
    t = (m1 - m2) / F.sqrt(spread)
    parts = F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1)
    return t, F.try_divide(spread * spread, parts)


def student(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column):
    """t and degrees of freedom with the pooled variance; NULL when it is zero."""
    df = (n1 + n2 - 2).cast("double")
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, df)
    per_row = F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)
    spread = F.when(pooled > 0, pooled * per_row)
    return (m1 - m2) / F.sqrt(spread), df
