"""Statistics as Column expressions; a null or empty input gives null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALERTS, SEVERITY_BANDS, SEVERITY_WEIGHTS


def erf(x: Column) -> Column:
    """The error function by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / F.sqrt(F.lit(2.0))))


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 - normal_cdf(F.abs(z)))))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z of x1/n1 against x2/n2; 0 where the pooled rate has no variance or a side is empty."""
    pooled = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.coalesce(F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), F.when(se > 0, se)), F.lit(0.0))


def test_is_valid(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Whether every expected count under the pooled rate is at least 5."""
    pooled = F.try_divide(x1 + x2, n1 + n2)
    rare = F.least(pooled, 1 - pooled)
    return F.coalesce(F.least(n1 * rare, n2 * rare) >= 5, F.lit(False))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, null for n = 0."""
    p = F.try_divide(k, n)
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def clamp01(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def severity_score(wcr: Column, z: Column, velocity: Column, impact: Column, coverage: Column) -> Column:
    w = SEVERITY_WEIGHTS
    return clamp01(
        w["wcr"] * clamp01(wcr, 0, 0.1) + w["z"] * clamp01(F.abs(z), 0, 6) + w["velocity"] * clamp01(velocity, 0, 3) + w["impact"] * F.coalesce(impact, F.lit(0.25)) + w["coverage"] * clamp01(coverage)
    )


def severity_band(score: Column) -> Column:
    return reduce(lambda rest, b: F.when(score < b[0], b[1]).otherwise(rest), reversed(SEVERITY_BANDS), F.lit("Critical"))


def velocity_ratio(current: Column, base: Column) -> Column:
    """Relative growth, at most 3; from nothing to something is 3."""
    return F.when(base <= 0, F.when(current > 0, 3.0).otherwise(0.0)).otherwise(F.least((current - base) / base, F.lit(3.0)))


def log_odds_z(y1: Column, n1: Column, y2: Column, n2: Column) -> Column:
    """z of the difference of log-odds with half a count added to each cell."""
    a, b, c, d = y1 + 0.5, n1 - y1 + 0.5, y2 + 0.5, n2 - y2 + 0.5
    return (F.ln(a / b) - F.ln(c / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def upper_median(values: Column) -> Column:
    """Of a collected array, the element at floor(n / 2) of the sorted order (null if empty)."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def ewma(values: Column, lam: float = 0.2, limit: float = 3.0) -> Column:
    """Control chart of an ordered array: struct(valid, mean, sd, ucl, last, longest_run, breached).

    The baseline is the first max(4, n / 2) points; it needs three points other than
    zero and a spread.  Breached: a run of at least 3 points of the average above
    the upper limit.
    """
    n = F.size(values)
    base = F.slice(values, 1, F.greatest(F.lit(4), F.floor(n / 2).cast("int")))
    m = F.size(base)
    mean = F.aggregate(base, F.lit(0.0), lambda a, x: a + x) / m
    sd = F.sqrt(F.aggregate(base, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(m - 1, F.lit(1)))
    ucl = mean + limit * sd * (lam / (2 - lam)) ** 0.5
    start = F.struct(mean.alias("s"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        s = lam * x + (1 - lam) * a["s"]
        run = F.when(s > ucl, a["run"] + 1).otherwise(F.lit(0))
        return F.struct(s.alias("s"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    end = F.aggregate(values, start, step)
    valid = (n >= 4) & (F.size(F.filter(base, lambda x: x != 0)) >= 3) & (sd > 0)
    return F.struct(
        valid.alias("valid"), mean.alias("mean"), sd.alias("sd"), ucl.alias("ucl"), end["s"].alias("last"), end["best"].alias("longest_run"), (valid & (end["best"] >= 3)).alias("breached")
    )


def passes_dual(p: Column, x1: Column, n1: Column, x2: Column, n2: Column, affected: Column, c=ALERTS) -> Column:
    """Significant, and large in points or in people, and a rise."""
    delta = F.coalesce(F.try_divide(x1, n1), F.lit(0.0)) - F.coalesce(F.try_divide(x2, n2), F.lit(0.0))
    return (p < c.p_value) & ((delta * 100 >= c.delta_points) | (affected >= c.affected)) & (delta > 0)
