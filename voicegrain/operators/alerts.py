"""Alerts: every supported combination tested against its baseline, with false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALERTS
from ..functions import stats
from ..functions.times import age_days
from .metrics import COUNTABLE, negative
from .ranks import in_order, running

SETS = [["category"], ["category", "product_name"], ["category", "cause"], ["category", "cause", "product_name"], ["category", "cause", "region"]]
_DIMS = ["category", "cause", "product_name", "region"]


def combinations(items: DataFrame, now: str, c=ALERTS) -> DataFrame:
    """One row per combination of the five grouping sets: rows and complaints now and before, people, weight.

    Rows of a null dimension do not enter a set that uses it; ``kind`` tells a null
    value from a dimension left out.
    """
    age = age_days(F.col("ts"), now)
    period = F.when((age >= 0) & (age <= c.window_days), "now").when((age > c.window_days) & (age <= c.baseline_days), "before")
    rows = items.withColumn("period", period).where(F.col("period").isNotNull() & (F.col("category") != "Other")).withColumn("counted", F.coalesce(F.expr(COUNTABLE), F.lit(False)))
    now_, before, counted, bad = F.col("period") == "now", F.col("period") == "before", F.col("counted"), negative()
    grouped = rows.groupingSets([[F.col(d) for d in s] for s in SETS], *[F.col(d) for d in _DIMS]).agg(
        F.grouping_id().alias("gid"),
        F.count_if(now_ & counted).alias("support"),
        F.count_if(now_ & counted & bad).alias("x1"),
        F.count_if(before & counted & bad).alias("x2"),
        F.countDistinct(F.when(now_ & counted & bad, F.coalesce("author", "feedback_id"))).alias("affected"),
        F.coalesce(F.sum(F.when(now_ & counted & bad, F.col("weight"))), F.lit(0.0)).alias("weighted"),
        F.count_if(now_ & counted & bad & (F.col("tier") != "P5")).alias("firm"),
        F.count_if(now_ & ~counted).alias("excluded_by_trust"),
    )
    for d, bit in zip(_DIMS, (8, 4, 2, 1)):  # grouping_id has a set bit for a dimension left out
        grouped = grouped.where(F.col(d).isNotNull() | (F.col("gid").bitwiseAND(F.lit(bit)) != 0))
    return grouped.where(F.col("support") >= c.min_support)


def window_totals(items: DataFrame, now: str, c=ALERTS) -> DataFrame:
    """One row: countable rows of the window and of the baseline."""
    age = age_days(F.col("ts"), now)
    return items.where(COUNTABLE).agg(F.count_if((age >= 0) & (age <= c.window_days)).alias("n1"), F.count_if((age > c.window_days) & (age <= c.baseline_days)).alias("n2"))


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], fdr: float = ALERTS.fdr) -> DataFrame:
    """Adds ``rank``, ``q_value`` and ``significant`` over all tests.

    Ranks and the smallest q from the end are running values over ranges of p, so the
    tests may be as many as the combinations of all dimensions.
    """
    ranked = in_order(tests, p, *order)
    total = ranked.agg(F.count("*").alias("_m"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    ranked = running(ranked, F.col(p) * F.col("_m") / F.col("rank"), "_q", "min", upwards=True)
    last = ranked.agg(F.max(F.when(F.col(p) <= F.col("rank") / F.col("_m") * fdr, F.col("rank"))).alias("_last"))
    ranked = ranked.crossJoin(F.broadcast(last)).withColumn("q_value", F.least(F.lit(1.0), "_q")).withColumn("rank", F.col("rank").cast("int"))  # one row
    return ranked.withColumn("significant", F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False))).drop("_m", "_q", "_last", "_part")


def detect(items: DataFrame, impacts: DataFrame, transactions: DataFrame, now: str, c=ALERTS) -> DataFrame:
    """All tested combinations with their statistics, severity and whether they alert.

    An alert has to be significant by its own p, large in points or people, a rise,
    and significant under Benjamini and Hochberg's procedure.  Evidence of tier P5
    alone cannot be High or Critical.
    """
    age = age_days(F.coalesce("delivered_at", "ordered_at"), now)
    orders = transactions.agg(F.count_if((age >= 0) & (age <= c.window_days)).alias("orders"))
    rows = combinations(items, now, c).crossJoin(F.broadcast(window_totals(items, now, c))).crossJoin(F.broadcast(orders)).where("n1 > 0 and n2 > 0")
    x1, n1, x2, n2 = (F.col(k).cast("double") for k in ("x1", "n1", "x2", "n2"))
    rows = rows.withColumn("z", F.round(stats.two_proportion_z(x1, n1, x2, n2), 6))
    rows = rows.withColumn("p", F.round(stats.two_sided_p(F.col("z")), 9))
    rows = rows.withColumn("dual", stats.passes_dual(F.col("p"), x1, n1, x2, n2, F.col("affected")))
    rows = benjamini_hochberg(rows, "p", ["gid", *_DIMS])
    rows = rows.join(F.broadcast(impacts), "category", "left")
    wcr = F.coalesce(F.try_divide(F.col("weighted"), F.col("orders").cast("double")), F.col("weighted") / n1)
    score = stats.severity_score(wcr, F.col("z"), stats.velocity_ratio(x1 / n1, x2 / n2), F.col("impact"), x1 / n1)
    rows = rows.withColumn("_score", F.round(score, 4))
    p5_only = (F.col("x1") > 0) & (F.col("firm") == 0) & (F.col("_score") >= 0.5)
    rows = rows.withColumn("severity", F.when(p5_only, F.least("_score", F.lit(c.p5_cap))).otherwise(F.col("_score")))
    return rows.select(
        *_DIMS, "support", "x1", "n1", "x2", "n2", "affected", "excluded_by_trust", F.round("weighted", 2).alias("weighted"), "z", F.round("p", 6).alias("p"), F.round("q_value", 6).alias("q_value"),
        "severity", stats.severity_band(F.col("severity")).alias("level"), (F.col("dual") & F.col("significant")).alias("alert"),
    )


def most_specific(alerts: DataFrame) -> DataFrame:
    """Of alerts that share category and cause the most specific stays (cause 4, product 2, region 1; then severity); the others are listed by it."""
    name = F.concat_ws("/", *[F.coalesce(d, F.lit("*")) for d in _DIMS])
    points = sum((F.when(F.col(d).isNotNull(), v).otherwise(0) for d, v in (("cause", 4), ("product_name", 2), ("region", 1))), F.lit(0))
    order = Window.partitionBy("category", F.coalesce("cause", F.lit(""))).orderBy(F.desc("points"), F.desc("severity"), "name")
    named = alerts.withColumn("name", name).withColumn("points", points)
    ranked = named.withColumn("_n", F.row_number().over(order))
    others = named.groupBy("category", F.coalesce("cause", F.lit("")).alias("_cause")).agg(F.sort_array(F.collect_list("name")).alias("_all"))
    kept = ranked.where("_n = 1").drop("_n").join(others, (ranked["category"] == others["category"]) & (F.coalesce(ranked["cause"], F.lit("")) == others["_cause"])).drop(others["category"])
    with_cause = alerts.where(F.col("cause").isNotNull()).select("category").distinct()
    bare = kept.where(F.col("cause").isNull()).join(with_cause, "category", "left_anti")
    kept = kept.where(F.col("cause").isNotNull()).unionByName(bare.select(kept.columns))
    return kept.select("name", "category", "cause", "product_name", "region", "severity", F.array_except("_all", F.array("name")).alias("also_seen_in"))


def drift(items: DataFrame, now: str, buckets: int = 12, span_days: float = 56, least: int = 10) -> DataFrame:
    """Per category: the control chart of the weighted complaint share over equal periods."""
    place = F.least(F.floor((span_days - age_days(F.col("ts"), now)) / (span_days / buckets)), F.lit(buckets - 1)).cast("int")
    inside = items.where(COUNTABLE).withColumn("_age", age_days(F.col("ts"), now)).where((F.col("_age") >= 0) & (F.col("_age") < span_days)).withColumn("bucket", place)
    base = F.col("tier_weight") * (1 - F.col("score"))
    all_rows = inside.groupBy("bucket").agg(F.sum(F.when(~negative(), base).otherwise(0.0)).alias("fine"))
    own = inside.where(negative()).groupBy("category", "bucket").agg(F.sum(base).alias("w"), F.count("*").alias("n"))
    names = own.groupBy("category").agg(F.sum("n").alias("members")).where(F.col("members") >= least)
    grid = names.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dense = grid.join(own, ["category", "bucket"], "left").join(all_rows, "bucket", "left")
    rate = F.coalesce(F.try_divide(F.coalesce("w", F.lit(0.0)) * 100, F.coalesce("w", F.lit(0.0)) + F.coalesce("fine", F.lit(0.0))), F.lit(0.0))
    series = dense.groupBy("category", "members").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.round(rate, 6).alias("v")))), lambda s: s["v"]).alias("series"))
    chart = stats.ewma(F.col("series"))
    return series.withColumn("c", chart).select("category", "members", "c.valid", F.round("c.mean", 4).alias("mean"), F.round("c.ucl", 4).alias("ucl"), F.round("c.last", 4).alias("last"), "c.longest_run", "c.breached")
