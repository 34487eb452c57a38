"""Trust-weighted metrics over items (feedback with tier, band and weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..functions.times import age_days
from .joins import range_join

COUNTABLE = "coalesce(weight, 0) > 0"


def negative() -> Column:
    return F.col("sentiment") == "Negative"


def weight() -> Column:
    """The weight as a decimal: it has four places, and a decimal sum does not depend on the order of rows."""
    return F.col("weight").cast("decimal(18,4)")


def weight_of(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, weight())), F.lit(0).cast("decimal(18,4)"))


def two_places(total: Column) -> Column:
    return F.round(total, 2).cast("double")


def weighted_complaint_rate(items: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: weighted complaints of reconcilable rows over the number of transactions (null without any)."""
    two = F.col("tier").isin("P1", "P2")
    top = items.where(COUNTABLE).agg(two_places(weight_of(negative() & two)).alias("weighted_complaints"), F.count_if(two).alias("reconcilable"), F.count("*").alias("countable"))
    bottom = transactions.agg(F.count("*").alias("transactions"))
    both = top.crossJoin(F.broadcast(bottom))
    return both.select("*", F.round(F.try_divide("weighted_complaints", F.col("transactions").cast("double")), 6).alias("wcr"), F.round(F.try_divide("reconcilable", F.col("countable").cast("double")), 6).alias("coverage"))


def share_of_negative(items: DataFrame, by: str | None = None) -> DataFrame:
    """Share of negative weight and of negative rows, all rows or by a column."""
    grouped = items.where(COUNTABLE).groupBy(*[by] if by else [])
    total = F.sum(weight())
    return grouped.agg(
        F.count("*").alias("n"), two_places(total).alias("weight"), F.round(F.try_divide(weight_of(negative()).cast("double"), total.cast("double")), 6).alias("negative_share"), F.round(F.try_divide(F.count_if(negative()).cast("double"), F.count("*")), 6).alias("negative_rate")
    )


def negative_velocity(items: DataFrame, now: str, window: int = 7, baseline: int = 28) -> DataFrame:
    """One row: negatives a day in the window and before it, and the relative change."""
    age = age_days(F.col("ts"), now)
    current = F.count_if(negative() & (age >= 0) & (age <= window)) / float(window)
    before = F.count_if(negative() & (age > window) & (age <= baseline)) / float(max(1, baseline - window))
    rows = items.where(COUNTABLE).agg(F.round(current, 6).alias("current"), F.round(before, 6).alias("before"))
    change = F.when(F.col("before") == 0, F.when(F.col("current") > 0, 1.0).otherwise(0.0)).otherwise((F.col("current") - F.col("before")) / F.col("before"))
    return rows.withColumn("velocity", F.round(change, 6))


def weighted_series(items: DataFrame, now: str, buckets: int = 12, span_days: float = 84) -> DataFrame:
    """``buckets`` equal periods that end at ``now``, empty ones included; the last is closed."""
    place = F.floor((span_days - age_days(F.col("ts"), now)) / (span_days / buckets)).cast("int")
    inside = items.withColumn("_age", age_days(F.col("ts"), now)).where((F.col("_age") >= 0) & (F.col("_age") <= span_days))
    counted = F.expr(COUNTABLE)
    sums = inside.groupBy(F.least(place, F.lit(buckets - 1)).alias("bucket")).agg(
        F.count_if(counted).alias("n"), two_places(weight_of(counted)).alias("weight"), two_places(weight_of(negative() & counted)).alias("negative_weight"), F.count_if(~counted).alias("excluded")
    )
    every = items.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(sums, "bucket", "left").fillna(0)


def period_comparison(items: DataFrame, now: str, window: int = 28) -> DataFrame:
    """One row: two adjacent periods and the relative change of rows, weight and negatives."""
    age = age_days(F.col("ts"), now)
    now_, before = (age >= 0) & (age <= window), (age > window) & (age <= 2 * window)
    rows = items.where(COUNTABLE).agg(
        *[F.count_if(p).alias(f"n_{k}") for k, p in (("now", now_), ("before", before))], *[two_places(weight_of(p)).alias(f"weight_{k}") for k, p in (("now", now_), ("before", before))], *[F.count_if(p & negative()).alias(f"negative_{k}") for k, p in (("now", now_), ("before", before))]
    )
    delta = lambda k: F.round(F.try_divide((F.col(f"{k}_now") - F.col(f"{k}_before")).cast("double"), F.col(f"{k}_before")), 6).alias(f"{k}_delta")
    return rows.select("*", *[delta(k) for k in ("n", "weight", "negative")])


def evidence_kind() -> Column:
    return F.when(F.col("tier").isin("P1", "P2"), "verified").otherwise("inferred")


def ledger(items: DataFrame) -> DataFrame:
    """One row whose parts add up to the raw number: spam, inauthentic, pending (not) counted, aged, counted."""
    gray, zero = F.col("band") == "GRAY_ZONE", F.coalesce(F.col("weight"), F.lit(0.0)) <= 0
    accepted = F.col("band") == "ACCEPTED"
    return items.agg(
        F.count("*").alias("raw"), F.count_if(F.col("band") == "SPAM").alias("spam"), F.count_if(F.col("band") == "LIKELY_INAUTHENTIC").alias("inauthentic"), F.count_if(gray & zero).alias("pending_not_counted"),
        F.count_if(gray & ~zero).alias("pending_counted"), F.count_if(accepted & zero).alias("aged"), F.count_if(accepted & ~zero).alias("accepted_counted"),
    )


def category_counts(items: DataFrame) -> DataFrame:
    return items.where(COUNTABLE).groupBy("category", "sentiment").agg(F.count("*").alias("n"), two_places(F.sum(weight())).alias("weight"))


def root_causes(items: DataFrame) -> DataFrame:
    """Complaints by category and cause with their share of all complaints in percent."""
    causes = items.where(COUNTABLE).where(negative()).groupBy("category", "cause").agg(F.count("*").alias("n"))
    return causes.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def pareto(items: DataFrame) -> DataFrame:
    """Categories but Other by complaints, with the cumulative share; a fixed handful of rows."""
    rows = items.where(COUNTABLE).where(negative() & (F.col("category") != "Other")).groupBy("category").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "category")
    return rows.select("category", "n", F.row_number().over(order).alias("place"), F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()), 6).alias("cumulative"))


def kpis() -> list[Column]:
    return [
        F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"), F.round(F.count_if(negative()) / F.count("*"), 6).alias("negative_rate"),
        F.round(F.avg(F.when(F.col("rating") > 0, F.col("rating"))), 6).alias("stars"), F.round(F.count_if(F.col("evidence") != "inferred") / F.count("*"), 6).alias("proof_share"),
    ]


def cube(items: DataFrame, anchor: str) -> DataFrame:
    """Countable rows as a star: day age, dimensions, rating (0 if null), weight in ten-thousandths."""
    back = F.greatest(F.lit(0), F.floor(age_days(F.col("ts"), anchor))).cast("int")
    return items.where(COUNTABLE).select(
        back.alias("back"), F.coalesce("source", F.lit("Other")).alias("source"), "category", F.coalesce("sentiment", F.lit("Neutral")).alias("sentiment"), evidence_kind().alias("evidence"), F.col("product_name").alias("product"),
        "cause", F.coalesce("rating", F.lit(0)).alias("rating"), F.floor(F.col("weight") * 10000 + 0.5).cast("long").alias("weight"),
    )


def cross_filter(rows: DataFrame, selection: dict, dimension: str | None = None) -> DataFrame:
    """``rows`` under every selection but that of the chart's own dimension."""
    for column, values in selection.items():
        if column != dimension:
            rows = rows.where(F.col(column).isin(values))
    return rows


def segments(items: DataFrame, unnamed: str = "feedback_id") -> DataFrame:
    """Customers by behaviour: any negative is at risk, fewer than two rows one-time, mostly positive a promoter, else passive.

    A row without a customer is one of its own, named by ``unnamed``.
    """
    person = items.groupBy(F.coalesce(F.col("customer_id").cast("string"), unnamed).alias("customer")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("Negative", "Neutral", "Positive")], two_places(F.sum(weight())).alias("weight"), F.max("ts").alias("latest")
    )
    kind = F.when(F.col("Negative") > 0, "at_risk").when(F.col("n") < 2, "one_time").when(F.col("Positive") >= F.col("Neutral"), "promoter").otherwise("passive")
    return person.withColumn("segment", kind)


def product_profiles(items: DataFrame, least: int = 20) -> DataFrame:
    """Products of at least ``least`` countable rows: complaint rate with its Wilson interval, weighted share, stars."""
    rows = items.where(COUNTABLE).groupBy("product_name").agg(
        F.count("*").alias("n"), F.count_if(negative()).alias("negatives"), F.round(F.try_divide(weight_of(negative()), F.sum("weight")), 6).alias("weighted_share"), F.round(F.avg("rating"), 6).alias("stars")
    )
    low, high = wilson(F.col("negatives"), F.col("n"))
    return rows.where(F.col("n") >= least).select("*", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def decision_effect(items: DataFrame, decisions: DataFrame, window: int = 28) -> DataFrame:
    """Difference in differences per decision ``(decision_id, product_name, category, at)``.

    Complaint rates of the category among countable rows in ``window`` days before
    and after, for the product and for all others.
    """
    asked = decisions.select("decision_id", "at", F.col("product_name").alias("_product"), F.col("category").alias("_category"))
    near = range_join(items.where(COUNTABLE), asked, "ts", "at", window * 86400).where(F.col("ts") < F.col("at") + F.make_dt_interval(F.lit(window)))
    own = F.col("product_name") == F.col("_product")
    hit = negative() & (F.col("category") == F.col("_category"))
    late = F.col("ts") >= F.col("at")
    rate = lambda side, time: F.try_divide(F.count_if(side & time & hit).cast("double"), F.count_if(side & time))
    rows = near.groupBy("decision_id").agg(
        F.count_if(own & ~late).alias("n_before"), F.count_if(own & late).alias("n_after"), rate(own, ~late).alias("before"), rate(own, late).alias("after"), rate(~own, ~late).alias("control_before"), rate(~own, late).alias("control_after")
    )
    effect = (F.col("after") - F.col("before")) - (F.col("control_after") - F.col("control_before"))
    return rows.select("decision_id", "n_before", "n_after", *[F.round(c, 6).alias(c) for c in ("before", "after", "control_before", "control_after")], F.round(effect, 6).alias("effect"))


def cadence(items: DataFrame, now: str) -> DataFrame:
    """One row: the shortest window of the ladder with 50 rows in it and 100 in the three windows before."""
    ladder = [7, 14, 28, 60, 90, 180, 365, 730]
    age = age_days(F.col("ts"), now)
    counts = items.where(COUNTABLE).agg(*[F.count_if((age >= 0) & (age < w)).alias(f"w{w}") for w in ladder], *[F.count_if((age >= w) & (age < 4 * w)).alias(f"b{w}") for w in ladder])
    chosen = F.coalesce(*[F.when((F.col(f"w{w}") >= 50) & (F.col(f"b{w}") >= 100), F.lit(w)) for w in ladder], F.lit(ladder[-1]))
    return counts.select(chosen.alias("window_days"), (chosen * 4).alias("baseline_days"))
