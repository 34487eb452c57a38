"""What stands behind a number: concentration, modes, agreement, dense series, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..functions.times import age_days
from . import ranks
from .metrics import COUNTABLE, negative


def bundle(items: DataFrame, now: str, recent_days: int = 7) -> DataFrame:
    """One row: countable rows, complaints, reconcilable and recent ones."""
    age = age_days(F.col("ts"), now)
    return items.where(COUNTABLE).agg(
        F.count("*").alias("rows"), F.count_if(negative()).alias("complaints"), F.count_if(F.col("tier").isin("P1", "P2")).alias("reconcilable"), F.count_if((age >= 0) & (age <= recent_days)).alias("recent")
    )


def first_seen_mode(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The commonest value of each group; of equals the one seen first by ``position``."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("_first"))).alias(value), F.max("n").alias("n"))


def concentration(rows: DataFrame, group: str, dimension: str) -> DataFrame:
    """Herfindahl index of a dimension's shares within each group, and the largest share."""
    counts = rows.groupBy(group, dimension).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(group))
    return counts.withColumn("_s", share).groupBy(group).agg(F.round(F.sum(F.col("_s") * F.col("_s")), 6).alias("hhi"), F.round(F.max("_s"), 6).alias("largest"), F.count("*").alias("parts"))


def profile(rows: DataFrame, baseline: DataFrame, dimension: str, share: float = 0.45, lift: float = 1.4, least: int = 4) -> DataFrame:
    """Values of a dimension by their share of ``rows`` against their share of ``baseline``; ``focused`` if it stands out."""
    part = lambda d, name: d.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(F.count("*").alias(name)).withColumn(f"{name}_share", F.col(name) / F.sum(name).over(Window.partitionBy()))
    both = part(rows, "n").join(part(baseline, "base"), dimension, "left")
    up = F.try_divide(F.col("n_share"), F.col("base_share"))
    return both.select(dimension, "n", F.round("n_share", 6).alias("share"), F.round(up, 6).alias("lift"), ((F.col("n_share") >= share) & F.coalesce(up >= lift, F.lit(True)) & (F.col("n") >= least)).alias("focused"))


def compare_shares(rows: DataFrame, key: str, a: str, b: str, by: str) -> DataFrame:
    """Shares of the values of ``by`` among the rows of ``a`` and of ``b``; a value that one lacks has the share 0 there."""
    def side(value: str, name: str) -> DataFrame:
        counts = rows.where(F.col(key) == value).groupBy(by).agg(F.count("*").alias("c"))
        return counts.select(by, F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias(name))

    both = side(a, "share_a").join(side(b, "share_b"), by, "full_outer").fillna(0.0, ["share_a", "share_b"])
    return both.withColumn("difference", F.round(F.col("share_a") - F.col("share_b"), 6))


def agreement(rows: DataFrame, gold: str, said: str) -> DataFrame:
    """One row: accuracy with its Wilson interval, macro F1 over the gold labels, and Cohen's kappa."""
    cells = rows.where(F.col(gold).isNotNull() & F.col(said).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(said).alias("s")).agg(F.count("*").alias("c"))
    by = lambda k: cells.groupBy(F.col(k).alias("label")).agg(F.sum("c").alias(f"n_{k}"))
    hit = cells.where("g = s").select(F.col("g").alias("label"), F.col("c").alias("tp"))
    labels = by("g").join(by("s"), "label", "full_outer").join(hit, "label", "left").fillna(0)
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("n_g") + F.col("n_s"))
    one = labels.agg(F.sum("n_g").alias("n"), F.sum("tp").alias("right"), F.avg(F.when(F.col("n_g") > 0, f1)).alias("f1"), F.sum(F.col("n_g") * F.col("n_s")).cast("double").alias("chance"))
    low, high = wilson(F.col("right"), F.col("n"))
    accuracy, by_chance = F.col("right") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return one.select("n", F.round(accuracy, 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round("f1", 6).alias("macro_f1"), F.round(F.try_divide(accuracy - by_chance, 1 - by_chance), 6).alias("kappa"))


def daily_series(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of every day from the first to the last, days without rows included."""
    day = rows.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    span = day.agg(F.min("day").alias("a"), F.max("day").alias("z")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "z")).alias("day"))
    return every.join(day, "day", "left").fillna(0, ["n"])


def peak(series: DataFrame, at: str, n: str, times: float = 1.3) -> DataFrame:
    """One row: the highest point (the first of equals) if it is ``times`` the mean or more; else none."""
    top = series.agg(F.max_by(F.struct(at, n), F.struct(F.col(n), -F.unix_date(at))).alias("top"), F.avg(n).alias("mean"))
    return top.select(f"top.{at}", f"top.{n}", F.round("mean", 6).alias("mean")).where(F.col(n) >= times * F.col("mean"))


def rising(items: DataFrame, now: str, by: str = "category", days: int = 28) -> DataFrame:
    """Complaints of two adjacent periods by a column, and the growth (null from nothing)."""
    age = age_days(F.col("ts"), now)
    rows = items.where(COUNTABLE).where(negative()).groupBy(by).agg(F.count_if((age >= 0) & (age <= days)).alias("current"), F.count_if((age > days) & (age <= 2 * days)).alias("before"))
    return rows.withColumn("growth", F.round(F.try_divide((F.col("current") - F.col("before")).cast("double"), F.col("before")), 6))


def waits(rows: DataFrame, person: str, ts: str = "ts") -> DataFrame:
    """One row: the median and the variance (0 below two) of the minutes between a person's consecutive rows."""
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(Window.partitionBy(person).orderBy(ts)))) / 60e6
    gaps = rows.select(gap.alias("gap"))
    spread = gaps.agg(F.round(F.coalesce(F.var_samp("gap"), F.lit(0.0)), 2).alias("variance"))
    return ranks.median(gaps, "gap").crossJoin(F.broadcast(spread)).select(F.col("n").alias("gaps"), F.round("median", 4).alias("median"), "variance")  # one row each


def bucket_days(span: Column) -> Column:
    """Days of a bucket for a span: one up to 45 days, a week up to 200, else 30 or a sixtieth of it."""
    return F.when(span <= 45, 1).when(span <= 200, 7).otherwise(F.greatest(F.lit(30), F.ceil(span / 60))).cast("int")


def adaptive_series(cube: DataFrame) -> DataFrame:
    """Rows and complaints of a cube by buckets that suit its span; bucket 0 ends at the anchor."""
    size = cube.agg(bucket_days(F.max("back") + 1).alias("_size"))
    rows = cube.crossJoin(F.broadcast(size))  # one row
    return rows.groupBy(F.floor(F.col("back") / F.col("_size")).cast("int").alias("bucket"), F.col("_size").alias("days")).agg(F.count("*").alias("n"), F.count_if(negative()).alias("negatives"))


def weekly(rows: DataFrame, by: str, now: str, weeks: int = 12, step: int = 7) -> DataFrame:
    """Rows of each ``by`` in the last ``weeks`` periods of ``step`` days that end at ``now``; empty periods are zero."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("ts")) / (step * 86400.0)
    week = (weeks - 1 - F.floor(age)).cast("int")
    counts = rows.where(age >= 0).groupBy(by, week.alias("week")).agg(F.count("*").alias("n")).where("week >= 0")
    every = rows.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week"))
    return every.join(counts, [by, "week"], "left").fillna(0, ["n"])
