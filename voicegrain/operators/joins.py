"""Joins that the planner has no operator for: time-range joins, as-of decisions, near-duplicate clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Inner join of rows whose times are at most ``seconds`` apart (and whose ``keys`` are equal).

    Each left row keeps one time bucket, each right row stands in three, so the join
    is an equi-join on the bucket with a residual bound.  Null times match nothing.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", bucket(left_ts))
    b = right.withColumn("_b", bucket(right_ts)).withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    same = F.col("_bucket") == F.col("_b")
    for x, y in keys:
        same = same & (F.col(x) == F.col(y))
    near = F.abs(F.unix_micros(left_ts) - F.unix_micros(right_ts)) <= seconds * 1_000_000
    return a.join(b, same & near).drop("_bucket", "_b")


def latest_decision(alerts: DataFrame, decisions: DataFrame, days: int = 7) -> DataFrame:
    """``alerts (alert_id, scope, at)`` with the latest decision on the same alert, or on its scope within ``days`` before."""
    ways = decisions.select(F.col("alert_id").alias("d_alert"), F.col("scope").alias("d_scope"), F.col("decision"), F.col("at").alias("d_at"))
    exact = alerts.join(ways, F.col("alert_id") == F.col("d_alert"))
    scoped = alerts.join(ways, (F.col("scope") == F.col("d_scope")) & (F.col("d_at") <= F.col("at")) & (F.col("d_at") >= F.col("at") - F.make_dt_interval(F.lit(days))))
    found = exact.unionByName(scoped).groupBy("alert_id").agg(F.max_by("decision", F.struct("d_at", "decision")).alias("decision"), F.max("d_at").alias("decided_at"))
    return alerts.join(found, "alert_id", "left")


def same_text_clusters(items: DataFrame, text: str = "text", key: str = "doc_id", ts: str = "ts", least: int = 5, span_hours: int = 48) -> DataFrame:
    """Groups of equal texts of at least ``least`` rows that span at most ``span_hours``."""
    grouped = items.groupBy(F.sha1(text).alias("text_key")).agg(F.count("*").alias("size"), F.min(key).alias("first_id"), F.min(ts).alias("since"), F.max(ts).alias("until"))
    hours = (F.unix_seconds("until") - F.unix_seconds("since")) / 3600
    out = grouped.withColumn("hours", F.round(hours, 4)).where((F.col("size") >= least) & (hours <= span_hours))
    return out.withColumn("density", F.round(F.col("size") / F.greatest(hours, F.lit(1 / 60)), 4))


def revenue_at_risk(evidence: DataFrame, orders: DataFrame, least_coverage: float = 0.33) -> DataFrame:
    """One row: the amounts of the orders that the evidence names, scaled up to all rows if enough have an order."""
    book = orders.groupBy("order_id").agg(F.max("amount").alias("amount"))
    known = evidence.join(book, "order_id", "left").agg(F.count("*").alias("rows"), F.count("amount").alias("matched"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    coverage = F.try_divide(F.col("matched").cast("double"), F.col("rows"))
    return known.select("rows", "matched", F.round("total", 2).alias("known_revenue"), F.round(F.when(coverage >= least_coverage, F.col("total") / coverage), 2).alias("estimated_revenue"))


def merge_orders(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Order lines folded to one row an order (summed quantity, first amount that is not null), merged over what is known."""
    folded = lines.groupBy("order_id").agg(F.sum("quantity").alias("quantity"), F.min_by("amount", F.when(F.col("amount").isNotNull(), F.col("line"))).alias("amount"))
    new, old = folded.alias("n"), known.alias("k")
    return new.join(old, "order_id", "full_outer").select("order_id", *[F.coalesce(F.col(f"n.{c}"), F.col(f"k.{c}")).alias(c) for c in ("quantity", "amount")])


def newest_per_key(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest row of each key (ties by all columns)."""
    everything = F.struct(ts, *[c for c in rows.columns if c not in (key, ts)])
    return rows.groupBy(key).agg(F.max(everything).alias("r")).select(key, "r.*")


def insert_if_absent(new: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``held`` has not, one a key (the smallest row)."""
    everything = F.struct(*new.columns)
    return new.join(held.select(key), key, "left_anti").groupBy(key).agg(F.min(everything).alias("r")).select("r.*")


def carry_forward(comments: DataFrame, switches: DataFrame, session: str = "session_id") -> DataFrame:
    """As-of join: each comment with the product shown last before it in its session."""
    both = comments.select(session, "ts", "comment_id", F.lit(None).cast("long").alias("shown")).unionByName(switches.select(session, "ts", F.lit(None).cast("long").alias("comment_id"), F.col("product_id").alias("shown")))
    order = Window.partitionBy(session).orderBy("ts", F.col("comment_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("current", F.last("shown", True).over(order)).where("comment_id is not null").select(session, "comment_id", "ts", "current")


def by_ids(rows: DataFrame, lists: DataFrame, key: str, ids: str) -> DataFrame:
    """The rows whose key is in one of the lists of ids, each once."""
    return rows.join(lists.select(F.explode(ids).alias(key)).distinct(), key, "left_semi")
