"""Live comments: the same expressions for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_window(comments: DataFrame, window: str = "1 minute", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Comments of each intent per (sliding) window; a stream needs the watermark ``late``."""
    rows = comments.withWatermark("ts", late) if late else comments
    counts = rows.groupBy(F.window("ts", window, slide or window).alias("w"), "intent").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("intent") == "order", F.col("quantity"))), F.lit(0)).alias("ordered"))
    return counts.select(F.col("w.start").alias("since"), "intent", "n", "ordered")


def distinct_comments(comments: DataFrame) -> DataFrame:
    """Comments once each, however late a platform sends one again; a stream keeps the ids it has seen, and no watermark drops any."""
    return comments.dropDuplicates(["comment_id"])


def totals(comments: DataFrame) -> DataFrame:
    return comments.groupBy("intent").agg(F.count("*").alias("n"), F.countDistinct("author").alias("people"))


def conversion(comments: DataFrame) -> DataFrame:
    """One row: distinct commenters, askers, buyers, and buyers who asked before (by person)."""
    person = comments.groupBy("author").agg(F.max((F.col("intent") == "question").cast("int")).alias("asked"), F.max((F.col("intent") == "order").cast("int")).alias("bought"))
    return person.agg(F.count("*").alias("people"), F.sum("asked").alias("askers"), F.sum("bought").alias("buyers"), F.sum(F.col("asked") * F.col("bought")).alias("asked_and_bought"))


def stock_replay(orders: DataFrame, stock: DataFrame) -> DataFrame:
    """Per product: orders served and lost. An order is lost if those before it have used up the stock."""
    before = Window.partitionBy("product_id").orderBy("ts", "comment_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = orders.join(F.broadcast(stock), "product_id").withColumn("used", F.coalesce(F.sum("quantity").over(before), F.lit(0)))
    lost = F.col("used") >= F.col("stock")
    return rows.groupBy("product_id", "stock").agg(F.count_if(~lost).alias("served"), F.count_if(lost).alias("lost"), F.coalesce(F.sum(F.when(lost, F.col("quantity"))), F.lit(0)).alias("lost_quantity"))


def best_minute(comments: DataFrame, unit: str = "hour") -> DataFrame:
    """One row: the period with the most orders (the first of equals) and the product ordered most in it."""
    orders = comments.where("intent = 'order'").withColumn("since", F.date_trunc(unit, "ts"))
    counted = orders.groupBy("since").agg(F.count("*").alias("orders"))
    top = counted.orderBy(F.desc("orders"), "since").limit(1)
    product = orders.join(F.broadcast(top), "since").groupBy("since", "orders", "product_id").agg(F.count("*").alias("n"))
    return product.groupBy("since", "orders").agg(F.min_by("product_id", F.struct(-F.col("n"), F.col("product_id"))).alias("product_id"))


def queue_groups(comments: DataFrame) -> DataFrame:
    """Open questions by product and complaints by themselves, with their rank in the queue."""
    key = F.when(F.col("intent") == "complaint", F.concat(F.lit("c"), F.col("comment_id").cast("string"))).otherwise(F.concat_ws("|", F.lit("q"), F.col("product_id").cast("string")))
    groups = comments.where("intent in ('complaint', 'question')").groupBy(key.alias("group_key"), "intent").agg(F.count("*").alias("n"), F.countDistinct("author").alias("people"), F.min("ts").alias("since"), F.max("ts").alias("latest"))
    return groups.withColumn("weight", F.when(F.col("intent") == "complaint", 1_000_000).otherwise(0) + F.col("n") * 10)


def sessions(comments: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Active time per author: comments closer than ``gap`` are one session."""
    found = comments.groupBy(F.session_window("ts", gap).alias("s"), "author").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return found.groupBy("author").agg(F.count("*").alias("sessions"), F.sum("n").alias("comments"), F.sum(F.unix_seconds("z") - F.unix_seconds("a")).alias("active_seconds"))


def action_effect(actions: DataFrame, comments: DataFrame, minutes: int = 180) -> DataFrame:
    """Orders a minute before and after each action ``(action_id, at)``."""
    from ..operators.joins import range_join

    near = range_join(comments.where("intent = 'order'"), actions, "ts", "at", minutes * 60)
    late = F.col("ts") >= F.col("at")
    return near.groupBy("action_id").agg(F.round(F.count_if(~late) / float(minutes), 6).alias("before"), F.round(F.count_if(late) / float(minutes), 6).alias("after"))


def complaint_spikes(comments: DataFrame, window: str = "5 minutes", least: int = 3, share: float = 0.04) -> DataFrame:
    """Windows with at least ``least`` complaints that are ``share`` of the comments or more."""
    n, bad = F.count("*"), F.count_if(F.col("intent") == "complaint")
    rows = comments.groupBy(F.window("ts", window).alias("w")).agg(n.alias("n"), bad.alias("complaints"))
    return rows.where((F.col("complaints") >= least) & (F.col("complaints") >= share * F.col("n"))).select(F.col("w.start").alias("since"), "n", "complaints")


def ask_not_buy(comments: DataFrame, least: int = 6, share: float = 0.25) -> DataFrame:
    """Products with at least ``least`` askers of whom at most ``share`` bought."""
    person = comments.where("product_id is not null").groupBy("product_id", "author").agg(F.max((F.col("intent") == "question").cast("int")).alias("asked"), F.max((F.col("intent") == "order").cast("int")).alias("bought"))
    rows = person.where("asked = 1").groupBy("product_id").agg(F.count("*").alias("askers"), F.sum("bought").alias("buyers"))
    return rows.where((F.col("askers") >= least) & (F.col("buyers") <= share * F.col("askers")))


def missed_value(comments: DataFrame, prices: DataFrame, least: int = 5) -> DataFrame:
    """Per product with questions: people asking, and what they may have been worth: people x conversion x price.

    Conversion is orders over questions, at most one; below ``least`` questions that of the session.
    """
    q, o = F.count_if(F.col("intent") == "question"), F.count_if(F.col("intent") == "order")
    per = comments.groupBy("product_id").agg(q.alias("q"), o.alias("o"))
    whole = per.agg(F.least(F.lit(1.0), F.try_divide(F.sum("o").cast("double"), F.sum("q"))).alias("c"))
    rows = per.where("q > 0").crossJoin(F.broadcast(whole)).join(prices, "product_id")  # whole: one row
    conversion = F.least(F.lit(1.0), F.when(F.col("q") >= least, F.col("o") / F.col("q")).otherwise(F.col("c")))
    return rows.select("product_id", F.col("q").alias("people"), F.round(conversion * F.col("q") * F.col("price"), 2).alias("lost_value"))


def response_quality(questions: DataFrame, by: str) -> DataFrame:
    """Questions asked and answered, their share, and the median wait in minutes of the answered."""
    wait = (F.unix_micros("answered_at") - F.unix_micros("ts")) / 60e6
    return questions.groupBy(by).agg(
        F.count("*").alias("asked"), F.count("answered_at").alias("answered"), F.round(F.count("answered_at") / F.count("*"), 6).alias("share"), F.round(F.median(F.when(wait >= 0, wait)), 4).alias("median_wait")
    )


def previous_session(sessions: DataFrame) -> DataFrame:
    """Each session with the last ended one of its store that began before it."""
    before = Window.partitionBy("store").orderBy(F.unix_micros("created_at")).rangeBetween(Window.unboundedPreceding, -1)
    ended = F.when(F.col("ended"), F.struct("created_at", "session_id", "revenue"))
    return sessions.withColumn("p", F.max(ended).over(before)).select("*", F.col("p.session_id").alias("previous_id"), F.col("p.revenue").alias("previous_revenue")).drop("p")


def reminders(schedules: DataFrame, sessions: DataFrame, now: str) -> DataFrame:
    """Scheduled lives that are due (inside their reminder time) or late (10 to 30 minutes past, and no session of the store since an hour before)."""
    at = F.unix_seconds(F.lit(now).cast("timestamp"))
    start = F.unix_micros("start_at") / 1e6
    rows = schedules.where("status = 'scheduled'")
    due = rows.where((at >= start - F.col("remind_min") * 60) & (at < start)).select("schedule_id", F.lit("due").alias("kind"))
    late = rows.where((at >= start + 600) & (at < start + 1800))
    begun = sessions.select(F.col("store").alias("s_store"), "created_at")
    same = (F.col("store") == F.col("s_store")) & (F.unix_micros("created_at") / 1e6 >= start - 3600) & (F.unix_micros("created_at") / 1e6 <= at)
    return due.union(late.join(begun, same, "left_anti").select("schedule_id", F.lit("late").alias("kind")))


def queue_status(asks: DataFrame, answers: DataFrame, again: int = 3) -> DataFrame:
    """Groups ``(group_key, ts, comment_id)`` of asks and of answers: open until answered, and again after ``again`` more asks (one more complaint).

    Only what came after the last answer decides, so it needs no state but that and a count.
    """
    at = F.struct("ts", "comment_id")
    last = answers.groupBy("group_key").agg(F.max(at).alias("last"))
    fresh = F.col("last").isNull() | (at > F.col("last"))
    rows = asks.join(last, "group_key", "left").groupBy("group_key").agg(F.count("*").alias("n"), F.count_if(fresh).alias("since_answer"), (F.count("last") > 0).alias("answered"))
    unasked = last.join(asks.select("group_key").distinct(), "group_key", "left_anti").select("group_key", F.expr("0L").alias("n"), F.expr("0L").alias("since_answer"), F.lit(True).alias("answered"))
    enough = F.when(F.col("group_key").startswith("c"), 1).otherwise(again)
    status = F.when(~F.col("answered") | (F.col("since_answer") >= enough), "open").otherwise("answered")
    return rows.union(unasked).select("group_key", "n", "since_answer", status.alias("status"))


def retained(comments: DataFrame, most: int = 60_000, hours: int = 3) -> DataFrame:
    """All comments of a session of at most ``most``; of a longer one those of the last ``hours``."""
    whole = comments.agg(F.max("ts").alias("_z"), F.count("*").alias("_n"))
    kept = (F.col("_n") <= most) | (F.col("ts") >= F.col("_z") - F.expr(f"interval {int(hours)} hours"))
    return comments.crossJoin(F.broadcast(whole)).where(kept).drop("_z", "_n")  # whole: one row


def cooled(actions: DataFrame, handled: DataFrame, minutes: int = 10) -> DataFrame:
    """Proposed ``actions (action_id, ts)`` with whether the same action was handled in the ``minutes`` before."""
    both = actions.withColumn("_at", F.lit(None).cast("timestamp")).unionByName(handled.select("action_id", F.col("at").alias("ts"), F.col("at").alias("_at")), allowMissingColumns=True)
    order = Window.partitionBy("action_id").orderBy("ts", F.col("_at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_at", True).over(order)
    young = F.unix_micros("ts") - F.unix_micros("_last") < minutes * 60_000_000
    return both.withColumn("_last", last).where(F.col("_at").isNull()).withColumn("suppressed", F.coalesce(young, F.lit(False))).drop("_at", "_last", "ts")
