"""What a live host should do now: nine triggers from one pass over a session's comments.

Every comment carries what it adds to each look-back; every trigger sums those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rank of a severity, and topics that lead to an order.
SEVERITY = {"critical": 3, "high": 2, "medium": 1}
BUYING_TOPICS = ["price", "promo", "size", "stock"]
_KEYS = ["session_id", "product_id", "variants", "intent", "topic", "group_key", "inferred"]


def _built(rows: DataFrame) -> DataFrame:
    """``rows``, far fewer than the comments, as the side that is hashed: the comments then need no sort in memory."""
    return rows.hint("shuffle_hash")


def counted(comments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Comments up to the session's ``now``, each as ``_KEYS`` with what it adds to every sum: the last 3, 5 and 10 minutes, the rates' two spans, and quantities.

    A column the comments have not is null, a null topic ``other``.  Nothing is grouped
    here: few comments of a session agree in all keys, so groups would hold as many rows
    in memory twice over, and every trigger sums by fewer keys anyway.
    """
    minutes = (F.unix_micros("now") - F.unix_micros("ts")) / 60e6
    rows = comments.join(_built(sessions.select("session_id", "now")), "session_id").where(minutes >= 0)
    rows = rows.withColumn("topic", F.coalesce("topic", F.lit("other"))).withColumn("inferred", F.coalesce("inferred", F.lit(False)))
    order = F.col("intent") == "order"
    quantity = F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1)).cast("long")
    if_ = lambda what, n=1: F.when(what, n).otherwise(0).cast("long")
    return rows.select(
        *_KEYS, *[if_(minutes <= m).alias(f"n{m}") for m in (3, 5, 10)], if_((minutes > 0) & (minutes <= 3)).alias("fresh"), if_((minutes > 3) & (minutes <= 9)).alias("before"),
        if_(order & ~F.coalesce(F.col("cancelled"), F.lit(False)), quantity).alias("ordered"), if_(order & (minutes <= 10), quantity).alias("wanted"),
    )


def _action(rows: DataFrame, number: int, kind: str, key: Column, severity: str, measure: Column, product: Column | None = None, lost: Column | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        "session_id", F.lit(number).alias("trigger"), F.lit(kind).alias("type"), key.cast("string").alias("key"), F.lit(severity).alias("severity"),
        (none("long") if product is None else product.cast("long")).alias("product_id"), measure.cast("double").alias("measure"), (none("double") if lost is None else lost.cast("double")).alias("lost_value"),
    )


def triggers(comments: DataFrame, sessions: DataFrame, stock: DataFrame, groups: DataFrame) -> DataFrame:
    """All actions that are due: ``(session_id, trigger, type, key, severity, product_id, measure, lost_value)``.

    comments: session_id, ts, intent, topic, product_id, variants (array), quantity,
    cancelled, inferred, group_key.  sessions: session_id, now, current_product_id.
    stock: session_id, product_id, variant (null: the whole product), initial, price.
    groups: session_id, group_key, intent, topic, product_id, count, first_at, status,
    grounded (whether the catalogue has the answer).  Of equal products the smaller id
    counts as the one most asked for.
    """
    c = counted(comments, sessions)
    is_ = lambda *kinds: F.col("intent").isin(*kinds)
    total = lambda what, n: F.coalesce(F.sum(F.when(what, F.col(n))), F.lit(0))
    every = c.groupBy("session_id").agg(
        total(is_("complaint"), "n5").alias("complaints"), F.sum("n5").alias("recent"), total(is_("question"), "n3").alias("questions"),
        (F.sum("fresh") / 3).alias("rate"), (F.sum("before") / 6).alias("rate_before"),
    )
    out = [_action(every.where((F.col("complaints") >= 3) & (F.col("complaints") >= 0.04 * F.col("recent"))), 1, "complaint_spike", F.lit("all"), "critical", F.col("complaints"))]

    fits = F.col("s.variant").isNull() | F.coalesce(F.array_contains("variants", F.col("s.variant")), F.lit(False))
    asked = is_("question") & (F.col("topic") == "stock")
    held = c.alias("c").join(_built(stock).alias("s"), (F.col("s.session_id") == F.col("c.session_id")) & (F.col("s.product_id") == F.col("c.product_id")) & fits)
    held = held.groupBy(F.col("s.session_id").alias("session_id"), F.col("s.product_id").alias("product_id"), F.col("s.variant").alias("variant"), F.col("s.initial").alias("initial"), F.col("s.price").alias("price"))
    held = held.agg(F.sum("ordered").alias("ordered"), total(is_("order"), "n10").alias("orders"), total(asked, "n10").alias("asks"), F.sum("wanted").alias("wanted"))
    left, demand = F.col("initial") - F.col("ordered"), F.col("orders") + F.col("asks")
    name = F.concat_ws("|", F.col("product_id").cast("string"), F.coalesce("variant", F.lit("")))
    out.append(_action(held.where((left <= 0) & (demand >= 2)), 2, "soldout_demand", name, "critical", demand, F.col("product_id"), F.col("wanted") * F.col("price")))
    few = (left > 0) & (left <= F.greatest(F.lit(3), F.ceil(F.col("initial") * 0.15))) & (F.col("orders") >= 2)
    out.append(_action(held.where(few), 4, "low_stock", name, "high", left, F.col("product_id")))

    opened = groups.where("status = 'open'")
    asks = c.where("group_key is not null").groupBy("session_id", "group_key").agg(F.sum("n3").alias("asks"))
    burst = opened.where("intent = 'question'").join(asks, ["session_id", "group_key"]).join(every.select("session_id", "questions"), "session_id")
    burst = burst.where((F.col("asks") >= 5) & (F.col("asks") >= 0.08 * F.col("questions")))
    most = Window.partitionBy("session_id").orderBy(F.desc("asks"), "group_key")
    burst = burst.withColumn("_n", F.row_number().over(most)).where("_n <= 2")
    out.append(_action(burst, 3, "question_burst", F.col("group_key"), "high", F.col("asks"), F.col("product_id")))

    queue = opened.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("count").alias("people"), F.min("first_at").alias("oldest")).join(sessions, "session_id")
    wait = (F.unix_micros("now") - F.unix_micros("oldest")) / 60e6
    out.append(_action(queue.where((F.col("n") >= 10) | ((wait >= 5) & (F.col("people") >= 8))), 5, "backlog", F.lit("queue"), "high", F.col("n")))

    about = c.where(F.col("product_id").isNotNull()).join(_built(sessions.select("session_id", "current_product_id")), "session_id")
    current = F.col("product_id") == F.col("current_product_id")
    said = F.col("n5") * (~F.col("inferred") & is_("question", "order")).cast("int")
    per = about.groupBy("session_id", "product_id", "current_product_id").agg(
        F.sum(said).alias("said"), total(is_("question") & F.col("topic").isin(BUYING_TOPICS), "n5").alias("asks"), total(is_("order"), "n5").alias("buys")
    )
    now_shown = F.max(F.when(current, F.col("said")))
    best = F.max(F.when(F.coalesce(~current, F.lit(True)), F.struct(F.col("said"), (-F.col("product_id")).alias("_id"))))
    hot = per.groupBy("session_id").agg(F.coalesce(now_shown, F.lit(0)).alias("shown"), best.alias("b")).where((F.col("b.said") >= 5) & (F.col("b.said") >= 1.5 * F.col("shown")))
    out.append(_action(hot, 6, "hot_other_product", -F.col("b._id"), "medium", F.col("b.said"), -F.col("b._id")))
    doubt = per.where(current & (F.col("asks") >= 6) & (F.col("buys") <= 0.25 * F.col("asks")))
    out.append(_action(doubt, 7, "ask_not_buy", F.col("product_id"), "medium", F.col("asks"), F.col("product_id")))

    out.append(_action(every.where((F.col("rate_before") >= 8) & (F.col("rate") < 0.6 * F.col("rate_before"))), 8, "engagement_drop", F.lit("rate"), "medium", F.round(1 - F.col("rate") / F.col("rate_before"), 6)))
    gaps = opened.where("intent = 'question' and not grounded and topic <> 'other'").groupBy("session_id", "topic", "product_id").agg(F.sum("count").alias("n")).where("n >= 3")
    out.append(_action(gaps, 9, "missing_info", F.concat_ws("|", "topic", F.coalesce(F.col("product_id").cast("string"), F.lit("-"))), "medium", F.col("n"), F.col("product_id")))
    return reduce(DataFrame.unionByName, out)


def coach(comments: DataFrame, sessions: DataFrame, stock: DataFrame, groups: DataFrame, per_type: int = 2, most: int = 6) -> DataFrame:
    """The actions of each session by severity, then lost value, with ``place``: at most ``per_type`` of a type and ``most`` in all."""
    rank = reduce(lambda w, s: F.when(F.col("severity") == s, SEVERITY[s]).otherwise(w), SEVERITY, F.lit(0))
    order = [rank.desc(), F.coalesce("lost_value", F.lit(0.0)).desc(), F.col("trigger").asc(), F.col("measure").desc(), F.col("key").asc()]
    due = triggers(comments, sessions, stock, groups).withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "type").orderBy(*order)))
    placed = due.where(F.col("_n") <= per_type).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))
    return placed.where(F.col("place") <= most).drop("_n")
