"""Work on alerts: labels of people, cases, decisions and what they brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key of an append-only log: what an upsert leaves; a max_by, so it is partly aggregated."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def open_cases(events: DataFrame) -> DataFrame:
    """Cases from a log of ``(case_key, at, event)``: a create while one is open is refused, a close ends it.

    One row per key: cases opened, creates refused, and whether one is open now.
    """
    order = Window.partitionBy("case_key").orderBy("at", "event_id")
    before = F.lag("event").over(order)
    marked = events.withColumn("opens", (F.col("event") == "create") & (before.isNull() | (before == "close")))
    return marked.groupBy("case_key").agg(
        F.count_if("opens").alias("opened"), F.count_if((F.col("event") == "create") & ~F.col("opens")).alias("refused"),
        (F.max_by("event", F.struct("at", "event_id")) != "close").alias("is_open"),
    )


def audit_summary(labels: DataFrame) -> DataFrame:
    """One row per labeller and one for all (labeller null): random audits, how many were right, Wilson bounds, reviewers."""
    rows = labels.where(F.coalesce("sample_mode", F.lit("random")) == "random")
    right = lambda c: F.count_if(F.col(c)).alias(c)
    parts = rows.rollup("labelled_by").agg(F.count("*").alias("n"), right("category_correct"), right("sentiment_correct"), F.countDistinct("reviewer").alias("reviewers"))
    low, high = wilson(F.col("category_correct"), F.col("n"))
    return parts.select("*", F.round(low, 6).alias("category_low"), F.round(high, 6).alias("category_high"))


def top_confusions(labels: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` commonest corrections of the category in random audits."""
    rows = labels.where((F.coalesce("sample_mode", F.lit("random")) == "random") & ~F.col("category_correct") & F.col("correct_category").isNotNull())
    counts = rows.groupBy(F.coalesce("ai_category", F.lit("Other")).alias("said"), F.col("correct_category").alias("is")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "said", "is").limit(k)


def head_to_head(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How often both classifiers are right, only one, or neither."""
    kind = F.when(F.col(a) & F.col(b), "both").when(F.col(a), "only_a").when(F.col(b), "only_b").otherwise("neither")
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def learned_actions(decisions: DataFrame) -> DataFrame:
    """Per action: how often it was accepted and dismissed, its prior (2 + accepted) / (4 + both), and when it was last decided."""
    rows = decisions.select("decision", "at", F.explode("action_ids").alias("action_id"))
    yes, no = F.count_if(F.col("decision") == "ACCEPTED"), F.count_if(F.col("decision") == "DISMISSED")
    return rows.groupBy("action_id").agg(yes.alias("accepted"), no.alias("dismissed"), F.round((2 + yes) / (4 + yes + no), 6).alias("prior"), F.max("at").alias("last_at"))


def suppressed(proposals: DataFrame, decisions: DataFrame, reasons: list[str], cooldown_days: int = 14) -> DataFrame:
    """``proposals (action_id, scope_key, at)`` with whether a dismissal of that action in that scope, for one of ``reasons``, is younger than the cooldown."""
    no = decisions.where((F.col("decision") == "DISMISSED") & F.col("reason").isin(reasons)).select(F.explode("action_ids").alias("action_id"), "scope_key", F.col("at").alias("no_at"))
    last = no.groupBy("action_id", "scope_key").agg(F.max("no_at").alias("no_at"))  # the youngest decides
    age = F.unix_seconds("at") - F.unix_seconds("no_at")
    return proposals.join(last, ["action_id", "scope_key"], "left").withColumn("suppressed", F.coalesce(age < cooldown_days * 86400, F.lit(False))).drop("no_at")


def bundles(steps: DataFrame) -> DataFrame:
    """Actions that at least two alerts share in one place: ``steps (alert_id, action_id, place, affected, revenue, score)``."""
    rows = steps.groupBy("action_id", F.coalesce("place", F.lit("*")).alias("place")).agg(
        F.count("*").alias("alerts"), F.sum("affected").alias("affected"), F.sum("revenue").alias("revenue"), F.max("score").alias("max_score")
    )
    return rows.where("alerts >= 2")


def action_score(weights: dict[str, float]) -> Column:
    """Geometric mean of impact, confidence, targeting, effect and prior (0 if any is not positive), less effort, risk and irreversibility.

    ``weights``: ``effort`` a day, ``risk`` of a risky kind, ``irreversible``.
    """
    factors = ["impact", "confidence", "targeting", "effect", "prior"]
    logs = sum((F.ln(F.when(F.col(f) > 0, F.col(f))) for f in factors[1:]), F.ln(F.when(F.col("impact") > 0, F.col("impact"))))
    gross = F.coalesce(F.exp(logs / float(len(factors))), F.lit(0.0))
    paid = F.col("effort_days") * weights["effort"] + F.when(F.col("risky"), weights["risk"]).otherwise(0.0) + F.when(~F.col("reversible"), weights["irreversible"]).otherwise(0.0)
    return F.round(gross - paid, 4)


def value_at_risk(alerts: DataFrame) -> DataFrame:
    """Revenue behind open alerts ``(alert_id, revenue, evidence array)``, each piece of evidence counted once, for the largest alert that names it."""
    each = alerts.select("alert_id", "revenue", F.size("evidence").alias("n"), F.explode("evidence").alias("id"))
    first = each.groupBy("id").agg(F.max_by(F.struct("alert_id", "revenue", "n"), F.struct("revenue", "alert_id")).alias("a")).select("a.*")
    return first.groupBy("alert_id", "revenue", "n").agg(F.round(F.col("revenue") * F.count("*") / F.col("n"), 2).alias("at_risk")).select("alert_id", "at_risk")


def growth() -> Column:
    """Relative growth of the current over the baseline rate; infinite from nothing, null where nothing is current."""
    rise = (F.col("current_rate") - F.col("baseline_rate")) / F.col("baseline_rate")
    return F.when(F.col("baseline_rate") > 0, rise).when(F.col("current_rate") > 0, F.lit(float("inf")))


def limited_per_type(actions: DataFrame, per_type: int = 2, total: int = 6) -> DataFrame:
    """What a coach shows: by severity, then lost value; at most ``per_type`` of a type and ``total`` in all."""
    order = [F.desc("severity"), F.desc_nulls_last("lost_value"), F.asc("action_id")]
    ranked = actions.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy(*order)))
    return ranked.where(F.col("_r") <= per_type).drop("_r").orderBy(*order).limit(total)


def summary(rows: DataFrame, by: str, now: str, trend_days: int = 28, products: int = 5) -> DataFrame:
    """Groups of complaints: rows, customers, days, weight, first and last, two adjacent periods, commonest cause and its share, products."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("ts")) / 86400
    named = F.coalesce("category", F.lit("Other")) != "Other"
    main = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.countDistinct("customer_id").alias("customers"), F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count_if((age >= 0) & (age < trend_days)).alias("recent"), F.count_if((age >= trend_days) & (age < 2 * trend_days)).alias("previous"), F.count_if(~named).alias("unlabelled"),
    )
    cause = rows.where(named).groupBy(by, "category", "cause").agg(F.count("*").alias("k"))
    cause = cause.groupBy(by).agg(F.max_by(F.struct("category", "cause", "k"), F.struct("k", "category", "cause")).alias("c")).select(by, F.col("c.category").alias("top_category"), F.col("c.cause").alias("top_cause"), F.col("c.k").alias("k"))
    sold = rows.groupBy(by, "product_name").agg(F.count("*").alias("k"))
    order = Window.partitionBy(by).orderBy(F.desc("k"), "product_name")
    sold = sold.withColumn("r", F.row_number().over(order)).where(F.col("r") <= products).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "product_name"))), lambda x: x["product_name"]), ";").alias("products"))
    both = main.join(cause, by, "left").join(sold, by, "left")
    return both.withColumn("cause_share", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6)).drop("k")


def case_effect(rows: DataFrame, hit: Column, opened: str, days: int) -> DataFrame:
    """One row: rows and hits ``days`` before and after a case was opened, and the change of the hit rate (null if a side is empty)."""
    at, span = F.lit(opened).cast("timestamp"), F.expr(f"interval {int(days)} days")
    before, after = (F.col("ts") >= at - span) & (F.col("ts") < at), (F.col("ts") >= at) & (F.col("ts") < at + span)
    r = rows.agg(F.count_if(before).alias("n_before"), F.count_if(before & hit).alias("hits_before"), F.count_if(after).alias("n_after"), F.count_if(after & hit).alias("hits_after"))
    rate = lambda k: F.try_divide(F.col(f"hits_{k}").cast("double"), F.col(f"n_{k}"))
    return r.select("*", F.round(rate("after") - rate("before"), 6).alias("change"), ((F.col("n_before") >= 30) & (F.col("n_after") >= 30)).alias("enough"))


def metric_cards(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of dashboard cards; shares are shown with a decimal comma."""
    valid = F.coalesce(F.col("weight"), F.lit(0.0)) > 0
    bad = F.count_if(valid & (F.col("sentiment") == "Negative"))
    top = rows.agg(F.count("*").alias("rows"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("excluded"), bad.alias("_bad"))
    both = top.crossJoin(F.broadcast(orders.agg(F.count("*").alias("_orders"))))  # one row each
    shown = F.concat(F.replace(F.format_string("%.1f", F.round(1000.0 * F.col("_bad") / F.col("valid")) / 10), F.lit("."), F.lit(",")), F.lit("%"))
    return both.select("rows", "valid", "excluded", shown.alias("negative_share"), F.round(F.try_divide(F.col("_bad").cast("double"), F.col("_orders")), 6).alias("complaint_rate"))


def eligible_actions(alerts: DataFrame, library: DataFrame, generic: str) -> DataFrame:
    """``(alert_id, action_id)``: actions of the alert's category whose needed slots are known and whose tier its severity allows; else ``generic``.

    The library is a catalogue of some hundred actions, so it is broadcast.
    """
    fits = (~F.col("escalated") | F.col("high")) & (F.size(F.array_except("needs", "slots")) == 0)
    found = alerts.join(F.broadcast(library), "category").where(fits).select("alert_id", "action_id")
    return alerts.select("alert_id").join(found, "alert_id", "left").fillna({"action_id": generic})
