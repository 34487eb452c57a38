"""From alerts to plans: where the evidence gathers, which actions fit, what each is worth, and what alerts share.

Alerts ``(alert_id, category, cause, product_name, region, level, q_value, affected,
current_rate, baseline_rate)``: a null cause, product or region stands for any.  Rows
are feedback with a weight.  Nulls: a row without time or category is no evidence; a null or empty
value of a dimension counts as missing there; an alert without evidence is DIFFUSE.
Of values equally common the first in order is taken.  No rows give no profiles; alerts
whose actions cannot be filled in have no step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .metrics import COUNTABLE, negative, weight

# When a value counts as concentrated; part of missing values beyond which a dimension is unusable.
MIN_SHARE, MIN_LIFT, MIN_COUNT, MAX_P, MAX_MISSING = 0.45, 1.4, 4, 0.05, 0.4
NEW_VALUE_LIFT = 99.0
# Of the score.
EFFORT_A_DAY, IRREVERSIBLE, MOST_STEPS = 0.035, 0.12, 5
RISK = {"FINANCIAL": 0.3, "CUSTOMER_CONTACT": 0.15, "CONTACT_PARTNER": 0.05, "INTERNAL_FIX": 0.03, "INVESTIGATE": 0.0}
PRIOR_ACCEPTED, PRIOR_DISMISSED = 2.8, 1.2
SUPPRESSING = ["ALREADY_DOING", "NOT_APPLICABLE", "đang làm rồi", "không áp dụng"]
#: Dimension, slot that its value fills, in order.
DIMENSIONS = [("region", "region"), ("product_name", "product"), ("product_category", "productGroup"), ("source", "channel"), ("hour", "hour"), ("weekday", "weekday")]
_OPEN = ["cause", "product_name", "region"]
_KEYS = ["category", "mask", *_OPEN]


def _places(x: Column, places: int) -> Column:
    """Rounded half up, without the noise of the last binary digits."""
    return F.round(F.round(x, 9), places)


def _hour(ts: str) -> Column:
    h = F.hour(ts)
    part = F.when(h < 6, "0–6h").when(h < 11, "6–11h").when(h < 14, "11–14h").when(h < 18, "14–18h")
    return F.when(h.isNotNull(), part.when(h < 22, "18–22h").otherwise("22–24h"))


def _values() -> Column:
    """The dimensions of a row as an array of (place, value), blank values as null."""
    value = {"hour": _hour("ts"), "weekday": F.date_format("ts", "EEEE")}
    pairs = [F.struct(F.lit(i).alias("dim"), F.nullif(value.get(d, F.col(d)), F.lit("")).alias("value")) for i, (d, _) in enumerate(DIMENSIONS)]
    return F.array(*pairs)


def _masked(alerts: DataFrame) -> DataFrame:
    """The alerts' keys: which of the open dimensions are set, and their values or blanks."""
    mask = sum((F.when(F.col(d).isNotNull(), 1 << i).otherwise(0) for i, d in enumerate(_OPEN)), F.lit(0))
    return alerts.select("alert_id", "category", mask.alias("mask"), *[F.coalesce(d, F.lit("")).alias(d) for d in _OPEN])


def evidence(alerts: DataFrame, items: DataFrame, now: str, window_days: int) -> DataFrame:
    """``items`` columns with ``alert_id``: countable complaints of the window that an alert stands for.

    Each complaint is dealt to its eight grouping sets, and these are joined with the
    alerts by equality; a set that needs a value which the row has not is left out.
    """
    start = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(window_days))
    rows = items.where(F.expr(COUNTABLE) & negative() & (F.col("ts") <= now) & (F.col("ts") >= start))
    sets = []
    for mask in range(1 << len(_OPEN)):
        taken = [d for i, d in enumerate(_OPEN) if mask >> i & 1]
        known = F.lit(True)
        for d in taken:
            known = known & F.col(d).isNotNull()
        sets.append(F.when(known, F.struct(F.lit(mask).alias("mask"), *[(F.col(d) if d in taken else F.lit("")).alias(d) for d in _OPEN])))
    dealt = rows.withColumn("_set", F.explode(F.array_compact(F.array(*sets))))
    dealt = dealt.select("*", F.col("category").alias("_category"), *[F.col("_set")[k].alias(f"_{k}") for k in _KEYS[1:]]).drop("_set")
    keys = _masked(alerts).select("alert_id", *[F.col(k).alias(f"_{k}") for k in _KEYS])
    return dealt.join(keys, [f"_{k}" for k in _KEYS]).drop(*[f"_{k}" for k in _KEYS])


def _counts(rows: DataFrame, *by: str) -> DataFrame:
    pair = rows.select(*by, F.explode(_values()).alias("_pair"))
    return pair.groupBy(*by, F.col("_pair.dim").alias("dim"), F.col("_pair.value").alias("value")).agg(F.count("*").alias("n"))


def dimension_profiles(found: DataFrame, items: DataFrame, now: str, window_days: int, baseline_days: int) -> DataFrame:
    """One row for each alert and dimension of ``found`` (``evidence``): the top value, its share here and before, lift, concentration.

    Before are all countable rows of the period before the window, not only complaints:
    the question is whether a value stands out from its usual part.
    """
    now_ = F.to_timestamp(F.lit(now))
    before = items.where(F.expr(COUNTABLE) & (F.col("ts") < now_ - F.make_dt_interval(F.lit(window_days))) & (F.col("ts") >= now_ - F.make_dt_interval(F.lit(baseline_days))))
    base = _counts(before).where("value is not null")
    total = base.groupBy("dim").agg(F.sum("n").alias("base_total"))  # one row a dimension
    here, n = F.col("value").isNotNull(), F.col("n")
    tops = _counts(found, "alert_id").groupBy("alert_id", "dim").agg(
        F.coalesce(F.sum(F.when(here, n)), F.lit(0)).alias("total"),
        F.sum(n).alias("evidence"),
        F.min(F.when(here, F.struct((-n).alias("n"), "value"))).alias("top"),
        F.count_if(here).alias("distinct_values"),
        F.coalesce(F.sum(F.when(here, n.cast("double") * n)), F.lit(0.0)).alias("squares"),
    )
    tops = tops.select("*", F.col("top.value").alias("value"), (-F.col("top.n")).alias("top_count")).drop("top")
    joined = tops.join(base.withColumnRenamed("n", "base_count"), ["dim", "value"], "left").join(F.broadcast(total), "dim", "left")
    x1, n1, x2, n2 = (F.coalesce(c, F.lit(0)).cast("double") for c in ("top_count", "total", "base_count", "base_total"))
    share, base_share = F.try_divide(x1, n1), F.try_divide(x2, n2)
    joined = joined.withColumn("missing_rate", 1 - n1 / F.col("evidence")).withColumn("_known", (n1 > 0) & (n2 > 0))
    lift = F.when(x2 > 0, F.try_divide(share, base_share)).otherwise(NEW_VALUE_LIFT)
    z = stats.two_proportion_z(x1, n1, x2, n2)
    tested = (F.col("missing_rate") <= MAX_MISSING) & (F.col("top_count") >= MIN_COUNT) & (share >= MIN_SHARE) & (lift >= MIN_LIFT) & (stats.two_sided_p(z) <= MAX_P)
    known = lambda c: F.when(F.col("_known"), c)
    return joined.select(
        "alert_id", "dim", F.element_at(F.array(*[F.lit(d) for d, _ in DIMENSIONS]), F.col("dim") + 1).alias("dimension"),
        known(F.col("value")).alias("top_value"), known(F.col("top_count")).alias("top_count"), known(F.col("distinct_values")).alias("distinct_values"),
        _places(F.col("missing_rate"), 3).alias("missing_rate"), known(_places(share, 3)).alias("share"), known(_places(base_share, 3)).alias("baseline_share"), known(_places(lift, 2)).alias("lift"),
        known(_places(F.col("squares") / (n1 * n1), 3)).alias("hhi"), known(_places(z, 2)).alias("z"), (F.col("_known") & tested).alias("concentrated"),
    )


def revenue(found: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row an alert: evidence, its weight, orders matched, money at risk and extrapolated to rows without an order.

    An order named twice counts each time; of several transactions of an order the
    largest is taken.  Below a third of rows with an order nothing is extrapolated.
    """
    amounts = transactions.groupBy("order_id").agg(F.max(F.coalesce("amount", F.lit(0.0))).cast("decimal(20,2)").alias("_amount"))
    rows = found.select("alert_id", "order_id", weight().alias("_w"))
    parts = rows.groupBy("alert_id", "order_id").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))  # few rows an order to join
    sums = parts.join(amounts, "order_id", "left").groupBy("alert_id").agg(
        F.sum("n").alias("evidence_count"), F.sum("w").alias("_w"), F.coalesce(F.sum(F.when(F.col("order_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_order"),
        F.coalesce(F.sum(F.when(F.col("_amount").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.col("_amount") * F.col("n")), F.lit(0)).cast("double").alias("money"),
    )
    coverage = F.col("with_order") / F.col("evidence_count")
    each = F.coalesce(F.try_divide(F.col("money"), F.col("matched").cast("double")), F.lit(0.0))
    return sums.select(
        "alert_id", "evidence_count", F.round(F.col("_w"), 2).cast("double").alias("weighted_count"), "matched", _places(coverage, 3).alias("coverage"),
        F.round("money").cast("long").alias("at_risk"), F.round(F.when(coverage >= 0.33, each * F.col("evidence_count")).otherwise(F.col("money"))).cast("long").alias("extrapolated"),
    )


def profiles(alerts: DataFrame, dimensions: DataFrame, money: DataFrame, window_days: int) -> DataFrame:
    """The alerts with their shape (FOCUSED, PARTIAL, DIFFUSE), money, and ``slots``: what is known to fill into an action."""
    hot = F.col("concentrated")
    shape = dimensions.groupBy("alert_id").agg(
        F.count_if(hot).cast("int").alias("focused"),
        F.avg(F.when(hot, F.least("lift", F.lit(5.0)))).alias("avg_lift"),
        F.min(F.when(hot, F.struct((-F.col("lift")).alias("l"), "dim", "share", "baseline_share"))).alias("_top"),
        *[F.max(F.when(hot & (F.col("dim") == i), F.col("top_value"))).alias(f"_{slot}") for i, (_, slot) in enumerate(DIMENSIONS)],
    )
    rows = alerts.join(shape, "alert_id", "left").join(money, "alert_id", "left")
    none = {"focused": 0, "evidence_count": 0, "weighted_count": 0.0, "matched": 0, "coverage": 0.0, "at_risk": 0, "extrapolated": 0, "affected": 0}
    rows = rows.fillna(none)
    percent = lambda c, digits=1: F.when(F.col(c).isNotNull(), F.concat(F.format_number(F.col(c) * 100, digits), F.lit("%")))
    slots = {slot: F.col(f"_{slot}") for _, slot in DIMENSIONS}
    slots |= {"product": F.coalesce("product_name", slots["product"]), "region": F.coalesce("region", slots["region"])}
    slots |= {
        "affected": F.col("affected").cast("string"), "evidenceCount": F.col("evidence_count").cast("string"), "windowDays": F.lit(f"{window_days} days" if window_days < 60 else f"{round(window_days / 30)} months"),
        "currentRate": percent("current_rate"), "baselineRate": percent("baseline_rate"), "revenue": F.when(F.col("matched") > 0, F.format_number("extrapolated", 0)),
        "topShare": percent("_top.share", 0), "topBaselineShare": percent("_top.baseline_share", 0),
    }
    kept = F.map_filter(F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    shape = F.when(F.col("focused") >= 2, "FOCUSED").when(F.col("focused") == 1, "PARTIAL").otherwise("DIFFUSE")
    scope = F.concat_ws("|", "category", *[F.coalesce(d, F.lit("*")) for d in _OPEN])
    return rows.withColumns({"slots": kept, "concentration": shape, "scope_key": scope}).drop("_top", *[f"_{s}" for _, s in DIMENSIONS])


def candidates(found: DataFrame, library: DataFrame) -> DataFrame:
    """Each alert with every action of its pool, the text filled in, and why an action does not fit (``reason``, else null).

    The pool is that of the cause, of the category where the cause has none, else the general one; a
    cause's gap adds the advice to record it; where nothing of these fits, the pool's safety net does if it can be filled in.
    ``library`` (``playbook.SCHEMA``) holds a handful of rows a pool.
    """
    pools = library.select(F.col("pool").alias("p")).distinct()
    for kind in ("cause", "category"):
        found = found.join(F.broadcast(pools.select(F.col("p").alias(f"_{kind}"))), F.concat(F.lit(f"{kind}/"), F.col(kind)) == F.col(f"_{kind}"), "left")
    general = F.lit("category/")
    found = found.withColumn("_pools", F.array(F.coalesce("_cause", "_category", general), F.concat(F.lit("net/"), F.substring_index(F.coalesce("_category", general), "/", -1))))
    rows = found.withColumn("pool", F.explode("_pools")).drop("_pools", "_cause", "_category").join(F.broadcast(library), "pool")
    needs = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1))
    unknown = lambda names: F.exists(names, lambda s: F.col("slots")[s].isNull())
    high, advice = F.coalesce(F.col("level").isin("High", "Critical"), F.lit(False)), F.col("role") == "action"
    reason = (
        F.when(advice & (F.col("tier") == "escalated") & ~high, "tier")
        .when(advice & ~F.array_contains("works_when", F.col("concentration")), "shape")
        .when(advice & unknown(F.col("requires")), "requires")
        .when((F.col("role") == "instrument") & F.col("slots")[F.col("gap_slot")].isNotNull(), "known")
        .when(unknown(needs), "template")
    )
    text = F.reduce(needs, F.col("template"), lambda t, s: F.replace(t, F.concat(F.lit("{"), s, F.lit("}")), F.col("slots")[s]))
    rows = rows.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), text))
    fits = F.max((advice & F.col("reason").isNull()).cast("int")).over(Window.partitionBy("alert_id"))  # a pool of actions
    return rows.withColumn("_fits", fits).where((F.col("role") != "net") | (F.col("_fits") == 0)).drop("_fits", "template", "pool")


def learned(decisions: DataFrame) -> DataFrame:
    """Per action of ``decisions (action_id, decision, reason, scope_key, at)``: how often accepted and dismissed."""
    return decisions.groupBy("action_id").agg(F.count_if(F.col("decision") == "ACCEPTED").alias("accepted"), F.count_if(F.col("decision") == "DISMISSED").alias("dismissed"))


def scored(rows: DataFrame, decisions: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """``candidates`` with the score's parts and ``score``; ``outcomes (action_id, n, sum_reduction)`` are measured effects of accepted actions."""
    rows = rows.join(learned(decisions), "action_id", "left").fillna({"accepted": 0, "dismissed": 0})
    if outcomes is not None:
        rows = rows.join(outcomes.select("action_id", F.col("n").alias("_n"), F.col("sum_reduction").alias("_sum")), "action_id", "left")
        share = F.col("_n") / (F.col("_n") + 2.0)
        mixed = (1 - share) * F.col("effect") + share * F.greatest(F.lit(0.01), F.least(F.lit(0.9), F.col("_sum") / F.col("_n")))
        rows = rows.withColumn("effect", F.when((F.col("_n") > 0) & (F.col("role") != "instrument"), mixed).otherwise(F.col("effect"))).drop("_n", "_sum")
    paid = stats.clamp01(F.log10(F.greatest(F.col("extrapolated"), F.lit(1)).cast("double")) / 8)
    rows = rows.withColumn("impact", F.when((F.col("matched") > 0) & (F.col("extrapolated") > 0), paid).otherwise(F.least(F.lit(1.0), F.col("affected") / 50.0)))
    firm = stats.clamp01(1 - F.coalesce("q_value", F.lit(0.05)) / 0.05) * 0.5 + F.least(F.lit(1.0), F.col("evidence_count") / 25.0) * 0.3
    trusted = F.coalesce(F.try_divide(F.col("weighted_count"), F.col("evidence_count").cast("double")), F.lit(0.0))
    rows = rows.withColumn("confidence", F.least(F.lit(1.0), firm + trusted * 0.2))
    aimed = F.when(F.size("requires") == 0, F.when(F.col("concentration") == "DIFFUSE", 0.7).otherwise(0.55))
    aimed = aimed.when(F.col("avg_lift").isNull(), 0.5).otherwise(F.least(F.lit(1.0), 0.5 + (F.col("avg_lift") - 1) * 0.125))
    accepted, dismissed = F.col("accepted") + PRIOR_ACCEPTED, F.col("dismissed") + PRIOR_DISMISSED
    rows = rows.withColumns({"targeting": aimed, "prior": accepted / (accepted + dismissed)})
    factors = [F.col(c) for c in ("impact", "confidence", "targeting", "effect", "prior")]
    logs = sum((F.ln(F.when(f > 0, f)) for f in factors[1:]), F.ln(F.when(factors[0] > 0, factors[0])))
    risk = F.lit(0.0)
    for kind, cost in RISK.items():
        risk = F.when(F.col("kind") == kind, cost).otherwise(risk)
    cost = F.col("effort_days") * EFFORT_A_DAY + risk + F.when(~F.col("reversible"), IRREVERSIBLE).otherwise(0.0)
    return rows.withColumn("score", F.round(F.coalesce(F.exp(logs / float(len(factors))), F.lit(0.0)) - cost, 4))


def plan(rows: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """``scored`` rows with their ``state``: step (with ``step``, at most five an alert), spare, data gap, suppressed or rejected.

    An action dismissed in the alert's scope for one of the suppressing reasons rests for its cooldown.
    Advice to record data is a step only where no other action is left.
    """
    no = decisions.where((F.col("decision") == "DISMISSED") & F.trim("reason").isin(SUPPRESSING))
    last = no.groupBy("action_id", "scope_key").agg(F.max("at").alias("_no"))  # the youngest decides
    age = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros("_no")
    resting = F.coalesce(age < F.col("cooldown_days") * 86_400_000_000, F.lit(False))
    state = F.when(F.col("reason").isNotNull(), "rejected").when(resting, "suppressed").when(F.col("role") == "instrument", "data gap").otherwise("step")
    rows = rows.join(last, ["action_id", "scope_key"], "left").withColumn("state", state).drop("_no")
    alert = Window.partitionBy("alert_id")  # a pool of actions
    left = F.max((F.col("state") == "step").cast("int")).over(alert)
    rows = rows.withColumn("state", F.when((F.col("state") == "data gap") & (left == 0), "step").otherwise(F.col("state")))
    place = F.row_number().over(Window.partitionBy("alert_id", "state").orderBy(F.desc("score"), "place"))
    rows = rows.withColumn("_at", place)
    rows = rows.withColumn("state", F.when((F.col("state") == "step") & (F.col("_at") > MOST_STEPS), "spare").otherwise(F.col("state")))
    follow_up = F.when(F.col("tier") == "escalated", 7).otherwise(14)
    rows = rows.withColumns({
        "step": F.when(F.col("state") == "step", F.col("_at")), "requires_approval": F.col("kind").isin("FINANCIAL", "CUSTOMER_CONTACT"), "follow_up_days": follow_up,
        "target_rate": F.round(F.coalesce("current_rate", F.lit(0.0)) * (1 - F.when(F.col("role") == "instrument", 0.0).otherwise(F.col("effect"))), 4),
    })
    return rows.drop("_at", "place")


def recommend(alerts: DataFrame, items: DataFrame, transactions: DataFrame, library: DataFrame, decisions: DataFrame, now: str, window_days: int, baseline_days: int, outcomes: DataFrame | None = None) -> DataFrame:
    """One row for each alert and action considered: the alert's profile, the action's text, score and state."""
    found = evidence(alerts, items, now, window_days)
    known = profiles(alerts, dimension_profiles(found, items, now, window_days, baseline_days), revenue(found, transactions), window_days)
    return plan(scored(candidates(known, library), decisions, outcomes), decisions, now)


def shared_actions(plans: DataFrame) -> DataFrame:
    """Steps that at least two alerts share in one region or product: alerts, people, money and the best score."""
    place = F.coalesce(F.col("slots")["region"], F.col("slots")["product"], F.lit("*"))
    rows = plans.where("state = 'step'").groupBy("action_id", place.alias("place")).agg(
        F.count("*").alias("alerts"), F.sum("affected").alias("affected"), F.sum("extrapolated").alias("revenue"), F.max("score").alias("max_score")
    )
    return rows.where("alerts >= 2")
