"""Queries on recommendations: alerts over complaints of the last month, their profiles, plans and shared actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_pain as _pain
from .config import CATEGORIES
from .operators import playbook
from .operators import recommendations as advice
from .queries import _FEEDBACK, QUERIES, SQL, query
from .sources import adapters
from .sources.adapters import NOW

__all__ = ["QUERIES", "SQL", "_pain"]

WINDOW, BASELINE = 30, 180
_CAUSES = {c: causes for c, (_, causes) in CATEGORIES.items()}


def _items(spark, sf_dir):
    """Feedback with named causes and a weight."""
    cause = F.col("cause")
    for category, names in _CAUSES.items():
        for i, name in enumerate(names):
            cause = F.when(F.col("cause") == f"{category}-{i}", name).otherwise(cause)
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    return rows.withColumns({"cause": cause, "weight": F.round((F.col("customer_id") % 5) * 0.25, 2)})


def _alerts(items):
    """Alerts of four grouping sets with at least four complaints of the last month."""
    rows = items.where("weight > 0").withColumn("hit", (F.col("sentiment") == "Negative") & (F.col("ts") >= "2001-05-31"))
    rows = rows.groupingSets([[F.col(c) for c in s] for s in (["category"], ["category", "cause"], ["category", "cause", "region"], ["category", "product_name"])], "category", "cause", "product_name", "region").agg(
        F.count_if("hit").alias("x"), F.count_if((F.col("sentiment") == "Negative") & ~F.col("hit")).alias("x2"), F.countDistinct(F.when(F.col("hit"), F.col("customer_id"))).alias("affected")
    )
    rows = rows.where("x >= 4 and category <> 'Other'")
    level = F.when(F.col("x") % 4 == 0, "Critical").when(F.col("x") % 4 == 1, "High").otherwise("Low")
    name = F.concat_ws("|", "category", *[F.coalesce(c, F.lit("*")) for c in ("cause", "product_name", "region")])
    return rows.select(
        name.alias("alert_id"), "category", "cause", "product_name", "region", level.alias("level"), ((F.col("x") % 6) / 100.0).alias("q_value"), "affected",
        (F.col("x") / 500.0).alias("current_rate"), (F.col("x2") / 50000.0).alias("baseline_rate"),
    )


def _decisions(spark, sf_dir, alerts):
    """Two thirds of the alerts have a decision on one of two actions, some of them of this week."""
    rows = alerts.where("affected % 3 > 0")
    return rows.select(
        F.when(F.col("affected") % 2 == 0, "LD-AUDIT-ALL").otherwise("FB-CS").alias("action_id"), F.when(F.col("affected") % 3 == 1, "DISMISSED").otherwise("ACCEPTED").alias("decision"),
        F.lit("NOT_APPLICABLE ").alias("reason"), F.col("alert_id").alias("scope_key"), (F.to_timestamp(F.lit(NOW)) - F.make_dt_interval((F.col("affected") % 20).cast("int"))).alias("at"),
    )




def _r(x: str, places: int) -> str:
    return f"round(CAST({x} AS DECIMAL(18, 9)), {places})::DOUBLE"


_NAMED = " ".join(f"WHEN cause = '{c}-{i}' THEN '{n}'" for c, names in _CAUSES.items() for i, n in enumerate(names))
_ADVICE = "WITH " + _FEEDBACK + f""", items AS (SELECT * REPLACE (CASE {_NAMED} ELSE cause END AS cause), round((customer_id % 5) * 0.25, 2)::DOUBLE AS weight FROM feedback),
hit AS (SELECT *, sentiment = 'Negative' AND ts >= TIMESTAMP '2001-05-31' AS hit FROM items WHERE weight > 0),
counted AS (SELECT category, cause, product_name, region, count(*) FILTER (hit) AS x, count(*) FILTER (sentiment = 'Negative' AND NOT hit) AS x2, count(DISTINCT CASE WHEN hit THEN customer_id END) AS affected
  FROM hit GROUP BY GROUPING SETS ((category), (category, cause), (category, cause, region), (category, product_name))),
alerts AS (SELECT concat_ws('|', category, coalesce(cause, '*'), coalesce(product_name, '*'), coalesce(region, '*')) AS alert_id, category, cause, product_name, region,
  CASE WHEN x % 4 = 0 THEN 'Critical' WHEN x % 4 = 1 THEN 'High' ELSE 'Low' END AS level, (x % 6) / 100.0::DOUBLE AS q_value, affected, x / 500.0::DOUBLE AS current_rate, x2 / 50000.0::DOUBLE AS baseline_rate
  FROM counted WHERE x >= 4 AND category <> 'Other'),
ev AS (SELECT a.alert_id, h.* FROM hit h JOIN alerts a ON h.category = a.category AND (a.cause IS NULL OR a.cause = h.cause) AND (a.product_name IS NULL OR a.product_name = h.product_name) AND (a.region IS NULL OR a.region = h.region) WHERE hit),
before AS (SELECT * FROM items WHERE weight > 0 AND ts < TIMESTAMP '2001-05-31' AND ts >= TIMESTAMP '2001-01-01'),
""" + ", ".join(
    f"{out} AS (" + " UNION ALL ".join(f"SELECT {key}{i} AS dim, {v} AS value FROM {rows}" for i, v in enumerate(["region", "product_name", "product_category", "source", "'0–6h'", "dayname(ts)"])) + ")"
    for out, key, rows in (("evd", "alert_id, ", "ev"), ("bd", "", "before"))
) + f""",
b AS (SELECT dim, value, count(*) AS n FROM bd GROUP BY ALL), bt AS (SELECT dim, sum(n)::DOUBLE AS n2 FROM b GROUP BY 1),
e AS (SELECT alert_id, dim, value, count(*) AS n FROM evd GROUP BY ALL),
t AS (SELECT alert_id, dim, arg_min(value, (-n, value)) AS top_value, max(n) AS top_count, count(*) AS distinct_values, sum(n)::DOUBLE AS n1, sum(n * n)::DOUBLE AS sq FROM e GROUP BY 1, 2),
j AS (SELECT t.*, bt.n2, coalesce(b.n, 0)::DOUBLE AS x2 FROM t JOIN bt USING (dim) LEFT JOIN b ON b.dim = t.dim AND b.value = t.top_value),
k AS (SELECT *, top_count / n1 AS sh, x2 / n2 AS bs, CASE WHEN x2 > 0 THEN (top_count / n1) / (x2 / n2) ELSE {advice.NEW_VALUE_LIFT} END AS lf, (top_count + x2) / (n1 + n2) AS pooled FROM j),
prof AS (SELECT alert_id, dim, top_value, top_count, distinct_values, 0.0::DOUBLE AS missing_rate, {_r('sh', 3)} AS share, {_r('bs', 3)} AS baseline_share, {_r('lf', 2)} AS lift, {_r('sq / (n1 * n1)', 3)} AS hhi,
  CASE WHEN pooled < 1 THEN (sh - bs) / sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)) ELSE 0 END AS z0, sh, lf, top_count >= 4 AND sh >= 0.45 AND lf >= 1.4 AND z0 >= 1.95996398 AS concentrated FROM k)
"""

_LIB = ",\n".join(
    "(" + ", ".join([f"'{r[0]}'", str(r[1]), f"'{r[2]}'", f"'{r[3]}'", f"'{r[4]}'", f"'{r[5]}'", str(r[6]) + "::VARCHAR[]", str(r[7]), str(r[8]), str(r[9]), f"{r[10]}::DOUBLE", str(r[11]), str([w.split("}")[0] for w in r[13].split("{")[1:]]) + "::VARCHAR[]"]) + ")"
    for r in playbook.rows()
)
_PLANS = _ADVICE + f""",
lib AS (SELECT * FROM (VALUES {_LIB}) l(pool, place, role, action_id, tier, kind, requires, works_when, effort_days, reversible, effect, cooldown_days, needs)),
shape AS (SELECT alert_id, count(*) FILTER (concentrated) AS focused, avg(least(lift, 5.0)) FILTER (concentrated) AS avg_lift, list(dim) FILTER (concentrated) AS dims,
  max(top_value) FILTER (concentrated AND dim = 0) AS r, max(top_value) FILTER (concentrated AND dim = 1) AS p FROM prof GROUP BY 1),
amounts AS (SELECT order_id, max(amount) AS amount FROM txn GROUP BY 1),
money AS (SELECT alert_id, count(*) AS n, round(sum(CAST(weight AS DECIMAL(18, 4))), 2)::DOUBLE AS w, count(e.order_id) AS o, count(amount) AS m, coalesce(sum(CAST(amount AS DECIMAL(20, 2))), 0)::DOUBLE AS money FROM ev e LEFT JOIN amounts USING (order_id) GROUP BY 1),
known AS (SELECT a.*, s.focused, s.avg_lift, m.n, m.w, m.m, CASE WHEN o / n::DOUBLE >= 0.33 THEN round(coalesce(money / nullif(m, 0), 0) * n) ELSE round(money) END::BIGINT AS extrapolated,
  CASE WHEN focused >= 2 THEN 'FOCUSED' WHEN focused = 1 THEN 'PARTIAL' ELSE 'DIFFUSE' END AS concentration, coalesce(a.region, r) AS place_region, coalesce(a.product_name, p) AS place_product,
  list_filter(['affected', 'evidenceCount', 'windowDays', 'currentRate', 'baselineRate', CASE WHEN m > 0 THEN 'revenue' END, CASE WHEN focused > 0 THEN 'topShare' END, CASE WHEN focused > 0 THEN 'topBaselineShare' END,
    CASE WHEN coalesce(a.region, r) IS NOT NULL THEN 'region' END, CASE WHEN coalesce(a.product_name, p) IS NOT NULL THEN 'product' END, CASE WHEN list_contains(dims, 2) THEN 'productGroup' END,
    CASE WHEN list_contains(dims, 3) THEN 'channel' END, CASE WHEN list_contains(dims, 4) THEN 'hour' END, CASE WHEN list_contains(dims, 5) THEN 'weekday' END], lambda x: x IS NOT NULL) AS slots
  FROM alerts a JOIN shape s USING (alert_id) JOIN money m USING (alert_id)),
pooled AS (SELECT k.*, CASE WHEN k.cause IN (SELECT pool[7:] FROM lib WHERE pool LIKE 'cause/%') THEN 'cause/' || k.cause ELSE 'category/' || k.category END AS pool1 FROM known k),
cand AS (SELECT p.*, l.* EXCLUDE (pool), CASE WHEN role = 'action' AND tier = 'escalated' AND level NOT IN ('High', 'Critical') THEN 'tier' WHEN role = 'action' AND NOT list_contains(works_when, concentration) THEN 'shape'
  WHEN role = 'action' AND NOT list_has_all(slots, requires) THEN 'requires' WHEN NOT list_has_all(slots, needs) THEN 'template' END AS reason FROM pooled p JOIN lib l ON l.pool = p.pool1 OR l.pool = 'net/' || p.category),
fit AS (SELECT * FROM cand QUALIFY role <> 'net' OR count(*) FILTER (role = 'action' AND reason IS NULL) OVER (PARTITION BY alert_id) = 0),
dec AS (SELECT CASE WHEN affected % 2 = 0 THEN 'LD-AUDIT-ALL' ELSE 'FB-CS' END AS action_id, CASE WHEN affected % 3 = 1 THEN 'DISMISSED' ELSE 'ACCEPTED' END AS decision, alert_id AS scope_key, affected % 20 AS age FROM alerts WHERE affected % 3 > 0),
priors AS (SELECT action_id, (2.8 + count(*) FILTER (decision = 'ACCEPTED')) / (4.0 + count(*)) AS prior FROM dec GROUP BY 1),
part AS (SELECT f.*, coalesce(prior, 0.7)::DOUBLE AS prior, CASE WHEN m > 0 AND extrapolated > 0 THEN least(1, log10(extrapolated) / 8) ELSE least(1.0, affected / 50.0) END AS impact,
  least(1.0, least(1, greatest(0, 1 - q_value / 0.05)) * 0.5 + least(1.0, n / 25.0) * 0.3 + w / n * 0.2) AS confidence,
  CASE WHEN len(requires) = 0 THEN CASE WHEN concentration = 'DIFFUSE' THEN 0.7 ELSE 0.55 END WHEN focused = 0 THEN 0.5 ELSE least(1.0, 0.5 + (avg_lift - 1) * 0.125) END AS targeting
  FROM fit f LEFT JOIN priors USING (action_id)),
scored AS (SELECT *, round(coalesce(pow(impact * confidence * targeting * effect * prior, 0.2), 0) - effort_days * 0.035 - CASE kind WHEN 'FINANCIAL' THEN 0.3 WHEN 'CUSTOMER_CONTACT' THEN 0.15 WHEN 'CONTACT_PARTNER' THEN 0.05 WHEN 'INTERNAL_FIX' THEN 0.03 ELSE 0 END
  - CASE WHEN reversible THEN 0 ELSE 0.12 END, 4)::DOUBLE AS score FROM part),
s1 AS (SELECT s.*, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN EXISTS (SELECT 1 FROM dec d WHERE d.action_id = s.action_id AND d.scope_key = s.alert_id AND decision = 'DISMISSED' AND age < cooldown_days) THEN 'suppressed'
  WHEN role = 'instrument' THEN 'data gap' ELSE 'step' END AS s0 FROM scored s),
s2 AS (SELECT *, CASE WHEN s0 = 'data gap' AND count(*) FILTER (s0 = 'step') OVER (PARTITION BY alert_id) = 0 THEN 'step' ELSE s0 END AS s_ FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY alert_id, s_ ORDER BY score DESC, place) AS at_ FROM s2),
plans AS (SELECT *, CASE WHEN s_ = 'step' AND at_ > 5 THEN 'spare' ELSE s_ END AS state FROM s3)
"""


@query(_ADVICE + f"SELECT alert_id, [{', '.join(repr(d) for d, _ in advice.DIMENSIONS)}][dim + 1] AS dimension, top_value, top_count, distinct_values, missing_rate, share, baseline_share, lift, hhi, {_r('z0', 2)} AS z, concentrated FROM prof")
def mth_19_dimension_profiles(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = advice.evidence(_alerts(items), items, NOW, WINDOW)
    return advice.dimension_profiles(found, items, NOW, WINDOW, BASELINE).drop("dim")


def _plans(spark, sf_dir):
    items = _items(spark, sf_dir)
    alerts = _alerts(items)
    return advice.recommend(alerts, items, adapters.transactions(spark, sf_dir), playbook.library(spark), _decisions(spark, sf_dir, alerts), NOW, WINDOW, BASELINE)


@query(_PLANS + f"""SELECT alert_id, concentration, n AS evidence_count, w AS weighted_count, extrapolated, action_id, role, reason, {_r('impact', 3)} AS impact, {_r('confidence', 3)} AS confidence, {_r('targeting', 3)} AS targeting,
{_r('prior', 3)} AS prior, score, state, CASE WHEN state = 'step' THEN at_ END AS step, kind IN ('FINANCIAL', 'CUSTOMER_CONTACT') AS requires_approval FROM plans""")
def cmp_09_recommendations(spark, sf_dir):
    """Every alert with every action considered for it, its score and what becomes of it."""
    parts = [F.round(F.round(c, 9), 3).alias(c) for c in ("impact", "confidence", "targeting", "prior")]
    return _plans(spark, sf_dir).select("alert_id", "concentration", "evidence_count", "weighted_count", "extrapolated", "action_id", "role", "reason", *parts, "score", "state", "step", "requires_approval")


@query(_PLANS + "SELECT action_id, coalesce(place_region, place_product, '*') AS place, count(*) AS alerts, sum(affected)::BIGINT AS affected, sum(extrapolated)::BIGINT AS revenue, max(score) AS max_score FROM plans WHERE state = 'step' GROUP BY 1, 2 HAVING count(*) >= 2")
def mth_22_shared_actions(spark, sf_dir):
    """Actions that several alerts share in one region or product."""
    return advice.shared_actions(_plans(spark, sf_dir))
