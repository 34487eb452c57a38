"""Queries over the shared tables: one entry per operator, and the same in SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats, text
from .operators import alerts, joins, metrics, near_duplicates, retrieval, trust
from .plans.context import items
from .sources import adapters
from .sources.adapters import NOW, table
from .streaming import live

QUERIES: dict = {}
SQL: dict = {}

# ---------------------------------------------------------------------------
# SQL that several queries begin with

_FEEDBACK = """
fb AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS feedback_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Hotline' WHEN '2-HIGH' THEN 'Shopee' WHEN '3-MEDIUM' THEN 'Tiki' WHEN '4-NOT SPECIFIED' THEN 'Facebook' ELSE 'Website' END AS source,
    c_name AS author, o_custkey AS customer_id, CAST(o_custkey % 700 AS DOUBLE) AS account_age_days, CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS INTEGER) AS rating,
    l_shipdate >= TIMESTAMP '2001-06-23' AND l_partkey % 3 = 0 AS planted, l_returnflag, l_suppkey, l_partkey, p_name AS product_name, p_type AS product_category, n_name AS region,
    CASE WHEN l_linenumber % 4 <> 0 THEN l_orderkey END AS order_id, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
fc AS (
  SELECT *, CASE WHEN planted OR l_returnflag = 'R' THEN 'Negative' WHEN l_returnflag = 'A' THEN 'Neutral' ELSE 'Positive' END AS sentiment,
    CASE WHEN planted THEN 'Delivery' ELSE ['Delivery', 'ProductQuality', 'CustomerService', 'Payment', 'TechnicalApp', 'ReturnRefund', 'PricePromotion', 'Other'][CAST(l_suppkey % 8 + 1 AS BIGINT)] END AS category
  FROM fb),
feedback AS (
  SELECT * EXCLUDE (planted, l_returnflag, l_suppkey, l_partkey), CASE WHEN planted THEN 'LateDelivery' ELSE category || '-' || (l_partkey % 5) END AS cause FROM fc WHERE ts <= TIMESTAMP '2001-06-30'),
txn AS (SELECT o_orderkey AS order_id, o_orderdate AS ordered_at, o_orderdate - to_days(CAST(o_orderkey % 4 * 400 AS INTEGER)) AS delivered_at, o_totalprice AS amount FROM orders)
"""
_TIER = """
tiered AS (
  SELECT *, CASE WHEN author IS NULL OR account_age_days < 7 THEN 'P5' WHEN order_id IS NOT NULL AND source IN ('Shopee', 'Tiki', 'Hotline') THEN 'P1'
    WHEN source = 'Hotline' THEN 'P2' WHEN source IN ('Shopee', 'Tiki', 'Hotline') THEN 'P3' ELSE 'P4' END AS tier FROM feedback)
"""
_ITEMS = (
    "WITH "
    + _FEEDBACK
    + ","
    + _TIER
    + """,
weighed AS (SELECT *, CASE tier WHEN 'P1' THEN 1.0 WHEN 'P2' THEN 0.9 WHEN 'P3' THEN 0.6 WHEN 'P4' THEN 0.4 ELSE 0.15 END::DOUBLE AS tier_weight FROM tiered),
book AS (SELECT order_id, max(delivered_at) AS order_delivered_at, true AS found FROM txn GROUP BY order_id),
matched AS (SELECT w.*, b.order_delivered_at, coalesce(b.found, false) AS order_found FROM weighed w LEFT JOIN book b USING (order_id)),
cover AS (SELECT count(order_id) AS with_order, count(*) FILTER (order_id IS NOT NULL AND order_found) AS matched, count(*) FILTER (order_id IS NOT NULL AND order_found) / count(order_id)::DOUBLE AS coverage FROM matched),
near AS (SELECT *, count(*) OVER f AS near, avg(CASE WHEN account_age_days < 7 THEN 1.0 ELSE 0.0 END) OVER f AS new_share FROM matched
  WINDOW f AS (PARTITION BY product_name ORDER BY epoch(ts) RANGE BETWEEN 1800 PRECEDING AND 1800 FOLLOWING)),
med AS (SELECT product_name, list_sort(list(near))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS m, count(*) AS rows FROM near GROUP BY product_name),
mad AS (SELECT product_name, list_sort(list(abs(near - m)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS d FROM near JOIN med USING (product_name) GROUP BY product_name),
burst AS (SELECT n.*, CASE WHEN rows >= 8 THEN (near - m) / coalesce(nullif(1.4826 * d, 0), 1) ELSE 0 END AS burst_z FROM near n JOIN med USING (product_name) JOIN mad USING (product_name)),
gaps AS (SELECT *, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY customer_id ORDER BY ts)) / 60 AS gap FROM feedback),
acc AS (SELECT customer_id, count(*) AS reviews, coalesce(min(account_age_days), 365) AS least_age, count(*) / greatest(1.0, (epoch(max(ts)) - epoch(min(ts))) / 86400) AS per_day,
  coalesce(count(*) FILTER (rating IN (1, 5)) / nullif(count(rating), 0)::DOUBLE, 0.5) AS extreme, CASE WHEN count(gap) >= 2 THEN 1 / (1 + ln(1 + coalesce(var_samp(gap), 0))) ELSE 0 END AS regularity FROM gaps GROUP BY customer_id),
risk AS (SELECT *, greatest(CASE WHEN least_age < 7 AND reviews <= 2 AND extreme >= 0.99 THEN 0.75 WHEN least_age < 7 THEN 0.45 ELSE 0 END, CASE WHEN per_day > 5 THEN 0.6 ELSE 0 END,
  CASE WHEN regularity > 0.85 AND reviews >= 4 THEN 0.65 ELSE 0 END)::DOUBLE AS risk FROM acc),
signal AS (SELECT b.*, r.risk AS account, CASE WHEN burst_z > 3 THEN least(1.0, burst_z / 6 * (0.5 + new_share)) ELSE 0 END AS burst,
  CASE WHEN rating IS NULL THEN 0 ELSE least(1.0, greatest(0.0, (abs((rating - 3) / 2.0 - CASE sentiment WHEN 'Positive' THEN 1 WHEN 'Negative' THEN -1 ELSE 0 END) / 2 - 0.25) / 0.75)) END AS star,
  CASE WHEN order_id IS NULL THEN 0 WHEN NOT order_found THEN CASE WHEN (SELECT coverage FROM cover) >= 0.5 THEN 0.6 ELSE 0 END WHEN epoch(order_delivered_at) - epoch(ts) > 43200 THEN 0.95 ELSE 0 END AS transaction
  FROM burst b LEFT JOIN risk r USING (customer_id)),
scored AS (SELECT *, round(1 / (1 + exp(-(-3.2 + 2.5 * burst + 2.6 * coalesce(account, 0) + 2.8 * star + 4.5 * transaction))), 4) AS score FROM signal),
banded AS (SELECT *, CASE WHEN score >= 0.7 THEN 'LIKELY_INAUTHENTIC' WHEN score >= 0.4 THEN 'GRAY_ZONE' ELSE 'ACCEPTED' END AS band, (epoch(TIMESTAMP '2001-06-30') - epoch(ts)) / 86400.0 AS age FROM scored),
items AS (SELECT *, CASE WHEN band = 'LIKELY_INAUTHENTIC' THEN 0 ELSE round(tier_weight * (1 - score) * pow(0.5, greatest(0.0, age) / 180), 4) END AS weight, round(1 - abs(score - 0.5) * 2, 4) AS uncertainty,
  sentiment = 'Negative' AS bad, CASE WHEN tier IN ('P1', 'P2') THEN 'verified' ELSE 'inferred' END AS evidence FROM banded),
ok AS (SELECT * FROM items WHERE coalesce(weight, 0) > 0)
"""
)
_LIVE = """
WITH live AS (SELECT event_id AS comment_id, ts, user_id AS author, CASE event_type WHEN 'error' THEN 'complaint' WHEN 'view' THEN 'question' WHEN 'purchase' THEN 'order' WHEN 'signup' THEN 'praise' ELSE 'chatter' END AS intent,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS product_id, 1 + CAST(floor(value) AS BIGINT) % 3 AS quantity FROM events)
"""
_FOLD_FROM = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
_FOLD_TO = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"
_TOKENS = f"list_filter(regexp_split_to_array(translate(lower(text), '{_FOLD_FROM}', '{_FOLD_TO}'), '[^\\pL\\pN]+'), lambda x: length(x) > 1)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.live_comments(table(spark, sf_dir, "events"))


# ---------------------------------------------------------------------------
# Trust layer


@query("WITH " + _FEEDBACK + "," + _TIER + "SELECT source, tier, count(*) AS n FROM tiered GROUP BY source, tier")
def mth_17_tiers(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    return rows.withColumn("tier", trust.tier()).groupBy("source", "tier").agg(F.count("*").alias("n"))


@query(_ITEMS + "SELECT with_order, matched, coverage FROM cover")
def join_02_order_coverage(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    return trust.order_coverage(trust.with_orders(rows, adapters.transactions(spark, sf_dir)))


@query(_ITEMS + "SELECT feedback_id, near, round(burst_z, 6) AS burst_z, round(burst, 6) AS burst FROM signal")
def win_01_bursts(spark, sf_dir):
    rows = trust.bursts(adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW))
    return rows.select("feedback_id", "near", F.round("burst_z", 6).alias("burst_z"), F.round("burst", 6).alias("burst"))


@query(_ITEMS + "SELECT customer_id, reviews, least_age, round(per_day, 6) AS per_day, round(extreme, 6) AS extreme, round(regularity, 6) AS regularity, risk FROM risk")
def win_05_account_features(spark, sf_dir):
    rows = trust.account_features(adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW))
    return rows.select("customer_id", "reviews", "least_age", *[F.round(c, 6).alias(c) for c in ("per_day", "extreme", "regularity")], "risk")


@query()
def mth_13_isolation_forest(spark, sf_dir):
    rows = trust.account_features(adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW))
    return trust.isolation_scores(rows, ["least_age", "per_day", "extreme", "regularity", "reviews"], "customer_id")


@query(_ITEMS + "SELECT feedback_id, tier, score, band, weight, uncertainty FROM items")
def cmp_01_trust_layer(spark, sf_dir):
    return items(spark, sf_dir).select("feedback_id", "tier", "score", "band", "weight", "uncertainty")


@query(_ITEMS + """, f AS (SELECT count(*) AS collected, count(*) FILTER (band = 'SPAM') AS spam, count(*) FILTER (band = 'LIKELY_INAUTHENTIC') AS inauthentic, count(*) FILTER (band = 'GRAY_ZONE') AS pending,
  count(*) FILTER (band = 'ACCEPTED') AS accepted, count(DISTINCT source) AS channels, count(*) FILTER (tier IN ('P1', 'P2')) AS reconcilable, CAST(round(sum(CAST(weight AS DECIMAL(18, 4))), 2) AS DOUBLE) AS effective_weight, min(age) AS newest FROM items)
SELECT * EXCLUDE (newest), CAST(floor((0.4 * (accepted + pending) / collected + 0.2 * least(1.0, channels / 5.0) + 0.2 * greatest(0.0, least(1.0, 1 - (newest * 24 - 1) / 23)) + 0.2 * reconcilable / collected) * 100 + 0.5) AS BIGINT) AS health FROM f""")
def agg_21_trust_funnel(spark, sf_dir):
    return trust.funnel(items(spark, sf_dir), NOW)


@query(_ITEMS + "SELECT feedback_id, uncertainty, score FROM items WHERE band = 'GRAY_ZONE' ORDER BY uncertainty DESC, feedback_id LIMIT 50")
def ord_04_review_queue(spark, sf_dir):
    return trust.review_queue(items(spark, sf_dir)).select("feedback_id", "uncertainty", "score")


# ---------------------------------------------------------------------------
# Metrics


@query(_ITEMS + """, t AS (SELECT CAST(round(coalesce(sum(CAST(weight AS DECIMAL(18, 4))) FILTER (bad AND tier IN ('P1', 'P2')), 0), 2) AS DOUBLE) AS weighted_complaints, count(*) FILTER (tier IN ('P1', 'P2')) AS reconcilable, count(*) AS countable FROM ok)
SELECT t.*, (SELECT count(*) FROM txn) AS transactions, round(weighted_complaints / (SELECT count(*) FROM txn), 6) AS wcr, round(reconcilable / countable::DOUBLE, 6) AS coverage FROM t""")
def agg_01_weighted_complaint_rate(spark, sf_dir):
    return metrics.weighted_complaint_rate(items(spark, sf_dir), adapters.transactions(spark, sf_dir))


@query(_ITEMS + "SELECT source, count(*) AS n, CAST(round(sum(CAST(weight AS DECIMAL(18, 4))), 2) AS DOUBLE) AS weight, round(coalesce(sum(weight) FILTER (bad), 0) / sum(weight), 6) AS negative_share, round(count(*) FILTER (bad) / count(*)::DOUBLE, 6) AS negative_rate FROM ok GROUP BY source")
def agg_02_share_of_negative(spark, sf_dir):
    return metrics.share_of_negative(items(spark, sf_dir), "source")


@query(_ITEMS + """, v AS (SELECT round(count(*) FILTER (bad AND age >= 0 AND age <= 7) / 7.0, 6) AS current, round(count(*) FILTER (bad AND age > 7 AND age <= 28) / 21.0, 6) AS before FROM ok)
SELECT *, round(CASE WHEN before = 0 THEN CASE WHEN current > 0 THEN 1.0 ELSE 0.0 END ELSE (current - before) / before END, 6) AS velocity FROM v""")
def agg_03_negative_velocity(spark, sf_dir):
    return metrics.negative_velocity(items(spark, sf_dir), NOW)


@query(_ITEMS + """, s AS (SELECT CAST(least(floor((84 - age) / 7), 11) AS INTEGER) AS bucket, count(*) FILTER (weight > 0) AS n, CAST(round(coalesce(sum(CAST(weight AS DECIMAL(18, 4))) FILTER (weight > 0), 0), 2) AS DOUBLE) AS weight,
  CAST(round(coalesce(sum(CAST(weight AS DECIMAL(18, 4))) FILTER (bad AND weight > 0), 0), 2) AS DOUBLE) AS negative_weight, count(*) FILTER (weight <= 0) AS excluded FROM items WHERE age >= 0 AND age <= 84 GROUP BY 1)
SELECT CAST(r.b AS INTEGER) AS bucket, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(negative_weight, 0) AS negative_weight, coalesce(excluded, 0) AS excluded FROM range(12) r(b) LEFT JOIN s ON s.bucket = r.b""")
def agg_04_weighted_series(spark, sf_dir):
    return metrics.weighted_series(items(spark, sf_dir), NOW)


@query(_ITEMS + """, p AS (SELECT count(*) FILTER (a) AS n_now, count(*) FILTER (b) AS n_before, CAST(round(coalesce(sum(CAST(weight AS DECIMAL(18, 4))) FILTER (a), 0), 2) AS DOUBLE) AS weight_now, CAST(round(coalesce(sum(CAST(weight AS DECIMAL(18, 4))) FILTER (b), 0), 2) AS DOUBLE) AS weight_before,
  count(*) FILTER (a AND bad) AS negative_now, count(*) FILTER (b AND bad) AS negative_before FROM (SELECT *, age >= 0 AND age <= 28 AS a, age > 28 AND age <= 56 AS b FROM ok))
SELECT *, round((n_now - n_before) / n_before::DOUBLE, 6) AS n_delta, round((weight_now - weight_before) / weight_before, 6) AS weight_delta, round((negative_now - negative_before) / negative_before::DOUBLE, 6) AS negative_delta FROM p""")
def agg_06_period_comparison(spark, sf_dir):
    return metrics.period_comparison(items(spark, sf_dir), NOW)


@query(_ITEMS + "SELECT evidence, count(*) AS n FROM ok GROUP BY evidence")
def agg_07_evidence_mix(spark, sf_dir):
    return items(spark, sf_dir).where(metrics.COUNTABLE).groupBy(metrics.evidence_kind().alias("evidence")).agg(F.count("*").alias("n"))


@query(_ITEMS + """SELECT count(*) AS raw, count(*) FILTER (band = 'SPAM') AS spam, count(*) FILTER (band = 'LIKELY_INAUTHENTIC') AS inauthentic, count(*) FILTER (band = 'GRAY_ZONE' AND weight <= 0) AS pending_not_counted,
  count(*) FILTER (band = 'GRAY_ZONE' AND weight > 0) AS pending_counted, count(*) FILTER (band = 'ACCEPTED' AND weight <= 0) AS aged, count(*) FILTER (band = 'ACCEPTED' AND weight > 0) AS accepted_counted FROM items""")
def agg_09_ledger(spark, sf_dir):
    return metrics.ledger(items(spark, sf_dir))


@query(_ITEMS + "SELECT category, sentiment, count(*) AS n, CAST(round(sum(CAST(weight AS DECIMAL(18, 4))), 2) AS DOUBLE) AS weight FROM ok GROUP BY category, sentiment")
def agg_10_category_counts(spark, sf_dir):
    return metrics.category_counts(items(spark, sf_dir))


@query(_ITEMS + "SELECT category, cause, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM ok WHERE bad GROUP BY category, cause")
def agg_11_root_causes(spark, sf_dir):
    return metrics.root_causes(items(spark, sf_dir))


_CUBE = """, c AS (SELECT CAST(greatest(0, floor(age)) AS INTEGER) AS back, source, category, sentiment, evidence, product_name AS product, cause, coalesce(rating, 0) AS rating, CAST(floor(weight * 10000 + 0.5) AS BIGINT) AS weight FROM ok)
"""


@query(_ITEMS + _CUBE + "SELECT * FROM c")
def agg_14_cube(spark, sf_dir):
    return metrics.cube(items(spark, sf_dir), NOW)


@query(_ITEMS + _CUBE + """SELECT category, count(*) AS n, CAST(round(sum(weight), 2) AS BIGINT) AS weight, round(count(*) FILTER (sentiment = 'Negative') / count(*)::DOUBLE, 6) AS negative_rate,
  round(avg(rating) FILTER (rating > 0), 6) AS stars, round(count(*) FILTER (evidence <> 'inferred') / count(*)::DOUBLE, 6) AS proof_share FROM c WHERE source IN ('Shopee', 'Tiki') GROUP BY category""")
def agg_16_cross_filter(spark, sf_dir):
    rows = metrics.cross_filter(metrics.cube(items(spark, sf_dir), NOW), {"source": ["Shopee", "Tiki"], "category": ["Delivery"]}, "category")
    return rows.groupBy("category").agg(*metrics.kpis())


@query(_ITEMS + _CUBE + "SELECT category, source, count(*) AS n FROM c WHERE sentiment = 'Negative' GROUP BY category, source")
def agg_17_heatmap(spark, sf_dir):
    return metrics.cube(items(spark, sf_dir), NOW).where("sentiment = 'Negative'").groupBy("category", "source").agg(F.count("*").alias("n"))


@query(_ITEMS + """SELECT coalesce(CAST(customer_id AS VARCHAR), feedback_id) AS customer, count(*) AS n, count(*) FILTER (bad) AS "Negative", count(*) FILTER (sentiment = 'Neutral') AS "Neutral", count(*) FILTER (sentiment = 'Positive') AS "Positive",
  CAST(round(sum(CAST(weight AS DECIMAL(18, 4))), 2) AS DOUBLE) AS weight, max(ts) AS latest, CASE WHEN count(*) FILTER (bad) > 0 THEN 'at_risk' WHEN count(*) < 2 THEN 'one_time' WHEN count(*) FILTER (sentiment = 'Positive') >= count(*) FILTER (sentiment = 'Neutral') THEN 'promoter' ELSE 'passive' END AS segment
  FROM items GROUP BY 1""")
def agg_20_segments(spark, sf_dir):
    unnamed = F.when(F.col("customer_id").isNull(), F.col("feedback_id"))  # only these rows take their id through the shuffles
    return metrics.segments(items(spark, sf_dir, prepare=lambda rows: rows.withColumn("unnamed", unnamed)), "unnamed")


@query(_ITEMS + """, p AS (SELECT product_name, count(*) AS n, count(*) FILTER (bad) AS negatives, round(coalesce(sum(weight) FILTER (bad), 0) / sum(weight), 6) AS weighted_share, round(avg(rating), 6) AS stars FROM ok GROUP BY product_name HAVING count(*) >= 20),
q AS (SELECT *, negatives / n::DOUBLE AS r FROM p)
SELECT * EXCLUDE (r), round(greatest(0.0, (r + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1.0, (r + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM q""")
def agg_28_product_profiles(spark, sf_dir):
    return metrics.product_profiles(items(spark, sf_dir))


_DECISIONS = [(f"d{k}", name, category, at) for k, (name, category, at) in enumerate([("small ring", "Delivery", "2000-03-01"), ("red widget", "PricePromotion", "1999-06-15"), ("blue bolt", "Payment", "2001-02-10")])]


def _decisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_DECISIONS, "decision_id string, product_name string, category string, at string").withColumn("at", F.to_timestamp("at"))


@query(_ITEMS + """, dec(decision_id, p, c, since) AS (VALUES ('d0', 'small ring', 'Delivery', TIMESTAMP '2000-03-01'), ('d1', 'red widget', 'PricePromotion', TIMESTAMP '1999-06-15'), ('d2', 'blue bolt', 'Payment', TIMESTAMP '2001-02-10')),
n AS (SELECT decision_id, product_name = p AS own, ts >= since AS late, bad AND category = c AS hit FROM ok JOIN dec ON ts >= since - INTERVAL 28 DAYS AND ts < since + INTERVAL 28 DAYS),
r AS (SELECT decision_id, count(*) FILTER (own AND NOT late) AS n_before, count(*) FILTER (own AND late) AS n_after, count(*) FILTER (own AND NOT late AND hit) / nullif(count(*) FILTER (own AND NOT late), 0)::DOUBLE AS before,
  count(*) FILTER (own AND late AND hit) / nullif(count(*) FILTER (own AND late), 0)::DOUBLE AS after, count(*) FILTER (NOT own AND NOT late AND hit) / nullif(count(*) FILTER (NOT own AND NOT late), 0)::DOUBLE AS control_before,
  count(*) FILTER (NOT own AND late AND hit) / nullif(count(*) FILTER (NOT own AND late), 0)::DOUBLE AS control_after FROM n GROUP BY decision_id)
SELECT decision_id, n_before, n_after, round(before, 6) AS before, round(after, 6) AS after, round(control_before, 6) AS control_before, round(control_after, 6) AS control_after, round((after - before) - (control_after - control_before), 6) AS effect FROM r""")
def agg_30_decision_effect(spark, sf_dir):
    return metrics.decision_effect(items(spark, sf_dir), _decisions(spark))


@query(_ITEMS + "SELECT source, count(*) AS n, round(count(*) FILTER (bad) / count(*)::DOUBLE, 6) AS negative_rate, round(avg(weight), 6) AS mean_weight FROM ok GROUP BY source")
def agg_33_channel_breakdown(spark, sf_dir):
    rows = items(spark, sf_dir).where(metrics.COUNTABLE).groupBy("source")
    return rows.agg(F.count("*").alias("n"), F.round(F.count_if(metrics.negative()) / F.count("*"), 6).alias("negative_rate"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query(_ITEMS + """, g AS (SELECT category, count(*) AS n FROM ok WHERE bad AND category <> 'Other' GROUP BY category)
SELECT category, n, CAST(row_number() OVER w AS INTEGER) AS place, round(sum(n) OVER (ORDER BY n DESC, category ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative FROM g WINDOW w AS (ORDER BY n DESC, category)""")
def agg_37_pareto(spark, sf_dir):
    return metrics.pareto(items(spark, sf_dir))


@query(_ITEMS + ", w AS (SELECT unnest([7, 14, 28, 60, 90, 180, 365, 730]) AS w), k AS (SELECT w, count(*) FILTER (age >= 0 AND age < w) AS a, count(*) FILTER (age >= w AND age < 4 * w) AS b FROM ok, w GROUP BY w), c AS (SELECT coalesce(min(w) FILTER (a >= 50 AND b >= 100), 730) AS w FROM k) SELECT CAST(w AS INTEGER) AS window_days, CAST(4 * w AS INTEGER) AS baseline_days FROM c")
def agg_40_cadence(spark, sf_dir):
    return metrics.cadence(items(spark, sf_dir), NOW)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def agg_38_confusion(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Alerts

_ERF = "CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-(z / sqrt(2.0)) * (z / sqrt(2.0))))"
_ALERTS = _ITEMS + """, pr AS (SELECT *, CASE WHEN age >= 0 AND age <= 7 THEN 'now' WHEN age > 7 AND age <= 28 THEN 'before' END AS period, coalesce(weight, 0) > 0 AS counted FROM items WHERE category <> 'Other'),
gs AS (SELECT category, cause, product_name, region, grouping_id(category, cause, product_name, region) AS gid, count(*) FILTER (period = 'now' AND counted) AS support, count(*) FILTER (period = 'now' AND counted AND bad) AS x1,
  count(*) FILTER (period = 'before' AND counted AND bad) AS x2, count(DISTINCT author) FILTER (period = 'now' AND counted AND bad) AS affected, coalesce(sum(weight) FILTER (period = 'now' AND counted AND bad), 0) AS weighted,
  count(*) FILTER (period = 'now' AND counted AND bad AND tier <> 'P5') AS firm, count(*) FILTER (period = 'now' AND NOT counted) AS excluded_by_trust
  FROM pr WHERE period IS NOT NULL GROUP BY GROUPING SETS ((category), (category, product_name), (category, cause), (category, cause, product_name), (category, cause, region)) HAVING support >= 3),
tot AS (SELECT count(*) FILTER (age >= 0 AND age <= 7) AS n1, count(*) FILTER (age > 7 AND age <= 28) AS n2 FROM ok),
ord AS (SELECT count(*) AS orders FROM txn WHERE delivered_at >= TIMESTAMP '2001-06-23' AND delivered_at <= TIMESTAMP '2001-06-30'),
t1 AS (SELECT *, (x1 + x2) / (n1 + n2)::DOUBLE AS pool FROM gs, tot, ord WHERE n1 > 0 AND n2 > 0),
t2 AS (SELECT *, round(coalesce((x1 / n1::DOUBLE - x2 / n2::DOUBLE) / nullif(sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2)), 0), 0), 6) AS z FROM t1),
t3 AS (SELECT *, 1 / (1 + 0.3275911 * abs(abs(z) / sqrt(2.0))) AS t FROM t2),
t4 AS (SELECT *, round(least(1.0, greatest(0.0, 2 * (1 - 0.5 * (1 + (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-(abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0)))))))), 9) AS p FROM t3),
t5 AS (SELECT *, p < 0.01 AND ((x1 / n1::DOUBLE - x2 / n2::DOUBLE) * 100 >= 0.5 OR affected >= 20) AND x1 / n1::DOUBLE - x2 / n2::DOUBLE > 0 AS dual,
  row_number() OVER (ORDER BY p, gid, category NULLS FIRST, cause NULLS FIRST, product_name NULLS FIRST, region NULLS FIRST) AS rank, count(*) OVER () AS m FROM t4),
t6 AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, coalesce(rank <= max(CASE WHEN p <= rank / m::DOUBLE * 0.05 THEN rank END) OVER (), false) AS sig FROM t5),
t7 AS (SELECT *, CASE category WHEN 'Delivery' THEN 0.55 WHEN 'ProductQuality' THEN 0.7 WHEN 'CustomerService' THEN 0.45 WHEN 'Payment' THEN 0.9 WHEN 'TechnicalApp' THEN 0.6 WHEN 'ReturnRefund' THEN 0.75 WHEN 'PricePromotion' THEN 0.3 ELSE 0.25 END AS impact, coalesce(weighted / nullif(orders, 0), weighted / n1) AS wcr, x1 / n1::DOUBLE AS r1, x2 / n2::DOUBLE AS r2 FROM t6),
t8 AS (SELECT *, round(least(1.0, greatest(0.0, 0.25 * least(1.0, greatest(0.0, wcr / 0.1)) + 0.25 * least(1.0, abs(z) / 6) + 0.2 * least(1.0, greatest(0.0, CASE WHEN r2 <= 0 THEN CASE WHEN r1 > 0 THEN 3 ELSE 0 END ELSE least((r1 - r2) / r2, 3) END / 3))
  + 0.2 * impact + 0.1 * least(1.0, r1))), 4) AS s FROM t7),
t9 AS (SELECT *, CASE WHEN x1 > 0 AND firm = 0 AND s >= 0.5 THEN least(s, 0.49) ELSE s END AS severity FROM t8)
"""


@query(_ALERTS + """SELECT category, cause, product_name, region, support, x1, n1, x2, n2, affected, excluded_by_trust, round(weighted, 2) AS weighted, z, round(p, 6) AS p, round(q, 6) AS q_value, severity,
  CASE WHEN severity < 0.25 THEN 'Low' WHEN severity < 0.5 THEN 'Medium' WHEN severity < 0.75 THEN 'High' ELSE 'Critical' END AS level, dual AND sig AS alert FROM t9""")
def cmp_06_alerts(spark, sf_dir):
    return alerts.detect(items(spark, sf_dir), adapters.category_dim(spark), adapters.transactions(spark, sf_dir), NOW)


@query()
def win_10_most_specific_alerts(spark, sf_dir):
    found = alerts.detect(items(spark, sf_dir), adapters.category_dim(spark), adapters.transactions(spark, sf_dir), NOW)
    return alerts.most_specific(found.where("alert"))


@query()
def win_09_drift(spark, sf_dir):
    return alerts.drift(items(spark, sf_dir), NOW)


@query("""WITH s AS (SELECT l_suppkey AS supplier, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS x FROM lineitem GROUP BY l_suppkey), a AS (SELECT sum(n) AS tn, sum(x) AS tx FROM s),
z AS (SELECT supplier, n, x, coalesce((x / n::DOUBLE - (tx - x) / (tn - n)::DOUBLE) / nullif(sqrt(tx / tn::DOUBLE * (1 - tx / tn::DOUBLE) * (1.0 / n + 1.0 / (tn - n))), 0), 0) AS z FROM s, a),
t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z)
SELECT supplier, n, x, round(z, 6) AS z, round(least(1.0, greatest(0.0, 1 - (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)))), 6) AS p FROM t""")
def mth_02_two_proportion(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    rows = s.crossJoin(F.broadcast(s.agg(F.sum("n").alias("tn"), F.sum("x").alias("tx"))))
    z = stats.two_proportion_z(*[c.cast("double") for c in (F.col("x"), F.col("n"), F.col("tx") - F.col("x"), F.col("tn") - F.col("n"))])
    return rows.select("supplier", "n", "x", F.round(z, 6).alias("z"), F.round(stats.two_sided_p(z), 6).alias("p"))


# ---------------------------------------------------------------------------
# Joins and keys


@query(_ITEMS + ", e AS (SELECT b.amount FROM ok LEFT JOIN (SELECT order_id, max(amount) AS amount FROM txn GROUP BY order_id) b USING (order_id) WHERE bad AND age <= 28), k AS (SELECT count(*) AS rows, count(amount) AS matched, coalesce(sum(amount), 0) AS total FROM e) SELECT rows, matched, round(total, 2) AS known_revenue, round(CASE WHEN matched / rows::DOUBLE >= 0.33 THEN total / (matched / rows::DOUBLE) END, 2) AS estimated_revenue FROM k")
def join_10_revenue_at_risk(spark, sf_dir):
    rows = items(spark, sf_dir).where(metrics.COUNTABLE).where(metrics.negative() & (F.datediff(F.lit(NOW), "ts") <= 28))
    return joins.revenue_at_risk(rows, adapters.transactions(spark, sf_dir))


@query("SELECT a.event_id AS order_event, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000 WHERE a.event_type = 'purchase' GROUP BY 1")
def join_05_range_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("order_event"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    near = joins.range_join(a, e.where("event_type = 'error'"), "t", "ts", 6 * 3600, [("u", "user_id")])
    return near.groupBy("order_event").agg(F.count("*").alias("near"))


@query("""WITH d AS (SELECT doc_id, text, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 48 AS INTEGER)) AS ts FROM documents), g AS (SELECT sha1(text) AS text_key, count(*) AS size, min(doc_id) AS first_id, min(ts) AS since, max(ts) AS until, (epoch(max(ts)) - epoch(min(ts))) / 3600.0 AS h FROM d GROUP BY text HAVING count(*) >= 5)
SELECT text_key, size, first_id, since, until, round(h, 4) AS hours, round(size / greatest(h, 1 / 60.0), 4) AS density FROM g WHERE h <= 48""")
def cmp_02_copy_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 48).cast("int"))).alias("ts"))
    return joins.same_text_clusters(rows)


@query("WITH o AS (SELECT user_id % 50 AS session_id, ts, event_id AS comment_id, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS p, event_type FROM events), c AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_type <> 'click' ROWS UNBOUNDED PRECEDING) AS current FROM o) SELECT session_id, comment_id, ts, current FROM c WHERE event_type <> 'click'")
def stm_11_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id") % 50)
    comments = e.where("event_type <> 'click'").select("session_id", "ts", F.col("event_id").alias("comment_id"))
    switches = e.where("event_type = 'click'").select("session_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("product_id"))
    return joins.carry_forward(comments, switches)


@query("SELECT o_custkey AS customer, max(o_orderdate) AS at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def snk_06_latest_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("at"), "o_orderkey")
    return joins.newest_per_key(rows, "customer", "at")


@query("SELECT o_orderkey, sha1(coalesce(CAST(o_custkey AS VARCHAR), '') || chr(1) || coalesce(o_orderpriority, '') || chr(1) || strftime(o_orderdate, '%Y-%m-%d')) AS dedup_key, CAST(('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS share FROM orders")
def snk_02_dedup_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.dedup_key(F.col("o_custkey"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dedup_key"), text.hash_share(F.col("o_orderkey").cast("string")).alias("share"))


@query("SELECT c_custkey, 'shop:' || substr(sha1('salt|Shop|' || c_custkey), 1, 12) AS pseudonym FROM customer")
def prj_04_pseudonym(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.pseudonym(F.lit("Shop"), F.col("c_custkey"), "salt").alias("pseudonym"))


# ---------------------------------------------------------------------------
# Text


@query(f"SELECT doc_id, sha256(translate(lower(text), '{_FOLD_FROM}', '{_FOLD_TO}')) AS folded FROM documents")
def str_02_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS text_sha FROM pages""")
def str_03_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("text_sha"))


@query()
def str_05_mask_pii(spark, sf_dir):
    masked, kinds = text.mask_pii(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha"), kinds.alias("kinds"))


@query()
def str_17_simhash32(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.simhash32(near_duplicates.words(F.col("text"))).alias("simhash"))


@query("WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), n AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 5) AS cosine FROM v JOIN q ON v.vec_id <> q.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS place FROM n) SELECT query_id, vec_id, cosine, place FROM r WHERE place <= 5")
def str_18_nearest_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 50 = 0"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), a AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t), p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t), f AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN ('idiot', 'the', 'nicht', 'pour') GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term) SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f JOIN d USING (term), a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def mth_08_bm25(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), ["idiot", "the", "nicht", "pour"])


@query(f"""WITH p AS (SELECT doc_id, source = 'src1' AS i, unnest({_TOKENS}) AS term FROM documents), t AS (SELECT term, count(*) FILTER (i) AS n, count(DISTINCT doc_id) AS df FROM p GROUP BY term HAVING count(*) FILTER (i) >= 2)
SELECT term, n, df, round(n / (SELECT count(*) FROM p WHERE i) * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS score FROM t ORDER BY score DESC, term LIMIT 20""")
def mth_09_salient_terms(spark, sf_dir):
    return retrieval.salient_terms(table(spark, sf_dir, "documents"), "source = 'src1'")


@query("""WITH n AS (SELECT DISTINCT p_name AS product_name, string_split(lower(p_name), ' ') AS w FROM part), s AS (SELECT product_name, k, array_to_string(w[1:k], ' ') AS start FROM n, range(1, 4) r(k) WHERE k <= len(w)), h AS (SELECT start FROM s GROUP BY start HAVING count(DISTINCT product_name) >= 2),
b AS (SELECT product_name, arg_max(start, k) AS grp FROM s JOIN h USING (start) GROUP BY product_name) SELECT n.product_name, coalesce(grp, lower(n.product_name)) AS product_group FROM n LEFT JOIN b USING (product_name)""")
def mth_24_name_groups(spark, sf_dir):
    return retrieval.name_groups(table(spark, sf_dir, "part").select(F.col("p_name").alias("product_name")))


# ---------------------------------------------------------------------------
# Live


@query(_LIVE + "SELECT date_trunc('hour', ts) AS since, intent, count(*) AS n, CAST(coalesce(sum(quantity) FILTER (intent = 'order'), 0) AS BIGINT) AS ordered FROM live GROUP BY 1, 2")
def stm_02_tumbling_counts(spark, sf_dir):
    return live.per_window(_live(spark, sf_dir), "1 hour")


@query(_LIVE + "SELECT date_trunc('hour', ts) AS since, intent, count(*) AS n, CAST(coalesce(sum(quantity) FILTER (intent = 'order'), 0) AS BIGINT) AS ordered FROM live GROUP BY 1, 2")
def stm_02_tumbling_counts_streamed(spark, sf_dir):
    """The same counts by Structured Streaming over the event file, run until nothing is left."""
    from .streaming.run import drained

    return drained(spark, sf_dir, lambda events: live.per_window(live.distinct_comments(adapters.live_comments(events)), "1 hour"))


@query(_LIVE + "SELECT intent, count(*) AS n, count(DISTINCT author) AS people FROM live GROUP BY intent")
def agg_34_live_totals(spark, sf_dir):
    return live.totals(_live(spark, sf_dir))


@query(_LIVE + ", p AS (SELECT author, max(CAST(intent = 'question' AS INTEGER)) AS asked, max(CAST(intent = 'order' AS INTEGER)) AS bought FROM live GROUP BY author) SELECT count(*) AS people, CAST(sum(asked) AS BIGINT) AS askers, CAST(sum(bought) AS BIGINT) AS buyers, CAST(sum(asked * bought) AS BIGINT) AS asked_and_bought FROM p")
def agg_35_conversion(spark, sf_dir):
    return live.conversion(_live(spark, sf_dir))


@query(_LIVE + """, o AS (SELECT *, CAST(product_id * 5 + 20 AS BIGINT) AS stock, coalesce(sum(quantity) OVER (PARTITION BY product_id ORDER BY ts, comment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM live WHERE intent = 'order')
SELECT product_id, stock, count(*) FILTER (used < stock) AS served, count(*) FILTER (used >= stock) AS lost, CAST(coalesce(sum(quantity) FILTER (used >= stock), 0) AS BIGINT) AS lost_quantity FROM o GROUP BY product_id, stock""")
def win_12_stock_replay(spark, sf_dir):
    stock = spark.range(20).select(F.col("id").alias("product_id"), (F.col("id") * 5 + 20).alias("stock"))
    return live.stock_replay(_live(spark, sf_dir).where("intent = 'order'"), stock)


@query(_LIVE + """, o AS (SELECT date_trunc('hour', ts) AS since, product_id FROM live WHERE intent = 'order'), t AS (SELECT since, count(*) AS orders FROM o GROUP BY since ORDER BY orders DESC, since LIMIT 1),
p AS (SELECT since, orders, product_id, count(*) AS n FROM o JOIN t USING (since) GROUP BY ALL) SELECT since, orders, product_id FROM p ORDER BY n DESC, product_id LIMIT 1""")
def win_13_best_hour(spark, sf_dir):
    return live.best_minute(_live(spark, sf_dir))


@query(_LIVE + """SELECT CASE WHEN intent = 'complaint' THEN 'c' || comment_id ELSE 'q|' || product_id END AS group_key, intent, count(*) AS n, count(DISTINCT author) AS people, min(ts) AS since, max(ts) AS latest,
  CASE WHEN intent = 'complaint' THEN 1000000 ELSE 0 END + count(*) * 10 AS weight FROM live WHERE intent IN ('complaint', 'question') GROUP BY 1, 2""")
def stm_12_queue_groups(spark, sf_dir):
    return live.queue_groups(_live(spark, sf_dir))


@query(_LIVE + """, s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY author ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM live), g AS (SELECT *, sum(fresh) OVER (PARTITION BY author ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s),
t AS (SELECT author, k, count(*) AS n, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS d FROM g GROUP BY author, k) SELECT author, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS comments, CAST(sum(d) AS BIGINT) AS active_seconds FROM t GROUP BY author""")
def stm_10_sessions(spark, sf_dir):
    return live.sessions(_live(spark, sf_dir), "12 hours")


@query(_LIVE + """, a(action_id, since) AS (VALUES ('a0', TIMESTAMP '2024-01-05 10:00:00'), ('a1', TIMESTAMP '2024-01-15 18:00:00')) SELECT action_id, round(count(*) FILTER (ts < since) / 180.0, 6) AS before, round(count(*) FILTER (ts >= since) / 180.0, 6) AS after
  FROM live JOIN a ON abs(epoch_us(ts) - epoch_us(since)) <= 10800000000 WHERE intent = 'order' GROUP BY action_id""")
def stm_14_action_effect(spark, sf_dir):
    actions = spark.createDataFrame([("a0", "2024-01-05 10:00:00"), ("a1", "2024-01-15 18:00:00")], "action_id string, at string").withColumn("at", F.to_timestamp("at"))
    return live.action_effect(actions, _live(spark, sf_dir))
