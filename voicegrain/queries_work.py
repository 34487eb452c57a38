"""Queries on filters, labels, cases, decisions and summaries, with SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_more as _more
from .config import CATEGORIES, OLD_CATEGORIES
from .functions import stats, text
from .operators import filters, joins, work
from .queries import _FEEDBACK, _LIVE, QUERIES, SQL, _live, query
from .sources import adapters, files
from .sources.adapters import NOW, table
from .streaming import live

__all__ = ["QUERIES", "SQL", "_more"]

LONG = "1999-01-01 00:00:00"

# ---------------------------------------------------------------------------
# Scans, sinks, filters


@query("WITH " + _FEEDBACK.replace("WHERE ts <= TIMESTAMP '2001-06-30'", "") + "SELECT count(*) > 0 AS replay FROM feedback WHERE ts > TIMESTAMP '2001-06-30'")
def src_05_replay_rows(spark, sf_dir):
    return filters.any_after(adapters.feedback(spark, sf_dir), NOW)


_HEADER = ["Order Code", "Product title", "Product code", "Amount (VND)", "Delivered on", "Ordered on", "Ship address"]
_WANTED = [("order_id", ["order code", "order"], []), ("product", ["product"], ["code"]), ("amount", ["amount", "total"], []), ("delivered_at", ["deliver"], []), ("ordered_at", ["ordered"], []), ("region", ["region", "address"], ["mail"])]


@query("SELECT * FROM (VALUES ('order_id', 'Order Code'), ('product', 'Product title'), ('amount', 'Amount (VND)'), ('delivered_at', 'Delivered on'), ('ordered_at', 'Ordered on'), ('region', 'Ship address')) t(field, header)")
def src_11_header_guess(spark, sf_dir):
    """The columns of an order file by the words of its header; a header has a handful of names, so this runs on the driver."""
    return spark.createDataFrame(list(filters.guess_columns(_HEADER, _WANTED).items()), "field string, header string")


@query("""WITH raw AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END AS txt, value, ts, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN TIMESTAMP '2030-01-01' ELSE ts END AS day FROM events)
SELECT event_id AS row_id, trim(txt) AS text, CASE WHEN value >= 1 AND value <= 5 THEN CAST(round(value) AS INTEGER) END AS rating, day IS NULL OR day > TIMESTAMP '2024-02-01' AS time_inferred,
  CASE WHEN day IS NULL OR day > TIMESTAMP '2024-02-01' THEN TIMESTAMP '2024-01-31' ELSE day END AS ts FROM raw WHERE trim(txt) <> ''""")
def src_12_import(spark, sf_dir):
    """Events as an uploaded file: rows without text go, ratings outside 1 to 5 are dropped, missing and future dates become the day of import."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("text"), F.col("value").alias("rating"),
        F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 7 == 1, F.lit("2030-01-01").cast("timestamp")).otherwise(F.col("ts")).alias("date"),
    )
    return files.imported_feedback(raw, "2024-01-31 00:00:00")


@query("""SELECT trim(CAST(o_orderkey AS VARCHAR)) AS order_id, 'Region ' || (o_custkey % 5) AS region, o_orderdate AS ordered_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS delivered_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE round(o_totalprice, 2) END AS amount FROM orders""")
def src_14_json_orders(spark, sf_dir):
    """Orders written as JSON with a blank before the key, bad dates and bad amounts, and read back in canonical form."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("orderId"), F.concat(F.lit("Region​ "), (F.col("o_custkey") % 5).cast("string")).alias("region"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("orderedAt"),
        F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("deliveredAt"), F.when(F.col("o_orderkey") % 4 == 0, "free").otherwise(F.format_string("%.2f", "o_totalprice")).alias("amount"),
    )
    return files.json_orders(spark, files.as_json(raw))


@query("SELECT event_id AS comment_id, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE user_id % 10 = 3 QUALIFY place <= 5000")
def src_15_batch_ingest(spark, sf_dir):
    """One call of a batch ingest: at most 5000 comments, in time order (the limit is the operator)."""
    rows = table(spark, sf_dir, "events").where("user_id % 10 = 3").select(F.col("event_id").alias("comment_id"), "ts")
    first = rows.orderBy("ts", "comment_id").limit(5000)
    from pyspark.sql import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy("ts", "comment_id")))


@query("SELECT event_id AS comment_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def src_20_replay(spark, sf_dir):
    """Comments replayed in the order of each author, with what came before: only the columns a replay needs are read."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("comment_id"), "ts", "user_id")
    return rows.withColumn("previous", F.lag("comment_id").over(Window.partitionBy("user_id").orderBy("ts", "comment_id"))).drop("user_id")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events WHERE event_type = 'purchase'")
def snk_05_export(spark, sf_dir):
    """Orders of a session exported as CSV with a byte-order mark and read back."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "event_type", "props")
    return files.csv_export_round_trip(rows)


_CASES = "SELECT user_id % 50 AS case_key, ts AS t, event_id, CASE WHEN event_type = 'error' THEN 'create' ELSE 'close' END AS event FROM events WHERE event_type IN ('error', 'signup')"


@query(f"""WITH e AS ({_CASES}), m AS (SELECT *, lag(event) OVER (PARTITION BY case_key ORDER BY t, event_id) AS prev FROM e),
o AS (SELECT *, event = 'create' AND coalesce(prev, 'close') = 'close' AS opens FROM m)
SELECT case_key, count(*) FILTER (opens) AS opened, count(*) FILTER (event = 'create' AND NOT opens) AS refused, arg_max(event, (t, event_id)) <> 'close' AS is_open FROM o GROUP BY case_key""")
def snk_07_cases(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return work.open_cases(e.select((F.col("user_id") % 50).alias("case_key"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_type") == "error", "create").otherwise("close").alias("event")))


@query("SELECT user_id AS feedback_id, arg_max(event_type, (ts, event_id)) AS label, arg_max(value, (ts, event_id)) AS score FROM events GROUP BY user_id")
def snk_08_latest_label(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("feedback_id"), F.col("event_type").alias("label"), F.col("value").alias("score"), "ts", "event_id")
    return work.latest(log, ["feedback_id"], ["ts", "event_id"]).select("feedback_id", "label", "score")


@query("""WITH l AS (SELECT doc_id, quality, CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 15 AS blind FROM labels)
SELECT doc_id, text, quality FROM documents JOIN l USING (doc_id) WHERE NOT blind""")
def snk_10_training_data(spark, sf_dir):
    """Labelled texts without the blind test, as JSON lines written and read back."""
    labels = table(spark, sf_dir, "labels").where(text.hash_share(F.col("doc_id").cast("string")) >= 15).select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    return spark.read.schema("doc_id long, text string, quality int").json(files.as_json(rows))


_INFERRED = "customer_id % 11 = 0"


@query("WITH " + _FEEDBACK + f"SELECT source, count(*) AS n, count(*) FILTER (NOT ({_INFERRED})) AS timed, max(CASE WHEN NOT ({_INFERRED}) THEN ts END) AS latest FROM feedback GROUP BY source")
def flt_03_time_of(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW).withColumn("time_inferred", F.expr(_INFERRED))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count(filters.time_of()).alias("timed"), F.max(filters.time_of()).alias("latest"))


@query("WITH " + _FEEDBACK + f"SELECT category, count(*) AS n FROM feedback WHERE source = 'Tiki' AND NOT ({_INFERRED}) AND ts >= TIMESTAMP '1999-01-01' AND ts <= TIMESTAMP '2001-06-30' GROUP BY category")
def flt_04_common_filter(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).withColumn("time_inferred", F.expr(_INFERRED))
    return filters.common_filter(rows, LONG, NOW, source="Tiki", region="All", product_name=None).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 3 DAYS END, o_orderdate) BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2001-06-30'""")
def flt_07_order_scope(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("region"), F.col("o_orderdate").alias("ordered_at"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate") + F.expr("interval 3 days")).alias("delivered_at"), "o_totalprice")
    kept = filters.order_scope(rows, LONG, NOW, region="NATION_3", source="Tiki")
    return kept.agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("amount"))


@query("""WITH r AS (SELECT event_id, event_type = 'error' AS suspected, CASE WHEN event_id % 3 = 0 THEN 'human' END AS suspected_by, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 30 END AS needs_review FROM events)
SELECT 'random' AS mode, count(*) AS n FROM r UNION ALL SELECT 'sarcasm', count(*) FROM r WHERE suspected AND coalesce(suspected_by, '') <> 'human' UNION ALL SELECT 'review', count(*) FROM r WHERE needs_review""")
def flt_13_audit_queues(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("suspected"), F.when(F.col("event_id") % 3 == 0, "human").alias("suspected_by"), F.when(F.col("event_id") % 5 != 0, F.col("value") > 30).alias("needs_review"))
    sizes = rows.agg(*[F.count_if(filters.in_audit_queue(m)).alias(m) for m in ("random", "sarcasm", "review")])
    return sizes.unpivot([], ["random", "sarcasm", "review"], "mode", "n")


# ---------------------------------------------------------------------------
# Projections

_OLD = ["Delivery", "Product Quality", "Technical Issue", "Refund", "Pricing", "Unknown"]


@query("""WITH raw AS (SELECT ['Delivery', 'Product Quality', 'Technical Issue', 'Refund', 'Pricing', 'Unknown'][CAST(l_partkey % 6 + 1 AS BIGINT)] AS old FROM lineitem),
c AS (SELECT CASE old WHEN 'Delivery' THEN 'Delivery' WHEN 'Product Quality' THEN 'ProductQuality' WHEN 'Technical Issue' THEN 'TechnicalApp' WHEN 'Refund' THEN 'ReturnRefund' WHEN 'Pricing' THEN 'PricePromotion' ELSE 'Other' END AS category FROM raw)
SELECT category, CAST(CASE category WHEN 'Delivery' THEN 0.55 WHEN 'ProductQuality' THEN 0.7 WHEN 'TechnicalApp' THEN 0.6 WHEN 'ReturnRefund' THEN 0.75 WHEN 'PricePromotion' THEN 0.3 ELSE 0.25 END AS DOUBLE) AS impact, count(*) AS n FROM c GROUP BY 1, 2""")
def prj_01_conformed_labels(spark, sf_dir):
    """Labels of older records conformed to the present categories, with their impact; the dimension has a handful of rows."""
    old = F.element_at(F.array(*[F.lit(x) for x in _OLD]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(text.conform(old, list(CATEGORIES), OLD_CATEGORIES).alias("category"))
    return rows.join(F.broadcast(adapters.category_dim(spark)), "category").groupBy("category", "impact").agg(F.count("*").alias("n"))


@query("WITH " + _FEEDBACK + "SELECT feedback_id, source, rating, substr(author, 1, 1) || '***' AS author FROM feedback")
def prj_02_public_rows(spark, sf_dir):
    """What may be shown: no ids of customers or orders, names masked."""
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    return rows.select("feedback_id", "source", "rating", text.mask_name(F.col("author")).alias("author"))


@query("SELECT event_type, substr(sha256('salt|live|' || user_id), 1, 16) AS author, count(*) AS n FROM events GROUP BY 1, 2")
def prj_05_author_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", text.author_hash(F.lit("live"), F.col("user_id").cast("string"), "salt").alias("author"))
    return rows.groupBy("event_type", "author").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Alerts, evidence and decisions

_ALERTS = """,
alerts AS (SELECT category || '/' || cause AS alert_id, category, cause, count(*) FILTER (ts > TIMESTAMP '2001-05-31') / 30.0::DOUBLE AS current_rate, count(*) FILTER (ts <= TIMESTAMP '2001-05-31') / 180.0::DOUBLE AS baseline_rate,
  count(DISTINCT customer_id) AS affected, count(*) AS evidence FROM feedback WHERE sentiment = 'Negative' AND ts > TIMESTAMP '2000-12-02' GROUP BY category, cause)
"""


def _alerts(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where((F.col("ts") <= NOW) & (F.col("ts") > "2000-12-02") & (F.col("sentiment") == "Negative"))
    new = F.col("ts") > "2001-05-31"
    return rows.groupBy(F.concat_ws("/", "category", "cause").alias("alert_id"), "category", "cause").agg((F.count_if(new) / 30.0).alias("current_rate"), (F.count_if(~new) / 180.0).alias("baseline_rate"), F.countDistinct("customer_id").alias("affected"), F.count("*").alias("evidence"))


@query("WITH " + _FEEDBACK + "SELECT feedback_id, category, rating FROM feedback WHERE feedback_id IN (SELECT min(feedback_id) FROM feedback GROUP BY category)")
def join_08_evidence_by_id(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    ids = rows.groupBy("category").agg(F.min("feedback_id").alias("id")).agg(F.collect_list("id").alias("ids"))  # a list as an alert holds it
    return joins.by_ids(rows, ids, "feedback_id", "ids").select("feedback_id", "category", "rating")


@query("WITH c AS (SELECT md5(text) AS cluster, doc_id FROM documents), s AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster HAVING count(*) > 1) SELECT d.doc_id, d.lang, s.size FROM s JOIN c USING (cluster) JOIN documents d USING (doc_id)")
def join_09_cluster_members(spark, sf_dir):
    """Clusters of equal texts exploded to their members and joined to the rows."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.groupBy(F.md5("text").alias("cluster")).agg(F.count("*").alias("size")).where("size > 1")
    members = docs.select(F.md5("text").alias("cluster"), "doc_id").join(sized, "cluster")
    return docs.select("doc_id", "lang").join(members.select("doc_id", "size"), "doc_id").select("doc_id", "lang", "size")


@query("WITH " + _FEEDBACK + _ALERTS + "SELECT alert_id, affected FROM alerts WHERE NOT (cause LIKE '%-1' OR cause LIKE '%-2')")
def join_13_open_alerts(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    decided = alerts.where("cause like '%-1' or cause like '%-2'").select("alert_id")
    return alerts.join(decided, "alert_id", "left_anti").select("alert_id", "affected")


@query("WITH " + _FEEDBACK + _ALERTS + "SELECT alert_id, CASE WHEN category IN ('Delivery', 'Payment') THEN 'call ' || lower(category) END AS action FROM alerts")
def join_15_recommendation(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    advice = alerts.where("category in ('Delivery', 'Payment')").select("alert_id", F.concat(F.lit("call "), F.lower("category")).alias("action"))
    return alerts.select("alert_id").join(advice, "alert_id", "left")


@query("WITH " + _FEEDBACK + _ALERTS + """, b AS (SELECT 'SPIKE' AS type, alert_id, current_rate - baseline_rate AS score, NULL::BIGINT AS run FROM alerts WHERE current_rate > baseline_rate
UNION ALL SELECT 'DRIFT', alert_id, NULL, evidence FROM alerts WHERE evidence >= 3) SELECT type, alert_id, round(score, 6) AS score, run FROM b""")
def set_01_all_alerts(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    spikes = alerts.where("current_rate > baseline_rate").select(F.lit("SPIKE").alias("type"), "alert_id", F.round(F.col("current_rate") - F.col("baseline_rate"), 6).alias("score"))
    drifts = alerts.where("evidence >= 3").select(F.lit("DRIFT").alias("type"), "alert_id", F.col("evidence").alias("run"))
    return spikes.unionByName(drifts, allowMissingColumns=True)


@query("""WITH f AS (SELECT DISTINCT doc_id % 2 = 0 AS dev, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4)) AS word FROM documents)
SELECT word FROM f WHERE NOT dev EXCEPT SELECT word FROM f WHERE dev""")
def set_07_leaked_words(spark, sf_dir):
    """Words that fire on the test half and never on the development half."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2 == 0).alias("dev"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("char_length(word) >= 4").distinct()
    return rows.where("not dev").select("word").join(rows.where("dev").select("word"), "word", "left_anti")


@query("WITH " + _FEEDBACK + _ALERTS + "SELECT alert_id, round((current_rate - baseline_rate) / baseline_rate, 6) AS growth FROM alerts WHERE baseline_rate > 0 AND current_rate > baseline_rate ORDER BY growth DESC, alert_id LIMIT 5")
def ord_11_rising(spark, sf_dir):
    rows = _alerts(spark, sf_dir).withColumn("growth", F.round(work.growth(), 6))
    return rows.where("growth > 0 and baseline_rate > 0").orderBy(F.desc("growth"), "alert_id").limit(5).select("alert_id", "growth")


@query("WITH " + _FEEDBACK + _ALERTS + """, s AS (SELECT alert_id, CASE WHEN affected >= 20 THEN 3 WHEN affected >= 10 THEN 2 ELSE 1 END AS severity, round(current_rate, 6) AS score FROM alerts)
SELECT *, row_number() OVER (ORDER BY severity DESC, score DESC, alert_id) AS place FROM s""")
def ord_02_alert_order(spark, sf_dir):
    """Alerts by severity, then score; the place is of a report with one row an alert combination."""
    from pyspark.sql import Window

    s = _alerts(spark, sf_dir).select("alert_id", F.when(F.col("affected") >= 20, 3).when(F.col("affected") >= 10, 2).otherwise(1).alias("severity"), F.round("current_rate", 6).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity"), F.desc("score"), "alert_id")))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id")
def ord_01_newest_first(spark, sf_dir):
    return filters.newest_first(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")


@query("SELECT DISTINCT p_name AS product FROM part ORDER BY product")
def ord_09_product_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("product")).distinct().orderBy("product")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY sha1('7|' || event_id), event_id LIMIT 50")
def ord_10_sample_after_filter(spark, sf_dir):
    return filters.sampled(table(spark, sf_dir, "events").where("ts >= '2024-01-10'"), "event_id", 50, 7).select("event_id")


_COACH = "SELECT 'a' || event_id AS action_id, event_type AS type, CAST(floor(value) AS BIGINT) % 3 AS severity, CASE WHEN event_id % 4 <> 0 THEN value END AS lost_value FROM events"


@query(f"WITH a AS ({_COACH}), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY severity DESC, lost_value DESC NULLS LAST, action_id) AS k FROM a) SELECT action_id, type, severity, lost_value FROM r WHERE k <= 2 ORDER BY severity DESC, lost_value DESC NULLS LAST, action_id LIMIT 6")
def ord_08_coach_output(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return work.limited_per_type(e.select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("action_id"), F.col("event_type").alias("type"), (F.floor("value") % 3).alias("severity"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("lost_value")))


@query(_LIVE + """, g AS (SELECT CASE WHEN intent = 'complaint' THEN 'c' || comment_id ELSE 'q|' || product_id END AS group_key, intent, count(*) AS n, max(ts) AS latest FROM live WHERE intent IN ('complaint', 'question') GROUP BY 1, 2)
SELECT group_key, intent, n FROM g ORDER BY CASE WHEN intent = 'complaint' THEN 1000000 ELSE 0 END + n * 10 + epoch_ms(latest) / 1e12 DESC, group_key LIMIT 40""")
def ord_07_queue(spark, sf_dir):
    """The open queue of a live session: complaints, then groups of many, then the latest; 40 are shown."""
    groups = live.queue_groups(_live(spark, sf_dir))
    rank = F.col("weight") + F.unix_millis("latest") / 1e12
    return groups.orderBy(F.desc(rank), "group_key").limit(40).select("group_key", "intent", "n")


# ---------------------------------------------------------------------------
# Summaries


@query("""WITH l AS (SELECT event_type AS labelled_by, user_id % 9 AS reviewer, value > 20 AS category_correct, value > 5 AS sentiment_correct FROM events WHERE event_id % 3 <> 0),
g AS (SELECT labelled_by, count(*) AS n, count(*) FILTER (category_correct) AS category_correct, count(*) FILTER (sentiment_correct) AS sentiment_correct, count(DISTINCT reviewer) AS reviewers FROM l GROUP BY ROLLUP (labelled_by)),
w AS (SELECT *, category_correct / n::DOUBLE AS p, 1 + 3.8416 / n AS d FROM g)
SELECT labelled_by, n, category_correct, sentiment_correct, reviewers, round(greatest(0, (p + 1.9208 / n) / d - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) AS category_low,
  round(least(1, (p + 1.9208 / n) / d + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) AS category_high FROM w""")
def agg_29_audit_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return work.audit_summary(e.select(F.col("event_type").alias("labelled_by"), (F.col("user_id") % 9).alias("reviewer"), F.when(F.col("event_id") % 3 == 0, "sarcasm").alias("sample_mode"), (F.col("value") > 20).alias("category_correct"), (F.col("value") > 5).alias("sentiment_correct")))


@query("WITH " + _FEEDBACK + """, w AS (SELECT category, CAST(11 - floor((epoch(TIMESTAMP '2001-06-30') - epoch(ts)) / 604800) AS INTEGER) AS week FROM feedback WHERE ts <= TIMESTAMP '2001-06-30'),
c AS (SELECT category, week, count(*) AS n FROM w WHERE week >= 0 GROUP BY 1, 2)
SELECT category, CAST(week AS INTEGER) AS week, coalesce(n, 0) AS n FROM (SELECT DISTINCT category FROM w) CROSS JOIN range(12) r(week) LEFT JOIN c USING (category, week)""")
def agg_36_weekly(spark, sf_dir):
    from .operators import evidence

    return evidence.weekly(adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW), "category", NOW)


_DECIDED = "SELECT event_id, ts AS t, CASE WHEN event_type = 'error' THEN 'DISMISSED' WHEN event_type = 'purchase' THEN 'ACCEPTED' ELSE 'PROPOSED' END AS decision, ['act' || (user_id % 7), 'act' || (user_id % 5 + 7)] AS action_ids, CASE WHEN event_id % 2 = 0 THEN 'not feasible' ELSE 'later' END AS reason, 'scope' || (user_id % 3) AS scope_key FROM events"


def _decided(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "DISMISSED").when(F.col("event_type") == "purchase", "ACCEPTED").otherwise("PROPOSED")
    act = lambda c: F.concat(F.lit("act"), c.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), kind.alias("decision"), F.array(act(F.col("user_id") % 7), act(F.col("user_id") % 5 + 7)).alias("action_ids"), F.when(F.col("event_id") % 2 == 0, "not feasible").otherwise("later").alias("reason"), F.concat(F.lit("scope"), (F.col("user_id") % 3).cast("string")).alias("scope_key"))


@query(f"""WITH d AS ({_DECIDED}), e AS (SELECT decision, t, unnest(action_ids) AS action_id FROM d)
SELECT action_id, count(*) FILTER (decision = 'ACCEPTED') AS accepted, count(*) FILTER (decision = 'DISMISSED') AS dismissed,
  round((2 + count(*) FILTER (decision = 'ACCEPTED')) / (4 + count(*) FILTER (decision IN ('ACCEPTED', 'DISMISSED')))::DOUBLE, 6) AS prior, max(t) AS last_at FROM e GROUP BY action_id""")
def agg_39_learned_actions(spark, sf_dir):
    return work.learned_actions(_decided(spark, sf_dir))


@query(f"""WITH d AS ({_DECIDED}), n AS (SELECT unnest(action_ids) AS action_id, scope_key, t FROM d WHERE decision = 'DISMISSED' AND reason = 'not feasible'),
last AS (SELECT action_id, scope_key, max(t) AS no_at FROM n GROUP BY 1, 2), p AS (SELECT DISTINCT 'act' || (user_id % 7) AS action_id, 'scope' || (user_id % 4) AS scope_key, TIMESTAMP '2024-02-10' AS t FROM events)
SELECT action_id, scope_key, coalesce(epoch(t) - epoch(no_at) < 14 * 86400, false) AS suppressed FROM p LEFT JOIN last USING (action_id, scope_key)""")
def mth_22_suppressed(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.concat(F.lit("act"), (F.col("user_id") % 7).cast("string")).alias("action_id"), F.concat(F.lit("scope"), (F.col("user_id") % 4).cast("string")).alias("scope_key"), F.lit("2024-02-10").cast("timestamp").alias("at")).distinct()
    return work.suppressed(p, _decided(spark, sf_dir), ["not feasible"]).select("action_id", "scope_key", "suppressed")


@query("WITH " + _FEEDBACK + _ALERTS + """, s AS (SELECT alert_id, 'act' || (affected % 3) AS action_id, CASE WHEN affected % 2 = 0 THEN category END AS place, affected, current_rate AS score FROM alerts)
SELECT action_id, coalesce(place, '*') AS place, count(*) AS alerts, CAST(sum(affected) AS BIGINT) AS affected, CAST(sum(affected * 10) AS BIGINT) AS revenue, round(max(score), 6) AS max_score FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def mth_22_bundles(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    steps = a.select("alert_id", F.concat(F.lit("act"), (F.col("affected") % 3).cast("string")).alias("action_id"), F.when(F.col("affected") % 2 == 0, F.col("category")).alias("place"), "affected", (F.col("affected") * 10).alias("revenue"), F.col("current_rate").alias("score"))
    return work.bundles(steps).withColumn("max_score", F.round("max_score", 6))


@query("""WITH a AS (SELECT event_id, least(1.0, value / 50) AS impact, 0.2 + (user_id % 8) / 10.0 AS confidence, 0.55::DOUBLE AS targeting, 0.1 + (event_id % 5) / 10.0 AS effect, 0.5::DOUBLE AS prior, event_id % 6 AS days, event_id % 3 = 0 AS risky, event_id % 4 <> 0 AS reversible FROM events)
SELECT event_id AS action_id, round(CASE WHEN impact > 0 THEN exp((ln(impact) + ln(confidence) + ln(targeting) + ln(effect) + ln(prior)) / 5) ELSE 0 END - days * 0.01 - CASE WHEN risky THEN 0.05 ELSE 0 END - CASE WHEN NOT reversible THEN 0.1 ELSE 0 END, 4) AS score FROM a""")
def mth_20_action_scores(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("action_id"), F.least(F.lit(1.0), F.col("value") / 50).alias("impact"), (0.2 + F.col("user_id") % 8 / 10.0).alias("confidence"), F.lit(0.55).alias("targeting"), (0.1 + F.col("event_id") % 5 / 10.0).alias("effect"),
        F.lit(0.5).alias("prior"), (F.col("event_id") % 6).alias("effort_days"), (F.col("event_id") % 3 == 0).alias("risky"), (F.col("event_id") % 4 != 0).alias("reversible"),
    )
    return a.select("action_id", work.action_score({"effort": 0.01, "risk": 0.05, "irreversible": 0.1}).alias("score"))


@query("WITH " + _FEEDBACK + """, e AS (SELECT category || '/' || cause AS alert_id, feedback_id AS id FROM feedback WHERE sentiment = 'Negative' UNION ALL SELECT category, feedback_id FROM feedback WHERE sentiment = 'Negative'),
r AS (SELECT alert_id, count(*) * 100.0::DOUBLE AS revenue, count(*) AS n FROM e GROUP BY 1), f AS (SELECT id, arg_max(alert_id, (revenue, alert_id)) AS alert_id FROM e JOIN r USING (alert_id) GROUP BY id)
SELECT alert_id, round(revenue * count(*) / n, 2) AS at_risk FROM f JOIN r USING (alert_id) GROUP BY alert_id, revenue, n""")
def agg_32_value_at_risk(spark, sf_dir):
    """Alerts of a category and of its causes share evidence; each row's money counts once, with the larger alert."""
    rows = adapters.feedback(spark, sf_dir).where((F.col("ts") <= NOW) & (F.col("sentiment") == "Negative"))
    named = rows.select(F.explode(F.array(F.concat_ws("/", "category", "cause"), "category")).alias("alert_id"), F.col("feedback_id").alias("id"))
    alerts = named.groupBy("alert_id").agg((F.count("*") * 100.0).alias("revenue"), F.collect_list("id").alias("evidence"))
    return work.value_at_risk(alerts)


@query(_LIVE + "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS session, count(*) FILTER (intent = 'order') AS new_orders, count(*) FILTER (intent = 'complaint' AND comment_id % 2 = 0) AS unpushed FROM live GROUP BY 1")
def agg_41_session_rollup(spark, sf_dir):
    c = _live(spark, sf_dir)
    return c.groupBy(F.date_trunc("day", "ts").alias("session")).agg(F.count_if(F.col("intent") == "order").alias("new_orders"), F.count_if((F.col("intent") == "complaint") & (F.col("comment_id") % 2 == 0)).alias("unpushed"))


@query(_LIVE + """, p AS (SELECT product_id, count(*) FILTER (intent = 'question') AS q, count(*) FILTER (intent = 'order') AS o FROM live GROUP BY 1), s AS (SELECT least(1.0, sum(o) / sum(q)) AS c FROM p),
v AS (SELECT product_id, q, least(1.0, CASE WHEN q >= 5 THEN o / q::DOUBLE ELSE s.c END) * q * (10 + product_id) AS lost FROM p, s)
SELECT product_id, q AS people, round(lost, 2) AS lost_value FROM v WHERE q > 0""")
def agg_42_missed_value(spark, sf_dir):
    """What open questions may have cost: people asking, times the product's conversion (the session's below five askers), times price."""
    c = _live(spark, sf_dir)
    prices = c.select("product_id").distinct().withColumn("price", 10 + F.col("product_id"))
    return live.missed_value(c, prices)


@query(_LIVE + """, q AS (SELECT product_id, ts, CASE WHEN comment_id % 3 <> 0 THEN ts + to_seconds(author % 600) END AS answered_at FROM live WHERE intent = 'question')
SELECT product_id, count(*) AS asked, count(answered_at) AS answered, round(count(answered_at) / count(*)::DOUBLE, 6) AS share, round(median((epoch(answered_at) - epoch(ts)) / 60), 4) AS median_wait FROM q GROUP BY product_id""")
def agg_43_response_quality(spark, sf_dir):
    q = _live(spark, sf_dir).where("intent = 'question'")
    answered = F.when(F.col("comment_id") % 3 != 0, F.col("ts") + F.make_dt_interval(secs=F.col("author") % 600))
    return live.response_quality(q.withColumn("answered_at", answered), "product_id")


@query("""SELECT event_type = 'click' AS spam, count(*) AS n, count(*) FILTER (event_type <> 'click' AND value > 40) AS with_pii, count(*) FILTER (event_type <> 'click' AND value < 3) AS negative, count(*) FILTER (event_type <> 'click' AND event_id % 3 = 0) AS several FROM events GROUP BY 1""")
def agg_46_batch_summary(spark, sf_dir):
    """A labelled batch: spam is only counted; the rest by masked data, sentiment and several issues at once."""
    e = table(spark, sf_dir, "events").withColumn("spam", F.col("event_type") == "click")
    real = lambda c: F.count_if(~F.col("spam") & c)
    return e.groupBy("spam").agg(F.count("*").alias("n"), real(F.col("value") > 40).alias("with_pii"), real(F.col("value") < 3).alias("negative"), real(F.col("event_id") % 3 == 0).alias("several"))


@query("SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS outcome, count(*) AS n FROM (SELECT (quality = 1) = (doc_id % 2 = 0) AS a, (quality = 1) = (doc_id % 3 = 0) AS b FROM labels) GROUP BY 1")
def agg_47_head_to_head(spark, sf_dir):
    good = F.col("quality") == 1
    return work.head_to_head(table(spark, sf_dir, "labels").select((good == (F.col("doc_id") % 2 == 0)).alias("a"), (good == (F.col("doc_id") % 3 == 0)).alias("b")), "a", "b")


@query("WITH " + _FEEDBACK + """, n AS (SELECT * FROM feedback WHERE sentiment = 'Negative'), a AS (SELECT *, (epoch(TIMESTAMP '2001-06-30') - epoch(ts)) / 86400 AS age FROM n),
m AS (SELECT region, count(*) AS n, count(DISTINCT customer_id) AS customers, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (age >= 0 AND age < 28) AS recent, count(*) FILTER (age >= 28 AND age < 56) AS previous, count(*) FILTER (category = 'Other') AS unlabelled FROM a GROUP BY region),
c AS (SELECT region, category, cause, count(*) AS k FROM n WHERE category <> 'Other' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, category DESC, cause DESC) = 1),
p AS (SELECT region, string_agg(product_name, ';' ORDER BY r) AS products FROM (SELECT region, product_name, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, product_name) AS r FROM n GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1)
SELECT region, m.n, customers, days, first_seen, last_seen, recent, previous, unlabelled, category AS top_category, cause AS top_cause, round(coalesce(k, 0) / m.n::DOUBLE, 6) AS cause_share, products FROM m LEFT JOIN c USING (region) LEFT JOIN p USING (region)""")
def agg_25_group_summary(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where((F.col("ts") <= NOW) & (F.col("sentiment") == "Negative"))
    return work.summary(rows, "region", NOW)


@query("WITH " + _FEEDBACK + "SELECT customer_id, max(ts) AS latest, count(*) AS n FROM feedback GROUP BY customer_id")
def win_15_latest_activity(spark, sf_dir):
    return adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW).groupBy("customer_id").agg(F.max("ts").alias("latest"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id AS session_id, user_id % 20 AS store, ts AS created_at, value AS revenue, event_type <> 'error' AS ended FROM events WHERE event_type IN ('signup', 'error'))
SELECT a.session_id, arg_max(b.session_id, (b.created_at, b.session_id)) AS previous_id, arg_max(b.revenue, (b.created_at, b.session_id)) AS previous_revenue FROM s a LEFT JOIN s b ON a.store = b.store AND b.ended AND b.created_at < a.created_at GROUP BY a.session_id""")
def win_16_previous_session(spark, sf_dir):
    s = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')").select(F.col("event_id").alias("session_id"), (F.col("user_id") % 20).alias("store"), F.col("ts").alias("created_at"), F.col("value").alias("revenue"), (F.col("event_type") != "error").alias("ended"))
    return live.previous_session(s).select("session_id", "previous_id", "previous_revenue")


# ---------------------------------------------------------------------------
# Times, live rules


@query("SELECT event_id, ts - INTERVAL 7 HOURS AS at FROM events")
def dat_03_shop_local_time(spark, sf_dir):
    """Local times of a shop, written without a zone, as instants."""
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select("event_id", F.to_utc_timestamp(F.to_timestamp(local), "Asia/Ho_Chi_Minh").alias("at"))


@query("SELECT event_id, CASE WHEN round(value) < 60 THEN CAST(round(value) AS BIGINT) || ' ngày' ELSE CAST(round(round(value) / 30) AS BIGINT) || ' tháng' END AS words FROM events")
def dat_06_span_words(spark, sf_dir):
    days = F.round("value").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(days < 60, F.concat(days.cast("string"), F.lit(" ngày"))).otherwise(F.concat(F.round(days / 30).cast("long").cast("string"), F.lit(" tháng"))).alias("words"))


_SCHEDULES = "SELECT event_id AS schedule_id, user_id AS store, ts AS start_at, 150 + user_id % 600 AS remind_min, CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'scheduled' END AS status FROM events"


@query(f"""WITH s AS ({_SCHEDULES}), t AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now)
SELECT schedule_id, CASE WHEN now >= start_at - to_minutes(CAST(remind_min AS INTEGER)) AND now < start_at THEN 'due' ELSE 'late' END AS kind FROM s, t WHERE status = 'scheduled' AND ((now >= start_at - to_minutes(CAST(remind_min AS INTEGER)) AND now < start_at)
  OR (now >= start_at + INTERVAL 10 MINUTES AND now < start_at + INTERVAL 30 MINUTES AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'signup' AND e.user_id = s.store AND e.ts >= start_at - INTERVAL 60 MINUTES AND e.ts <= now)))""")
def stm_18_reminders(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("event_id").alias("schedule_id"), F.col("user_id").alias("store"), F.col("ts").alias("start_at"), (150 + F.col("user_id") % 600).alias("remind_min"), F.when(F.col("event_type") == "error", "cancelled").otherwise("scheduled").alias("status"))
    sessions = e.where("event_type = 'signup'").select(F.col("user_id").alias("store"), F.col("ts").alias("created_at"))
    return live.reminders(s, sessions, "2024-01-15 12:00:00")


_ZERO = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{00AD}]"
_BLANKS = r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(nfc_normalize(text), '{_ZERO}', '', 'g'), '{_BLANKS}', ' ', 'g')) AS digest FROM documents")
def str_01_canonical(spark, sf_dir):
    """Texts in composed form without invisible characters, from texts with zero-width joints put in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(text.canonical(F.replace("text", F.lit("a"), F.lit("a\u200b")))).alias("digest"))


@query(_LIVE + """, e AS (SELECT intent, product_id, ts, comment_id, intent IN ('question', 'complaint') AS ask FROM live WHERE intent IN ('question', 'complaint', 'praise')),
k AS (SELECT *, CASE WHEN intent = 'complaint' THEN 'c|' ELSE 'q|' END || product_id AS key FROM e WHERE ask UNION ALL SELECT *, 'q|' || product_id FROM e WHERE NOT ask UNION ALL SELECT *, 'c|' || product_id FROM e WHERE NOT ask AND comment_id % 2 = 0),
l AS (SELECT key, max((ts, comment_id)) FILTER (NOT ask) AS last FROM k GROUP BY key)
SELECT key AS group_key, count(*) FILTER (ask) AS n, count(*) FILTER (ask AND (last IS NULL OR (ts, comment_id) > last)) AS since_answer,
  CASE WHEN any_value(last) IS NULL OR count(*) FILTER (ask AND (ts, comment_id) > last) >= CASE WHEN key LIKE 'c%' THEN 1 ELSE 3 END THEN 'open' ELSE 'answered' END AS status FROM k JOIN l USING (key) GROUP BY key""")
def stm_04_queue_status(spark, sf_dir):
    """Groups of asks and the answers to them: an answered group opens again after three more questions or one more complaint."""
    c = _live(spark, sf_dir)
    asks = c.where("intent in ('question', 'complaint')").select(F.concat_ws("|", F.when(F.col("intent") == "complaint", "c").otherwise("q"), F.col("product_id").cast("string")).alias("group_key"), "ts", "comment_id")
    key = lambda k: F.concat(F.lit(f"{k}|"), F.col("product_id").cast("string")).alias("group_key")
    said = c.where("intent = 'praise'")
    answers = said.select(key("q"), "ts", "comment_id").union(said.where("comment_id % 2 = 0").select(key("c"), "ts", "comment_id"))
    return live.queue_status(asks, answers)


@query(_LIVE + ", m AS (SELECT max(ts) AS z, count(*) AS n FROM live) SELECT comment_id FROM live, m WHERE m.n <= 500 OR ts >= z - INTERVAL 3 HOURS")
def stm_07_retention(spark, sf_dir):
    return live.retained(_live(spark, sf_dir), most=500, hours=3).select("comment_id")


@query(_LIVE + """, a AS (SELECT comment_id, ts, 'act' || product_id AS action_id FROM live WHERE intent = 'question'), h AS (SELECT ts AS at, 'act' || product_id AS action_id FROM live WHERE intent = 'order')
SELECT action_id, comment_id, EXISTS (SELECT 1 FROM h WHERE h.action_id = a.action_id AND h.at <= a.ts AND a.ts < h.at + INTERVAL 10 MINUTES) AS suppressed FROM a""")
def stm_08_cooldown(spark, sf_dir):
    """Proposed actions that were handled in the ten minutes before."""
    c = _live(spark, sf_dir).withColumn("action_id", F.concat(F.lit("act"), F.col("product_id").cast("string")))
    return live.cooled(c.where("intent = 'question'").select("action_id", "comment_id", "ts"), c.where("intent = 'order'").select("action_id", F.col("ts").alias("at")))


@query("WITH " + _FEEDBACK + """, b AS (SELECT count(*) FILTER (ts >= TIMESTAMP '2000-06-01' AND ts < TIMESTAMP '2000-12-01') AS n0, count(*) FILTER (ts >= TIMESTAMP '2000-06-01' AND ts < TIMESTAMP '2000-12-01' AND h) AS h0,
  count(*) FILTER (ts >= TIMESTAMP '2000-12-01' AND ts < TIMESTAMP '2001-06-02') AS n1, count(*) FILTER (ts >= TIMESTAMP '2000-12-01' AND ts < TIMESTAMP '2001-06-02' AND h) AS h1 FROM (SELECT *, sentiment = 'Negative' AND product_name LIKE '%ring%' AS h FROM feedback))
SELECT n0 AS n_before, h0 AS hits_before, n1 AS n_after, h1 AS hits_after, round(h1 / n1::DOUBLE - h0 / n0::DOUBLE, 6) AS change, n0 >= 30 AND n1 >= 30 AS enough FROM b""")
def agg_31_case_effect(spark, sf_dir):
    """How often a case's phrase was complained about before and after the case was opened."""
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    hit = (F.col("sentiment") == "Negative") & F.col("product_name").contains("ring")
    return work.case_effect(rows, hit, "2000-12-01 00:00:00", 183)


@query("WITH " + _FEEDBACK + """, o AS (SELECT count(*) AS t FROM orders)
SELECT count(*) AS rows, count(*) FILTER (rating <> 3) AS valid, count(*) FILTER (rating = 3) AS excluded, replace(printf('%.1f', round(1000.0 * count(*) FILTER (rating <> 3 AND sentiment = 'Negative') / count(*) FILTER (rating <> 3)) / 10), '.', ',') || '%' AS negative_share,
  round(count(*) FILTER (rating <> 3 AND sentiment = 'Negative') / any_value(t)::DOUBLE, 6) AS complaint_rate FROM feedback, o""")
def agg_05_metric_cards(spark, sf_dir):
    """The cards of a dashboard in one pass: raw, valid and excluded rows, share of negatives as shown, complaints an order."""
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW).withColumn("weight", F.when(F.col("rating") == 3, 0.0).otherwise(1.0))
    return work.metric_cards(rows, table(spark, sf_dir, "orders"))


@query("WITH " + _FEEDBACK + _ALERTS + """, lib(action_id, category, needs, escalated) AS (VALUES ('a1', 'Delivery', 'region', false), ('a2', 'Delivery', NULL, true), ('a3', 'Payment', NULL, false), ('a4', 'Payment', 'product', true)),
s AS (SELECT alert_id, category, affected >= 10 AS high, affected % 2 = 0 AS has_region, affected % 3 = 0 AS has_product FROM alerts),
e AS (SELECT alert_id, action_id FROM s JOIN lib USING (category) WHERE (NOT escalated OR high) AND (needs IS NULL OR (needs = 'region' AND has_region) OR (needs = 'product' AND has_product)))
SELECT alert_id, coalesce(action_id, 'generic') AS action_id FROM s LEFT JOIN e USING (alert_id)""")
def mth_21_eligible_actions(spark, sf_dir):
    """Actions of a library that an alert's severity and known slots allow; where none is left, the generic one."""
    library = spark.createDataFrame([("a1", "Delivery", ["region"], False), ("a2", "Delivery", [], True), ("a3", "Payment", [], False), ("a4", "Payment", ["product"], True)], "action_id string, category string, needs array<string>, escalated boolean")
    slots = F.array_compact(F.array(F.when(F.col("affected") % 2 == 0, "region"), F.when(F.col("affected") % 3 == 0, "product")))
    alerts = _alerts(spark, sf_dir).select("alert_id", "category", (F.col("affected") >= 10).alias("high"), slots.alias("slots"))
    return work.eligible_actions(alerts, library, "generic")
