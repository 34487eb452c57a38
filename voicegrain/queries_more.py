"""More queries over the shared tables: imports, labels, text rules, evidence and live triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import rules, stats, text, times
from .operators import alerts, evidence, metrics, records, trust
from .operators.joins import latest_decision
from .plans.context import items
from .queries import _CUBE, _FEEDBACK, _FOLD_FROM, _FOLD_TO, _ITEMS, _LIVE, _TOKENS, QUERIES, SQL, _live, query
from .sources import adapters, files
from .sources.adapters import NOW, table
from .streaming import live

__all__ = ["QUERIES", "SQL"]

# ---------------------------------------------------------------------------
# Scans, sinks, filters


@query("SELECT (SELECT count(*) || ':' || max(o_orderkey) FROM orders) || ':' || (SELECT count(*) || ':' || max(event_id) FROM events) AS version")
def src_04_version(spark, sf_dir):
    return records.fingerprint((table(spark, sf_dir, "orders"), "o_orderkey"), (table(spark, sf_dir, "events"), "event_id"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def src_09_csv_round_trip(spark, sf_dir):
    """Customers written as CSV and read back through the delimiter sniffer."""
    return files.csv_round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ";")


@query("SELECT l_orderkey AS order_id, CAST(sum(l_quantity) AS DOUBLE) AS quantity, arg_min(l_extendedprice, (l_linenumber, l_extendedprice)) AS amount, count(*) AS lines FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1")
def src_13_fold_orders(spark, sf_dir):
    return records.fold_order_lines(table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS inserted, count(*) + count(*) FILTER (o_orderkey % 5 = 0) - count(*) FILTER (o_orderkey % 3 <> 0) AS duplicates FROM orders")
def snk_01_insert_absent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return records.insert_report(o.where("o_orderkey % 3 = 0"), o.union(o.where("o_orderkey % 5 = 0")), "o_orderkey")


@query("WITH " + _FEEDBACK + "SELECT source, count(*) AS n FROM feedback WHERE ts >= TIMESTAMP '2001-05-31' AND ts <= TIMESTAMP '2001-06-30' GROUP BY source")
def flt_05_this_month(spark, sf_dir):
    low, high = times.time_bounds("This Month", NOW)
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts + INTERVAL 7 HOURS) - INTERVAL 7 HOURS AS day_start, count(*) AS n FROM events GROUP BY 1")
def flt_06_shop_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(times.shop_day_start(F.col("ts")).alias("day_start")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (source = 'src1') AS kept FROM documents WHERE contains(translate(lower(text), '{_FOLD_FROM}', '{_FOLD_TO}'), 'tion') GROUP BY lang")
def flt_08_search_facets(spark, sf_dir):
    """Facets of what a folded search finds, before and after a facet filter."""
    found = table(spark, sf_dir, "documents").where(F.contains(text.fold(F.col("text")), F.lit("tion")))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "src1").alias("kept"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'tion') ORDER BY conv_id DESC, turn DESC LIMIT 50")
def flt_14_comment_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("tion")))
    return records.page(rows.select("conv_id", "turn"), [F.desc("conv_id"), F.desc("turn")], 1, 50)


@query("SELECT hour(ts) >= 22 OR hour(ts) < 7 AS quiet, count(*) AS n FROM events GROUP BY 1")
def flt_17_quiet_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(rules.in_quiet(F.hour("ts"), 22, 7).alias("quiet")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[1] || ' ' || upper(string_split(p_name, ' ')[2][1]) || '.' AS masked FROM part")
def prj_03_mask_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), text.mask_name(F.col("p_name")).alias("masked")).distinct()


# ---------------------------------------------------------------------------
# Joins, sets, order


@query("SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, source) AS source, source AS machine_source, l.doc_id IS NOT NULL AS by_human FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_03_human_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("source"))
    return records.human_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), labels, "doc_id", ["source"])


@query(_ITEMS + """SELECT CASE customer_id % 40 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'SPAM' ELSE band END AS band, count(*) AS n, round(sum(CASE customer_id % 40 WHEN 0 THEN tier_weight WHEN 1 THEN 0 ELSE weight END), 2) AS weight FROM items GROUP BY 1""")
def join_04_review_override(spark, sf_dir):
    labels = adapters.feedback(spark, sf_dir).where("customer_id % 40 in (0, 1)").select("feedback_id", F.when(F.col("customer_id") % 40 == 0, "valid").otherwise("spam").alias("label")).dropDuplicates(["feedback_id"])
    # labels meet the rows before the trust layer, so that the long ids do not go through its shuffles
    unread = ["category", "cause", "product_category", "region"]
    rows = items(spark, sf_dir, prepare=lambda rows: records.labelled(rows.drop(*unread), labels).drop("feedback_id"))
    return records.overridden(rows).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


@query("""WITH a AS (SELECT event_id AS alert_id, user_id AS scope, ts AS at FROM events WHERE event_type = 'error'), d AS (SELECT event_id + 1 AS alert_id, user_id AS scope, event_id AS decision, ts AS at FROM events WHERE event_type = 'purchase'),
m AS (SELECT a.alert_id, d.decision, d.at FROM a JOIN d ON a.alert_id = d.alert_id UNION SELECT a.alert_id, d.decision, d.at FROM a JOIN d ON a.scope = d.scope AND d.at <= a.at AND d.at >= a.at - INTERVAL 7 DAYS)
SELECT a.alert_id, a.scope, a.at, arg_max(decision, (m.at, decision)) AS decision, max(m.at) AS decided_at FROM a LEFT JOIN m USING (alert_id) GROUP BY ALL""")
def join_07_latest_decision(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("scope"), F.col("ts").alias("at"))
    made = e.where("event_type = 'purchase'").select((F.col("event_id") + 1).alias("alert_id"), F.col("user_id").alias("scope"), F.col("event_id").alias("decision"), F.col("ts").alias("at"))
    return latest_decision(asked, made)


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def join_11_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query("WITH " + _FEEDBACK + """, s AS (SELECT product_name, category, count(*) / sum(count(*)) OVER (PARTITION BY product_name) AS share FROM feedback GROUP BY product_name, category),
a AS (SELECT category, round(share, 6) AS share_a FROM s WHERE product_name = 'small widget'), b AS (SELECT category, round(share, 6) AS share_b FROM s WHERE product_name = 'large bolt')
SELECT category, coalesce(share_a, 0) AS share_a, coalesce(share_b, 0) AS share_b, round(coalesce(share_a, 0) - coalesce(share_b, 0), 6) AS difference FROM a FULL JOIN b USING (category)""")
def join_18_compare_products(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    return evidence.compare_shares(rows, "product_name", "small widget", "large bolt", "category")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def ord_03_page(spark, sf_dir):
    return records.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 50)


@query("SELECT doc_id FROM documents ORDER BY sha1(doc_id || '|s1'), doc_id LIMIT 100")
def ord_05_audit_sample(spark, sf_dir):
    return records.audit_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "s1")


@query(f"WITH t AS (SELECT list_contains({_TOKENS}, 'the') AS a, list_contains({_TOKENS}, 'and') AS b FROM documents), n AS (SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a OR b) AS either, least(count(*) FILTER (a), count(*) FILTER (b)) AS l FROM t) SELECT shared, either, round(shared / nullif(either, 0)::DOUBLE, 6) AS jaccard, round(shared / nullif(l, 0)::DOUBLE, 6) AS overlap FROM n")
def set_05_term_overlap(spark, sf_dir):
    return records.overlap(table(spark, sf_dir, "documents"), text.tokens(F.col("text")), "the", "and")


@query("""SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS key, o_totalprice AS weight FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION ALL SELECT 'complaint', CAST(event_id AS VARCHAR), value FROM events WHERE event_type = 'error'
UNION ALL SELECT 'unlabelled', CAST(doc_id AS VARCHAR), n_chars::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def set_06_inbox(spark, sf_dir):
    shape = lambda d, kind, key, weight: d.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(weight).cast("double").alias("weight"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    bad = table(spark, sf_dir, "events").where("event_type = 'error'")
    open_ = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return shape(urgent, "order", "o_orderkey", "o_totalprice").unionByName(shape(bad, "complaint", "event_id", "value")).unionByName(shape(open_, "unlabelled", "doc_id", "n_chars"))


# ---------------------------------------------------------------------------
# Evidence


@query(_ITEMS + "SELECT count(*) AS rows, count(*) FILTER (bad) AS complaints, count(*) FILTER (tier IN ('P1', 'P2')) AS reconcilable, count(*) FILTER (age >= 0 AND age <= 7) AS recent FROM ok")
def agg_08_evidence(spark, sf_dir):
    return evidence.bundle(items(spark, sf_dir), NOW)


@query(_ITEMS + _CUBE + ", s AS (SELECT max(back) + 1 AS span FROM c), z AS (SELECT CAST(CASE WHEN span <= 45 THEN 1 WHEN span <= 200 THEN 7 ELSE greatest(30, ceil(span / 60.0)) END AS INTEGER) AS days FROM s) SELECT CAST(back // days AS INTEGER) AS bucket, days, count(*) AS n, count(*) FILTER (sentiment = 'Negative') AS negatives FROM c, z GROUP BY 1, 2")
def agg_18_adaptive_series(spark, sf_dir):
    return evidence.adaptive_series(metrics.cube(items(spark, sf_dir), NOW))


@query("WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 60e6 AS gap FROM events) SELECT count(gap) AS gaps, round(median(gap), 4) AS median, round(coalesce(var_samp(gap), 0), 2) AS variance FROM g")
def agg_23_waits(spark, sf_dir):
    return evidence.waits(table(spark, sf_dir, "events"), "user_id")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, -f)) AS event_type, max(n) AS n FROM c GROUP BY user_id")
def agg_26_mode_first_seen(spark, sf_dir):
    return evidence.first_seen_mode(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("WITH " + _FEEDBACK + ", c AS (SELECT category, region, count(*) AS c FROM feedback WHERE sentiment = 'Negative' GROUP BY ALL), s AS (SELECT category, c / sum(c) OVER (PARTITION BY category)::DOUBLE AS s FROM c) SELECT category, round(sum(s * s), 6) AS hhi, round(max(s), 6) AS largest, count(*) AS parts FROM s GROUP BY category")
def agg_27_concentration(spark, sf_dir):
    return evidence.concentration(adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW).where(metrics.negative()), "category", "region")


_AGREE = """SELECT CAST(n AS BIGINT) AS n, round(r / n, 6) AS accuracy, round(greatest(0, (r / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(r / n * (1 - r / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (r / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(r / n * (1 - r / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high, round(f1, 6) AS macro_f1, round((r / n - e / (n * n)) / nullif(1 - e / (n * n), 0), 6) AS kappa FROM o"""


@query("""WITH p AS (SELECT quality AS g, 1 - toxic AS s FROM labels), l AS (SELECT g AS label, count(*) AS ng FROM p GROUP BY g), m AS (SELECT s AS label, count(*) AS ns FROM p GROUP BY s), h AS (SELECT g AS label, count(*) AS tp FROM p WHERE g = s GROUP BY g),
j AS (SELECT coalesce(ng, 0) AS ng, coalesce(ns, 0) AS ns, coalesce(tp, 0) AS tp FROM l FULL JOIN m USING (label) LEFT JOIN h USING (label)),
o AS (SELECT sum(ng)::DOUBLE AS n, sum(tp)::DOUBLE AS r, avg(2.0 * tp / (ng + ns)) FILTER (ng > 0) AS f1, sum(ng * ns)::DOUBLE AS e FROM j) """ + _AGREE)
def agg_38_agreement(spark, sf_dir):
    return evidence.agreement(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("said")), "quality", "said")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), t AS (SELECT arg_max(day, (n, -epoch(day))) AS day, max(n) AS n, round(avg(n), 6) AS mean, avg(n) AS m FROM d) SELECT day, n, mean FROM t WHERE n >= 1.05 * m")
def agg_44_peak(spark, sf_dir):
    return evidence.peak(evidence.daily_series(table(spark, sf_dir, "events")), "day", "n", 1.05)


@query("WITH a AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM events), e AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM a), d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM e LEFT JOIN d USING (day)")
def win_17_daily_series(spark, sf_dir):
    return evidence.daily_series(table(spark, sf_dir, "events"))


@query(_ITEMS + ", r AS (SELECT category, count(*) FILTER (age >= 0 AND age <= 28) AS current, count(*) FILTER (age > 28 AND age <= 56) AS before FROM ok WHERE bad GROUP BY category) SELECT *, round((current - before) / nullif(before, 0)::DOUBLE, 6) AS growth FROM r")
def win_14_rising(spark, sf_dir):
    return evidence.rising(items(spark, sf_dir), NOW)


@query(_ITEMS + ", r AS (SELECT *, row_number() OVER (PARTITION BY product_name, date_trunc('hour', ts) ORDER BY ts, feedback_id) AS k FROM signal WHERE burst > 0) SELECT product_name, ts, feedback_id, near FROM r WHERE k = 1")
def win_04_burst_reports(spark, sf_dir):
    rows = trust.bursts(adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)).where("burst > 0").withColumn("hour", F.date_trunc("hour", "ts"))
    return records.top_per_group(rows, ["product_name", "hour"], [F.col("ts"), F.col("feedback_id")], 1).select("product_name", "ts", "feedback_id", "near")


@query("WITH " + _FEEDBACK + ", c AS (SELECT product_name, cause, count(*) AS n FROM feedback WHERE sentiment = 'Negative' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_name ORDER BY n DESC, cause) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 3")
def win_11_top_causes(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW).where(metrics.negative()).groupBy("product_name", "cause").agg(F.count("*").alias("n"))
    return records.top_per_group(rows, ["product_name"], [F.desc("n"), F.col("cause")], 3)


@query("WITH " + _FEEDBACK + ", n AS (SELECT region, count(*) AS n FROM feedback WHERE sentiment = 'Negative' GROUP BY region), b AS (SELECT region, count(*) AS b FROM feedback GROUP BY region), s AS (SELECT *, n / sum(n) OVER ()::DOUBLE AS s FROM n), t AS (SELECT *, b / sum(b) OVER ()::DOUBLE AS t FROM b) SELECT region, n, round(s, 6) AS share, round(s / t, 6) AS lift, s >= 0.02 AND s / t >= 1.02 AND n >= 4 AS focused FROM s JOIN t USING (region)")
def mth_19_dimension_profile(spark, sf_dir):
    rows = adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW)
    return evidence.profile(rows.where(metrics.negative()), rows, "region", share=0.02, lift=1.02)


@query("WITH s AS (SELECT l_suppkey AS supplier, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS x FROM lineitem GROUP BY 1), a AS (SELECT sum(n) AS tn, sum(x) AS tx FROM s) SELECT supplier, round((ln((x + 0.5) / (n - x + 0.5)) - ln((tx - x + 0.5) / (tn - n - tx + x + 0.5))) / sqrt(1 / (x + 0.5) + 1 / (n - x + 0.5) + 1 / (tx - x + 0.5) + 1 / (tn - n - tx + x + 0.5)), 6) AS z FROM s, a")
def mth_07_log_odds(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    rows = s.crossJoin(F.broadcast(s.agg(F.sum("n").alias("tn"), F.sum("x").alias("tx"))))  # one row
    x, n, tx, tn = (F.col(c).cast("double") for c in ("x", "n", "tx", "tn"))
    return rows.select("supplier", F.round(stats.log_odds_z(x, n, tx - x, tn - n), 6).alias("z"))


@query()
def cmp_07_trust_impact(spark, sf_dir):
    """Alerts that only stand while every row counts alike: those without the trust layer less those with it."""
    rows = items(spark, sf_dir)
    args = (adapters.category_dim(spark), adapters.transactions(spark, sf_dir), NOW)
    dims = ["category", "cause", "product_name", "region"]
    naive, trusted = (alerts.detect(r, *args).where("alert").select(*dims, "severity") for r in (rows.withColumn("weight", F.lit(1.0)), rows))
    same = [naive[d].eqNullSafe(trusted[d]) for d in dims]
    return naive.join(trusted, same[0] & same[1] & same[2] & same[3], "left_anti")


# ---------------------------------------------------------------------------
# Text and rules


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)https?://|www\.') AS url, regexp_matches(text, '(?:\+84|\b0)\d{9}\b') AS phone, regexp_matches(text, '(?i)\b(zalo|telegram|inbox|whatsapp)\b') AS contact,
  regexp_matches(text, '(?i)\b(free|sale|discount|click here|buy now)\b') AS promo, regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z]+') AS email FROM documents""")
def str_13_spam_signals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.spam_signals(F.col("text")).alias("s")).select("doc_id", "s.*")


@query()
def str_08_collapse_repeats(spark, sf_dir):
    plain = rules.collapse_repeats(rules.join_spelled(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(plain, 256).alias("collapsed"))


@query(r"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '\d{2,}')), lambda x: x NOT IN ('10', '100', '2024'))) AS ungrounded FROM documents")
def str_23_number_grounding(spark, sf_dir):
    found = rules.ungrounded_numbers(F.col("text"), F.array(*[F.lit(x) for x in ("10", "100", "2024")]))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("ungrounded"))


@query("SELECT o_orderkey, replace(format('{:,}', CAST(o_orderkey * 12345 AS BIGINT)), ',', '.') AS amount, 'Order ' || o_orderkey || ': ' || o_orderpriority AS line FROM orders")
def str_24_formats(spark, sf_dir):
    slots = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("p"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.vn_number(F.col("o_orderkey") * 12345).alias("amount"), rules.fill_template(F.lit("Order {id}: {p}"), slots).alias("line"))


@query(f"WITH t AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS w FROM conversations) SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE, 6) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def str_25_turn_likeness(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.col("text"))).alias("w"))
    follow = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(follow, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("WITH " + _FEEDBACK + """, v AS (SELECT sentiment AS p, ['Positive', 'Negative', 'Neutral'][CAST(customer_id % 3 + 1 AS BIGINT)] AS j, CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' ELSE 'Neutral' END AS r FROM feedback)
SELECT CASE WHEN p = j OR p = r THEN p ELSE j END AS label, p <> j AND p <> r AND j <> r AS needs_review, count(*) AS n FROM v GROUP BY 1, 2""")
def cls_09_votes(spark, sf_dir):
    judge = F.element_at(F.array(F.lit("Positive"), F.lit("Negative"), F.lit("Neutral")), (F.col("customer_id") % 3 + 1).cast("int"))
    label, look = rules.resolve_votes(F.col("sentiment"), judge, rules.rating_vote(F.col("rating")))
    return adapters.feedback(spark, sf_dir).where(F.col("ts") <= NOW).groupBy(label.alias("label"), look.alias("needs_review")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, CAST(o_orderkey * 1000 AS BIGINT) AS whole, CAST(o_orderkey % 90 * 1000 + 500 AS BIGINT) AS short FROM orders")
def dat_02_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    money = rules.vn_number(F.col("o_orderkey") * 1000)
    short = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(",5k"))
    return o.select("o_orderkey", rules.parse_date(F.date_format("o_orderdate", "d/M/yyyy")).alias("day"), rules.parse_money(F.concat(money, F.lit(" đ"))).alias("whole"), rules.parse_money(short).alias("short"))


@query("WITH h AS (SELECT hour(ts + INTERVAL 7 HOURS) // 4 * 4 AS h, dayname(ts + INTERVAL 7 HOURS) AS weekday FROM events) SELECT lpad(CAST(h AS VARCHAR), 2, '0') || '-' || lpad(CAST(h + 4 AS VARCHAR), 2, '0') AS band, weekday, count(*) AS n FROM h GROUP BY 1, 2")
def dat_04_hours_and_weekdays(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(times.hour_band(F.col("ts")).alias("band"), F.date_format(F.col("ts") + F.expr("INTERVAL 7 HOURS"), "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT c_custkey, 40 + c_custkey % 50 AS kg, 150 + c_custkey % 40 AS cm FROM customer) SELECT c_custkey, CASE WHEN kg <= 50 AND cm <= 160 THEN 'S' WHEN kg <= 60 AND cm <= 170 THEN 'M' WHEN kg <= 70 AND cm <= 180 THEN 'L' ELSE 'XL' END AS size FROM c")
def mth_25_sizes(spark, sf_dir):
    guide = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(kg).alias("max_kg"), F.lit(cm).alias("max_cm")) for s, kg, cm in (("S", 50, 160), ("M", 60, 170), ("L", 70, 180), ("XL", 80, 190))])
    return table(spark, sf_dir, "customer").select("c_custkey", rules.size_for(guide, 40 + F.col("c_custkey") % 50, 150 + F.col("c_custkey") % 40).alias("size"))


# ---------------------------------------------------------------------------
# Live


@query(_LIVE + ", s AS (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS since, intent, quantity FROM live, range(5) r(k)) SELECT since, intent, count(*) AS n, CAST(coalesce(sum(quantity) FILTER (intent = 'order'), 0) AS BIGINT) AS ordered FROM s GROUP BY 1, 2")
def stm_03_sliding_counts(spark, sf_dir):
    return live.per_window(_live(spark, sf_dir), "5 hours", "1 hour")


@query(_LIVE + ", w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS since, count(*) AS n, count(*) FILTER (intent = 'complaint') AS complaints FROM live GROUP BY 1) SELECT * FROM w WHERE complaints >= 3 AND complaints >= 0.04 * n")
def stm_13_complaint_spikes(spark, sf_dir):
    return live.complaint_spikes(_live(spark, sf_dir), "6 hours")


@query(_LIVE + ", s AS (SELECT product_id + 100 * CAST(floor(epoch(ts) / 259200) AS BIGINT) AS product_id, author, intent FROM live), p AS (SELECT product_id, author, max(CAST(intent = 'question' AS INTEGER)) AS asked, max(CAST(intent = 'order' AS INTEGER)) AS bought FROM s GROUP BY product_id, author), r AS (SELECT product_id, count(*) AS askers, CAST(sum(bought) AS BIGINT) AS buyers FROM p WHERE asked = 1 GROUP BY 1) SELECT * FROM r WHERE askers >= 6 AND buyers <= 0.25 * askers")
def stm_13_ask_not_buy(spark, sf_dir):
    """Products of each session of three days that people ask for and do not buy; a product of a session has a number of its own."""
    session = F.floor(F.unix_seconds("ts") / 259200)
    return live.ask_not_buy(_live(spark, sf_dir).withColumn("product_id", F.col("product_id") + 100 * session))
