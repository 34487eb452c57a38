"""Queries on campaigns, Telex words, learnt coefficients and keyed streams, with SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_phrases as _phrases
from .functions import telex
from .operators import near_duplicates, trust
from .queries import _LIVE, QUERIES, SQL, query
from .sources import adapters
from .sources.adapters import table
from .streaming import coach as coaching
from .streaming import state
from .streaming.run import event_stream

__all__ = ["QUERIES", "SQL", "_phrases"]


@query()
def cmp_02_near_clusters(spark, sf_dir):
    """Clusters of two and more near-equal documents within two days; greedy in time order, so tested against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 48).cast("int"))).alias("ts"))
    found = near_duplicates.near_clusters(docs, "doc_id", least=2, density=0.01)
    return found.select("doc_id", "seed", "size", *[F.round(c, 4).alias(c) for c in ("similarity", "hours", "density")])


_TYPED = [("chaamjmmmm", "chậm"), ("ddepjppppp!!", "đẹp!!"), ("(ddungs)", "(đúng)"), ("nguowif", "người"), ("ngonnnnn", "ngon"), ("free", "free")]


@query("SELECT doc_id, [" + ", ".join(f"'{w}'" for _, w in _TYPED) + f"][CAST(doc_id % {len(_TYPED)} AS INTEGER) + 1] AS word FROM documents")
def str_10_telex(spark, sf_dir):
    """Every document with one typed word after it; the word as it is understood in the whole text."""
    typed = F.element_at(F.array(*[F.lit(t) for t, _ in _TYPED]), (F.col("doc_id") % len(_TYPED) + 1).cast("int"))
    whole = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), typed).alias("text"))
    return whole.select("doc_id", telex.resolver()(F.col("text")).alias("text")).select("doc_id", F.substring_index("text", " ", -1).alias("word"))


_SAMPLES = """s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y, l_quantity::DOUBLE / 50 AS a, l_discount::DOUBLE * 10 AS b, l_tax::DOUBLE * 10 AS c, CAST(l_linenumber AS DOUBLE) / 7 AS d, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS e FROM lineitem),
g AS (SELECT y, a, b, c, d, e, CAST(count(*) AS DOUBLE) AS m FROM s GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SAMPLES}, w AS (SELECT 0 AS k, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc, 0.0::DOUBLE AS wd, 0.0::DOUBLE AS we
  UNION ALL SELECT k + 1, w0 - 0.1 * sum(o) / sum(m), wa - 0.1 * sum(o * a) / sum(m), wb - 0.1 * sum(o * b) / sum(m), wc - 0.1 * sum(o * c) / sum(m), wd - 0.1 * sum(o * d) / sum(m), we - 0.1 * sum(o * e) / sum(m)
  FROM (SELECT w.*, g.*, m * (1 / (1 + exp(-(w0 + wa * a + wb * b + wc * c + wd * d + we * e))) - y) AS o FROM w, g WHERE k < 20) GROUP BY k, w0, wa, wb, wc, wd, we)
SELECT unnest(['intercept', 'duplicate', 'burst', 'account', 'star', 'transaction']) AS signal, round(unnest([w0, wa, wb, wc, wd, we]), 6) AS coefficient FROM w WHERE k = 20""")
def mth_12_authenticity_fit(spark, sf_dir):
    """Twenty steps of gradient descent over every order line; returned lines stand for the label."""
    flag = lambda c, v: F.when(F.col(c) == v, 1.0).otherwise(0.0)
    line = table(spark, sf_dir, "lineitem").select(
        flag("l_returnflag", "R").alias("label"), (F.col("l_quantity") / 50).cast("double").alias("duplicate"), (F.col("l_discount").cast("double") * 10).alias("burst"),
        (F.col("l_tax").cast("double") * 10).alias("account"), (F.col("l_linenumber").cast("double") / 7).alias("star"), flag("l_linestatus", "F").alias("transaction"),
    )
    model = trust.fit_authenticity(line, epochs=20)
    return spark.createDataFrame([(k, float(v)) for k, v in model.items()], "signal string, coefficient double").select("signal", F.round("coefficient", 6).alias("coefficient"))


def _stream(spark, sf_dir):
    return adapters.live_comments(event_stream(spark, sf_dir))


@query(SQL["stm_04_queue_status"])
def stm_04_queues_streamed(spark, sf_dir):
    """STM-04 with keyed state: the asks and answers of the batch query, as a stream."""
    c = _stream(spark, sf_dir)
    said, asked = F.col("intent") == "praise", F.col("intent").isin("question", "complaint")
    kinds = F.when(F.col("intent") == "complaint", F.array(F.lit("c"))).when(F.col("intent") == "question", F.array(F.lit("q")))
    kinds = kinds.when(said & (F.col("comment_id") % 2 == 0), F.array(F.lit("q"), F.lit("c"))).when(said, F.array(F.lit("q")))
    keyed = c.where(said | asked).select(F.explode(kinds).alias("kind"), "product_id", "ts", "comment_id", said.alias("answer"))
    events = keyed.select(F.concat_ws("|", "kind", F.col("product_id").cast("string")).alias("group_key"), "ts", "comment_id", "answer")
    return state.newest(spark, state.ended(spark, events, state.queues), "group_key", state.QUEUE)


@query(_LIVE + """, s AS (SELECT author % 10 AS session_id, intent, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS m FROM live), z AS (SELECT *, max(m) OVER (PARTITION BY session_id) AS newest FROM s)
SELECT session_id, make_timestamp((newest + 1) * 60000000) AS as_of, intent, count(*) FILTER (newest - m < 3) AS last_3, count(*) FILTER (newest - m < 5) AS last_5, count(*) FILTER (newest - m < 10) AS last_10, count(*) FILTER (newest - m < 15) AS last_15
FROM z WHERE newest - m < 180 GROUP BY session_id, newest, intent""")
def stm_03_look_backs_streamed(spark, sf_dir):
    """STM-03 with keyed state: look-backs of every session from its ring of minutes."""
    comments = _stream(spark, sf_dir).select(F.pmod("author", F.lit(10)).cast("long").alias("session_id"), "ts", "intent")
    return state.newest(spark, state.ended(spark, comments, state.look_backs), "session_id", state.RING)


_COACHED = """
WITH RAW AS (SELECT event_id AS id, event_id // 250 AS session_id, event_id % 250 * 4 AS sec, CASE event_type WHEN 'error' THEN 'complaint' WHEN 'view' THEN 'question' WHEN 'purchase' THEN 'order' WHEN 'signup' THEN 'praise' ELSE 'chatter' END AS intent,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS k, 1 + CAST(floor(value) AS BIGINT) % 3 AS quantity FROM events),
P AS (SELECT *, CASE WHEN session_id // 2 % 2 = 1 AND sec > 820 AND id % 4 <> 0 THEN sec - 400 ELSE sec END AS t, CASE WHEN intent = 'question' THEN (session_id + session_id % 2 * 7) % 20 ELSE k END AS product_id FROM RAW),
C AS (SELECT *, max(t) OVER (PARTITION BY session_id) - t AS ago, ['S', 'M', 'L'][CAST(id % 3 AS INTEGER) + 1] AS variant, ['stock', 'price', 'size', 'ship', 'other'][CAST(id // 3 % 5 AS INTEGER) + 1] AS topic,
  id % 13 = 0 AS cancelled, id % 11 = 0 AS inferred, 'q|' || product_id AS group_key, session_id % 20 AS cur FROM P),
S AS (SELECT session_id, product_id, variant, CAST(product_id % 3 * 4 AS BIGINT) AS initial, 10 + product_id AS price,
  sum(CASE WHEN cancelled THEN 0 ELSE quantity END) FILTER (intent = 'order') AS ordered, count(*) FILTER (intent = 'order' AND ago <= 600) AS orders, count(*) FILTER (intent = 'question' AND topic = 'stock' AND ago <= 600) AS asks,
  sum(quantity) FILTER (intent = 'order' AND ago <= 600) AS wanted FROM C GROUP BY ALL),
S2 AS (SELECT *, initial - coalesce(ordered, 0) AS rest, product_id || '|' || variant AS name FROM S),
G AS (SELECT session_id, group_key, product_id, count(*) AS n, max(ago) AS waited, ['stock', 'price', 'size', 'ship', 'other'][CAST(product_id % 5 AS INTEGER) + 1] AS topic, product_id % 3 <> 1 AS open, product_id % 3 = 0 AS grounded FROM C WHERE intent = 'question' GROUP BY ALL),
O AS (SELECT * FROM G WHERE open),
E AS (SELECT session_id, count(*) FILTER (intent = 'complaint' AND ago <= 300) AS complaints, count(*) FILTER (ago <= 300) AS recent, count(*) FILTER (intent = 'question' AND ago <= 180) AS questions,
  count(*) FILTER (ago > 0 AND ago <= 180) / 3 AS rate, count(*) FILTER (ago > 180 AND ago <= 540) / 6 AS rate_before FROM C GROUP BY 1),
B AS (SELECT O.*, (SELECT count(*) FROM C WHERE C.session_id = O.session_id AND C.group_key = O.group_key AND ago <= 180) AS asked FROM O),
H AS (SELECT session_id, product_id, cur, count(*) FILTER (NOT inferred AND intent IN ('question', 'order') AND ago <= 300) AS said, count(*) FILTER (intent = 'question' AND topic IN ('price', 'promo', 'size', 'stock') AND ago <= 300) AS asks, count(*) FILTER (intent = 'order' AND ago <= 300) AS buys FROM C GROUP BY ALL),
T AS (SELECT session_id, 1 AS trigger, 'complaint_spike' AS type, 'all' AS key, 'critical' AS severity, NULL::BIGINT AS product_id, complaints::DOUBLE AS measure, NULL::DOUBLE AS lost_value FROM E WHERE complaints >= 3 AND complaints >= 0.04 * recent
 UNION ALL SELECT session_id, 2, 'soldout_demand', name, 'critical', product_id, orders + asks, coalesce(wanted, 0) * price FROM S2 WHERE rest <= 0 AND orders + asks >= 2
 UNION ALL SELECT session_id, 4, 'low_stock', name, 'high', product_id, rest, NULL FROM S2 WHERE rest > 0 AND rest <= greatest(3, ceil(initial * 0.15)) AND orders >= 2
 UNION ALL SELECT session_id, 3, 'question_burst', group_key, 'high', product_id, asked, NULL FROM (SELECT B.* FROM B JOIN E USING (session_id) WHERE asked >= 5 AND asked >= 0.08 * questions QUALIFY row_number() OVER (PARTITION BY B.session_id ORDER BY asked DESC, group_key) <= 2)
 UNION ALL SELECT session_id, 5, 'backlog', 'queue', 'high', NULL, count(*), NULL FROM O GROUP BY 1 HAVING count(*) >= 10 OR (max(waited) >= 300 AND sum(n) >= 8)
 UNION ALL SELECT session_id, 6, 'hot_other_product', product_id::VARCHAR, 'medium', product_id, said, NULL FROM (SELECT H.*, (SELECT coalesce(max(x.said), 0) FROM H x WHERE x.session_id = H.session_id AND x.product_id = x.cur) AS shown FROM H WHERE product_id <> cur QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY said DESC, product_id) = 1) WHERE said >= 5 AND said >= 1.5 * shown
 UNION ALL SELECT session_id, 7, 'ask_not_buy', product_id::VARCHAR, 'medium', product_id, asks, NULL FROM H WHERE product_id = cur AND asks >= 6 AND buys <= 0.25 * asks
 UNION ALL SELECT session_id, 8, 'engagement_drop', 'rate', 'medium', NULL, round(1 - rate / rate_before, 6), NULL FROM E WHERE rate_before >= 8 AND rate < 0.6 * rate_before
 UNION ALL SELECT session_id, 9, 'missing_info', topic || '|' || product_id, 'medium', product_id, sum(n), NULL FROM O WHERE NOT grounded AND topic <> 'other' GROUP BY session_id, topic, product_id HAVING sum(n) >= 3)
"""


def _coached(spark, sf_dir):
    """Comments, sessions, stock and question groups that the event table gives: four seconds between the comments of a session of 250."""
    raw = adapters.live_comments(table(spark, sf_dir, "events"))
    id_, names = F.col("comment_id"), lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    session, sec = F.floor(id_ / 250), id_ % 250 * 4
    late = (F.floor(session / 2) % 2 == 1) & (sec > 820) & (id_ % 4 != 0)
    topics = ["stock", "price", "size", "ship", "other"]
    rows = raw.select(
        session.alias("session_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(late, sec - 400).otherwise(sec))).alias("ts"), "intent", names(topics, F.floor(id_ / 3) % 5).alias("topic"),
        F.when(F.col("intent") == "question", (session + session % 2 * 7) % 20).otherwise(F.col("product_id")).alias("product_id"), F.array(names(["S", "M", "L"], id_ % 3)).alias("variants"), "quantity", (id_ % 13 == 0).alias("cancelled"), (id_ % 11 == 0).alias("inferred"),
    )
    rows = rows.withColumn("group_key", F.concat(F.lit("q|"), F.col("product_id").cast("string")))
    sessions = rows.groupBy("session_id").agg(F.max("ts").alias("now")).withColumn("current_product_id", F.col("session_id") % 20)
    stock = rows.select("session_id", "product_id", F.element_at("variants", 1).alias("variant")).distinct().withColumns({"initial": F.col("product_id") % 3 * 4, "price": 10 + F.col("product_id")})
    groups = rows.where("intent = 'question'").groupBy("session_id", "group_key", "product_id").agg(F.count("*").alias("count"), F.min("ts").alias("first_at"))
    groups = groups.select("*", F.lit("question").alias("intent"), names(topics, F.col("product_id") % 5).alias("topic"), F.when(F.col("product_id") % 3 != 1, "open").otherwise("answered").alias("status"), (F.col("product_id") % 3 == 0).alias("grounded"))
    return rows, sessions, stock, groups


@query(_COACHED + "SELECT * FROM T")
def stm_13_triggers(spark, sf_dir):
    """All nine kinds of trigger, for every session."""
    return coaching.triggers(*_coached(spark, sf_dir))


@query(_COACHED + """, R AS (SELECT *, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 1 END AS r FROM T), N AS (SELECT *, row_number() OVER (PARTITION BY session_id, type ORDER BY r DESC, coalesce(lost_value, 0) DESC, trigger, measure DESC, key) AS n FROM R),
M AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY session_id ORDER BY r DESC, coalesce(lost_value, 0) DESC, trigger, measure DESC, key) AS place FROM N WHERE n <= 2) SELECT * EXCLUDE (r) REPLACE (CAST(place AS INTEGER) AS place) FROM M WHERE place <= 6""")
def cmp_12_coach(spark, sf_dir):
    """What the host of each session should do: six actions at most, two of a kind."""
    return coaching.coach(*_coached(spark, sf_dir))
