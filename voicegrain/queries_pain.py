"""Queries on pain points and labels: whole texts with a sentence put into each."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_signals as _signals
from .operators import cascade
from .operators import pain_points as pains
from .queries import QUERIES, SQL, query
from .queries_phrases import _fold, _phrase_sql, _quoted
from .sources.adapters import NOW, table

__all__ = ["QUERIES", "SQL", "_signals"]

# Every second document is a complaint; two thirds of a group's complaints hold its sentence, the others that of the shop.
_SAID = "CASE WHEN floor(doc_id / 6) % 3 = 0 THEN 'phản hồi chậm chạp' WHEN doc_id % 3 = 0 THEN 'mất kết nối liên tục' WHEN doc_id % 3 = 1 THEN 'màn hình sọc ngang' ELSE 'pin tụt nhanh' END"
_PLAIN = f"CASE WHEN doc_id % 5 = 0 THEN {_fold(_SAID)} ELSE {_SAID} END"
_TEXT = f"CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || '. ' || {_PLAIN} ELSE text END"
_WEIGHT = "CASE WHEN doc_id % 17 = 0 THEN 0.0 ELSE 0.5 + (doc_id % 5) / 10.0 END"


def _complaints(spark, sf_dir):
    cause = F.expr("floor(doc_id / 6) % 3 = 0")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_TEXT).alias("text"), F.expr("concat('g', doc_id % 3)").alias("group_key"), F.lit("Loa (xanh)").alias("product_name"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'Negative' ELSE 'Positive' END").alias("sentiment"), F.expr(_WEIGHT).cast("double").alias("weight"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'P1' ELSE 'P3' END").alias("tier"),
        F.when(cause, "CustomerService").otherwise("ProductQuality").alias("category"), F.when(cause, "SlowResponse").otherwise("TechnicalDefect").alias("cause"),
        (F.col("doc_id") % 400).alias("customer_id"), F.lit(None).cast("string").alias("author"),
        F.expr("CASE WHEN doc_id % 13 <> 0 THEN timestamp'2024-01-01' + make_dt_interval(cast(doc_id % 90 AS int)) END").alias("ts"),
    )


def _log_odds(y1: str, n1: str, y2: str, n2: str) -> str:
    a, b, c, d = f"({y1} + 0.5)", f"({n1} - {y1} + 0.5)", f"({y2} + 0.5)", f"({n2} - {y2} + 0.5)"
    return f"CASE WHEN {n2} >= 10 THEN (ln({a} / {b}) - ln({c} / {d})) / sqrt(1 / {a} + 1 / {b} + 1 / {c} + 1 / {d}) END"


_TESTED = f"""WITH {_phrase_sql(_TEXT).replace("FROM documents)", f"FROM documents WHERE {_WEIGHT} > 0)")},
c0 AS (SELECT phrase, count(*) AS n FROM g GROUP BY phrase), b AS (SELECT {_fold('phrase')} AS plain, phrase AS spelled FROM c0 WHERE {_fold('phrase')} <> phrase QUALIFY row_number() OVER (PARTITION BY {_fold('phrase')} ORDER BY n DESC, phrase) = 1),
h AS (SELECT DISTINCT doc_id, coalesce(spelled, phrase) AS phrase FROM g LEFT JOIN b ON phrase = plain),
f AS (SELECT doc_id, 'g' || (doc_id % 3) AS group_key, doc_id % 2 = 0 AS neg FROM documents WHERE {_WEIGHT} > 0),
gr AS (SELECT group_key, count(*)::DOUBLE AS n, count(*) FILTER (neg)::DOUBLE AS n1 FROM f GROUP BY 1),
al AS (SELECT sum(n) AS n_all, sum(n1) AS n_neg, CASE WHEN count(*) FILTER (n1 >= 15) >= 3 THEN ceil(count(*) FILTER (n1 >= 15) * 0.5) ELSE 1e9 END AS common FROM gr),
k AS (SELECT phrase, group_key, count(*)::DOUBLE AS df, count(*) FILTER (neg)::DOUBLE AS y FROM h JOIN f USING (doc_id) GROUP BY 1, 2),
p AS (SELECT phrase, sum(df) AS df_all, sum(y) AS y_all, sum(CASE WHEN n1 >= 15 AND y > 0 THEN 1 ELSE 0 END) AS spread FROM k JOIN gr USING (group_key) GROUP BY 1),
t AS (SELECT 'group' AS scope, group_key, phrase, y, n1, spread, {_log_odds('y', 'n1', '(df_all - y)', '(n_all - n1)')} AS z, {_log_odds('y', 'n1', '(df - y)', '(n - n1)')} AS z_same, {_log_odds('y', 'n1', '(y_all - y)', '(n_neg - n1)')} AS z_other, (y / n1) / ((df_all - y + 0.5) / (n_all - n1 + 0.5)) AS lift
  FROM k JOIN gr USING (group_key) JOIN p USING (phrase), al WHERE n1 >= 15 AND y >= 3 AND spread < common AND NOT list_bool_and(list_transform(string_split({_fold('phrase')}, ' '), lambda w: w IN ('loa', {_quoted(pains._STOP)})))
  UNION ALL SELECT 'shop', 'shop', phrase, y_all, n_neg, spread, {_log_odds('y_all', 'n_neg', '(df_all - y_all)', '(n_all - n_neg)')}, NULL, NULL, (y_all / n_neg) / ((df_all - y_all + 0.5) / (n_all - n_neg + 0.5)) FROM p, al WHERE n_neg >= 15 AND y_all >= 3 AND spread >= common)
SELECT scope, group_key, phrase, y::BIGINT AS y, n1::BIGINT AS n1, spread::BIGINT AS spread, round(z, 6) AS z, round(z_same, 6) AS z_same, round(z_other, 6) AS z_other, round(lift, 6) AS lift FROM t WHERE z >= 2.5 AND lift >= 2 AND coalesce(z_same, 9) >= 1.5 AND coalesce(z_other, 9) >= 1.5"""


@query(_TESTED)
def cmp_08_phrase_tests(spark, sf_dir):
    """The phrases that stand out in the complaints of a group, or of the shop."""
    items = _complaints(spark, sf_dir)
    counts, _ = pains.phrase_counts(pains.phrases_said(items, "doc_id", normalised=False))
    found = pains.phrase_tests(counts, pains.facts(items, "doc_id"))
    return found.select("scope", "group_key", "phrase", "y", "n1", "spread", *[F.round(c, 6).alias(c) for c in ("z", "z_same", "z_other", "lift")])


@query()
def cmp_08_pain_points(spark, sf_dir):
    """Greedy by strength, so tested against brute force.  The documents hold no slang, so they are taken as they are."""
    points, _ = pains.pain_points(_complaints(spark, sf_dir), NOW, "doc_id", normalised=False)
    return points.withColumn("variants", F.concat_ws("|", "variants"))


@query()
def join_19_pain_members(spark, sf_dir):
    """Each complaint with the points that it is part of."""
    return pains.pain_points(_complaints(spark, sf_dir), NOW, "doc_id", normalised=False)[1]


@query()
def cmp_08_group_status(spark, sf_dir):
    items = _complaints(spark, sf_dir)
    return pains.group_status(items, pains.pain_points(items, NOW, "doc_id", normalised=False)[1], "doc_id")


_ENDS = "CASE conv_id % 4 WHEN 0 THEN 'app lag quá' WHEN 1 THEN 'máy hỏng rồi' WHEN 2 THEN 'tuyệt vời, chờ cả tuần' ELSE 'hàng lỗi' END"
_STARS = "CASE conv_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 5 END"
_MODELS = [
    cascade.PatternScorer("first", {"hỏng rồi$": '{"sentiment": "Negative", "category": "Product", "subCategory": "TechnicalDefect"}'}),
    cascade.PatternScorer("second", {"hỏng": '{"sentiment": "Neutral", "category": "Other"}', "tuyệt vời": '{"sentiment": "Positive", "category": "Other"}'}),
]
_JUDGE = cascade.PatternScorer("judge", {"tuyệt vời": '{"sentiment": "Negative", "category": "Delivery", "subCategory": "LateDelivery", "sarcastic": true}'})


@query("""WITH v(k, sentiment, category, cause, labelled_by, suspected, verdict, needs_review) AS (VALUES
  (0, 'Negative', 'TechnicalApp', 'AppSlowOrCrash', 'rules', false, NULL, false), (1, 'Negative', 'ProductQuality', 'TechnicalDefect', 'first', false, NULL, false),
  (2, 'Negative', 'Delivery', 'LateDelivery', 'cascade', true, 'sarcastic', false), (3, 'Negative', 'Payment', NULL, 'stored', true, NULL, true))
  SELECT conv_id * 1000 + turn AS id, v.* EXCLUDE (k) FROM conversations JOIN v ON conv_id % 4 = k""")
def cls_10_cascade(spark, sf_dir):
    """Every turn with a sentence at its end: rules, a model, a judge and an answer given beforehand each label a fourth."""
    turns = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), "conv_id", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), F.expr(_ENDS)).alias("text"), F.expr(_STARS).alias("rating"))
    known = turns.where("conv_id % 4 = 3").select("id", F.lit('{"sentiment": "Negative", "category": "Payment"}').alias("answer"), F.lit("stored").alias("model"))
    return cascade.labels(turns, _MODELS, _JUDGE, known.distinct(), key="id")
