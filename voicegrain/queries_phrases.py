"""Queries on phrases and on answers of models, with SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_text as _text
from .config import CATEGORIES, OLD_CATEGORIES
from .functions import model_output, phrases, text
from .queries import _FOLD_FROM, _FOLD_TO, QUERIES, SQL, query
from .sources.adapters import table

__all__ = ["QUERIES", "SQL", "_text"]


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _fold(x: str) -> str:
    return f"translate({x}, '{_FOLD_FROM}', '{_FOLD_TO}')"


def _phrase_sql(text_sql: str) -> str:
    """CTEs ending in ``g (doc_id, phrase)``: the distinct phrases of each document."""
    ends = phrases.SEGMENT_END.replace("'", "''")
    edge = f"CASE WHEN w = {_fold('w')} THEN w IN ({_quoted(phrases.EDGE)}) ELSE w IN ({_quoted(phrases.EDGE_MARKED)}) END"
    dull = f"CASE WHEN w = {_fold('w')} THEN w IN ({_quoted(phrases.EDGE + phrases.DULL)}) ELSE w IN ({_quoted(phrases.EDGE_MARKED + phrases.DULL_MARKED)}) END"
    return f"""s AS (SELECT doc_id, unnest(regexp_split_to_array(lower({text_sql}), '{ends}')) AS seg FROM documents),
        l AS (SELECT row_number() OVER () AS sid, doc_id, list_filter(regexp_split_to_array(seg, '[^\\pL\\pN]+'), lambda x: x <> '') AS ws FROM s),
        u AS (SELECT sid, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l),
        m AS (SELECT sid, doc_id, w, i, regexp_full_match(w, '[0-9]+') AS num, {edge} AS edge, {dull} AS dull FROM u),
        r AS (SELECT doc_id, a.w || ' ' || b.w AS phrase FROM m a JOIN m b USING (sid, doc_id) WHERE b.i = a.i + 1 AND NOT a.num AND NOT b.num AND (NOT a.edge OR a.w IN ({_quoted(phrases.MAY_BEGIN)})) AND NOT b.edge AND NOT (a.dull AND b.dull)
          UNION SELECT doc_id, a.w || ' ' || x.w || ' ' || b.w FROM m a JOIN m x USING (sid, doc_id) JOIN m b USING (sid, doc_id) WHERE x.i = a.i + 1 AND b.i = a.i + 2 AND NOT a.num AND NOT b.num AND (NOT a.edge OR a.w IN ({_quoted(phrases.MAY_BEGIN)})) AND NOT b.edge AND NOT (a.dull AND x.dull AND b.dull)
          UNION SELECT doc_id, a.w || ' ' || x.w || ' ' || y.w || ' ' || b.w FROM m a JOIN m x USING (sid, doc_id) JOIN m y USING (sid, doc_id) JOIN m b USING (sid, doc_id) WHERE x.i = a.i + 1 AND y.i = a.i + 2 AND b.i = a.i + 3 AND NOT a.num AND NOT b.num AND (NOT a.edge OR a.w IN ({_quoted(phrases.MAY_BEGIN)})) AND NOT b.edge AND NOT (a.dull AND x.dull AND y.dull AND b.dull)),
        g AS (SELECT DISTINCT doc_id, phrase FROM r)"""


@query(f"WITH {_phrase_sql('text')} SELECT doc_id, count(*) AS n, min(phrase) AS first, max(phrase) AS last FROM g GROUP BY doc_id")
def str_19_phrases(spark, sf_dir):
    rows = phrases.phrase_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("phrase").alias("first"), F.max("phrase").alias("last"))


_PLAIN = f"CASE WHEN doc_id % 2 = 0 THEN {_fold('lower(text)')} ELSE text END"


@query(f"""WITH {_phrase_sql(_PLAIN)}, c AS (SELECT phrase, count(*) AS n FROM g GROUP BY phrase), b AS (SELECT {_fold('phrase')} AS plain, phrase AS spelled FROM c WHERE {_fold('phrase')} <> phrase QUALIFY row_number() OVER (PARTITION BY {_fold('phrase')} ORDER BY n DESC, phrase) = 1)
        SELECT phrase, spelled FROM c JOIN b ON phrase = plain""")
def str_20_spellings(spark, sf_dir):
    """Documents of even ids count as typed without accents."""
    docs = table(spark, sf_dir, "documents")
    typed = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, text.fold(F.col("text"))).otherwise(F.col("text")))
    rows = phrases.each_key_once(typed.select("doc_id", "text"), "doc_id", "text").where("first").select("text")
    counts = phrases.counted(phrases.said(rows, "text"), n=F.count("*"))
    return phrases.with_spelled(counts).where("phrase = plain and spelled is not null").select("phrase", "spelled")


_RAW = "CASE event_id % 5 WHEN 0 THEN 'Delivery' WHEN 1 THEN 'Refund' WHEN 2 THEN 'other' WHEN 3 THEN 'Weather' ELSE 'Payment' END"
_SAID = "CASE event_id % 3 WHEN 0 THEN 'Negative' WHEN 1 THEN 'angry' ELSE 'Neutral' END"
_CAUSE = "CASE event_id % 4 WHEN 0 THEN 'LateDelivery' WHEN 1 THEN 'SlowRefund' ELSE 'GatewayError' END"
_NEW = "CASE raw " + " ".join(f"WHEN '{o}' THEN '{n}'" for o, n in OLD_CATEGORIES.items()) + " ELSE CASE WHEN raw IN (" + _quoted(CATEGORIES) + ") THEN raw ELSE 'Other' END END"
_KNOWN = " OR ".join(f"(category = '{c}' AND cause IN ({_quoted(v[1])}))" for c, v in CATEGORIES.items())


@query(f"""WITH r AS (SELECT event_id, event_id % 11 = 0 AS broken, {_RAW} AS raw, {_SAID} AS said, {_CAUSE} AS cause FROM events), n AS (SELECT *, {_NEW} AS category, CASE WHEN said = 'angry' THEN 'Neutral' ELSE said END AS mood FROM r), x AS (SELECT *, broken OR (category = 'Other' AND lower(raw) <> 'other') AS rules FROM n)
        SELECT event_id, CASE WHEN rules THEN 'ProductQuality' ELSE category END AS category, CASE WHEN NOT rules AND ({_KNOWN}) THEN cause END AS cause, CASE WHEN broken OR (rules AND mood = 'Neutral') THEN 'Positive' ELSE mood END AS sentiment, CASE WHEN rules THEN 'rules' ELSE 'llm' END AS labelled_by FROM x""")
def cls_07_coerced_answers(spark, sf_dir):
    """Answers built from the events; every eleventh is no JSON."""
    answer = F.to_json(F.struct(F.expr(_RAW).alias("category"), F.expr(_CAUSE).alias("subCategory"), F.expr(_SAID).alias("sentiment")))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "sorry").otherwise(answer).alias("raw"))
    label = model_output.coerced(F.col("raw"), F.lit("ProductQuality"), F.lit("Positive"))
    return rows.select("event_id", label.alias("l")).select("event_id", "l.category", "l.cause", "l.sentiment", "l.labelled_by")


_LOGITS = "[value / 10 - 4, event_id % 9 - 6.5, event_id % 13 - 9.5]"


@query(f"""WITH x AS (SELECT event_id, CAST({_LOGITS} AS DOUBLE[]) AS v FROM events), y AS (SELECT event_id, v, list_max(v) AS top FROM x)
        SELECT event_id, concat_ws(',', CASE WHEN v[1] >= 0 THEN 'Delivery' END, CASE WHEN v[2] >= 0 THEN 'Payment' END, CASE WHEN v[3] >= 0 THEN 'Refund' END) AS labels, CASE WHEN top = v[3] THEN 'Refund' WHEN top = v[2] THEN 'Payment' ELSE 'Delivery' END AS best, 1 / (1 + exp(-top)) < 0.3 AS uncertain FROM y""")
def cls_17_decoded_labels(spark, sf_dir):
    logits = F.array(F.col("value") / 10 - 4, F.col("event_id") % 9 - 6.5, F.col("event_id") % 13 - 9.5)
    found = model_output.decoded(logits, ["Delivery", "Payment", "Refund"])
    return table(spark, sf_dir, "events").select("event_id", found.alias("f")).select("event_id", "f.labels", "f.best", "f.uncertain")


_INTENTS = {"compare": ["th", "ver"], "trend": ["er", "in", "quo"], "cause": ["por", "ein"]}
_POINTS = {i: " + ".join(f"CASE WHEN contains(q, '{k}') THEN {20 + len(k)} ELSE 0 END" for k in ks) for i, ks in _INTENTS.items()}


@query(f"""WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, turn, {_POINTS['compare']} AS a, {_POINTS['trend']} AS b, {_POINTS['cause']} AS c FROM c)
        SELECT conv_id, turn, CASE WHEN greatest(a, b, c) = 0 THEN 'overview' WHEN a >= b AND a >= c THEN 'compare' WHEN b >= c THEN 'trend' ELSE 'cause' END AS intent, greatest(a, b, c) / 20.0::DOUBLE AS score FROM p""")
def cls_15_routed_questions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", model_output.routed(F.lower("text"), _INTENTS).alias("r")).select("conv_id", "turn", "r.intent", "r.score")
