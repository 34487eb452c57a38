"""Answers of models and routed questions as columns: coercion to the taxonomy, decoding of scores, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CATEGORIES, OLD_CATEGORIES

SENTIMENTS = ["Positive", "Negative", "Neutral"]
ANSWER = "category string, subCategory string, sentiment string, aiSummary string"


def coerced(raw: Column, rule_category: Column, rule_sentiment: Column) -> Column:
    """A struct ``(category, cause, sentiment, summary, labelled_by)`` from a model's JSON answer.

    Old names become taxonomy names; a cause outside its category is null; an unknown
    sentiment is Neutral.  Text that is no JSON object, or a category that is unknown
    without being named Other, takes the rules' label, with the model's sentiment if it
    is not Neutral.
    """
    answer = F.from_json(raw, ANSWER)
    name, said = F.trim(answer["category"]), F.lit(None).cast("string")
    for old, new in OLD_CATEGORIES.items():
        said = F.when(name == old, new).otherwise(said)
    category = F.coalesce(F.when(name.isin(*CATEGORIES), name), said, F.lit("Other"))
    cause = F.lit(None).cast("string")
    for known, (_, causes) in CATEGORIES.items():
        cause = F.when((category == known) & answer["subCategory"].isin(*causes), answer["subCategory"]).otherwise(cause)
    sentiment = F.when(answer["sentiment"].isin(*SENTIMENTS), answer["sentiment"]).otherwise("Neutral")
    empty = answer.isNull() | F.coalesce(answer["category"], answer["subCategory"], answer["sentiment"], answer["aiSummary"]).isNull()
    rules = empty | ((category == "Other") & (F.lower(F.coalesce(name, F.lit(""))) != "other"))
    summary = F.nullif(F.substring(F.coalesce(answer["aiSummary"], F.lit("")), 1, 300), F.lit(""))
    return F.struct(
        F.when(rules, rule_category).otherwise(category).alias("category"),
        F.when(~rules, cause).alias("cause"),
        F.when(rules & (empty | (sentiment == "Neutral")), rule_sentiment).otherwise(sentiment).alias("sentiment"),
        F.when(~rules, summary).alias("summary"),
        F.when(rules, "rules").otherwise("llm").alias("labelled_by"),
    )


def decoded(logits: Column, names: list[str], at: float = 0.5, unsure: float = 0.3) -> Column:
    """A struct ``(labels, best, uncertain)`` of one logit a name: those of probability ``at`` or more, the likeliest, and whether it is below ``unsure``."""
    scored = F.transform(F.arrays_zip(logits.alias("x"), F.array(*[F.lit(n) for n in names]).alias("name")), lambda r: F.struct((1 / (1 + F.exp(-r["x"].cast("double")))).alias("p"), r["name"].alias("name")))
    labels = F.array_join(F.transform(F.filter(scored, lambda r: r["p"] >= at), lambda r: r["name"]), ",")
    best = F.array_max(scored)
    return F.struct(labels.alias("labels"), best["name"].alias("best"), (best["p"] < unsure).alias("uncertain"))


def routed(question: Column, intents: dict[str, list[str]], fallback: str = "overview") -> Column:
    """A struct ``(intent, score)``: each keyword held adds 1 + its length / 20; the first intent of the highest score."""
    scores = []
    for place, (intent, keywords) in enumerate(intents.items()):
        points = sum((F.when(F.contains(question, F.lit(k)), 20 + len(k)).otherwise(0) for k in keywords), F.lit(0))
        scores.append(F.struct(points.cast("int").alias("points"), F.lit(-place).alias("place"), F.lit(intent).alias("intent")))
    best = F.array_max(F.array(*scores))
    return F.struct(F.when(best["points"] > 0, best["intent"]).otherwise(fallback).alias("intent"), (best["points"] / 20).alias("score"))
