"""Label cascade: models in order of preference, the rules where none answers, a judge for what may be sarcastic, and a vote.

A model is any object with a ``name`` and ``answers(texts, ratings)``, which gives a JSON
answer or None for each text of an Arrow batch; it is sent to the executors once a
task.  A batch goes to the first model, what that leaves goes to the next, and the
judge sees flagged rows only.  Nothing is shuffled but to join answers given beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import complaints, model_output, normalize, rules

ANSWERED = ["_answer", "_model"]
# Short words of praise; where there is none, nothing is sarcastic.
SHORT_PRAISE = "tốt|ok|oke|okela|ổn|đẹp|xinh|ngon|thích|ưng|hay|nhanh|rẻ|chất|xịn|đỉnh|tuyệt|hài lòng|cảm ơn|cám ơn|uy tín|đáng|5\\s*\\*|5\\s*sao"


class Scorer(Protocol):
    name: str

    def answers(self, texts: Sequence[str], ratings: Sequence[float | None]) -> Sequence[str | None]: ...


class PatternScorer:
    """A scorer by patterns: the answer of the first that a text holds, else none."""

    def __init__(self, name: str, answers: dict[str, str]):
        self.name, self.patterns = name, answers

    def answers(self, texts: Sequence[str], ratings: Sequence[float | None]) -> list[str | None]:
        return [next((a for p, a in self.patterns.items() if re.search(p, t)), None) for t in texts]


def answered(rows: DataFrame, models: Sequence[Scorer], text: str, rating: str, where: Column | None = None, names: Sequence[str] = ANSWERED) -> DataFrame:
    """``rows`` with the first model's answer to each row and the model's name, both null where no model answers.

    Only rows ``where`` it holds are asked about, and only those that the models before
    left.  A model that gives another number of answers than it got texts is an error.
    """
    asked = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    rows = rows.withColumn("_asked", asked)
    at = [rows.columns.index(c) for c in (text, rating, "_asked")]

    def run(batches):
        for b in batches:
            texts, ratings, wanted = (b.column(i).to_pylist() for i in at)
            answers, by = [None] * b.num_rows, [None] * b.num_rows
            for model in models:
                left = [i for i, w in enumerate(wanted) if w and answers[i] is None]
                if not left:
                    break
                given = list(model.answers([texts[i] or "" for i in left], [ratings[i] for i in left]))
                if len(given) != len(left):
                    raise ValueError(f"{model.name}: {len(given)} answers to {len(left)} texts")
                for i, answer in zip(left, given):
                    if answer is not None:
                        answers[i], by[i] = answer, model.name
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(by, pa.string())], [*b.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.StringType()) for n in names]])
    return rows.mapInArrow(run, schema).drop("_asked")


def _votes(primary: Column, judge: Column, stars: Column) -> tuple[Column, Column]:
    """The sentiment that two of the votes given share, else the primary one, and whether none has a majority."""
    votes = F.array_compact(F.array(primary, judge, stars))
    shared = F.filter(votes, lambda v: F.size(F.filter(votes, lambda w: w == v)) >= 2)
    split = (F.size(votes) > 1) & (F.size(shared) == 0)
    return F.coalesce(F.get(shared, F.lit(0)), primary), split


def labels(items: DataFrame, models: Sequence[Scorer] = (), judge: Scorer | None = None, known: DataFrame | None = None, key: str = "feedback_id", text: str = "text", rating: str = "rating") -> DataFrame:
    """``(key, sentiment, category, cause, labelled_by, suspected, verdict, needs_review)`` for every row of ``items``.

    The primary label is the answer in ``known`` (``key, answer, model``, a key once),
    else the first model's answer, else the rules'; an answer that cannot be read gives
    way to the rules too.  A row that may be sarcastic, or is called negative with four
    or five stars, goes to the judge, and the label is the vote of the primary one, the
    judge and the stars.  It needs a review where the judge is silent, no two votes
    agree, primary and judge name different problems, or it is called sarcastic and
    positive.  A judge's sarcasm counts only where the text praises something.
    A null text is empty: rules call it Neutral, or by its stars.
    """
    rows = items.select(key, F.col(text).alias("_text"), F.col(rating).cast("double").alias("_stars"))
    rows = normalize.normalized(rows, "_text").withColumn("normalized", F.lower("normalized"))
    if known is not None:
        given = known.select(F.col(key), F.col("answer").alias("_given"), F.col("model").alias("_given_by"))
        rows = rows.join(given, key, "left")
    else:
        rows = rows.withColumns({"_given": F.lit(None).cast("string"), "_given_by": F.lit(None).cast("string")})
    if models:
        rows = answered(rows, models, "_text", "_stars", F.col("_given").isNull())
    else:
        rows = rows.withColumns(dict.fromkeys(ANSWERED, F.lit(None).cast("string")))
    rows = rows.withColumns({"_raw": F.coalesce("_given", "_answer"), "_by": F.when(F.col("_given").isNotNull(), F.col("_given_by")).otherwise(F.col("_model"))})
    rows = rows.withColumn("_found", complaints.complaints(F.col("normalized")))
    top = F.get("_found", F.lit(0))
    rows = rows.withColumns({"_rule": F.coalesce(top["category"], F.lit("Other")), "_cause": top["cause"], "_felt": complaints.sentiment(F.col("normalized"), F.col("_found"), F.col("_stars"))})
    rows = rows.withColumn("_p", model_output.coerced(F.col("_raw"), F.col("_rule"), F.col("_felt")))
    ruled = F.col("_p.labelled_by") == "rules"
    rows = rows.select(
        key, "_text", "_stars", "normalized", F.col("_p.sentiment").alias("_s"), F.col("_p.category").alias("_c"),
        F.when(ruled, F.col("_cause")).otherwise(F.col("_p.cause")).alias("_u"), F.when(ruled, "rules").otherwise(F.coalesce("_by", F.lit("llm"))).alias("_l"),
    )
    odd = (F.col("_stars") >= 4) & (F.col("_s") == "Negative")
    flag = complaints.sarcasm(F.col("normalized"), F.col("_stars"), F.col("_s")) | F.coalesce(odd, F.lit(False))
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    if judge is not None:
        rows = answered(rows, [judge], "_text", "_stars", F.col("_flag"), ["_verdict", "_judge"])
    else:
        rows = rows.withColumns(dict.fromkeys(("_verdict", "_judge"), F.lit(None).cast("string")))
    return _judged(rows, key)


def _judged(rows: DataFrame, key: str) -> DataFrame:
    said = F.from_json("_verdict", "sarcastic boolean, sentiment string, category string, subCategory string")
    rows = rows.withColumn("_j", said).withColumn("_heard", F.col("_j.sentiment").isNotNull() | F.col("_j.sarcastic").isNotNull())
    checked = model_output.coerced(F.to_json(F.struct("_j.category", "_j.subCategory", "_j.sentiment")), F.lit("Other"), F.col("_j.sentiment"))
    rows = rows.withColumn("_k", checked)
    praise = F.col("normalized").rlike(complaints.SARCASM_PRAISE) | F.col("normalized").rlike(rf"(?<!\p{{L}})({SHORT_PRAISE})(?!\p{{L}})")
    sarcastic = F.coalesce(F.col("_j.sarcastic"), F.lit(False)) & praise
    label, split = _votes(F.col("_s"), F.when(F.col("_j.sentiment").isin(*model_output.SENTIMENTS), F.col("_j.sentiment")), rules.rating_vote(F.col("_stars")))
    takes = sarcastic & (F.col("_k.category") != "Other") & (F.col("_c") == "Other")
    conflict = F.col("_heard") & (F.col("_k.category") != "Other") & (F.col("_c") != "Other") & (F.col("_k.category") != F.col("_c"))
    flag = F.col("_flag")
    sentiment, category = F.when(flag, label).otherwise(F.col("_s")), F.when(flag & takes, F.col("_k.category")).otherwise(F.col("_c"))
    review = flag & (~F.col("_heard") | split | conflict | (sarcastic & (label == "Positive")))
    changed = (sentiment != F.col("_s")) | (category != F.col("_c"))
    return rows.select(
        key, sentiment.alias("sentiment"), category.alias("category"), F.when(flag & takes, F.col("_k.cause")).otherwise(F.col("_u")).alias("cause"),
        F.when(changed, "cascade").otherwise(F.col("_l")).alias("labelled_by"), flag.alias("suspected"),
        F.when(flag & F.col("_heard"), F.when(sarcastic, "sarcastic").otherwise("literal")).alias("verdict"), F.coalesce(review, F.lit(False)).alias("needs_review"),
    )
