"""What the two classifiers share: folds, bounded samples of labelled rows, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(doc_id, text, y, part)`` of at most ``rows`` labelled ids outside fold 0, those of the smallest hashes.

    Labels other than 0 and 1 are left out; of several labels for an id the largest
    holds, and of several texts the smallest, so there are never more than ``rows``.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").withColumn("part", fold(F.col("doc_id"))).where("part <> 0")
    known = known.groupBy("doc_id", "part").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by the parameter, so it may be broadcast
    return documents(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "part").agg(F.min("text").alias("text")).select("doc_id", "text", "y", "part")


def matrix(texts: list[str], features: Callable[[str], list[float]]) -> np.ndarray:
    """Features of a batch of texts, (rows, features)."""
    return np.array([features(t) for t in texts], dtype=np.float64)


def collect_features(rows: DataFrame, features: Callable[[str], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of the bounded ``training_rows``; one small row each goes to the driver."""

    def run(batches):
        for b in batches:
            values = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "y", "part", "x"])

    got = rows.select("text", "doc_id", "y", "part").mapInArrow(run, "doc_id long, y int, part int, x array<double>").toArrow()
    if got.num_rows == 0:
        return np.zeros((0, len(features("")))), np.zeros(0), np.zeros(0, np.int64)
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.array(got.column("x").to_pylist(), dtype=np.float64)
    return x, got.column("y").to_numpy().astype(np.float64), got.column("part").to_numpy()


def with_score(docs: DataFrame, features: Callable[[str], list[float]], score: Callable[[np.ndarray], np.ndarray], name: str, text_col: str = "text") -> DataFrame:
    """All of ``docs`` with the column ``name``; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series(score(matrix(list(texts), features)) if len(texts) else np.zeros(0))

    return docs.withColumn(name, value(F.coalesce(F.col(text_col), F.lit(""))))


def scored(docs: DataFrame, features: Callable[[str], list[float]], score: Callable[[np.ndarray], np.ndarray], cut: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            value = score(matrix(texts, features)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, pa.float64())], ["doc_id", "score"])

    rows = documents(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
