import os
import zlib

import numpy as np
import pytest

from voicegrain.llm import boosting, quality, toxicity
from voicegrain.llm.queries import queries

CASES = [("op8_quality_classifier", "quality", 0.3, quality.quality_scores), ("op9_toxicity", "toxic", 0.5, toxicity.toxicity_scores)]


def ranked(score, y):
    """The share of pairs of a one and a zero that the score puts in order."""
    one, zero = score[y == 1], score[y == 0]
    return np.mean((one[:, None] > zero) + 0.5 * (one[:, None] == zero))


@pytest.mark.parametrize("name,label,cut,_", CASES)
def test_held_out_rows_are_told_apart(spark, sf, name, label, cut, _):
    sf = os.path.join(os.path.dirname(sf), "sf0.1")  # the smaller tables hold out only a few toxic rows
    got = {r.doc_id: r for r in queries()[name](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id].score, r[label]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    score, y = np.array([x for x, _ in held]), np.array([x for _, x in held])
    assert ranked(score, y) > 0.95


@pytest.mark.parametrize("name,label,cut,scores", CASES)
def test_odd_inputs(spark, name, label, cut, scores):
    rows = [(i, f"good words number {i} here." if i % 2 else "bad $$$ !!! bad bad") for i in range(60)] + [(100, None), (101, ""), (102, "x " * 30_000), (102, "x " * 30_000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0.0, 1) for i, t in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, None), (500, 1), (None, 1)], f"doc_id long, {label} int")
    got = scores(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1  # a null text is scored as an empty one
    assert len({r.score for r in scores(docs, labels.limit(0)).collect()}) == 1
    assert scores(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * (i % 9)) for i in range(80)], "doc_id long, text string")
    one = spark.createDataFrame([(i, i % 3 % 2) for i in range(80)], "doc_id long, quality int")
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0]
    other = spark.createDataFrame([(i, 1 - i % 3 % 2 if i in held else i % 3 % 2) for i in range(80)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (one, other))
    assert a == b


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boosting.fit(x, y)
    assert np.mean((model.probability(x) > 0.5) == y) > 0.95
    assert boosting.fit(x, np.zeros(400)).probability(x).max() < 0.01
    line = boosting.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    out = line(np.linspace(0, 1, 11))
    assert (np.diff(out) >= 0).all() and 0 < out.min() and out.max() < 1
