import numpy as np
import pytest
from pyspark.sql import functions as F

from voicegrain.operators import trust


def descent(x, y, rate, epochs):
    b, w = 0.0, np.zeros(x.shape[1])
    for _ in range(epochs):
        off = 1 / (1 + np.exp(-(b + x @ w))) - y
        b, w = b - rate * off.mean(), w - rate * (off[:, None] * x).mean(axis=0)
    return [b, *w]


def test_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((600, 5)), 1)
    y = (x @ [2, 1, 0, 1, 3] + rng.normal(0, 0.5, 600) > 3.3).astype(int)
    rows = [(int(v), *map(float, r)) for v, r in zip(y, x)]
    frame = spark.createDataFrame(rows, "label int, duplicate double, burst double, account double, star double, transaction double").repartition(5)
    model = trust.fit_authenticity(frame, epochs=25, rate=0.5)
    assert list(model.values()) == pytest.approx(descent(x, y, 0.5, 25), abs=1e-9)
    score = trust.authenticity(*[F.col(s) for s in trust.SIGNALS], model)
    scored = frame.select("label", score.alias("s")).groupBy("label").agg(F.avg("s").alias("s")).collect()
    assert {r.label: r.s for r in scored}[1] > {r.label: r.s for r in scored}[0]


def test_nulls_and_no_rows(spark):
    schema = "label int, duplicate double, burst double, account double, star double, transaction double"
    one = spark.createDataFrame([(1, None, 1.0, None, 0.0, None)], schema)
    assert list(trust.fit_authenticity(one, epochs=2).values()) == pytest.approx(descent(np.array([[0, 1.0, 0, 0, 0]]), np.array([1.0]), 0.1, 2), abs=1e-12)
    assert set(trust.fit_authenticity(one.limit(0), epochs=3).values()) == {0.0}
