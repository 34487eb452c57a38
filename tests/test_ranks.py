import random
import statistics

from pyspark.sql import functions as F

from voicegrain.operators import alerts, ranks


def test_running_values_over_many_ranges(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([0.001, 0.01, 0.02, 0.2, 0.5, 1.0]) * rng.random(), rng.randrange(-5, 6)) for k in range(2000)]
    frame = spark.createDataFrame(rows, "id int, p double, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = ranks.in_order(frame, "p", "id")
        assert ordered.select("_part").distinct().count() > 1
        out = ranks.running(ranks.running(ordered, F.col("v"), "upto"), F.col("v"), "least", "min", upwards=True).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    total, least = 0, [min(r[2] for r in want[k:]) for k in range(0, 2000)]
    for k, (r, w) in enumerate(zip(out, want)):
        total += w[2]
        assert (r.rank, r.id, r.upto, r.least) == (k + 1, w[0], total, least[k])


def test_false_discovery_rate(spark):
    rng = random.Random(9)
    ps = [round(rng.random() ** 4, 6) for _ in range(700)]
    frame = spark.createDataFrame(list(enumerate(ps)), "id int, p double").repartition(5)
    got = {r.id: (r["rank"], r.q_value, r.significant) for r in alerts.benjamini_hochberg(frame, "p", ["id"], 0.05).collect()}
    order = sorted(range(700), key=lambda k: (ps[k], k))
    last = max((n + 1 for n, k in enumerate(order) if ps[k] <= (n + 1) / 700 * 0.05), default=0)
    q = 1.0
    for n in range(699, -1, -1):
        q = min(q, ps[order[n]] * 700 / (n + 1))
        assert got[order[n]][0] == n + 1 and abs(got[order[n]][1] - q) < 1e-12 and got[order[n]][2] == (n < last)
    assert alerts.benjamini_hochberg(frame.limit(0), "p", ["id"]).count() == 0


def test_medians(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 100):
        values = [float(rng.randrange(20)) for _ in range(n)]
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        got = ranks.median(frame, "v").first()
        assert (got.n, got.median) == (n, statistics.median(values) if values else None)
