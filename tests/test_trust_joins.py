import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from voicegrain.operators import trust
from voicegrain.plans.context import items


def test_rows_without_an_order_do_not_meet_in_one_task(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"), spark.conf.set("spark.sql.adaptive.enabled", "false")
        items = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("order_id"))
        orders = spark.range(500).select(F.col("id").alias("order_id"), F.lit("2024-01-01").cast("timestamp").alias("delivered_at"))
        got = trust.with_orders(items, orders)
        assert got.where("order_id is null").select(F.spark_partition_id()).distinct().count() > 1
        assert got.count() == 1000 and got.where("order_found").count() == 50 == got.where("order_delivered_at is not null").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bursts_equal_brute_force_over_bucket_edges_and_odd_rows(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), None if rng.random() < 0.1 else start + timedelta(seconds=rng.choice([0, 1799, 1800, 1801, 14399, 14400, rng.randrange(60000)])), rng.choice([1.0, 300.0, None])) for i in range(300)]
    rows += [(900, "few", start, 1.0), (901, "few", None, 1.0), (902, "untimed", None, 1.0)]
    got = {r.id: (r.near, None if r.burst_z is None else round(r.burst_z, 9), round(r.burst, 9)) for r in trust.bursts(spark.createDataFrame(rows, "id int, product_name string, ts timestamp, account_age_days double")).collect()}

    def median(values):
        return sorted(values)[len(values) // 2]

    near = {i: [r for r in rows if t and r[1] == p and r[2] and abs((r[2] - t).total_seconds()) <= 1800] for i, p, t, _ in rows}
    want = {}
    for i, p, t, _ in rows:
        counts = [len(near[r[0]]) for r in rows if r[1] == p and r[2]] if p else []
        z = 0.0
        if len(counts) >= 8:
            m = median(counts)
            mad = median([abs(c - m) for c in counts])
            z = (len(near[i]) - m) / (1.4826 * mad or 1.0) if t else None
        new = sum(r[3] is not None and r[3] < 7 for r in near[i]) / len(near[i]) if t else 0
        burst = min(1.0, z / 6 * (0.5 + new)) if z is not None and z > 3 else 0.0
        want[i] = (len(near[i]) if t else None, None if z is None else round(z, 9), round(burst, 9))
    assert got == want and len(got) == len(rows)


def test_what_the_order_signal_comes_from_does_not_go_to_the_bursts(spark, sf):
    plan = items(spark, sf).select("feedback_id", "weight")._jdf.queryExecution().optimizedPlan().toString()
    timed = [line for line in plan.splitlines() if " AS _s#" in line and "feedback_id#" in line]
    assert timed and not any(re.search(r"[\[ ](order_delivered_at|order_found|coverage|tier_weight)#\d+L?[,\]]", line) for line in timed)


def test_segments_take_no_long_ids_through_the_trust_layer(spark, sf):
    from voicegrain.operators import metrics
    from voicegrain.queries import QUERIES

    found = QUERIES["agg_20_segments"](spark, sf)
    assert "feedback_id#" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    rows = spark.createDataFrame([(1, None, "Positive"), (1, None, "Neutral"), (None, "f3", "Positive"), (None, "f4", "Negative")], "customer_id int, unnamed string, sentiment string")
    rows = rows.selectExpr("*", "1.0D as weight", "timestamp'2024-01-01' as ts", "'ACCEPTED' as band")
    assert {r.customer: r.segment for r in metrics.segments(rows, "unnamed").collect()} == {"1": "promoter", "f3": "one_time", "f4": "at_risk"}


def test_review_labels_meet_rows_before_the_trust_layer(spark, sf):
    from voicegrain.operators import records
    from voicegrain.queries_more import QUERIES

    found = QUERIES["join_04_review_override"](spark, sf)
    assert "feedback_id#" not in found._jdf.queryExecution().optimizedPlan().toString()
    items = spark.createDataFrame([("a", "ACCEPTED", 0.2, 1.0), ("b", "GRAY_ZONE", 0.3, 0.8), ("c", "ACCEPTED", 0.5, 0.6)], "feedback_id string, band string, weight double, tier_weight double")
    labels = spark.createDataFrame([("a", "spam"), ("b", "valid")], "feedback_id string, label string")
    early = records.overridden(records.labelled(items, labels).drop("feedback_id"))
    assert sorted((r.band, r.weight) for r in early.collect()) == [("ACCEPTED", 0.5), ("ACCEPTED", 0.8), ("SPAM", 0.0)]
