"""Recommendations against a plain version over lists, and known cases."""

import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voicegrain.operators import playbook
from voicegrain.operators import recommendations as advice

NOW = datetime(2026, 9, 10, 12)
ITEMS = "feedback_id string, category string, cause string, product_name string, region string, product_category string, source string, order_id long, ts timestamp, sentiment string, weight double, level string, n long"
ALERTS = "alert_id string, category string, cause string, product_name string, region string, level string, q_value double, affected long, current_rate double, baseline_rate double"
DECISIONS = "action_id string, decision string, reason string, scope_key string, at timestamp"


def rows():
    """Late deliveries gather in one region and evening; defects in one product; refunds are spread; a third of all complaints falls to one alert."""
    out = []
    for i in range(240):  # the weeks before
        out.append((f"b{i}", ["Delivery", "ProductQuality", "ReturnRefund"][i % 3], "Any", f"p{i % 8}", f"r{i % 6}", f"g{i % 4}", f"s{i % 5}", i, NOW - timedelta(days=8 + i % 19, hours=i % 24), "Positive" if i % 4 else "Negative", 0.5))
    for i in range(60):
        out.append((f"l{i}", "Delivery", "LateDelivery", f"p{i % 8}", "r1" if i % 10 else "r2", f"g{i % 4}", f"s{i % 5}", i if i % 2 else None, (NOW - timedelta(days=1 + i % 5)).replace(hour=20), "Negative", 0.9))
    for i in range(20):
        out.append((f"d{i}", "ProductQuality", "TechnicalDefect", "p3" if i % 4 else None, f"r{i % 6}", "g3" if i % 4 else "", f"s{i % 5}", None, NOW - timedelta(days=i % 6, hours=i), "Negative", 1.0))
    for i in range(12):
        out.append((f"f{i}", "ReturnRefund", "SlowRefund", f"p{i % 8}", None, f"g{i % 4}", f"s{i % 5}", 5000 + i, NOW - timedelta(days=i % 7, hours=2 * i), "Negative", 0.4))
    out.append(("spam", "Delivery", "LateDelivery", "p1", "r1", "g1", "s1", 1, NOW, "Negative", 0.0))
    out.append(("unsure", "Delivery", "LateDelivery", "p1", "r1", "g1", "s1", 1, NOW, "Negative", None))
    out.append(("later", "Delivery", "LateDelivery", "p1", "r1", "g1", "s1", 1, NOW + timedelta(seconds=1), "Negative", 1.0))
    out.append(("timeless", "Delivery", "LateDelivery", "p1", "r1", "g1", "s1", 1, None, "Negative", 1.0))
    out.append(("nothing", None, None, None, None, None, None, None, NOW, "Negative", 1.0))
    return [(*r, "clash", 7) for r in out]


WANTED = [
    ("late", "Delivery", "LateDelivery", None, None, "Critical", 0.001, 40, 0.2, 0.05),
    ("late r2", "Delivery", "LateDelivery", None, "r2", "Low", 0.04, 3, 0.2, 0.0),
    ("any delivery", "Delivery", None, None, None, "High", None, 45, 0.3, 0.05),
    ("defect", "ProductQuality", "TechnicalDefect", None, None, "High", 0.01, 15, 0.1, 0.01),
    ("refund", "ReturnRefund", "SlowRefund", None, None, "Low", 0.02, 12, 0.1, 0.01),
    ("silent", "Payment", "GatewayError", None, None, "Low", 0.02, 0, None, None),
    ("unknown", "Nowhere", "Nothing", "p1", None, None, 0.02, 5, 0.1, 0.1),
]


def hour(t):
    return next((f"{a}–{b}h" for a, b in ((0, 6), (6, 11), (11, 14), (14, 18), (18, 22)) if a <= t.hour < b), "22–24h")


def brute_profiles(items, alerts):
    dims = [lambda r: r[4], lambda r: r[3], lambda r: r[5], lambda r: r[6], lambda r: hour(r[8]), lambda r: r[8].strftime("%A")]
    ok = [r for r in items if r[10] and r[8] and r[8] <= NOW]
    base = [r for r in ok if NOW - timedelta(days=28) <= r[8] < NOW - timedelta(days=7)]
    out = {}
    for a in alerts:
        ev = [r for r in ok if r[8] >= NOW - timedelta(days=7) and r[9] == "Negative" and r[1] == a[1] and all(w is None or w == v for w, v in zip(a[2:5], r[2:5]))]
        for (name, _), get in zip(advice.DIMENSIONS, dims):
            here, before = Counter(get(r) for r in ev if get(r)), Counter(get(r) for r in base if get(r))
            if not ev:
                continue
            n1, n2 = sum(here.values()), sum(before.values())
            missing = 1 - n1 / len(ev)
            if not n1 or not n2:
                out[a[0], name] = (len(ev), None, None, None, False)
                continue
            top = min(here, key=lambda v: (-here[v], v))
            x1, x2 = here[top], before[top]
            share, usual = x1 / n1, x2 / n2
            lift = share / usual if usual else 99.0
            pooled = (x1 + x2) / (n1 + n2)
            z = (share - usual) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)) if 0 < pooled < 1 else 0
            hot = missing <= 0.4 and x1 >= 4 and share >= 0.45 and lift >= 1.4 and math.erfc(abs(z) / math.sqrt(2)) <= 0.05
            out[a[0], name] = (len(ev), top, share, lift, hot)
    return out


@pytest.fixture(scope="module")
def frames(spark):
    items = spark.createDataFrame(rows(), ITEMS)
    # an order twice, the smaller amount is not taken
    paid = spark.createDataFrame([(i, 100_000.0) for i in range(60)] + [(1, 5.0), (5001, None)], "order_id long, amount double")
    return items, spark.createDataFrame(WANTED, ALERTS), paid, playbook.library(spark)


def plans(spark, frames, decisions=(), outcomes=None):
    items, alerts, paid, library = frames
    got = advice.recommend(alerts, items, paid, library, spark.createDataFrame(list(decisions), DECISIONS), NOW.isoformat(" "), 7, 28, outcomes)
    return {(r.alert_id, r.action_id): r for r in got.collect()}


def test_profiles_match_brute_force(frames):
    items, alerts, _, _ = frames
    found = advice.evidence(alerts, items, NOW.isoformat(" "), 7)
    got = advice.dimension_profiles(found, items, NOW.isoformat(" "), 7, 28).collect()
    want = brute_profiles(rows(), WANTED)
    assert {(r.alert_id, r.dimension) for r in got} == set(want)
    for r in got:
        _, top, share, lift, hot = want[r.alert_id, r.dimension]
        assert (r.top_value, r.concentrated) == (top, hot)
        assert r.share == (None if share is None else pytest.approx(share, abs=6e-4)) and r.lift == (None if lift is None else pytest.approx(lift, abs=6e-3))
    assert any(r.concentrated for r in got) and any(r.top_value is None for r in got)


def test_shapes_slots_and_states(spark, frames):
    got = plans(spark, frames)
    shape = {a: r.concentration for (a, _), r in got.items()}
    assert shape["late"] == "FOCUSED" and shape["refund"] == "DIFFUSE" and shape["silent"] == "DIFFUSE"
    late = {k[1]: r for k, r in got.items() if k[0] == "late"}
    # the share named is that of the dimension that stands out most: here the evening
    assert "r1" in late["LD-AUDIT-REGION"].text and "100%" in late["LD-AUDIT-REGION"].text and "18–22h" in late["LD-PEAK-CAPACITY"].text
    assert late["LD-AUDIT-ALL"].reason == "shape" and late["INS-CARRIER"].state == "data gap" and "{" not in "".join(r.text or "" for r in got.values())
    steps = sorted((r.step, -r.score) for r in late.values() if r.state == "step")
    assert [s for s, _ in steps] == [1, 2, 3, 4, 5] and steps == sorted(steps, key=lambda s: s[1])
    assert got["late r2", "LD-REROUTE"].reason == "tier" and got["defect", "TD-HALT-SALE"].reason == "template"  # no order, so no money
    assert {k[1] for k in got if k[0] == "any delivery"} == {"FB-DELIVERY"}  # its only action fits, so there is no net beside it
    assert {(k[1], r.state) for k, r in got.items() if k[0] == "unknown"} == {("FB-GENERIC", "step")}
    assert got["silent", "GE-LOG"].reason == "shape" and got["silent", "GE-LOG-ALL"].state == "step"
    assert late["LD-PROACTIVE-NOTICE"].requires_approval and not late["LD-REROUTE"].requires_approval


def test_scores_money_and_measured_effects(spark, frames):
    got = plans(spark, frames)
    r = got["late", "LD-REROUTE"]
    assert (r.evidence_count, r.matched, r.coverage, r.at_risk, r.extrapolated) == (60, 30, 0.5, 3_000_000, 6_000_000)
    assert (got["refund", "SRF-MEASURE"].matched, got["refund", "SRF-MEASURE"].extrapolated) == (1, 0)  # one order has a transaction, without an amount
    factors = [math.log10(6_000_000) / 8, (1 - 0.001 / 0.05) * 0.5 + 0.3 + 0.9 * 0.2, r.targeting, 0.45, 0.7]
    assert r.score == pytest.approx(math.prod(factors) ** 0.2 - 2 * 0.035 - 0.03, abs=1e-4)
    effects = spark.createDataFrame([("LD-REROUTE", 2, 0.2)], "action_id string, n long, sum_reduction double")
    factors[3] = 0.5 * 0.45 + 0.5 * 0.1
    assert plans(spark, frames, outcomes=effects)["late", "LD-REROUTE"].score == pytest.approx(math.prod(factors) ** 0.2 - 0.1, abs=1e-4)


def test_decisions_teach_and_suppress(spark, frames):
    scope = "Delivery|LateDelivery|*|*"
    no = lambda action, days, reason=" NOT_APPLICABLE", s=scope: (action, "DISMISSED", reason, s, NOW - timedelta(days=days))
    log = [no("LD-REROUTE", 29), no("LD-REROUTE", 400), no("LD-AUDIT-REGION", 14), no("LD-PARTNER-SLA", 1, "too dear"), no("LD-PEAK-CAPACITY", 1, s="elsewhere"), ("LD-AUDIT-REGION", "ACCEPTED", None, scope, None), (None, None, None, None, None)]
    before, got = plans(spark, frames), plans(spark, frames, log)
    state = {k[1]: r.state for k, r in got.items() if k[0] == "late"}
    assert state["LD-REROUTE"] == "suppressed" and "suppressed" not in (state["LD-AUDIT-REGION"], state["LD-PARTNER-SLA"], state["LD-PEAK-CAPACITY"])
    assert got["late", "LD-REROUTE"].prior == pytest.approx(2.8 / 6) and got["late", "LD-AUDIT-REGION"].prior == pytest.approx(3.8 / 6)
    assert got["late", "LD-PARTNER-SLA"].score < before["late", "LD-PARTNER-SLA"].score


def test_shared_actions_and_empty_tables(spark, frames):
    items, alerts, paid, library = frames
    twice = alerts.union(alerts.where("alert_id = 'late'").withColumn("alert_id", F.lit("again")))
    none = spark.createDataFrame([], DECISIONS)
    made = advice.recommend(twice, items, paid, library, none, NOW.isoformat(" "), 7, 28)
    shared = {(r.action_id, r.place): r for r in advice.shared_actions(made).collect()}
    assert shared["LD-REROUTE", "r1"].alerts == 2 and shared["LD-REROUTE", "r1"].affected == 80 and shared["LD-REROUTE", "r1"].revenue == 12_000_000
    empty = advice.recommend(alerts.limit(0), items, paid, library, none, NOW.isoformat(" "), 7, 28)
    assert empty.count() == 0
    bare = advice.recommend(alerts, items.limit(0), paid.limit(0), library, none, NOW.isoformat(" "), 7, 28).where("state = 'step'")
    assert {r.concentration for r in bare.collect()} == {"DIFFUSE"}
