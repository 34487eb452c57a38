import math
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voicegrain.config import PAIN
from voicegrain.functions import phrases
from voicegrain.operators import pain_points as pains

SCHEMA = "id long, text string, group_key string, product_name string, sentiment string, weight double, tier string, category string, cause string, customer_id long, author string, ts timestamp"
STOP = set(phrases.EDGE + phrases.DULL)


def _rows(seed, n):
    rng = random.Random(seed)
    words = "sọc rung kêu nóng lạnh gãy vỡ trầy mờ tối ồn rè chập cháy hở kẹt".split()
    themes = {"a": ["mất kết nối liên tục", "kết nối chập chờn", "liên tục mất sóng"], "b": ["pin tụt nhanh", "tụt nhanh khủng khiếp"], "c": ["màn hình sọc ngang", "hình sọc ngang dọc"], "tiny": ["nắp gãy"]}
    out = []
    for i in range(n):
        group = "tiny" if i % 60 == 0 else "abc"[i % 3]
        bad = rng.random() < 0.5
        text = [" ".join(rng.choice(words) for _ in range(4))]
        if bad:
            text += rng.sample(themes[group], rng.randint(0, min(2, len(themes[group]))))
            text += ["phản hồi chậm chạp"] if rng.random() < 0.3 else []
        known = rng.random() < 0.8
        slow = "phản hồi chậm chạp" in text
        out.append((i, ", ".join(text), group, "Loa thùng", "Negative" if bad else "Positive", 0.0 if i % 19 == 0 else 0.25 + i % 4 / 8, "P1", "CustomerService" if slow else "ProductQuality", "SlowResponse" if slow else "TechnicalDefect", i % 50, None, f"2024-01-{i % 27 + 1:02d} 00:00:00" if known else None))
    return out


def _frame(spark, rows):
    texts = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string"))
    return texts.withColumn("ts", F.col("ts").cast("timestamp"))


def _fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d")


def _z(y1, n1, y2, n2):
    a, b, c, d = y1 + 0.5, n1 - y1 + 0.5, y2 + 0.5, n2 - y2 + 0.5
    return (math.log(a / b) - math.log(c / d)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d) if n2 >= PAIN.background else None


def _brute(rows, grams, fold):
    """(scope, group, seed phrase) -> ids, by loops over sets."""
    live = {r[0]: r for r in rows if r[5] > 0}
    negatives = {i for i, r in live.items() if r[4] == "Negative"}
    has = defaultdict(set)
    for i, p in grams:
        has[p].add(i)
    groups = sorted({r[2] for r in live.values()})
    of = {g: {i for i, r in live.items() if r[2] == g} for g in groups}
    big = [g for g in groups if len(of[g] & negatives) >= PAIN.negatives]
    common = math.ceil(len(big) / 2) if len(big) >= 3 else math.inf
    out = {}
    for scope, g in [("group", g) for g in big] + [("shop", "shop")]:
        mine = of[g] if scope == "group" else set(live)
        bad = mine & negatives
        names = {"loa", "thung", g}
        found = []
        for p, ids in has.items():
            y1, n1 = len(ids & bad), len(bad)
            spread = sum(1 for x in big if ids & of[x] & negatives)
            if y1 < 3 or (spread >= common) == (scope == "group") or (scope == "group" and all(w in names | STOP for w in fold(p).split())):
                continue
            rest, rest_n = len(ids) - y1, len(live) - n1
            same = _z(y1, n1, len(ids & mine) - y1, len(mine) - n1)
            z, sides = (same, []) if scope == "shop" else (_z(y1, n1, rest, rest_n), [same, _z(y1, n1, len(ids & negatives) - y1, len(negatives) - n1)])
            lift = (y1 / n1) / ((rest + 0.5) / (rest_n + 0.5))
            docs = ids & bad
            days = {live[i][11] for i in docs if live[i][11]}
            if z is None or z < 2.5 or lift < 2 or any(s is not None and s < 1.5 for s in sides) or len({live[i][9] for i in docs}) < 3 or len(days) + sum(live[i][11] is None for i in docs) < 2:
                continue
            found.append((-z, -len(p.split()), p, docs))
        seeds = []
        for _, _, p, docs in sorted(found, key=lambda x: x[:3]):
            for s in seeds:
                both = len(docs & s[1])
                touch = (set(fold(p).split()) - STOP) & set(fold(s[0]).split())
                small = both / min(len(docs), len(s[1]))
                inside = f" {p} " in f" {s[0]} " or f" {s[0]} " in f" {p} "
                if (inside and both) or both / len(docs | s[1]) >= 0.5 or (touch and small >= 0.5) or small >= 0.8:
                    s[1].update(docs)
                    break
            else:
                if len(seeds) < 2 * PAIN.shown:
                    seeds.append((p, set(docs)))
        shown = 0
        for p, docs in seeds:
            labels = defaultdict(int)
            for i in docs:
                labels[live[i][8]] += 1
            if shown < PAIN.shown and max(labels.values()) / len(docs) >= (0.6 if scope == "shop" else 0.5):
                shown += 1
                out[scope, f"{g}::{p}"] = docs
    return out


@pytest.mark.parametrize("normalised", [False, True])
def test_points_equal_sets_and_loops(spark, normalised):
    rows = _rows(1 + normalised, 420)
    items = _frame(spark, rows)
    grams = [tuple(r) for r in pains.phrases_of(items, "id", normalised=normalised).collect()]
    want = _brute(rows, grams, _fold)
    points, members = pains.pain_points(items, "2024-02-01", "id", normalised=normalised)
    got = defaultdict(set)
    for r in members.collect():
        got[r.scope, r.pain_key].add(r.id)
    assert dict(got) == want
    assert {(r.scope, r.pain_key): r["count"] for r in points.collect()} == {k: len(v) for k, v in want.items()}
    said = {(r.scope, r.group_key): set() for r in points.collect()}
    for r in points.collect():
        said[r.scope, r.group_key] |= {r.phrase, *r.variants}
    assert any("kết nối" in p for p in said["group", "a"]) and any("tụt" in p for p in said["group", "b"]) and any("phản hồi" in p for p in said["shop", "shop"])
    assert not any("tụt" in p or "phản hồi" in p for p in said["group", "a"])  # planted phrases in their own group only
    status = {r.group_key: r for r in pains.group_status(items, members, "id").collect()}
    assert status["tiny"].status == "too_few" and status["a"].status == "ok"
    assert status["a"].uncovered == status["a"].negatives - len(set().union(*[v for (s, k), v in want.items() if s == "group" and k.startswith("a::")]))


def test_nulls_and_empty_tables(spark):
    rows = [(i, None if i % 2 else "", None, None, None if i % 3 else "Negative", 1.0, None, None, None, None, None, None) for i in range(40)]
    for given in (rows, []):
        items = _frame(spark, given)
        points, members = pains.pain_points(items, "2024-02-01", "id")
        assert points.count() == 0 and members.count() == 0
        assert pains.group_status(items, members, "id").count() == (1 if given else 0)


def test_counts_equal_those_of_spelled_phrases_in_rows(spark):
    rows = [r[:1] + (r[1] if k % 4 else _fold(r[1]) + (", màn hình sọc" if k % 8 else ""),) + r[2:] for k, r in enumerate(_rows(3, 240))]
    items = _frame(spark, rows)
    counts, _ = pains.phrase_counts(pains.phrases_said(items, "id", normalised=False))
    live = {r[0]: (r[2], r[4] == "Negative") for r in rows if r[5] > 0}
    want = defaultdict(lambda: [0, 0])
    for i, p in pains.phrases_of(items, "id", normalised=False).collect():
        want[p, live[i][0]][0] += 1
        want[p, live[i][0]][1] += live[i][1]
    bad = defaultdict(int)
    for (p, _), (_, y) in want.items():
        bad[_fold(p)] += y
    want = {k: tuple(v) for k, v in want.items() if bad[_fold(k[0])] >= PAIN.customers}
    got = {(r.phrase, r.group_key): (r.df, r.y) for r in counts.collect()}
    assert want and {k: got.get(k) for k in want} == want
