import math
import re
from collections import Counter

import pytest

from voicegrain.llm import lm_scoring
from voicegrain.llm.queries import queries


def brute(rows, vocabulary=lm_scoring.VOCABULARY, backoff=0.4, least=2, out_of_own=False):
    texts = [(i, re.findall(r"[^\x09-\x0D\x20]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows]
    count = Counter(w for _, ws in texts for w in ws)
    top = set(sorted(count, key=lambda w: -count[w])[:vocabulary]) if vocabulary < len(count) else set(count)
    name = lambda w: w if w in top else "<unk>"
    pair, follow, one = Counter(), Counter(), Counter()
    for _, ws in texts:
        for v, w in zip(["<s>", *map(name, ws)], map(name, ws)):
            pair[v, w] += 1
            follow[v] += 1
            one[w] += 1
    n = sum(one.values())
    out = []
    for i, ws in texts:
        steps = list(zip(["<s>", *map(name, ws)], map(name, ws)))
        own_pair, own_follow, own_one = Counter(steps), Counter(v for v, _ in steps), Counter(w for _, w in steps)
        if not out_of_own:
            own_pair = own_follow = own_one = Counter()
        rest = max(n - sum(own_one.values()), 1)
        s = backed = 0
        for v, w in steps:
            if pair[v, w] - own_pair[v, w] >= least:
                s += math.log((pair[v, w] - own_pair[v, w]) / (follow[v] - own_follow[v]))
            else:
                s += math.log(backoff * max(one[w] - own_one[w], backoff) / rest)
                backed += 1
        out.append((i, len(ws), backed, s))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_backed_off, r.log_score) for r in lm_scoring.scores(docs, **options).collect()), key=str)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-9, abs=1e-9)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same(run(docs), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b A B a"), (5, "a b a b c"), (5, "a b a b c"), (None, "z"), (7, "é É"), (8, "w " * 40_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, pair int")
    same(run(docs), brute(rows))
    same(run(docs, vocabulary=2), brute(rows, vocabulary=2))
    assert run(docs.limit(0)) == []
    assert [r.mean_log_score for r in lm_scoring.scores(docs.where("doc_id < 4")).collect()] == [None] * 3


def test_rare_words_are_not_pooled(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i * 1000, i * 1000 + 1000))) for i in range(270)]  # more words than 2 ** 18
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(run(docs), brute(rows, vocabulary=math.inf))


ODD = [(1, None), (2, "a b A B a"), (3, "a b c"), (3, "a b c"), (None, "z c"), (5, "once only"), (6, " "), (7, "w " * 5000), (8, "b a b")]


def test_every_observed_pair(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    same(run(docs, min_count=1), brute(ODD, least=1))


def test_own_counts_left_out(spark, sf):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for least in (1, 2):
        same(run(docs, min_count=least, leave_own_out=True), brute(ODD, least=least, out_of_own=True))
    same(run(docs, vocabulary=3, leave_own_out=True), brute(ODD, vocabulary=3, out_of_own=True))
    alone = [(1, "a b a b")]  # no other row has a word
    same(run(spark.createDataFrame(alone, "doc_id long, text string"), leave_own_out=True), brute(alone, out_of_own=True))
    assert run(docs.limit(0), leave_own_out=True) == []


def test_query_backs_off(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_backed_off, r.log_score) for r in queries()["op1_lm_scoring"](spark, sf).collect()), key=str)
    same(got, brute(rows, least=1, out_of_own=True))
    assert sum(r[2] for r in got) > 0 and any(r[2] < r[1] for r in got)


def test_pairs_are_counted_packed_and_rare_ones_are_no_rows(spark):
    rows = [(i, f"a b c{i} d{i}") for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = lm_scoring.pair_counts(docs, least=2)
    assert sorted(r.n for r in counts.collect()) == [300, 300]  # the start mark and a, a and b
    assert lm_scoring.pair_counts(docs).count() == 2 + 2 * 300
    assert lm_scoring.pair_counts(docs.limit(0)).count() == 0
    assert "HashAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
