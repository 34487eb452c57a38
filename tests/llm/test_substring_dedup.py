import random
import re

import numpy as np

from voicegrain.llm import substring_dedup


def brute(rows, window=20):
    texts = sorted(((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0))
    seen, out = set(), []
    for i, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if (key := tuple(words[s : s + window])) in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def run(docs, window=20, **options):
    return sorted([tuple(r) for r in substring_dedup.remove_windows(docs, window, **options).collect()], key=str)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs) == want and sum(r[2] for r in want) > 0


def test_small_files_read_together(spark, sf):
    """A task that reads several files gets rows of all of them in one batch."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    changed = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert run(docs) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_buckets_and_segments(spark, monkeypatch):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(80)]
    rows = []
    for i in range(400):
        a = rng.randrange(70)
        words = [rng.choice("abcdefg") for _ in range(rng.randrange(12))] + passage[a : a + rng.randrange(30)] + [f"u{i}"] * rng.randrange(8)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (1, 3, 8):
        assert run(docs, window, bucket_bytes=500) == brute(rows, window)
        assert run(docs, window) == brute(rows, window)


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 30), (4, "a b " * 30), (None, "x y z " * 9), (None, "x y z " * 9), (5, "é" * 3 + " Q w\x0be r t y"), (7, "w v " * 25), (-(1 << 63), "w v " * 12), (8, "\n"), (9, "q w e r t y")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, at int, bucket string")
    for window in (3, 20):
        assert run(docs, window) == brute(rows, window)
    assert run(docs.limit(0)) == []


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, "start " + long[:3000]), (2, long), (3, "x" * 3_000_000 + " " + long[-4000:])]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_texts_of_one_id_are_ordered_by_hash(spark):
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(4, f"left {shared}"), (4, f"right {shared}"), (4, f"left {shared}")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r[2] for r in got) in ([0, 30, 31], [0, 30, 31][::-1])


def test_a_word_hash_does_not_depend_on_its_place():
    from voicegrain.llm import textvec as tv

    data = np.frombuffer(b"one two " * 300_000 + b"one", np.uint8)
    starts, ends = tv.spans(data, np.array([0, len(data)]))
    assert len(set(substring_dedup._words(data, starts, ends).tolist())) == 2
