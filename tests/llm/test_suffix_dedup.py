import random
from collections import Counter

import numpy as np

from voicegrain.llm import suffix_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def run(docs, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length).collect()), key=str)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 400)
    assert run(docs, 400) == want
    assert sum(x[2] for x in want) > 0


def test_small_random_texts(spark, monkeypatch):
    rng = random.Random(3)
    words = ["ab", "é", "aaaa", "xyz ", "q", "\n"]
    passage = "".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        t = "".join(rng.choice(words) for _ in range(rng.randrange(40)))
        a = rng.randrange(50)
        rows.append((i, t + passage[a : a + rng.randrange(60)] + t[: rng.randrange(30)]))
    rows += [(100, None), (101, ""), (102, "a" * 300), (5, "short"), (5, "another text under the id five" * 3), (None, passage), (103, passage), (103, passage)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    for length in (16, 21):
        assert run(docs, length) == brute(rows, length)
    assert run(docs.limit(0), 16) == []


def test_long_texts_are_taken_in_pieces():
    rng = random.Random(4)
    data = np.array([rng.randrange(97, 100) for _ in range(3_000)], np.uint8)
    data[700:1000] = 97
    for length in (16, 21, 40):
        span = suffix_dedup.spans(length)[0]
        whole = suffix_dedup.runs(data, length, span)
        cut = suffix_dedup.runs(data, length, span, piece=100)
        assert all((a == b).all() for a, b in zip(whole, cut))
        at, first, last = whole
        assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(data) - length  # every start names one position
        assert all((a == b).all() for a, b in zip(suffix_dedup.ranks(data, *whole, length, 1), suffix_dedup.ranks(data, *whole, length, 1, piece=64)))


def test_passages_of_every_length_about_the_limit(spark):
    rng = random.Random(9)
    letters = "abcdefgh"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = text(200)
    rows = [(i, text(rng.randrange(60)) + shared[a : a + 36 + i] + text(rng.randrange(60))) for i in range(30) for a in [rng.randrange(100)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 40)
    assert run(docs, 40) == want
    assert 0 < sum(x[2] > 0 for x in want) < len(rows)


def test_texts_of_null_ids_are_told_apart(spark):
    rows = [(None, "abcdefghijklmnopqrstuvwxyz"), (None, "0123456789abcdefghijklmnop"), (None, "zyxw" * 3), (None, "0123456789abcdefghijklmnop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, 16) == brute(rows, 16)
