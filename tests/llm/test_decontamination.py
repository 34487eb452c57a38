import re

from voicegrain.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for item_id, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item_id))
    sizes = {len(x) for x in wins}
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in wins:
                    hit |= set(range(i, i + k))
                    ids |= wins[x]
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def run(docs, items, **more):
    got = decontamination.contamination(docs, items, **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str)


def test_matches_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert run(docs, items) == want
    assert any(x[4] for x in want)


def test_odd_inputs(spark, monkeypatch):
    passage = "a b c d e f g h i j k l"
    docs = [(1, None), (2, ""), (3, f"x {passage} y {passage}"), (3, f"x {passage} y {passage}"), (4, "Only, FIVE words HERE now"),
            (None, passage), (5, "z " * 30_000 + passage), (6, "É é a b"), (7, "c d e f g h i j k l")]
    items = [(10, passage), (9, passage), (8, "five words"), (7, None), (6, "--"), (5, "é é A"), (4, "z " * 12)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [x if x[1] else (*x[:2], 0, [], False) for x in brute(docs, items)]
    assert run(d, b) == want
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert run(d, b) == want
    assert run(d.limit(0), b) == []
    assert all(not x[4] for x in run(d, b.limit(0)))
