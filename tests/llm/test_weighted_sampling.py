import hashlib
import re
from collections import Counter

from voicegrain.llm import weighted_sampling as cws


def ring(rows):
    """Each text with its edited text and the next one, in descending id."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        out[i] = (text, text[: len(text) - cut] + follows[:cut], follows)
    return out


def jaccard(a, b):
    x, y = (Counter(w for w in re.split(r"[\x09-\x0D\x20]+", t) if w) for t in (a, b))
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def test_edits_and_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = ring([(r.doc_id, r.text or "") for r in docs.collect()])
    got = cws.edited_fingerprints(docs).collect()
    assert len(got) == len(want)
    off = []
    for r in got:
        text, edited, follows = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for seen, true in ((r.near_edited, jaccard(text, edited)), (r.near_next, jaccard(text, follows))):
            assert 0 <= seen <= 1 and abs(seen - true) <= 5.5 * max(cws.standard_error(true), 0.03)
            off.append(seen - true)
    assert abs(sum(off) / len(off)) < 0.02  # no bias
    by_text = {}
    for r in got:
        by_text.setdefault(want[r.doc_id][0], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b a"), (5, "a  b\ta"), (6, "𐍈é " * 9), (7, "w" * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, n int")
    got = {r.doc_id: r for r in cws.edited_fingerprints(docs).collect()}
    want = ring([(i, t or "") for i, t in rows])
    assert {i: r.edited_sha256 for i, r in got.items()} == {i: hashlib.sha256(e.encode()).hexdigest() for i, (_, e, _) in want.items()}
    assert got[4].fingerprint == got[5].fingerprint and got[6].n_chars == 27
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0
    lone = cws.edited_fingerprints(docs.where("doc_id = 4")).collect()
    assert [r.near_next for r in lone] == [1.0]
    twice = cws.edited_fingerprints(docs.union(docs).union(spark.createDataFrame([(None, "z", "x", 1)], docs.schema)))
    assert twice.count() == 15 and twice.where("doc_id is null").count() == 1
    assert cws.edited_fingerprints(docs.limit(0)).count() == 0
