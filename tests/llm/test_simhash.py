import random
import re

import numpy as np
import xxhash

from voicegrain.llm import simhash_dedup
from voicegrain.llm.common import connected_components


def brute(rows, max_bits=4):
    """Fingerprints and smallest reachable id, by definition."""
    fps = {}
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        fps[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicate_groups(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "é x " * 9), (6, " \t\n"), (7, "w " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, cell int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicate_groups(docs).collect()}
    assert got == brute(rows)
    assert got[1] == ("0" * 16, 1) and got[6][1] == 1
    twice = simhash_dedup.near_duplicate_groups(docs.union(docs))
    assert twice.count() == 14
    assert simhash_dedup.near_duplicate_groups(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "a b c"), (9, "a b c")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash_dedup.near_duplicate_groups(null_id).collect()) == [9, 9]


def test_blocks_and_chains_lose_no_link(spark):
    rng = random.Random(5)
    fps = {0}
    while len(fps) < 400:  # a dense cloud: each new one is a few bits from an old one
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), 4)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    roots = {}
    for block in (16, 1024):
        edges = [(r.a, r.b) for r in simhash_dedup.links(frame, block=block).collect()]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        assert len({find(f - (1 << 64) if f >= 1 << 63 else f) for f in fps}) == 1


def similar_pairs(texts, least):
    """All pairs of a five-word Jaccard similarity of at least ``least``, from an inverted list of shingles."""
    sets, holders, both = {}, {}, {}
    for i, text in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    found = [(a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in both.items()]
    return [x for x in found if x[2] >= least]


def groups(texts, least=0.8):
    """The smallest id of each text's group under verified pairs."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in similar_pairs(texts, least):
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def edited(rng, words, similarity):
    """``words`` with as many changed as keep the similarity, and with one change more, which does not."""
    now, before = list(words), list(words)
    while similar_pairs({0: " ".join(words), 1: " ".join(now)}, similarity):
        before = list(now)
        now[rng.randrange(len(now))] = f"new{rng.random()}"
    return " ".join(before), " ".join(now)


def test_similar_texts_keep_one_of_each_group(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows, copies, apart = [], [], []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 600))]
        above, below = edited(rng, words, 0.8)
        rows += [(3 * k, " ".join(words)), (3 * k + 1, above if k % 2 else below), (3 * k + 2, above.upper() if k % 6 == 1 else f"{k} one two")]
        (copies if k % 2 else apart).append(3 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash_dedup.one_of_each_similar(docs).collect()}
    want = groups(dict(rows))
    assert {i for i in want if want[i] == i} <= left  # nothing goes without a verified pair, however close below 0.8
    assert set(apart) <= left
    assert sum(c not in left for c in copies) >= 0.9 * len(copies)  # all of them just above 0.8


def test_a_group_of_near_copies_is_one_by_verified_paths(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**5)}" for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"e{rng.random()}" for w in words)) for i in range(300)]
    chain = list(words)
    for i in range(300, 340):  # each step is near the one before, the ends are far apart
        for _ in range(4):
            chain[rng.randrange(300)] = f"c{rng.random()}"
        rows.append((i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(dict(rows))
    for block in (16, 1024):
        simhash_dedup.SIMILAR_BLOCK, before = block, simhash_dedup.SIMILAR_BLOCK
        try:
            left = {r.doc_id for r in simhash_dedup.one_of_each_similar(docs).collect()}
        finally:
            simhash_dedup.SIMILAR_BLOCK = before
        assert left == {i for i in want if want[i] == i}


def test_false_edges_hide_no_true_pair(spark):
    rng = random.Random(13)
    rows = []
    for k in range(40):  # three texts close to each other, of which two are a pair
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        _, near = edited(rng, words, 0.79)
        above, _ = edited(rng, words, 0.8)
        rows += [(3 * k, near), (3 * k + 1, " ".join(words)), (3 * k + 2, above)]
    left = {r.doc_id for r in simhash_dedup.one_of_each_similar(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=80).collect()}
    want = groups(dict(rows))
    assert {i for i in want if want[i] == i} <= left and len(left) <= len(set(want.values())) + 4


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 5, 254, 255, 256, 0, 511, 2000, 0])
    hashes = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    got, at = simhash_dedup._wide(hashes, counts), 0
    for row, n in zip(got, counts):
        bits = (hashes[at : at + n, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert int(row[0]) == sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > n)
        at += n
    assert not got[0].any() and not got[-1].any()


def test_edges_of_a_cell_of_copies_grow_with_its_rows():
    rng = np.random.default_rng(5)
    fp = np.repeat(rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64), 500, axis=0)
    fp[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    pairs = simhash_dedup._near([], fp, np.full(500, 9), np.array([0]), 54, 0.8)
    take, label = simhash_dedup._connecting(*pairs, 500)
    assert len(pairs[0]) > 50_000 and len(take) < 520 and not label.any()


def test_exploded_rows_are_not_broadcast(spark):
    """Seventy rows of each fingerprint (or one a grid) are sized like the fingerprints; broadcast, they filled the driver."""
    rng = np.random.default_rng(3)
    fps = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 62), 1 << 62, 300)], "fp long")
    classes = fps.selectExpr("fp as id", "5L as n", *[f"xxhash64(fp, {k}) as w{k}" for k in range(simhash_dedup.WORDS)])
    for frame in (simhash_dedup.links(fps), simhash_dedup.similar_pairs(classes)):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
