import hashlib
import zlib

from voicegrain.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, index int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(hashes, fanout):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout):
    for level in tree[:-1]:
        start = i // fanout * fanout
        yield level[start:i], level[i + 1 : start + fanout]
        i //= fanout


def brute(rows, fanout=16):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaves = sorted(((r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, H(*map(part, r[:5])), r) for r in rows), key=lambda x: x[:5])
    trees = {}
    for x in leaves:
        trees.setdefault(x[:2], []).append(x)
    built = {k: levels([x[4] for x in v], fanout) for k, v in trees.items()}
    crown = levels([built[k][-1][0] for k in sorted(built)], fanout)
    out = []
    for n, k in enumerate(sorted(built)):
        for i, x in enumerate(trees[k]):
            path, r = [*siblings(built[k], i, fanout), *siblings(crown, n, fanout)], x[5]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = H(*map(part, (*r[:4], low(r[4])))) if changed else x[4]
            for left, right in path:
                folded = H(*left, folded, *right)
            root = crown[-1][0]
            out.append((r[0], x[4], built[k][-1][0], root, H(*[h for a, b in path for h in a + b]), folded, folded == root))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted([tuple(r) for r in merkle.manifest(docs, **options).collect()], key=str)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = run(docs)
    assert got == brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_sizes_about_the_fanout_in_many_partitions(spark):
    sizes = {"a": 1, "b": 4, "c": 5, "d": 16, "e": 17, "f": 64, "g": 65, "h": 300, None: 7, "é": 2, "Z": 3}
    rows = [(1000 * k + i, s, None, i, f"Text {i} of {s}", "x", 0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for parts in ("1", "24"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert run(docs, fanout=4) == brute(rows, 4)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(5, "a", "en", 3, "ABC"), (5, "a", "en", 3, "ABC"), (5, "a", None, None, None), (None, "a", "en", 1, "Z"), (None, None, None, None, None), (7, "", "", 0, ""), (8, None, "de", 9, "É" * 300_000), (-3, "a", "x", -1, "lower")]
    rows += [(9, "a", "en", 3, "SAME")] * 40
    docs = spark.createDataFrame([(*r, "1a", 3) for r in rows], SCHEMA)
    assert run(docs) == brute(rows)
    assert run(docs.limit(0)) == []
    assert run(docs.where("doc_id = 7")) == brute([r for r in rows if r[0] == 7])
