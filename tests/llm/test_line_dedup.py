import random
import re

import pyarrow as pa

from voicegrain.llm import line_dedup


def brute(rows, t=0.8):
    texts = {}
    for i, text in rows:
        texts.setdefault((i is None, i, text or ""), 0)
    lines = [(key, n, frozenset(re.findall(r"[^\x09-\x0D\x20]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))), line) for key in sorted(texts, key=lambda k: (k[0], k[1] or 0)) for n, line in enumerate(key[2].split("\n"))]
    kept, seen = {}, []
    for key, n, words, line in lines:
        match = bool(words) and any(len(words & w) >= t * len(words | w) - 1e-9 for w in seen)
        if words:
            seen.append(words)
        if not match:
            kept.setdefault(key, []).append(line)
    return sorted(((i, "\n".join(kept.get((i is None, i, t or ""), []))) for i, t in rows), key=str)


def run(docs, **more):
    return sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, **more).collect()), key=str)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_and_odd_inputs(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["the", "of", "É"]
    base = [rng.sample(words, rng.randrange(1, 14)) for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\t\n a"), (None, "only here \n the end"), (204, "x " * 20_000 + "\nlast"), (205, "A b\na B\n"), (205, "A b\na B\n")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, line int")
    want = brute(rows)
    assert run(docs) == want
    assert run(docs, cells=2) == want  # a useless rarity table changes nothing but the work
    assert run(docs.limit(0)) == []


def test_lines_about_the_threshold_of_one_another(spark):
    rng = random.Random(7)
    core = [f"c{k}" for k in range(30)]
    rows = [(i, " ".join(rng.sample(core, 26) + [f"u{rng.randrange(12)}" for _ in range(rng.randrange(6))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)


def test_texts_of_null_ids_and_of_one_id_are_told_apart(spark):
    rows = [(None, "shared line here\none two three"), (None, "shared line here\nfour five six"), (7, "same again now\nx y z"), (7, "same again now\nq r s"), (7, "same again now\nq r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 1]
    of_seven = sorted((r.text, r.n_removed) for r in got if r.doc_id == 7)
    assert len(of_seven) == 3 and of_seven.count(("q r s", 1)) in (0, 2) and sum(n for _, n in of_seven) in (1, 2)


def test_words_of_many_lines_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, f"always {rng.randrange(30)} w{rng.randrange(4)} w{rng.randrange(4)} end") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "BLOCK", 10)  # in this process: the steps of the tasks are run here
    base = line_dedup.keyed(docs)
    count = type("Held", (), {"value": line_dedup.rarity(line_dedup._survey(base, 1 << 12).where("chunk is not null").select("chunk", "counts"), 1 << 12)})
    arrow = base.select("z", "i", "h", "text").toArrow().combine_chunks().to_batches()
    packs = []
    class Frame:
        def select(self, *_): return self
        def mapInArrow(self, run, _): packs.extend(run(iter(arrow)))
    line_dedup._packs(Frame(), count, 1 << 12, 0.8, 4)
    rows_out = sum(sum(b.column(1).to_pylist()) for b in packs)
    assert rows_out > 2 * 150  # words above the block size travel several times


def test_a_task_sends_its_lines_packed(spark):
    rows = [(i, "\n".join(["said by all of them"] * 3 + [f"line a{k} of b{i}" for k in range(20)])) for i in range(200)]
    base = line_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    survey = line_dedup._survey(base, 1 << 12).where("chunk is null").toArrow()
    assert survey.num_rows <= 200 + 16  # a row a text with repeats and one a bucket of classes, not one a line
    gone = {i: sorted(set(lines)) for i, lines in zip(survey.column("i").to_pylist(), survey.column("gone").to_pylist()) if lines}
    assert gone == {i: [0, 1, 2] if i else [1, 2] for i in range(200)}


def test_texts_come_in_small_batches(spark):
    docs = spark.createDataFrame([(i, str(i % 10) * 100_000) for i in range(120)], "doc_id long, text string").coalesce(1)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    sizes = [r.n for r in line_dedup.keyed(docs).select("text").mapInArrow(run, "n long").collect()]
    assert max(sizes) < 6 << 20 and sum(sizes) >= 12_000_000
