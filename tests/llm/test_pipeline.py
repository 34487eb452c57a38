import corpus_pipeline
import test_decontamination
import test_line_dedup
import test_simhash
from voicegrain.llm.queries import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark, sf):
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in queries()["op9_toxicity"](spark, sf).where("predicted = 1").collect()}
    clean = steps["toxicity"](spark, docs, sf).cache()
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic

    lined = steps["line_dedup"](spark, clean, sf).cache()
    assert lined.columns == COLUMNS
    assert sorted(((r.doc_id, r.text) for r in lined.collect()), key=str) == test_line_dedup.brute([(r.doc_id, r.text) for r in clean.collect()])
    assert {(r.doc_id, r.source) for r in lined.collect()} == {(r.doc_id, r.source) for r in clean.collect()}
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = steps["simhash_near_dedup"](spark, lined, sf).cache()
    texts, left = {r.doc_id: r.text for r in lined.collect()}, {r.doc_id for r in single.collect()}
    want = test_simhash.groups(texts)
    assert single.columns == COLUMNS and len(left) == single.count()
    gone = {i for i in want if want[i] != i}
    assert set(texts) - left <= gone  # each has a path of pairs of 0.8 and more
    assert len(set(texts) - left) >= 0.9 * len(gone) > 0

    fair = steps["benchmark_decontamination"](spark, single, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {x[0] for x in test_decontamination.brute([(r.doc_id, r.text) for r in single.collect()], items) if x[4]}
    assert fair.columns == COLUMNS and {r.doc_id for r in fair.collect()} == {r.doc_id for r in single.collect()} - hit

    last = steps["sentencepiece"](spark, fair, sf)
    assert last.count() == fair.count() and last.where("not round_trip").count() == 0


def test_run_and_empty_input(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark, sf):
    text = "one two three four five six seven eight\nnine ten eleven twelve"
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (1, text, "de", "b", 9), (2, text, None, None, None), (None, text, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, None, None, None, None), (5, "other words entirely " * 30, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, line int, _k string")
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, sf)
    assert clean.columns == COLUMNS and clean.count() == 9
    lined = steps["line_dedup"](spark, docs, sf).collect()
    assert sorted(r.text == text for r in lined) == [False] * 6 + [True] * 3 and len(lined) == 9  # document 1 is first, in each of its rows
    single = steps["simhash_near_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in single)[:2] == [(1, text), (3, None)] and len(single) == 3
    assert {(r.lang, r.source) for r in single if r.doc_id == 1} <= {("en", "a"), ("de", "b")}
    fair = steps["benchmark_decontamination"](spark, docs, sf)
    assert fair.columns == COLUMNS and fair.count() == 9
    last = steps["sentencepiece"](spark, docs, sf).collect()
    assert len(last) == 9 and all(r.round_trip for r in last)


def test_tokenizing_takes_one_python_worker_a_task(spark, sf):
    plan = corpus_pipeline.tokenize(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
