import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voicegrain.functions import model_output, phrases


def test_phrases_respect_segments_stop_words_and_numbers(spark):
    rows = [(1, "Mất kết nối, màn hình sọc 12"), (2, "mat ket noi"), (3, None), (4, ""), (5, "và không nghe")]
    docs = spark.createDataFrame(rows, "id int, text string")
    got = {}
    for r in phrases.phrase_rows(docs, "id", "text").collect():
        got.setdefault(r.id, set()).add(r.phrase)
    assert got[1] == {"mất kết", "mất kết nối", "kết nối", "màn hình", "màn hình sọc", "hình sọc"}
    assert got[5] == {"không nghe"} and 3 not in got and 4 not in got
    spelled = {r.phrase: r.spelled for r in phrases.spellings(phrases.phrase_rows(docs, "id", "text")).collect()}
    assert spelled["ket noi"] == "kết nối" and spelled["mat ket noi"] == "mất kết nối"
    both = phrases.spelled_rows(phrases.phrase_rows(docs, "id", "text"), "id").where("phrase = 'kết nối'")
    assert sorted(r.id for r in both.collect()) == [1, 2]


def test_answers_of_models(spark):
    raw = ["{\"category\": \"Refund\", \"subCategory\": \"SlowRefund\", \"sentiment\": \"Negative\"}", "no json", None, "{\"category\": \"Other\"}", "{\"category\": \"Moon\", \"sentiment\": \"Negative\"}"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [tuple(r.l) for r in rows.orderBy("i").select(model_output.coerced(F.col("raw"), F.lit("Payment"), F.lit("Positive")).alias("l")).collect()]
    assert got == [
        ("ReturnRefund", "SlowRefund", "Negative", None, "llm"),
        ("Payment", None, "Positive", None, "rules"),
        ("Payment", None, "Positive", None, "rules"),
        ("Other", None, "Neutral", None, "llm"),
        ("Payment", None, "Negative", None, "rules"),
    ]
    question = spark.createDataFrame([("why late",), ("hello",)], "q string")
    routed = [tuple(r.r) for r in question.select(model_output.routed(F.col("q"), {"cause": ["why", "late"], "trend": ["late"]}).alias("r")).collect()]
    assert routed == [("cause", 2.35), ("overview", 0.0)]


def test_unique_keys_need_no_shuffle_and_repeated_ones_give_a_phrase_once(spark):
    rows = spark.createDataFrame([(1, "màn hình tối|đen. hình tối; | tối đen"), (2, None), (3, "")], "id int, text string")
    found = phrases.phrase_rows(rows, "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.phrase for r in found.collect()) == ["hình tối", "màn hình", "màn hình tối", "tối đen"]
    assert phrases.phrase_rows(rows.union(rows), "id", "text").count() == 4


def test_a_row_with_both_spellings_gives_the_phrase_once(spark):
    grams = spark.createDataFrame([(1, "man hinh"), (1, "màn hình"), (2, "man hinh"), (3, "pin yếu"), (4, "loa hay")], "id int, phrase string")
    assert sorted(map(tuple, phrases.spelled_rows(grams, "id").collect())) == [(1, "màn hình"), (2, "màn hình"), (3, "pin yếu"), (4, "loa hay")]


def test_only_classes_that_may_matter_become_texts(spark):
    """Every phrase of every row went through three shuffles as a text, with its key."""
    rows = [(i, i % 2 == 0, f"loa{i} rung{i} kêu{i}. " + ("man hinh đen" if i % 3 else "màn hình đen; man hinh") ) for i in range(60)]
    rows += [(60, True, None), (61, True, ""), (62, False, "vỏ trầy"), (63, True, "vỏ trầy|vo tray")]
    docs = spark.createDataFrame(rows, "id int, bad boolean, text string")
    got = {r.id: {(p.phrase, p.both) for p in r.phrases} for r in phrases.said(docs, "text", F.col("bad"), 3).collect()}
    assert got[1] == {("man hinh", False), ("man hinh đen", False), ("hinh đen", False)}
    assert got[3] == {("màn hình", True), ("màn hình đen", False), ("hình đen", False), ("man hinh", False)}
    assert got[60] == got[61] == got[62] == got[63] == set()
    both = {r.id: {(p.phrase, p.both) for p in r.phrases} for r in phrases.said(docs, "text").collect()}
    assert both[62] == {("vỏ trầy", False)} and both[63] == {("vỏ trầy", True), ("vo tray", False)} and both[60] == set()
    assert all(len(p) <= 4 for p in both.values())


def test_full_blocks_go_on_and_meet_again(monkeypatch):
    rows = [" ".join(f"tu{(i * 7 + k) % 40}" for k in range(30)) for i in range(50)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(rows[:20])], ["text"]), pa.RecordBatch.from_arrays([pa.array(rows[20:])], ["text"])])
    want = {}
    for r in rows:
        for h in {int(h) for run in phrases._Text().runs([r.split(" ")]) for h in run[3]}:
            want[h] = min(want.get(h, 0) + 1, 255)
    monkeypatch.setattr(phrases, "_HELD", 60)
    monkeypatch.setattr(phrases, "_AT_ONCE", 100)
    parts = pa.Table.from_batches(list(phrases._hashed(False)(batches())))
    blocks = parts.column("block").to_pylist()
    assert len(blocks) > len(set(blocks))
    for least in (1, 5, 30):
        found = set()
        for b in set(blocks):
            one = phrases._passed(least, False)(parts.filter(pa.array([x == b for x in blocks])))
            found |= set(np.frombuffer(one.column("hashes")[0].as_py(), np.uint64).tolist())
        assert found == {h for h, n in want.items() if n >= least}


def test_repeated_keys_say_all_their_texts_and_count_once(spark):
    rows = spark.createDataFrame([(1, "màn hình"), (1, "pin yếu"), (2, "loa rè")], "id int, text string")
    got = sorted((r.id, r.first, {w for w in ("màn hình", "pin yếu", "loa rè") if w in r.text} == ({"loa rè"} if r.id == 2 else {"màn hình", "pin yếu"})) for r in phrases.each_key_once(rows, "id", "text").collect())
    assert got == [(1, False, True), (1, True, True), (2, True, True)]
