import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voicegrain.streaming import live, state

START = datetime(2024, 5, 1, 12)


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")


def feed(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_queues_survive_a_restart_and_equal_the_batch(spark, folders):
    source, out, offsets = folders
    rng = random.Random(1)
    schema = "group_key string, ts timestamp, comment_id long, answer boolean"
    rows = [(rng.choice(["q|1", "q|2", "c|3", "c|4", "q|5"]), START + timedelta(seconds=rng.randrange(3000)), k, rng.random() < 0.25) for k in range(240)]
    rows += [("q|only", START, 900, False), ("c|done", START, 901, False), ("c|done", START + timedelta(seconds=5), 902, True)]
    rng.shuffle(rows)  # late events in every file
    feed(spark, rows[:90], schema, source)
    state.run_to_end(state.queues(stream(spark, schema, source)), out, offsets)
    feed(spark, rows[60:200], schema, source)  # a part is sent twice
    feed(spark, rows[200:] + rows[:10], schema, source)
    state.run_to_end(state.queues(stream(spark, schema, source)), out, offsets)  # a new query on the old checkpoint
    got = {tuple(r) for r in state.newest(spark, out, "group_key", state.QUEUE).collect()}
    frame = spark.createDataFrame(rows, schema)
    want = live.queue_status(frame.where("not answer").drop("answer"), frame.where("answer").drop("answer"))
    assert got == {tuple(r) for r in want.collect()} and {r[3] for r in got} == {"open", "answered"}


def test_look_backs_come_from_a_bounded_ring(spark, folders):
    source, out, offsets = folders
    rng = random.Random(2)
    schema = "session_id long, ts timestamp, intent string"
    rows = [(rng.randrange(3), START + timedelta(seconds=rng.randrange(5 * 3600)), rng.choice(["question", "order", "complaint"])) for _ in range(900)]
    for part in (rows[:400], rows[400:]):
        feed(spark, part, schema, source)
        state.run_to_end(state.look_backs(stream(spark, schema, source)), out, offsets)
    got = {(r.session_id, r.intent): (r.as_of, r.last_3, r.last_5, r.last_10, r.last_15) for r in state.newest(spark, out, "session_id", state.RING).collect()}
    want = {}
    for s in range(3):
        end = max(t for i, t, _ in rows if i == s).replace(second=0) + timedelta(minutes=1)
        for intent in ("question", "order", "complaint"):
            times = [t for i, t, w in rows if i == s and w == intent]
            want[s, intent] = (end, *[sum(t >= end - timedelta(minutes=m) for t in times) for m in state.LOOK_BACKS])
    assert got == want


def test_cooldowns_equal_the_batch(spark, folders):
    source, out, offsets = folders
    rng = random.Random(3)
    schema = "action_id string, ts timestamp, comment_id long, handled boolean"
    rows = sorted(((rng.choice("abc"), START + timedelta(seconds=30 * k), k, rng.random() < 0.15) for k in range(200)), key=lambda r: r[1])
    for part in (rows[:70], rows[70:130], rows[130:]):
        feed(spark, part, schema, source)
        state.run_to_end(state.cooldowns(stream(spark, schema, source)), out, offsets)
    got = {tuple(r) for r in spark.read.schema(state.COOLED).parquet(out + "/*").collect()}
    frame = spark.createDataFrame(rows, schema)
    want = live.cooled(frame.where("not handled").select("action_id", "comment_id", "ts"), frame.where("handled").select("action_id", F.col("ts").alias("at")))
    assert got == {(r.action_id, r.comment_id, r.suppressed) for r in want.collect()} and {r[2] for r in got} == {True, False}


def test_a_queue_calls_its_store_once_a_minute_not_once_an_event():
    class Store(dict):
        calls = 0

        def getValue(self, k=None):
            return self[k]

        def updateValue(self, k, v):
            Store.calls += 1
            self[k] = v

        def removeKey(self, k):
            del self[k]

        containsKey, exists, get, update = dict.__contains__, lambda self: () in self, lambda self: self[()], lambda self, v: self.__setitem__((), v)

    class Handle:
        getValueState = getMapState = lambda self, *_: Store()

    rng = random.Random(4)
    events = [(rng.randrange(10) * 60_000_000 + rng.randrange(5), k, rng.random() < 0.0005) for k in range(20_000)]
    queue, seen = state.Queue(), []
    queue.init(Handle())
    for lo in range(0, len(events), 5000):  # four batches of five frames each
        seen += events[lo : lo + 5000]
        frames = (pd.DataFrame(events[k : k + 1000], columns=["at", "comment_id", "answer"]) for k in range(lo, lo + 5000, 1000))
        [out] = queue.handleInputRows(("q|1",), frames, None)
        last = max((e[:2] for e in seen if e[2]), default=None)
        fresh = sum(not e[2] and (last is None or e[:2] > last) for e in seen)
        assert tuple(out.iloc[0])[:3] == ("q|1", sum(not e[2] for e in seen), fresh)
    assert last is not None and Store.calls <= 4 * 10 * 2
