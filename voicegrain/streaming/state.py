"""Live operators with keyed state: question queues, look-backs from a ring of minutes, and cooldowns.

State lives in the RocksDB store, a key's events in map states, so neither a task nor
the driver holds a key's history.  No watermark is set: late events are counted where
they belong, and events that a platform sends again are known by their id for good.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUEUE = "group_key string, n long, since_answer long, status string"
RING = "session_id long, as_of timestamp, intent string, last_3 long, last_5 long, last_10 long, last_15 long"
COOLED = "action_id string, comment_id long, suppressed boolean"
LOOK_BACKS = (3, 5, 10, 15)
#: So many events of a group wait in a task before they go to the store.
PACKED = 1 << 18


def _micros(at) -> int:
    return int(pd.Timestamp(at).value // 1000)


def _after(events: np.ndarray, last: tuple[int, int] | None) -> np.ndarray:
    """The rows ``(time, id)`` that come after ``last``."""
    return events if last is None else events[(events[:, 0] > last[0]) | ((events[:, 0] == last[0]) & (events[:, 1] > last[1]))]


class Queue(StatefulProcessor):
    """Asks and answers of one group, each event once: how often it was asked, how often since the last answer, and whether it is open.

    Rows are ``(group_key, at, comment_id, answer)`` with the time in microseconds.  Asks
    after the last answer are packed by the minute, so the store is called once a
    minute that has new ones, not once an event.
    """

    def __init__(self, again: int = 3):
        self.again = again

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tally = handle.getValueState("tally", "asks bigint, fresh bigint, last_ts bigint, last_id bigint")
        self.fresh = handle.getMapState("fresh", "minute bigint", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asks, fresh, *last = self.tally.get() if self.tally.exists() else (0, 0, None, None)
        last = before = None if last[0] is None else tuple(last)
        waiting, held = [], 0
        for frame in rows:
            events = np.column_stack([frame["at"].to_numpy(np.int64), frame["comment_id"].to_numpy(np.int64)])
            answer = frame["answer"].to_numpy(bool)
            if answer.any():
                said = events[answer]
                newest = tuple(int(x) for x in said[np.lexsort((said[:, 1], said[:, 0]))[-1]])
                last = newest if last is None else max(last, newest)
            asked = events[~answer]
            asks += len(asked)
            waiting.append(_after(asked, last))
            held += len(waiting[-1])
            if held >= PACKED:
                fresh += self._pack(waiting, last)
                waiting, held = [], 0
        fresh += self._pack(waiting, last)
        if last != before:
            fresh -= self._drop(last)
        self.tally.update((asks, fresh, *(last or (None, None))))
        enough = 1 if key[0].startswith("c") else self.again
        status = "open" if last is None or fresh >= enough else "answered"
        yield pd.DataFrame({"group_key": [key[0]], "n": [asks], "since_answer": [fresh], "status": [status]})

    def _pack(self, waiting: list[np.ndarray], last: tuple[int, int] | None) -> int:
        """Adds what came after ``last`` to its minutes; how many events these are."""
        events = _after(np.concatenate(waiting), last) if waiting else np.empty((0, 2), np.int64)
        events = events[np.argsort(events[:, 0], kind="stable")]
        minute = events[:, 0] // 60_000_000
        for part in np.split(events, np.flatnonzero(np.diff(minute)) + 1) if len(events) else []:
            at = (int(part[0, 0] // 60_000_000),)
            had = bytes(self.fresh.getValue(at)[0]) if self.fresh.containsKey(at) else b""
            self.fresh.updateValue(at, (had + part.tobytes(),))
        return len(events)

    def _drop(self, last: tuple[int, int]) -> int:
        """Removes the events up to ``last``; how many these are."""
        gone = 0
        for at in [tuple(k) for k in self.fresh.keys() if k[0] <= last[0] // 60_000_000]:
            events = np.frombuffer(bytes(self.fresh.getValue(at)[0]), np.int64).reshape(-1, 2)
            left = _after(events, last)
            gone += len(events) - len(left)
            if len(left) == 0:
                self.fresh.removeKey(at)
            elif len(left) < len(events):
                self.fresh.updateValue(at, (left.tobytes(),))
        return gone

    def close(self) -> None:
        pass


class Ring(StatefulProcessor):
    """Counts of a session by minute and intent, of which minutes older than ``hours`` go; every look-back is summed from them."""

    def __init__(self, hours: int = 3):
        self.minutes = 60 * hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "minute bigint, intent string", "n bigint")
        self.newest = handle.getValueState("newest", "minute bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        for frame in rows:
            minute = frame["ts"].map(_micros) // 60_000_000
            for (m, intent), n in frame.groupby([minute, "intent"]).size().items():
                had = self.ring.getValue((int(m), intent)) if self.ring.containsKey((int(m), intent)) else (0,)
                self.ring.updateValue((int(m), intent), (had[0] + int(n),))
            newest = int(minute.max()) if newest is None else max(newest, int(minute.max()))
        self.newest.update((newest,))
        sums: dict[str, list[int]] = {}
        for (m, intent), (n,) in [(tuple(k), tuple(v)) for k, v in self.ring.iterator()]:
            if newest - m >= self.minutes:
                self.ring.removeKey((m, intent))
                continue
            back = sums.setdefault(intent, [0] * len(LOOK_BACKS))
            for k, width in enumerate(LOOK_BACKS):
                back[k] += n if newest - m < width else 0
        at = pd.Timestamp((newest + 1) * 60_000_000, unit="us")
        out = [(int(key[0]), at, intent, *back) for intent, back in sorted(sums.items())]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RING.split(", ")])

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Proposed actions, marked if the same action was handled in the ``minutes`` before; ``keep``: minutes after which the store may forget."""

    def __init__(self, minutes: int = 10, keep: int | None = None):
        self.span, self.keep = minutes * 60_000_000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handled = handle.getValueState("handled", "at bigint", self.keep and self.keep * 60_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.handled.get()[0] if self.handled.exists() else None
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "handled"], ascending=[True, False])
        for ts, id_, handled in zip(events["ts"], events["comment_id"], events["handled"]):
            at = _micros(ts)
            if handled:
                last = at if last is None else max(last, at)
            else:
                out.append((key[0], int(id_), last is not None and last <= at < last + self.span))
        if last is not None:
            self.handled.update((last,))
        yield pd.DataFrame(out, columns=["action_id", "comment_id", "suppressed"])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Update", time)


def queues(events: DataFrame, again: int = 3) -> DataFrame:
    """A stream of ``(group_key, ts, comment_id, answer)`` as changing rows ``(group_key, n, since_answer, status)``.

    Repeated events go first, by Spark's own state, which spreads over their ids; what a
    group then keeps is its tally and the asks since its last answer.
    """
    long = lambda c: F.coalesce(c, F.lit(-(2**63)))  # noqa: E731 - an unknown time comes before all others
    timed = events.select("group_key", long(F.unix_micros("ts")).alias("at"), "comment_id", F.coalesce("answer", F.lit(False)).alias("answer"))
    return _stateful(timed.dropDuplicates(["group_key", "comment_id", "answer"]), "group_key", Queue(again), QUEUE)


def look_backs(comments: DataFrame, hours: int = 3) -> DataFrame:
    """A stream of ``(session_id, ts, intent)`` as counts of the last 3, 5, 10 and 15 minutes up to the session's newest minute."""
    return _stateful(comments, "session_id", Ring(hours), RING)


def cooldowns(events: DataFrame, minutes: int = 10, keep: int | None = None) -> DataFrame:
    """A stream of ``(action_id, ts, comment_id, handled)`` as the proposed actions, with whether they are suppressed.

    With ``keep`` the state of an action expires that many minutes after it was last
    written.  Expiry goes by the clock, so it is for streams that run on: one that
    only processes what is there would not end.
    """
    return _stateful(events, "action_id", Cooldown(minutes, keep), COOLED, "None" if keep is None else "ProcessingTime")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop.  Each batch is a folder that a repeated batch writes again, so nothing is doubled.

    A later call with the same folders goes on where this one ended.
    """
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    try:
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)


def newest(spark: SparkSession, out: str, key: str, schema: str) -> DataFrame:
    """The last state of each key of a table of batches; keys change in whole batches."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(out)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")


def ended(spark: SparkSession, events: DataFrame, build: Callable[[DataFrame], DataFrame]) -> str:
    """The folder of batches of ``build`` over the stream ``events``, once all of it is processed."""
    out = shared_path(spark, "stream")
    run_to_end(build(events), out, shared_path(spark, "offsets"))
    return out
