"""Repeated byte strings by prefix doubling over sampled positions (operator 4).

A string of ``length`` bytes repeats only if what it holds does, so ranks grow from
short strings to the whole length, and positions drop out as soon as their rank is
unique.  Sorting every position of the corpus would take many times its size, so the
positions are sampled by content: every string names the position in it where the
smallest hash of a ``length - span + 1`` byte string stands (the rightmost of
equals).  Equal strings name equal positions, and about one position in
``span / 2`` is named.

A row stands for a named position and a block of the starts that name it.  It is
ranked by a pair: its core, the bytes that all strings of the block have in common,
and its hull, the bytes that they cover together.  Spark groups the pairs:

* a core that is unique: no string of the block repeats; the row drops out
* a hull that occurs again: all strings of the block repeat; the row is settled
* otherwise the block is cut into smaller ones, whose cores are longer and hulls
  shorter, and these are ranked anew.  Of settled rows with such a core one goes on
  for all, since the strings of an open row may be among theirs.

Blocks of one start have a core and a hull of the whole length: what they say is
exact.  A rank is a 64-bit hash and core and hull are hashed differently, so a pair
has 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, keyed, release, written

LENGTH = 400
_PIECE = 1 << 20
_KEY = ("z", "i", "h", "g")
_ROWS = "core long, hull long, z int, i long, h long, g long, at long, first long, last long"


def spans(length: int) -> list[int]:
    """How many starts a block has at each step: a power of two below two thirds of the length, an eighth of it, one."""
    first = 1 << max((2 * length // 3).bit_length() - 1, 0)
    return sorted({first, max(first // 8, 1), 1}, reverse=True)


class _Hasher:
    """Hashes of all substrings of a byte array in constant time each, for one multiplier."""

    def __init__(self, multiplier: int, seed: int):
        self.b = multiplier | 1
        self.table = tv.mix(np.arange(256, dtype=np.uint64) + np.uint64(seed))
        self.size = 0

    def grow(self, n: int) -> None:
        if n > self.size:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.b, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(self.b, -1, 1 << 64), np.uint64)]))
            self.size = n

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tv.mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


_ONE, _TWO = _Hasher(0x9E3779B97F4A7C15, 1), _Hasher(0xD1342543DE82EF95, 1 << 32)
_POS = np.uint64((1 << 24) - 1)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _named(data: np.ndarray, length: int, span: int) -> np.ndarray:
    """For each start of a ``length``-byte string in ``data`` (under 2^24 bytes), the position it names."""
    core = length - span + 1
    sums = _ONE.sums(data)
    at = np.arange(len(data) - core + 1)
    least = (_ONE.of(sums, at, at + core) & ~_POS) | (_POS - at.astype(np.uint64))
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return (_POS - (least & _POS)).astype(np.int64)


def runs(data: np.ndarray, length: int, span: int, piece: int = _PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The named positions of a text, and for each the first and the last start that name it.

    A long text is taken in pieces; the next begins with the last run of the one
    before, so no run is cut.
    """
    out, lo, total = [], 0, len(data) - length + 1
    while lo < total:
        n = min(max(piece, 2 * span), total - lo)
        named = lo + _named(data[lo : lo + n + length - 1], length, span)
        edge = np.flatnonzero(np.diff(named)) + 1
        first, last = np.append(0, edge), np.append(edge, n) - 1
        whole = len(first) if lo + n == total else len(first) - 1
        out.append((named[first[:whole]], lo + first[:whole], lo + last[:whole]))
        lo = total if lo + n == total else lo + int(first[-1])
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def ranks(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, span: int, piece: int = _PIECE):
    """Cuts the starts ``first`` to ``last`` that name ``at`` into blocks at fixed distances from it, and ranks them.

    Returns core, hull, at, first, last of each block.  A hull ends where the text
    does; how far it reaches is a part of its rank.
    """
    low, high = (at - last) // span, (at - first) // span
    n = high - low + 1
    k = np.repeat(np.arange(len(at)), n)
    j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k]
    at, near, far = at[k], at[k] - j * span, at[k] - j * span - span + 1
    first, last = np.maximum(first[k], far), np.minimum(last[k], near)
    begin, end = np.maximum(far, 0), np.minimum(near + length, len(data))
    mark = tv.mix(j.astype(np.uint64) + np.uint64(11))
    core, hull = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for c in np.unique(begin // piece):
        mine = np.flatnonzero(begin // piece == c)
        off = int(c) * piece
        part = data[off : off + piece + length + 2 * span]
        one, two = _ONE.sums(part), _TWO.sums(part)
        core[mine] = _ONE.of(one, near[mine] - off, far[mine] + length - off)
        hull[mine] = _TWO.of(two, begin[mine] - off, end[mine] - off) + np.uint64(3) * (at[mine] - begin[mine]).astype(np.uint64)
    return tv.mix(core + mark), tv.mix(hull ^ mark), at, first, last


def _batch(b: pa.RecordBatch, row: list, parts: list) -> pa.RecordBatch:
    """Ranked blocks as rows; ``row`` tells for each of ``parts`` which row of ``b`` it is of."""
    rows = pa.array(np.repeat(np.array(row), [len(p[0]) for p in parts]))
    core, hull, at, first, last = (np.concatenate(x) for x in zip(*parts))
    columns = [pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), *[b.column(k).take(rows) for k in range(4)], *[pa.array(x.astype(np.int64)) for x in (at, first, last)]]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ROWS.split(", ")])


def _gathered(b: pa.RecordBatch, found, size: int = 50_000):
    """Batches of about ``size`` rows of what ``found`` yields: (row of ``b``, ranked blocks)."""
    row, parts, n = [], [], 0
    for k, part in found:
        row.append(k), parts.append(part)
        n += len(part[0])
        if n >= size:
            yield _batch(b, row, parts)
            row, parts, n = [], [], 0
    if parts:
        yield _batch(b, row, parts)


def _first_rows(base: DataFrame, length: int, span: int) -> DataFrame:
    """A ranked row for every named position of every text."""

    def run(batches):
        for b in batches:

            def found(texts=b.column(4)):
                for k, text in enumerate(texts):
                    data = _bytes(text.as_py())
                    if len(data) >= length:
                        yield k, ranks(data, *runs(data, length, span), length, span)

            yield from _gathered(b, found())

    return base.select(*_KEY, "text").where(F.octet_length("text") >= length).mapInArrow(run, _ROWS)


def _lists(column: pa.Array):
    """For each row of a list-of-structs column, the numpy arrays of the struct's fields."""
    flat, offsets = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    fields = [flat.field(k).to_numpy() for k in range(flat.type.num_fields)]
    return [[f[a:z] for f in fields] for a, z in zip(offsets[:-1], offsets[1:])]


def _next_rows(base: DataFrame, going: DataFrame, length: int, span: int) -> DataFrame:
    """The blocks of ``going`` cut to ``span`` starts and ranked anew."""
    by_text = going.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "first", "last")).alias("blocks"))

    def run(batches):
        for b in batches:

            def found(texts=b.column(4), lists=_lists(b.column(5))):
                for k, (text, (at, first, last)) in enumerate(zip(texts, lists)):
                    yield k, ranks(_bytes(text.as_py()), at, first, last, length, span)

            yield from _gathered(b, found())

    return base.select(*_KEY, "text").join(by_text, list(_KEY)).select(*_KEY, "text", "blocks").mapInArrow(run, _ROWS)


def _judged(rows: DataFrame) -> DataFrame:
    """The rows whose core is not unique, with ``repeats`` (the hull occurs again) and ``lone`` (a hull of this core does not).

    Ranks are counted with partial aggregation, and only the counts are joined back,
    so both sides of each join are plain exchanges and a very common rank can be split.
    """
    classes = written(rows.groupBy("core", "hull").agg(F.count("*").alias("n")), "classes")
    cores = classes.groupBy("core").agg(F.sum("n").alias("all"), F.max(F.col("n") == 1).alias("lone")).where("all > 1")
    known = classes.join(cores, "core").select("core", "hull", (F.col("n") > 1).alias("repeats"), "lone")
    out = written(rows.join(known, ["core", "hull"]), "judged")
    drop_written(classes)
    return out


def repeated_starts(base: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(z, i, h, g, first, last)``: ranges of starts of strings of ``base (z, i, h, g, text)`` that start elsewhere too."""
    place = [*_KEY, "at", "first", "last"]
    going, settled = None, []
    for span in spans(length):
        rows = written(_first_rows(base, length, span) if going is None else _next_rows(base, going, length, span), "ranks")
        release(base.sparkSession)
        judged = _judged(rows)
        drop_written(rows)
        release(base.sparkSession)
        settled.append(judged.where("repeats").select(*_KEY, "first", "last"))
        one = judged.where("repeats and lone").groupBy("core", "hull").agg(F.min(F.struct(*place)).alias("p")).select("p.*")
        going = judged.where("not repeats").select(*place).union(one)
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _spans(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings of the starts cover; runs that touch are one."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    begin, reach = first[order], np.maximum.accumulate(last[order] + length)
    new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return list(zip(begin[new].tolist(), reach[np.append(new[1:], len(begin)) - 1].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the bytes of every ``length``-byte string that also starts anywhere else.

    One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` (maximal
    removed runs) and ``kept`` (binary, the remaining bytes).  Null and empty texts
    have no bytes; matches never cross texts; strings are judged on the input;
    repeated rows are copies of each other, so all of their strings repeat; a null
    id keeps its row, and several texts of one id are told apart by 128 bits of
    hash; an empty table gives no rows; other columns are not read.  A long text is
    hashed in pieces; a task holds one text and its ranges.
    """
    base = keyed(docs, id_col, text_col)
    found = repeated_starts(base, length).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def cut(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, (first, last) in zip(b.column(1), _lists(b.column(2))):
                data = text.as_py().encode("utf-8", "surrogatepass")
                spans_ = _spans(first, last, length)
                kept, at = [], 0
                for a, z in spans_:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                kept = b"".join(kept)
                for col, value in zip(out, (len(data), len(data) - len(kept), len(spans_), kept)):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    texts = base.join(found, list(_KEY), "left").select(F.when(F.col("z") == 0, F.col("i")).alias("doc_id"), "text", F.coalesce("ranges", none).alias("ranges"))
    return texts.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
