"""Near-duplicate lines by an exact set-similarity join (operator 6).

A line is the set of its words.  Words are put in one global order, rarest first,
by a table of hashed counts over all lines.  Two sets of a Jaccard similarity of at
least ``threshold`` share a word among the first ``s - ceil(threshold * s) + 1`` of
each, so each line is dealt to the cells of those prefix words.  Where lines meet,
the length bound, the positional bound and a bitmap bound on what they cannot share
decide whether they may be alike.

Lines that may be alike meet once more with their whole word sets, in the cells in
which they met before; there the similarity is verified, and what leaves a cell is
one row for a later line with a match, never a pair.  They first meet in the few
rarest of their cells; lines that found no match there are tried in all of them.

Lines of equal sets are one class.  A task sends a class once, and a cell keeps its
first line, so a line that fills a third of the corpus costs a row a task; what a task
itself finds to be a repeat goes no further than to its document.  A word whose lines
overfill a cell is dealt as pairs of blocks.  Rows of the first meeting, and of that of
the classes, travel packed, one binary for each task and bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, keyed, release, written

THRESHOLD = 0.8
#: Cells of the table of hashed counts; the broadcast table has 4 bytes a cell whatever the input.
CELLS = 1 << 21
#: Lines of a word that meet in one block; the words of overfull cells are dealt as pairs of blocks.
BLOCK = 4096
#: In so many of its cells, the rarest first, a line's whole set is tried before all of them are.
FIRST_CELLS = 2
#: Buckets of cells and of classes for each shuffle partition, and how many packed rows a task holds before it sends them.
_BUCKETS, _CLASS_BUCKETS = 8, 4
_HELD, _CLASSES_HELD = 1 << 18, 1 << 17
_CHUNK = 1 << 12
_ORDER = ("z", "i", "u", "line")


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Begin of each line of the texts, its row and its number within the row (a text has line feeds plus one lines)."""
    feed = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets[1:], feed, side="right")
    size = 1 + np.bincount(row, minlength=len(offsets) - 1)
    head = np.cumsum(size) - size  # the first line of each row; that after a feed stands behind as many heads as there are rows up to it
    begin = np.empty(len(feed) + len(size), np.int64)
    begin[head] = offsets[:-1]
    begin[np.arange(len(feed)) + row + 1] = feed + 1
    owner = np.repeat(np.arange(len(size)), size)
    return begin, owner, np.arange(len(owner)) - head[owner]


class _Sets:
    """The word sets of the lines of some texts that have words, each set in the order of ``often`` (hashed counts), then of hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, often: np.ndarray | None = None):
        begin, owner, number = _lines(data, offsets)
        lowered = tv.LOWER[data]
        starts, ends = tv.spans(lowered, offsets)
        self.every = word = tv.hashes(lowered, starts, ends)
        line = np.repeat(np.arange(len(begin)), np.diff(np.append(np.searchsorted(starts, begin), len(starts))))
        order = _by_line(line, word, None if often is None else often[(word & np.uint64(len(often) - 1)).astype(np.int64)])
        line, word = line[order], word[order]
        new = np.append(True, (line[1:] != line[:-1]) | (word[1:] != word[:-1]))[: len(line)]
        line, self.word = line[new], word[new]
        self.at = np.flatnonzero(np.append(True, line[1:] != line[:-1]))[: len(line)]
        self.size = np.diff(np.append(self.at, len(line)))
        used = line[self.at]
        self.row, self.number = owner[used], number[used].astype(np.int32)

    def sums(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each set."""
        return np.add.reduceat(tv.mix(self.word ^ np.uint64(seed)), self.at) if len(self.at) else np.zeros(0, np.uint64)


def _by_line(line: np.ndarray, word: np.ndarray, often: np.ndarray | None) -> np.ndarray:
    """The order by line (they ascend already), then ``often`` if given, then word."""
    if often is None:
        key = word
    else:  # one number for both, which two words of a line practically never share
        key = np.minimum(often, (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | word >> np.uint64(24)
    order = np.argsort(key)
    number = line - line[0] if len(line) else line
    small = len(line) and number[-1] < 1 << 16
    order = order[np.argsort(number[order].astype(np.uint16) if small else number[order], kind="stable")]
    if often is not None:
        tied = (line[order][1:] == line[order][:-1]) & (key[order][1:] == key[order][:-1]) & (word[order][1:] != word[order][:-1])
        if tied.any():
            order = np.lexsort((word, key, line))
    return order


_SIG, _SIG2 = 0x5DEECE66D, 0x2545F4914F6CDD1D


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of the ranges that begin at ``begin`` and have ``size`` elements, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


_SURVEY = "z int, i long, h long, g long, gone array<int>, bucket int, n int, data binary, chunk int, counts binary"
#: What a packed first line of a class has, and a packed line with a near match.
_CLASS = {"z": "u1", "i": "<i8", "h": "<i8", "g": "<i8", "line": "<i4", "sig": "<u8", "sig2": "<u8", "size": "<u4"}
_NEAR = {"z": "u1", "i": "<i8", "u": "<i4", "line": "<i4", "sig": "<u8"}
_CLASS_PACK = "bucket int, n int, near boolean, data binary"


def _survey(base: DataFrame, cells: int, buckets: int = 16) -> DataFrame:
    """Three kinds of rows: texts with the lines in ``gone`` that a task has found to repeat an earlier one; the first
    lines of the classes that a task has met, packed by buckets of classes; hashed word counts in ``chunk``s."""

    def batch(rows: int, **columns) -> pa.RecordBatch:
        kinds = {"z": pa.int32(), "gone": pa.list_(pa.int32()), "bucket": pa.int32(), "n": pa.int32(), "data": pa.binary(), "chunk": pa.int32(), "counts": pa.binary()}
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(rows, kinds.get(k, pa.int64()))) for k in _names(_SURVEY)], _names(_SURVEY))

    def send(held: list):
        c = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        first, gone = _classes(c)
        if gone.any():
            yield batch(**_by_text({k: c[k][gone] for k in ("z", "i", "h", "g", "line")}))
        bucket, n, data = _packed({k: c[k][first] for k in _CLASS}, _CLASS, buckets)
        yield batch(len(n), bucket=bucket, n=n, data=data)

    def run(batches):
        count = np.zeros(cells, np.int64)
        held, n = [], 0
        for b in batches:
            z, i, h, g = (b.column(k).to_numpy() for k in range(4))
            for lo, hi, data, offsets in tv.pieces(b.column(4)):
                sets = _Sets(data, offsets)
                np.add.at(count, (sets.every & np.uint64(cells - 1)).astype(np.int64), 1)
                if len(sets.at):
                    row = lo + sets.row
                    held.append({"z": z[row], "i": i[row], "h": h[row], "g": g[row], "line": sets.number, "sig": sets.sums(_SIG), "sig2": sets.sums(_SIG2), "size": sets.size})
                    n += len(row)
                if n >= _CLASSES_HELD:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)
        step = min(_CHUNK, cells)
        used = [k for k in range(cells // step) if count[k * step : (k + 1) * step].any()]
        data = [_pressed(count[k * step : (k + 1) * step]) for k in used]
        yield batch(len(used), chunk=pa.array(used, pa.int32()), counts=pa.array(data, pa.binary()))
        tv.give_back()

    return base.select("z", "i", "h", "g", "text").mapInArrow(run, _SURVEY)


def _classes(c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Which lines stand for their class, being the first of it, and which come after another text's or line."""
    first, gone = np.ones(len(c["sig"]), bool), np.zeros(len(c["sig"]), bool)
    order = np.argsort(c["sig"])
    same = c["sig"][order][1:] == c["sig"][order][:-1]
    order = order[np.append(False, same) | np.append(same, False)[: len(order)]]
    c = {k: x[order] for k, x in c.items()}
    by = np.lexsort([c["g"], c["h"], c["line"], c["h"] >> 32, c["i"], c["z"], c["size"], c["sig2"], c["sig"]])
    if len(by):
        c, order = {k: x[by] for k, x in c.items()}, order[by]
        new = np.append(True, np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("sig", "sig2", "size")]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        first[order] = new
        gone[order] = np.logical_or.reduce([c[k] != c[k][head] for k in ("z", "i", "line", "h", "g")])  # rows equal in id and text are one text
    return first, gone


def _by_text(c: dict) -> dict:
    """Lines as one row for each of their texts; repeats may stay."""
    order = np.lexsort([c["g"], c["h"], c["i"], c["z"]])
    c = {k: x[order] for k, x in c.items()}
    at = np.flatnonzero(np.append(True, np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("z", "i", "h", "g")])))
    gone = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(c["line"].astype(np.int32)))
    return {"rows": len(at), "z": pa.array(c["z"][at].astype(np.int32)), "gone": gone} | {k: pa.array(c[k][at]) for k in ("i", "h", "g")}


def _packed(c: dict, kinds: dict, buckets: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Bucket, number and bytes of the rows for each bucket of classes."""
    bucket = ((c["sig"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket)
    bucket = bucket[order]
    columns = [c[k][order].astype(t) for k, t in kinds.items()]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    data = [_pressed(np.frombuffer(b"".join(x[a:z].tobytes() for x in columns), np.uint8)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(data, pa.binary())


def _unpacked(parts: list, kinds: dict) -> dict:
    """The columns that ``_packed`` has packed; ``parts``: number of rows and bytes of each."""
    c: dict = {k: [np.zeros(0, t)] for k, t in kinds.items()}
    for n, data in parts:
        raw, at = _unpressed(data, np.uint8, n * sum(np.dtype(t).itemsize for t in kinds.values())), 0
        for k, t in kinds.items():
            c[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(x) for k, x in c.items()}


def _mark(c: dict) -> np.ndarray:
    """A hash of a line's place and class, all of which two lines practically never share."""
    mark = c["sig"]
    for k in ("z", "i", "u", "line"):
        mark = tv.mix(mark ^ c[k].astype(np.int64).view(np.uint64))
    return mark


_GONE = "z int, i long, h long, g long, gone array<int>"


def _gone(survey: DataFrame, near: DataFrame, buckets: int) -> DataFrame:
    """``(z, i, h, g, gone)``: the lines of each text that repeat an earlier one, or are first but have a near match; a text may have several rows."""

    def pack(batches):
        for b in batches:
            c = {k: b.column(j).to_numpy() for j, k in enumerate(_NEAR)}
            bucket, n, data = _packed(c | {"sig": c["sig"].view(np.uint64)}, _NEAR, buckets)
            yield pa.RecordBatch.from_arrays([bucket, n, pa.array(np.ones(len(n), bool)), data], _names(_CLASS_PACK))

    def resolve(parts: list):
        c = _unpacked([(n, data) for n, is_near, data in parts if not is_near], _CLASS)
        near = _unpacked([(n, data) for n, is_near, data in parts if is_near], _NEAR)
        first, gone = _classes(c)
        gone |= first & np.isin(_mark(c | {"u": c["h"] >> 32}), _mark(near))
        if gone.any():
            out = _by_text({k: c[k][gone] for k in ("z", "i", "h", "g", "line")})
            yield pa.RecordBatch.from_arrays([out[k] for k in _names(_GONE)], _names(_GONE))

    def run(batches):
        now, parts = None, []
        for b in batches:
            for bucket, n, is_near, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                if bucket != now and parts:
                    yield from resolve(parts)
                    parts = []
                now = bucket
                parts.append((n, is_near, data))
        if parts:
            yield from resolve(parts)
        tv.give_back()

    packs = survey.where("bucket is not null").select("bucket", "n", F.lit(False).alias("near"), "data")
    packs = packs.union(near.select(*_NEAR).mapInArrow(pack, _CLASS_PACK))
    met = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _GONE)
    return survey.where("gone is not null").select(*_names(_GONE)).union(met)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _pressed(array: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(array).view(np.uint8), asbytes=True)


def _unpressed(data, kind, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), kind)


def rarity(chunks: DataFrame, cells: int = CELLS) -> np.ndarray:
    """How often the words of each cell of the hash table occur in all texts; ``cells`` numbers come to the driver.

    ``chunks`` has ``chunk`` and ``counts``, added up in two steps so that a chunk of
    very many tasks is not summed in one.
    """
    step = min(_CHUNK, cells)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1)):
                part = _unpressed(counts.as_buffer(), np.int64, step)
                total[chunk] = total[chunk] + part if chunk in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pressed(x) for x in total.values()], pa.binary())], ["chunk", "counts"])

    salted = chunks.select("chunk", "counts", (F.spark_partition_id() % 16).alias("salt")).repartition("chunk", "salt")
    once = salted.select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    rows = once.repartition("chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    table = np.zeros(cells, np.int64)
    for chunk, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        table[chunk * step : (chunk + 1) * step] = _unpressed(counts, np.int64, step)
    return np.minimum(table, (1 << 31) - 1).astype(np.int32)


# --- bounds -----------------------------------------------------------------------------------------------------------------


def _bitmap_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of a set's bitmap: a power of two, with at least 1.5 bits for each word of the set."""
    return (1 << np.ceil(np.log2(np.maximum(1.5 * size / 64, 1))).astype(np.int64)).astype(np.int64)


def _bitmaps(word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the sets, one after the other, and how many 64-bit words each has."""
    words = _bitmap_words(size)
    begin = np.cumsum(words) - words
    bits = np.zeros(int(words.sum()) * 64, bool)
    each = np.repeat(np.arange(len(size)), size)
    bits[begin[each] * 64 + (tv.mix(word + np.uint64(7)) & (64 * words[each] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64), words


class _Bound:
    """Which pairs of sets may reach the threshold, by their sizes and bitmaps."""

    def __init__(self, threshold: float, size: np.ndarray, bits: np.ndarray, words: np.ndarray):
        self.threshold, self.size, self.bits, self.words = threshold, size.astype(np.int64), bits, words
        self.begin = np.cumsum(words) - words

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ceil(self.threshold / (1 + self.threshold) * (self.size[a] + self.size[b]) - 1e-9)

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(self.size[a], self.size[b]) >= self.threshold * np.maximum(self.size[a], self.size[b]) - 1e-9

    def _at(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of ``rows`` folded to ``width`` words."""
        out = np.zeros((len(rows), width), np.uint64)
        for w in np.unique(self.words[rows]):
            mine = np.flatnonzero(self.words[rows] == w)
            full = self.bits[self.begin[rows[mine]][:, None] + np.arange(w)]
            out[mine] = np.bitwise_or.reduce(full.reshape(len(mine), -1, width), axis=1)
        return out

    def bitmaps(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether so few words of each can be missing in the other that ``need`` can be common."""
        ok = np.zeros(len(a), bool)
        width = np.minimum(self.words[a], self.words[b])
        for w in np.unique(width):
            k = np.flatnonzero(width == w)
            x, y = self._at(a[k], int(w)), self._at(b[k], int(w))
            apart = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
            ok[k] = (self.size[a[k]] - apart(x, y) >= need[k]) & (self.size[b[k]] - apart(y, x) >= need[k])
        return ok


def _later(c: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether line ``a`` comes after line ``b``: by null id last, id, half of the text's hash, line, then class."""
    out = c["sig"][a] > c["sig"][b]
    for k in reversed(_ORDER):
        x, y = c[k][a], c[k][b]
        out = np.where(x != y, x > y, out)
    return out


# --- first meeting ----------------------------------------------------------------------------------------------------------

#: What a packed row has besides the words of its bitmap; ``u`` is half of the hash of the text.
_PACKED = {"cell": "<u8", "z": "u1", "i": "<i8", "u": "<i4", "line": "<i4", "sig": "<u8", "size": "<u4", "pos": "<u4"}
_PACK = "bucket int, n int, words int, data binary"


def _packs(base: DataFrame, count, cells: int, threshold: float, buckets: int) -> DataFrame:
    """Prefix rows of every line, packed: a row for each bucket of cells that a task has lines for."""

    def send(held: list):
        c = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        at, first = np.cumsum(c["prefix"]) - c["prefix"], np.cumsum(c["words"]) - c["words"]
        order = np.lexsort([c[k] for k in reversed(("sig", *_ORDER))])
        keep = order[np.append(True, c["sig"][order][1:] != c["sig"][order][:-1])]  # the first line of each set
        each = np.repeat(keep, c["prefix"][keep])
        word = c["word"][_ragged(at[keep], c["prefix"][keep])]
        pos = np.arange(len(each)) - np.repeat(np.cumsum(c["prefix"][keep]) - c["prefix"][keep], c["prefix"][keep])
        often = count.value[(word & np.uint64(cells - 1)).astype(np.int64)].astype(np.int64)
        room = max(BLOCK, 8 * int(count.value.mean()))
        blocks = np.where(often <= room, 1, -(-often // room))
        copy = np.repeat(np.arange(len(word)), blocks)
        mine = (tv.mix(c["sig"][each]) % blocks.astype(np.uint64)).astype(np.int64)[copy]
        other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        pair = (np.minimum(mine, other) << 32 | np.maximum(mine, other)).astype(np.uint64)
        # a mixed number for each cell; buckets are ranges of it, so one sort serves both
        cell = tv.mix(np.where(blocks[copy] == 1, word[copy], word[copy] ^ tv.mix(pair + np.uint64(1))))
        order = np.argsort(cell)
        cell, copy = cell[order], copy[order]
        bucket = ((cell >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        each, pos = each[copy], pos[copy]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        columns = {"cell": cell, "pos": pos} | {k: c[k][each] for k in _PACKED if k in c}
        columns = {k: columns[k].astype(t) for k, t in _PACKED.items()}
        words = c["words"][each]
        upto = np.append(0, np.cumsum(words))
        bits = c["bits"][_ragged(first[each], words)]
        rows: list[list] = [[], [], [], []]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            parts = [x[a:z].tobytes() for x in columns.values()] + [bits[upto[a] : upto[z]].tobytes()]
            for out, x in zip(rows, (bucket[a], z - a, upto[z] - upto[a], _pressed(np.frombuffer(b"".join(parts), np.uint8)))):
                out.append(x)
        for k in range(0, len(rows[0]), 64):
            yield pa.RecordBatch.from_arrays([pa.array(r[k : k + 64], t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], _names(_PACK))

    def run(batches):
        held, n = [], 0
        for b in batches:
            z, i, h = (b.column(k).to_numpy() for k in range(3))
            for lo, hi, data, offsets in tv.pieces(b.column(3)):
                sets = _Sets(data, offsets, count.value)
                if not len(sets.at):
                    continue
                prefix = sets.size - np.ceil(threshold * sets.size - 1e-9).astype(np.int64) + 1
                bits, words = _bitmaps(sets.word, sets.size)
                row = lo + sets.row
                held.append({"z": z[row], "i": i[row], "u": (h[row] >> 32).astype(np.int32), "line": sets.number, "sig": sets.sums(_SIG), "size": sets.size, "prefix": prefix, "word": sets.word[_ragged(sets.at, prefix)], "bits": bits, "words": words})
                n += int(prefix.sum())
                if n >= _HELD:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)
        del held
        tv.give_back()

    return base.select("z", "i", "h", "text").mapInArrow(run, _PACK)


_MET = "cell long, z int, i long, u int, line int, sig long, pos int, later boolean"


def _meet(threshold: float):
    """Of the lines of each cell, those that may be alike with another, and whether with an earlier one."""

    def unpacked(parts: list) -> tuple[dict, np.ndarray, np.ndarray]:
        c: dict = {k: [] for k in _PACKED}
        bits = []
        for n, words, data in parts:
            raw = pa.Codec("zstd").decompress(data, n * sum(np.dtype(t).itemsize for t in _PACKED.values()) + 8 * words, asbytes=True)
            at = 0
            for k, t in _PACKED.items():
                c[k].append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
            bits.append(np.frombuffer(raw, "<u8", words, at))
        c = {k: np.concatenate(x) for k, x in c.items()}
        words = _bitmap_words(c["size"].astype(np.int64))
        return c, np.concatenate(bits), words

    def met(parts: list) -> pa.RecordBatch:
        c, bits, words = unpacked(parts)
        begin = np.cumsum(words) - words
        order = np.argsort(c["cell"], kind="stable")
        cell = c["cell"][order]
        head = np.append(True, cell[1:] != cell[:-1])
        several = ~(head & np.append(head[1:], True))
        order, group = order[several], np.cumsum(head[several]) - 1
        # in a cell by size, then class: of each class the first line stays
        size, sig = c["size"][order].astype(np.uint64), c["sig"][order]
        if len(order) < 1 << 20 and (not len(order) or size.max() < 1 << 16):
            by = np.argsort(group.astype(np.uint64) << np.uint64(44) | size << np.uint64(28) | sig >> np.uint64(36))
        else:
            by = np.lexsort((sig, size, group))
        order, group, sig = order[by], group[by], sig[by]
        again = np.append(False, (group[1:] == group[:-1]) & (sig[1:] == sig[:-1]))
        if again.any():
            run = np.cumsum(~again) - 1
            twice = np.flatnonzero(again | np.append(again[1:], False))
            best = twice[np.lexsort([c[k][order[twice]] for k in reversed(_ORDER)] + [run[twice]])]
            drop = np.ones(len(order), bool)
            drop[np.setdiff1d(np.arange(len(order)), twice, assume_unique=True)] = False
            drop[best[np.append(True, run[best][1:] != run[best][:-1])]] = False
            order, group = order[~drop], group[~drop]
        c = {k: x[order] for k, x in c.items()}
        bits, words = bits[_ragged(begin[order], words[order])], words[order]
        bound = _Bound(threshold, c["size"], bits, words)
        size, pos = bound.size, c["pos"].astype(np.int64)
        some, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        held, n = [], 0

        def settle():
            a, b = (np.concatenate(x) for x in zip(*held))
            ok = bound.bitmaps(a, b, bound.need(a, b))
            a, b = a[ok], b[ok]
            some[a] = some[b] = True
            after = _later(c, a, b)
            later[np.where(after, a, b)] = True

        rows, lag = np.arange(1, len(order)), 1
        while len(rows):
            rows = rows[(group[rows] == group[rows - lag]) & (size[rows - lag] >= threshold * size[rows] - 1e-9)]
            a, b = rows, rows - lag
            fits = np.minimum(pos[a], pos[b]) + np.minimum(size[a] - pos[a], size[b] - pos[b]) >= bound.need(a, b)
            held.append((a[fits], b[fits]))
            n += len(held[-1][0])
            if n > 1 << 17:
                settle()
                held, n = [], 0
            lag += 1
            rows = rows[rows >= lag]
        if n:
            settle()
        k = np.flatnonzero(some)
        cols = [c["cell"].view(np.int64)[k], c["z"][k].astype(np.int32), c["i"][k], c["u"][k], c["line"][k], c["sig"].view(np.int64)[k], c["pos"][k].astype(np.int32), later[k]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _names(_MET))

    def run(batches):
        now, parts = None, []
        for b in batches:
            for bucket, n, words, data in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                if bucket != now and parts:
                    yield met(parts)
                    parts = []
                now = bucket
                parts.append((n, words, data.as_py()))
        if parts:
            yield met(parts)
        del parts
        tv.give_back()

    return run


# --- second meeting: whole sets ---------------------------------------------------------------------------------------------

_SETS = "z int, i long, u int, line int, sig long, words binary, cells array<long>, asked boolean"


def _whole_sets(base: DataFrame, met: DataFrame) -> DataFrame:
    """Each line of ``met`` with its sorted word hashes and the cells it met others in, rarest first."""
    wanted = met.groupBy("z", "i", "u").agg(F.collect_list(F.struct("line", "sig", "pos", "cell", "later")).alias("lines"))
    u = F.shiftright("h", 32).cast("int").alias("u")
    both = base.select("z", "i", u, "text").join(wanted.hint("shuffle_hash"), ["z", "i", "u"])  # texts need no sort.select("z", "i", "u", "text", "lines")

    def run(batches):
        for b in batches:
            lists = b.column(4).combine_chunks() if isinstance(b.column(4), pa.ChunkedArray) else b.column(4)
            for lo, hi, data, offsets in tv.pieces(b.column(3)):
                sets = _Sets(data, offsets)
                part = lists.slice(lo, hi - lo)
                sizes = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                owner = np.repeat(np.arange(hi - lo), sizes)
                line, sig, pos, cell, later = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                order = np.lexsort((cell, pos, sig, line, owner))
                owner, line, sig, cell, later = (x[order] for x in (owner, line, sig, cell, later))
                new = np.append(True, (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]) | (sig[1:] != sig[:-1]))[: len(owner)]
                at = np.flatnonzero(new)
                # the set of each: same row, same line, and the same class (else the line is another text's of this id)
                place = np.searchsorted(sets.row * (1 << 32) + sets.number, owner[at].astype(np.int64) * (1 << 32) + line[at])
                place = np.minimum(place, max(len(sets.at) - 1, 0))
                if not len(sets.at):
                    continue
                good = (sets.row[place] == owner[at]) & (sets.number[place] == line[at]) & (sets.sums(_SIG).view(np.int64)[place] == sig[at])
                stop = np.append(at[1:], len(owner))
                asked = np.logical_or.reduceat(later, at)
                at, stop, place, asked = at[good], stop[good], place[good], asked[good]
                n = stop - at
                cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(cell[_ragged(at, n)]))
                size = sets.size[place]
                words = sets.word[_ragged(sets.at[place], size)]
                binary = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(np.append(0, np.cumsum(8 * size)).astype(np.int32)), pa.py_buffer(words)])
                rows = pa.array(lo + owner[at])
                yield pa.RecordBatch.from_arrays([b.column(k).take(rows) for k in range(3)] + [pa.array(line[at]), pa.array(sig[at]), binary, cells, pa.array(asked)], _names(_SETS))
        tv.give_back()

    return both.mapInArrow(run, _SETS)


_LINE = "z int, i long, u int, line int, sig long"


def _verify(threshold: float):
    """The lines of each cell that are asked for and have an earlier line whose similarity reaches the threshold."""

    def matched(c: dict, words: list) -> pa.RecordBatch:
        order = np.lexsort([c[k] for k in reversed(("cell", *_ORDER, "sig"))])
        c = {k: x[order] for k, x in c.items()}
        size = np.array([len(words[k]) for k in order], np.int64) // 8
        word = np.frombuffer(b"".join(words[k] for k in order), np.uint64)
        bound = _Bound(threshold, size, *_bitmaps(word, size))
        # words are sorted within a line, so (line, word number) is sorted as a whole
        distinct, number = np.unique(word, return_inverse=True)
        begin = np.cumsum(size) - size
        key = np.repeat(np.arange(len(size)), size) * len(distinct) + number
        head = np.append(True, c["cell"][1:] != c["cell"][:-1])
        rank = np.arange(len(head)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        found = np.zeros(len(head), bool)
        rows, lag = np.flatnonzero((rank > 0) & c["asked"]), 1
        while len(rows):
            a, b = rows, rows - lag
            ok = bound.lengths(a, b)
            a, b = a[ok], b[ok]
            need = bound.need(a, b)
            ok = bound.bitmaps(a, b, need)
            a, b, need = a[ok], b[ok], need[ok]
            if len(a):
                each = np.repeat(np.arange(len(a)), size[a])
                wanted = b[each] * len(distinct) + number[_ragged(begin[a], size[a])]
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                common = np.bincount(each, key[at] == wanted, len(a))
                found[a[common >= need]] = True
            lag += 1
            rows = rows[(rank[rows] >= lag) & ~found[rows]]
        k = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(c[n][k]) for n in _names(_LINE)], _names(_LINE))

    def run(batches):
        held, words = None, []
        for b in batches:
            part = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(b.schema.names) if n != "words"}
            held = part if held is None else {n: np.concatenate([held[n], part[n]]) for n in part}
            words += b.column(b.schema.get_field_index("words")).to_pylist()
            starts = np.flatnonzero(np.append(True, held["cell"][1:] != held["cell"][:-1]))
            if len(starts) > 1 and len(words) > 10_000:
                cut = starts[-1]
                yield matched({n: x[:cut] for n, x in held.items()}, words[:cut])
                held, words = {n: x[cut:] for n, x in held.items()}, words[cut:]
        if held is not None and words:
            yield matched(held, words)
        del held, words
        tv.give_back()

    return run


def _matches(sets: DataFrame, threshold: float) -> DataFrame:
    """The asked lines with an earlier match among the lines that share a cell of their ``cells``; one row for each such cell."""
    dealt = sets.select(*_names(_LINE), "words", "asked", F.explode("cells").alias("cell")).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_verify(threshold), _LINE)


# --- the operator -----------------------------------------------------------------------------------------------------------


def removed(base: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS) -> DataFrame:
    """``(z, i, h, g, gone)``: the lines of each text of ``base (z, i, h, g, text)`` that an earlier line matches; a text may have several rows.

    Lines are ordered by id (null last), the high half of the text's hash, and position.
    """
    spark = base.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    survey = written(_survey(base, cells, _CLASS_BUCKETS * partitions), "lines")
    count = spark.sparkContext.broadcast(rarity(survey.where("chunk is not null").select("chunk", "counts"), cells))
    buckets = _BUCKETS * partitions
    packs = _packs(base, count, cells, threshold, buckets)
    met = written(packs.repartition("bucket").sortWithinPartitions("bucket").select(*_names(_PACK)).mapInArrow(_meet(threshold), _MET), "met")
    release(spark)
    sets = written(_whole_sets(base, met), "sets")
    drop_written(met)
    release(spark)
    near = written(_matches(sets.withColumn("cells", F.slice("cells", 1, FIRST_CELLS)), threshold), "near")
    release(spark)
    line = _names(_LINE)
    asked = sets.where(F.col("asked")).select(*line, "cells").join(near, line, "left_anti")
    again = written(asked.select(F.explode("cells").alias("cell"), *line), "asked")
    if not again.isEmpty():
        open_cells = again.select("cell").distinct()
        rows = sets.select(*line, "words", F.explode("cells").alias("cell")).join(open_cells, "cell", "left_semi")
        rows = rows.groupBy(*line).agg(F.first("words").alias("words"), F.collect_list("cell").alias("cells"))
        rows = rows.join(again.select(*line).distinct().withColumn("_asked", F.lit(True)), line, "left").withColumn("asked", F.col("_asked").isNotNull())
        near = near.union(written(_matches(rows, threshold), "near"))
        release(spark)
    drop_written(sets)
    drop_written(again)
    count.destroy()
    return _gone(survey, near, _CLASS_BUCKETS * partitions)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """``docs`` without the lines that an earlier line matches at ``threshold`` or more.

    One row per row of ``docs``: ``doc_id, text`` (the lines kept, joined by line
    feeds), ``n_lines`` and ``n_removed``.  Lines end at line feeds; words are runs
    of non-blank bytes, A-Z lower-cased; a line without words matches nothing and
    stays; matches are judged on the input, so a removed line can remove others.
    Earlier is what has the smaller id (null ids are last), under one id the smaller
    hash of the text, in one text the smaller line number.  A null text is empty,
    with one empty line.  Rows equal in id and text are one text: they lose the same
    lines and keep a row each.  Null ids stay null, and their texts are told apart
    by 128 bits of hash, as are several texts of one id; an empty table gives no
    rows; of the other columns only those named in ``keep`` are read, and they
    follow.  A task holds two blocks of the lines of a word with their word sets, so
    its memory grows with the length of a line, not with the corpus.
    """
    base = keyed(docs, id_col, text_col, keep)
    gone = removed(base, threshold, cells).groupBy("z", "i", "h", "g").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    found = base.join(gone.hint("shuffle_hash"), ["z", "i", "h", "g"], "left").select("z", "i", F.split("text", "\n").alias("lines"), "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), *["_rest"] * bool(keep))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    return found.select(
        F.when(F.col("z") == 0, F.col("i")).alias("doc_id"), kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        *["_rest.*"] * bool(keep),
    )
