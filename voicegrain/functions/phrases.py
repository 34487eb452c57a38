"""Phrases of two to four words, and the spelling with accents that an unaccented phrase stands for.

A phrase's class is its folded form.  Where only some classes matter (``said``), each
task counts 64-bit hashes of classes in packed blocks first.  The hashes that may matter
become bits of one bounded set that every task holds, and only phrases of those classes
are made into texts.  A false hit only lets a phrase through that the exact counts drop.
"""

from __future__ import annotations

import math
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.files import kept
from .text import FOLDED, fold

# Words that no phrase begins or ends with, without and with accents; words
# that may begin one all the same; further words of which no phrase consists alone.
EDGE = "a ah a ạ ai anh ba bao ban bay ben bi biet bon ca cac cai cam cho chi chiec chu chua co con cu cua cung da dang day de den deu di do dung duoc em gi gio gium giup ha hai hay het hoac hoi hon hu khi khien kho khong ko kia la lai lam len luc luon ma may minh moi mot muon nao nay neu nen nhe nha nhi nhieu nhu nhung nua nam o oi ok qua ra rang rat roi sao se so sp san pham shop ta tai thay the them thi thoi thuc toi tot trong tren tu tuy va vao vay ve vi voi vua xai xong xin".split()
EDGE_MARKED = "à ạ á ah ai anh ba bao bạn bây bên bị biết bốn cả các cái cảm cho chỉ chiếc chứ chưa có còn cứ của cũng đã đang đây để đề đến đều đi đó dùng được em gì giờ giùm giúp hả hai hay hết hoặc hỏi hơi hơn hử khi khiến khó không kia là lại làm lên lúc luôn mà mấy mình mỗi mới một muốn nào này nếu nên nhé nha nhà nhỉ nhiều như nhưng nữa năm ở ơi quá ra rằng rất rồi sao sẽ số sản phẩm ta tại thấy thế thêm thì thôi thực tôi tốt trong trên từ tuy và vào vậy về vì với vừa xài xong xin".split()
MAY_BEGIN = ["khong", "chua", "bi", "không", "chưa", "bị"]
DULL = ["hang", "mua", "nhan", "giao", "dung", "su", "cam", "on"]
DULL_MARKED = ["hàng", "mua", "nhận", "giao", "dùng", "sự", "cảm", "ơn"]

_END = "|"
SEGMENT_END = "[.,!?;:…\\n\\r()\"“”'\\-–—/\\\\|*~+=<>\\[\\]{}]+"


_WORDS = rf"[^\p{{L}}\p{{N}}{_END}]+"
#: Hashes are dealt to blocks by their first bits; a task holds so many; the set has so many bits at most; words are looked at so many at a time.
_BLOCKS, _HELD, _MOST_BITS, _AT_ONCE = 10, 1 << 21, 28, 1 << 17


def _stop(plain: Column, word: Column, marked_list: list[str], plain_list: list[str]) -> Column:
    return F.when(plain, word.isin(*plain_list)).otherwise(word.isin(*marked_list))


def _marks(text: str) -> Column:
    """The lower-cased text; a segment's end is a word that no phrase holds."""
    return F.regexp_replace(F.lower(text), SEGMENT_END, f" {_END} ")


def phrase_rows(rows: DataFrame, key: str, text: str, longest: int = 4) -> DataFrame:
    """``(key, phrase)``: the lower-cased phrases of each row, once a key.

    No phrase crosses punctuation, begins or ends with a stop word or a number, or
    holds only dull words.  Null and empty texts have none.  A row's words are marked
    once, in a column of their own, and read by place, so the work grows with the words.
    """
    words = F.filter(F.split(_marks(text), _WORDS), lambda w: w != "")
    words = rows.select(key, F.explode(F.array(words)).alias("_words"))
    known = F.transform("_words", lambda w: F.struct(w.alias("w"), (w == fold(w)).alias("plain"), w.rlike(r"^\d+$").alias("number"), (w == _END).alias("end")))

    def mark(x: Column) -> Column:
        edge = _stop(x["plain"], x["w"], EDGE_MARKED, EDGE)
        dull = _stop(x["plain"], x["w"], EDGE_MARKED + DULL_MARKED, EDGE + DULL)
        return F.struct(x["w"].alias("w"), (~x["end"] & ~x["number"] & (~edge | x["w"].isin(*MAY_BEGIN))).alias("begins"), (~x["end"] & ~x["number"] & ~edge).alias("ends"), dull.alias("dull"), x["end"].alias("end"))

    marked = words.select(key, F.explode(F.array(F.transform(known, mark))).alias("_m"))
    m = F.col("_m")

    def from_place(x: Column, i: Column) -> Column:
        def run(n: int) -> Column:
            rest = [F.get(m, i + k) for k in range(1, n)]
            live = x["begins"] & F.coalesce(rest[-1]["ends"], F.lit(False))
            for_all = x["dull"]
            for r in rest:
                for_all = for_all & r["dull"]
            for r in rest[:-1]:
                live = live & ~r["end"]
            return F.when(live & ~for_all, F.concat_ws(" ", x["w"], *[r["w"] for r in rest]))

        return F.array(*[run(n) for n in range(2, longest + 1)])

    found = marked.select(key, F.explode(F.array_distinct(F.array_compact(F.flatten(F.transform(m, from_place))))).alias("phrase"))
    once = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()
    return found if once else found.distinct()  # a key's phrases come from one row, unless a key is repeated


def spellings(phrase_rows: DataFrame) -> DataFrame:
    """``(phrase, spelled)``: an unaccented phrase and its most frequent accented spelling (ties: the smaller)."""
    counts = phrase_rows.groupBy("phrase").agg(F.count("*").alias("n"))
    return with_spelled(counts.withColumn("plain", fold(F.col("phrase")))).where("phrase = plain and spelled is not null").select("phrase", "spelled")


def spelled_rows(phrase_rows: DataFrame, key: str) -> DataFrame:
    """``phrase_rows`` with unaccented phrases put under their accented spelling, each once a key."""
    known = spellings(phrase_rows)
    targets = known.select(F.col("spelled").alias("phrase"), "spelled").distinct()  # only these can come twice
    met = phrase_rows.join(known.union(targets), "phrase", "left")
    put = met.where("spelled is not null").select(key, F.col("spelled").alias("phrase")).distinct()
    return met.where("spelled is null").select(key, "phrase").union(put)


class _Text(dict):
    """Words by number: whether they begin, end or make up phrases, and the hash of their folded form."""

    BEGINS, ENDS, DULL, BREAK, MARKED = 1, 2, 4, 8, 16

    def __init__(self):
        self.edge, self.edge_marked, self.may = set(EDGE), set(EDGE_MARKED), set(MAY_BEGIN)
        self.dull, self.dull_marked = self.edge | set(DULL), self.edge_marked | set(DULL_MARKED)
        self.hashes, self.flags = array("Q"), array("B")

    def __missing__(self, w: str) -> int:
        plain = w.translate(FOLDED)
        edge = w in (self.edge if w == plain else self.edge_marked)
        live = w != _END and not (w.isascii() and w.isdigit())
        self.flags.append(self.BEGINS * (live and (not edge or w in self.may)) + self.ENDS * (live and not edge) + self.DULL * (w in (self.dull if w == plain else self.dull_marked)) + self.BREAK * (w == _END) + self.MARKED * (w != plain))
        self.hashes.append(xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")))
        self[w] = len(self.hashes) - 1
        return self[w]

    def runs(self, texts: list[list[str]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For two to four words ``(words, row, place, hash of the class, marked)`` of every phrase; places are over all texts."""
        if len(self) > 1 << 19:
            self.clear()
            self.hashes, self.flags = array("Q"), array("B")
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        hashes, flags = np.array(self.hashes, np.uint64)[found], np.array(self.flags, np.uint8)[found]
        begins, ends, dull, stops, marks = (flags & b > 0 for b in (self.BEGINS, self.ENDS, self.DULL, self.BREAK, self.MARKED))
        out = []
        for n in range(2, 5):
            size = max(len(found) - n + 1, 0)
            part = lambda a, k: a[k : k + size]
            live = part(begins, 0) & part(ends, n - 1) & (part(row, 0) == part(row, n - 1))
            for k in range(1, n - 1):
                live &= ~part(stops, k)
            live &= ~np.logical_and.reduce([part(dull, k) for k in range(n)])
            at = np.flatnonzero(live)
            h, marked = np.full(len(at), n, np.uint64), np.zeros(len(at), bool)
            for k in range(n):
                h = (h ^ hashes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                marked |= marks[at + k]
            out.append((n, row[at], at, h * np.uint64(0xBF58476D1CE4E5B9), marked))
        return out


def _chunks(batch: pa.RecordBatch):
    """``(numbers of rows, their words)``, some thousand words at a time."""
    rows, texts, size = [], [], 0
    for k, text in enumerate(batch.column(batch.num_columns - 1)):
        words = (text.as_py() or "").split()
        rows.append(k), texts.append(words)
        size += len(words)
        if size >= _AT_ONCE:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _joined(hashes: np.ndarray, values: np.ndarray, flags: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, sorted, with the sum of its values (255 at most) or all its flags."""
    order = np.argsort(hashes, kind="stable")
    hashes, values = hashes[order], values[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    if not len(first):
        return hashes, values
    sums = np.bitwise_or.reduceat(values, first) if flags else np.minimum(np.add.reduceat(values.astype(np.int64), first), 255).astype(np.uint8)
    return hashes[first], sums


def _hashed(flags: bool):
    """Blocks ``(block, hashes, values)``: of each class its rows, or as flags whether it occurs plain (1) and marked (2)."""

    def blocks(hashes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        of = (hashes >> np.uint64(64 - _BLOCKS)).astype(np.int32)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        cut = lambda a: pa.array([x.tobytes() for x in np.split(a, first[1:])] if len(first) else [], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(of[first]), cut(hashes), cut(values)], ["block", "hashes", "values"])

    def run(batches):
        text, held, size = _Text(), [], 0
        merged = lambda: _joined(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), flags)
        for batch in batches:
            for _, texts in _chunks(batch):
                runs = text.runs(texts)
                row, hashes, marked = (np.concatenate([r[k] for r in runs]) for k in (1, 3, 4))
                if flags:
                    values = marked.astype(np.uint8) + np.uint8(1)
                else:  # once a row
                    order = np.lexsort((row, hashes))
                    row, hashes = row[order], hashes[order]
                    hashes = hashes[np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(hashes)]]
                    values = np.ones(len(hashes), np.uint8)
                held.append(_joined(hashes, values, flags))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield blocks(*held[0])
                        held, size = [], 0
        if held:
            yield blocks(*merged())

    return run


def _passed(least: int, flags: bool):
    def run(block: pa.Table) -> pa.Table:
        get = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in block.column(c)])
        hashes, values = _joined(get("hashes", np.uint64), get("values", np.uint8), flags)
        live = hashes[values == 3] if flags else hashes[values >= least]
        return pa.table({"block": block.column("block").slice(0, 1), "hashes": pa.array([live.tobytes()], pa.binary()), "n": pa.array([len(live)])})

    return run


def _bits(places: int):
    """The part of the set that a block fills."""

    def run(batches):
        for batch in batches:
            parts = []
            for x in batch.column(1):
                part = np.zeros(1 << (places - _BLOCKS), bool)
                part[((np.frombuffer(x.as_py(), np.uint64) << np.uint64(_BLOCKS)) >> np.uint64(64 - places + _BLOCKS)).astype(np.int64)] = True
                parts.append(np.packbits(part, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["block", "bits"])

    return run


def _texts(bits, places: int, schema: pa.Schema):
    """The columns but the last, and ``phrases``: those that the set lets through, and whether their plain form is in the row too."""
    both = schema.field("phrases").type.value_type

    def run(batches):
        text, filled = _Text(), np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for rows, texts in _chunks(batch):
                words, sets = list(chain.from_iterable(texts)), [{} for _ in rows]
                for n, row, at, hashes, marked in text.runs(texts):
                    place = hashes >> np.uint64(64 - places)
                    live = np.flatnonzero(filled[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    for r, i, m in zip(row[live].tolist(), at[live].tolist(), marked[live].tolist()):
                        sets[r][" ".join(words[i : i + n])] = m
                for k, own in zip(rows, sets):
                    found[k] = [(p, m and p.translate(FOLDED) in own) for p, m in own.items()]
            flat = [x for f in found for x in f]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            made = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.bool_())], fields=list(both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, made, type=schema.field("phrases").type)], schema=schema)

    return run


def said(rows: DataFrame, text: str, among: Column | None = None, least: int = 0) -> DataFrame:
    """``rows`` without the text, with ``phrases``, an array of ``(phrase, both)``: each row's phrases once; both: its plain form is in the row too.

    Phrases may be left out of classes that fewer than ``least`` of the rows ``among``
    hold or, without ``among``, of those that do not occur both plain and marked.  All
    rows of the other classes are given, and some of classes that could be left out.
    """
    spark, flags = rows.sparkSession, among is None
    plain = F.regexp_replace(_marks(text), _WORDS, " ")
    first = rows if flags else rows.where(among)
    packed = first.select(plain.alias("text")).mapInArrow(_hashed(flags), "block int, hashes binary, values binary")
    live = kept(packed.groupBy("block").applyInArrow(_passed(least, flags), "block int, hashes binary, n long"), "classes")
    n = live.agg(F.sum("n")).first()[0] or 0
    places = min(_MOST_BITS, max(16, math.ceil(math.log2(16 * max(n, 1)))))
    filled = bytearray(1 << (places - 3))
    for r in live.where("n > 0").select("block", "hashes").mapInArrow(_bits(places), "block int, bits binary").collect():  # at most 32 MB
        filled[r.block << (places - _BLOCKS - 3) : (r.block + 1) << (places - _BLOCKS - 3)] = r.bits
    others = rows.drop(text)
    schema = others.limit(0).withColumn("phrases", F.expr("cast(null as array<struct<phrase: string, both: boolean>>)")).schema
    made = rows.select(*others.columns, plain.alias("_text"))
    return made.mapInArrow(_texts(spark.sparkContext.broadcast(bytes(filled)), places, to_arrow_schema(schema)), schema)


def counted(said: DataFrame, *by: str, **counts: Column) -> DataFrame:
    """``(by, phrase, plain)`` with ``counts`` over the phrases of ``said``; a count may read ``both``."""
    each = said.select(*[c for c in said.columns if c != "phrases"], F.explode("phrases").alias("_p")).select("*", "_p.phrase", "_p.both")
    return each.groupBy(*by, "phrase").agg(*[c.alias(k) for k, c in counts.items()]).withColumn("plain", fold(F.col("phrase")))


def with_spelled(counts: DataFrame) -> DataFrame:
    """``counts (phrase, plain, n, ...)`` with ``spelled``, the most frequent accented spelling of the class (ties: the smaller), null if it has none."""
    dealt = counts.repartition("plain").withColumn("_n", F.sum("n").over(Window.partitionBy("plain", "phrase")))
    marked = F.when(F.col("phrase") != F.col("plain"), F.col("phrase"))
    best = F.min_by(marked, F.when(marked.isNotNull(), F.struct(-F.col("_n"), F.col("phrase")))).over(Window.partitionBy("plain"))
    return dealt.withColumn("spelled", best).drop("_n")


def each_key_once(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with ``first``, true for one row of each key.  Where keys are repeated, each row has all texts of its key."""
    if rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return rows.withColumn("first", F.lit(True))
    whole = rows.groupBy(key).agg(F.concat_ws(f" {_END} ", F.collect_list(text)).alias("_whole"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    return rows.withColumn("first", number == 1).drop(text).join(whole, key).withColumnRenamed("_whole", text)
