"""Stupid-backoff language-model scores, computed relationally (operator 1).

The model is a bigram model of the corpus.  Words and pairs of words (with a start
mark before the first word of a text) are known by 64-bit hashes.  Both are counted
over all documents into Spark tables, after a partial count in each task; the
documents are exploded to their words and pairs, and these are joined with the
counts by shuffle joins and summed per document:

    S(w | v) = c(v w) / c(v)          if the corpus holds v w at least ``min_count`` times
             = backoff * c(w) / N     otherwise, if it holds w
             = backoff ** 2 / N       otherwise

c(v) is how often v is followed by a word, N the number of words.  A text that is part
of the corpus would find all its own pairs in it.  So with ``leave_own_out`` each row is
scored by the counts of all other rows: every exploded pair carries how often its row
holds it and its two words, and the counts less these stand in the formula.

Each text first gets the score it would have if every pair of it backed off, which
takes only its words; a pair that does not then adds the difference.  The table of
pairs leaves out those that are too rare for any row; as most are, pairs are counted
packed, in buckets, and become rows only when they are known to be frequent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import documents, drop_written, release, written

#: All words are counted as themselves; a caller may ask for a limit, which pools the other words.
VOCABULARY = math.inf
BACKOFF = 0.4
MIN_COUNT = 2
#: The pairs of all documents are joined with their counts in so many turns, by hash, so that their shuffles do not stand on disk together.
SLICES = 3
#: Buckets of packed pairs for each shuffle partition, and how many pairs a task holds before it sends them.
_BUCKETS = 8
_HELD = 1 << 20
#: Stand in place of word hashes.
START, UNKNOWN = 0, 1
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _lines_of(batch, known=None):
    """(first row, end row, word hashes, hashes of the words before, their rows) of an Arrow batch whose second column is the text, a piece at a time."""
    for lo, hi, data, offsets in tv.pieces(batch.column(1)):
        data = tv.LOWER[data]
        starts, ends = tv.spans(data, offsets)
        word = tv.hashes(data, starts, ends).view(np.int64)
        if known is not None:
            word = np.where(np.isin(word, known.value), word, UNKNOWN)
        row = np.searchsorted(offsets, starts, side="right") - 1
        before = np.concatenate([[START], word[:-1]])[: len(word)]
        before[np.append(True, row[1:] != row[:-1])[: len(row)]] = START
        yield lo, hi, word, before, row


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tv.mix(before.view(np.uint64) * _PAIR + word.view(np.uint64)).view(np.int64)


def word_counts(docs: DataFrame, known=None) -> DataFrame:
    """``(gram, n, followed)``: the hash of each word and of the start mark, its count, and how often a word follows it."""

    def run(batches):
        for b in batches:
            for _, _, word, before, _ in _lines_of(b, known):
                unique, at = np.unique(np.concatenate([word, before]), return_inverse=True)
                n, followed = np.bincount(at[: len(word)], minlength=len(unique)), np.bincount(at[len(word) :], minlength=len(unique))
                yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n), pa.array(followed)], ["gram", "n", "followed"])

    counted = documents(docs).mapInArrow(run, "gram long, n long, followed long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("followed").alias("followed"))


def pair_counts(docs: DataFrame, known=None, least: int = 1) -> DataFrame:
    """``(v, w, gram, n)``: the hashes of the two words of each pair and of the pair, and its count, of pairs that occur at least ``least`` times.

    Most pairs are rare.  A task counts its pairs and sends them packed, one binary for
    each bucket of pairs, and only pairs that reach ``least`` become rows.
    """
    buckets = _BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(held: list):
        v, w = (np.concatenate(x) for x in zip(*held))
        v, w, n, gram = _counted(v, w, np.ones(len(v), np.int64))
        bucket = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascends with gram
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        n = n.astype(np.int32)  # a task's texts hold fewer
        data = [b"".join(x[a:z].tobytes() for x in (v, w, n)) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])

    def pack(batches):
        held, size = [], 0
        for b in batches:
            for _, _, word, before, _ in _lines_of(b, known):
                if len(word):
                    held.append((before, word))
                    size += len(word)
                if size >= _HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)
        del held
        tv.give_back()

    def total(parts: list) -> pa.RecordBatch:
        v, w, n = [], [], []
        for data in parts:
            rows = len(data) // 20
            v.append(np.frombuffer(data, np.int64, rows)), w.append(np.frombuffer(data, np.int64, rows, 8 * rows)), n.append(np.frombuffer(data, np.int32, rows, 16 * rows))
        v, w, n, gram = _counted(*(np.concatenate(x) for x in (v, w, n)))
        often = n >= least
        return pa.RecordBatch.from_arrays([pa.array(x[often]) for x in (v, w, gram.view(np.int64), n)], ["v", "w", "gram", "n"])

    def add(batches):
        now, parts = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now and parts:
                    yield total(parts)
                    parts = []
                now = bucket
                parts.append(data)
        if parts:
            yield total(parts)
        del parts
        tv.give_back()

    packs = documents(docs).mapInArrow(pack, "bucket int, data binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "v long, w long, gram long, n long")


def _counted(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in the order of their hash, their summed counts, and the hash."""
    gram = _pairs(v, w).view(np.uint64)
    order = np.argsort(gram)
    gram = gram[order]
    at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    first = order[at]
    return v[first], w[first], np.add.reduceat(n[order].astype(np.int64), at), gram[at]


def _built(counts: DataFrame) -> DataFrame:
    """``counts``, unique by what it is joined on, as the side that is hashed; the far longer other side then needs no sort."""
    return counts.hint("shuffle_hash")


def _groups(row: np.ndarray, gram: np.ndarray):
    """(order, starts, sizes) of the tokens grouped by row and gram, told apart by a 64-bit hash of both."""
    tokens = tv.mix(gram.view(np.uint64) + row.astype(np.uint64) * _PAIR)
    by = np.argsort(tokens)
    tokens = tokens[by]
    at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
    return by, at, np.diff(np.append(at, len(tokens)))


def _own(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, how often its row holds its word, and how often the word before it is followed there."""
    by, _, sizes = _groups(row, word)
    own_w = np.empty(len(word), dtype=np.int64)
    own_w[by] = np.repeat(sizes, sizes)
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)[: len(row)])
    final = np.repeat(word[last], np.diff(np.append(-1, last)))  # nothing follows the last word of a row
    own_v = np.append(1, (own_w - (word == final))[:-1])[: len(word)]
    own_v[np.append(0, last[:-1] + 1)[: len(last)]] = 1
    return own_v, own_w


def _exploded(docs: DataFrame, kind: str, known=None, slices: int = 1, part: int = 0) -> DataFrame:
    """``(doc_id, key, gram, times)``: how often each text holds each of its words or pairs; for pairs also ``own_v`` and ``own_w``.

    Only grams whose hash modulo ``slices`` is ``part``: what goes through a shuffle at once is that share.
    """
    pairs = kind == "pair"
    names = ["doc_id", "key", "gram", "times", *(["own_v", "own_w"] if pairs else [])]

    def run(batches):
        for b in batches:
            doc, key = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            for lo, _, word, before, row in _lines_of(b, known):
                gram, own = (_pairs(before, word), _own(row, word)) if pairs else (word, ())
                if slices > 1:
                    mine = gram % slices == part
                    gram, row, own = gram[mine], row[mine], [x[mine] for x in own]
                by, at, times = _groups(row, gram)
                first = by[at]
                columns = [pa.array(key[lo + row[first]]), pa.array(gram[first]), pa.array(times.astype(np.int32)), *[pa.array(x[first].astype(np.int32)) for x in own]]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(lo + row[first])), *columns], names)

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, gram long, times int" + (", own_v int, own_w int" if pairs else ""))


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("key", F.xxhash64("text"))


def _known(docs: DataFrame, vocabulary: float):
    """The hashes of the most frequent words, if the caller limits them."""
    if vocabulary == math.inf:
        return None
    top = word_counts(docs).where("n > 0").orderBy(F.desc("n"), "gram").limit(int(vocabulary)).toArrow()
    return docs.sparkSession.sparkContext.broadcast(top.column("gram").to_numpy())


def scores(docs: DataFrame, vocabulary: float = VOCABULARY, backoff: float = BACKOFF, min_count: int = MIN_COUNT, leave_own_out: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_backed_off, log_score, mean_log_score)`` for every row of ``docs``.

    Words are runs of non-blank bytes, A-Z lower-cased, known by a 64-bit hash.
    log_score is the sum of ln S over the text's words; with ``leave_own_out`` by the
    counts of all rows but its own (a copy in another row still counts; where no
    other row has a word, N is 1).  A text without words (null, empty, blank) has no
    words, log_score 0 and a null mean.  Repeated rows count in the corpus as often as
    they occur and keep a row each; null ids are kept; an empty table gives no rows;
    other columns are not read.
    """
    ln = lambda c: F.ln(c.cast("double"))
    mine = lambda c: F.col(c) if leave_own_out else F.lit(0)
    rest = lambda c: F.greatest(F.col("c_w") - mine(c), F.lit(backoff))
    known = _known(docs, vocabulary)
    counts = written(word_counts(docs, known), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = counts.where("n > 0").select("gram", F.col("n").alias("c_w"))
    pairs = pair_counts(docs, known, max(min_count, 1) + int(leave_own_out))
    before = counts.where("followed > 0").select(F.col("gram").alias("v"), F.col("followed").alias("c_v"))
    frequent = written(pairs, "pair-counts")  # the shuffle of all pairs ends before those of the joins begin
    release(docs.sparkSession)
    seen = frequent.join(_built(before), "v").join(_built(words.withColumnRenamed("gram", "w")), "w")
    seen = written(seen.select("gram", "n", "c_v", "c_w"), "pairs")
    drop_written(frequent)
    release(docs.sparkSession)
    part = _exploded(docs, "word", known).join(_built(words), "gram").select("doc_id", "key", "times", (F.col("times") * ln(rest("times"))).alias("log"))
    part = written(part.groupBy("doc_id", "key").agg(F.sum("times").alias("n"), F.sum("log").alias("log")), "word-sums")
    drop_written(counts)
    release(docs.sparkSession)

    held = []
    count = F.col("n") - mine("times")
    for turn in range(SLICES):
        table = seen.where(F.pmod("gram", F.lit(SLICES)) == turn)
        more = _exploded(docs, "pair", known, SLICES, turn).join(_built(table), "gram").where(count >= max(min_count, 1))
        more = more.select("doc_id", "key", "times", (F.col("times") * (ln(count) - ln(F.col("c_v") - mine("own_v")) - ln(rest("own_w")))).alias("log"))
        held.append(written(more.groupBy("doc_id", "key").agg(F.sum("times").alias("held"), F.sum("log").alias("log")), "pair-sums"))
        release(docs.sparkSession)
    drop_written(seen)
    zero = F.lit(0).cast("long")
    summed = _keyed(docs).select("doc_id", "key", F.lit(1).cast("long").alias("copies"), zero.alias("n"), zero.alias("held"), F.lit(0.0).alias("log"))
    summed = summed.union(part.select("doc_id", "key", zero, "n", zero, "log"))
    for sums in held:
        summed = summed.union(sums.select("doc_id", "key", zero, zero, "held", "log"))
    summed = summed.groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in ("copies", "n", "held", "log")])
    each = summed.withColumn("backed", F.col("n") - F.col("held"))
    each = each.select("doc_id", *[(F.col(c) / F.col("copies")).alias(c) for c in ("n", "backed", "log")], F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    unseen = F.lit(math.log(backoff)) - ln(F.greatest(F.lit(total) - mine("n"), F.lit(1)))
    log = F.col("log") + F.col("backed") * unseen
    return each.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("backed").cast("long").alias("n_backed_off"),
        log.alias("log_score"),
        F.when(F.col("n") > 0, log / F.col("n")).alias("mean_log_score"),
    )
