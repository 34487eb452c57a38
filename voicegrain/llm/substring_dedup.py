"""Removal of repeated token windows by Rabin-Karp hashes (operator 12).

The texts are put into global order once, by id, and written.  Every window of
``WINDOW`` words gets a 64-bit polynomial hash, taken from running sums of its words'
hashes; a second, independent one deals it to a bucket.  Consecutive texts of about a
megabyte are a segment, which sends each bucket one row: the hashes of its windows in
order, each hash once, since any further one in the segment repeats an earlier window
anyway.  A very common window so adds one number a segment to one bucket.  A bucket
counts the hashes of all segments in order and answers each segment with a bit a hash:
whether an earlier segment had it.  The segment's texts meet these bits again, the
windows that are not the first of their kind are marked, and the marked runs of words,
which are the maximal intervals, go.

Buckets hold about ``BUCKET_BYTES`` of text's windows at any size of the input, so a
bucket's memory does not grow.  Within one bucket a false match of two 64-bit hashes
has a chance near one in ten million, and as buckets grow in number, not in size, the
expected number of them in 100 TB is about one.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import keyed, written

WINDOW = 20
SEGMENT_BYTES = 1 << 20
BUCKET_BYTES = 1 << 24
#: Odd multipliers of the two polynomials.
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of words, a megabyte of text at a time."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + tv.CHUNK_BYTES, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        out.append(tv.hashes(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo))
        at = to
    return np.concatenate(out)


def _rolled(word: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial hash of every ``window`` consecutive words."""
    n = len(word)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(b))])) for b in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(word * up[:n])])
    return tv.mix((sums[window:] - sums[:-window]) * down[: n - window + 1])


class Segment:
    """The windows of consecutive texts: where they start, and the first of each kind by bucket."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, buckets: int):
        starts, ends = tv.spans(data, offsets)
        text = np.searchsorted(offsets, starts, side="right") - 1
        self.counts = np.bincount(text, minlength=len(offsets) - 1)
        self.n, self.window = len(starts), window
        if self.n < window:
            self.at = self.first = np.zeros(0, np.int64)
            self.bucket, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        word = _words(data, starts, ends)
        inside = text[: self.n - window + 1] == text[window - 1 :]
        self.at = np.flatnonzero(inside)
        hash_, deal = (_rolled(word, window, b)[inside] for b in _BASES)
        first = np.sort(np.unique(hash_, return_index=True)[1])
        bucket = (deal[first] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        self.first, self.bucket, self.hash = first[by], bucket[by], hash_[first[by]]

    def requests(self) -> tuple[np.ndarray, list[bytes]]:
        """The buckets and the hashes for each."""
        cut = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])[: len(self.bucket)])
        ends = np.append(cut[1:], len(self.bucket))
        return self.bucket[cut], [self.hash[a:z].tobytes() for a, z in zip(cut, ends)]

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Whether each word is in a window that is not the first of its kind; answers are bits for a bucket's hashes."""
        known = np.zeros(len(self.first), bool)
        for bucket, bits in answers:
            a, z = np.searchsorted(self.bucket, [bucket, bucket + 1])
            known[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a).astype(bool)
        repeats = np.ones(len(self.at), bool)
        repeats[self.first[~known]] = False
        cover = np.zeros(self.n + 1, np.int64)
        cover[self.at[repeats]] += 1
        ends = self.at[repeats] + self.window
        cover[ends] -= 1
        return np.cumsum(cover[: self.n]) > 0


def _requests(window: int, buckets: int):
    def run(batches):
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1), len(at)]  # a batch may hold rows of several files, in any order
            for a, z in zip(cuts[:-1], cuts[1:]):
                for lo, hi, data, offsets in tv.pieces(b.column(1).slice(a, z - a), SEGMENT_BYTES):
                    first = at[a + lo]
                    which, hashes = Segment(data, offsets, window, buckets).requests()
                    if not len(which):  # without any window it still gets an answer
                        which, hashes = np.array([first % buckets]), [b""]
                    same = lambda v: pa.array(np.full(len(which), v, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(which), same(first), same(hi - lo), pa.array(hashes, pa.binary())], ["bucket", "at", "texts", "hashes"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each segment's hashes of one bucket a bit whether a segment before has them, or null if none is known."""
    table = table.sort_by("at")
    blobs = table.column("hashes").to_pylist()
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    known = np.ones(len(hashes), bool)
    known[np.unique(hashes, return_index=True)[1]] = False
    cuts = np.cumsum([0, *[len(x) // 8 for x in blobs]])
    bits = [np.packbits(known[a:z]).tobytes() if known[a:z].any() else None for a, z in zip(cuts[:-1], cuts[1:])]
    return pa.table({**{c: table.column(c) for c in ("at", "texts", "bucket")}, "bits": pa.array(bits, pa.binary())})


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(window: int, buckets: int):
    """Rows ``(at, texts, answers, z, i, text)`` of partitions in order: a segment's row of ``texts`` and answers, then its texts."""

    def done(texts: list, keys: list, answers: list) -> pa.RecordBatch:
        column = pa.array(texts, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        found = Segment(data, offsets, window, buckets)
        gone = found.removed(answers)
        ends = np.cumsum(found.counts)
        n_removed, kept = [], []
        for text, a, z in zip(texts, ends - found.counts, ends):
            stay = ~gone[a:z]
            n_removed.append(int(z - a - stay.sum()))
            kept.append(b" ".join(compress(text.encode("utf-8", "surrogatepass").split(), stay)).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found.counts.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    def run(batches):
        left, texts, keys, answers = 0, [], [], []
        for b in batches:
            for at, n, given, z, i, text in zip(*[c.to_pylist() for c in b.columns]):
                if n:
                    left, answers = n, [(x["bucket"], x["bits"]) for x in given]
                    continue
                texts.append(text), keys.append(None if z else i)
                left -= 1
                if not left:
                    yield done(texts, keys, answers)
                    texts, keys = [], []

    return run


def remove_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without the words of every window whose words also start earlier: ``(doc_id, n_words, n_removed, kept)``.

    Words are runs of bytes other than space and tab to carriage return, unchanged.
    Earlier is a smaller id, then an earlier start; null ids come last, and texts of
    one id are ordered by their hash.  Of rows equal in id and text one is the first,
    so the others lose all their windows.  Windows are judged on the input.  kept
    joins the words that stay with one blank; a text of fewer words than a window
    loses none; a null text has none.  A very long text is a segment of its own and
    is hashed in pieces.  An empty table gives no rows; other columns are not read.
    """
    spread = keyed(docs, id_col, text_col).select("z", "i", "h", "text", F.monotonically_increasing_id().alias("_spread"))
    order = ["z", "i", "h", "_spread"]
    dealt = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    base = written(dealt.select(F.monotonically_increasing_id().alias("at"), "z", "i", "text"), "ordered")

    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    sent = base.select("at", "text").mapInArrow(_requests(window, buckets), "bucket long, at long, texts long, hashes binary")
    answered = written(sent.groupBy("bucket").applyInArrow(_answer, "at long, texts long, bucket long, bits binary"), "answers")
    given = F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("bucket", "bits"))).alias("answers")  # a bit a word at most
    heads = answered.groupBy("at").agg(F.max("texts").alias("texts"), given)
    heads = heads.select("at", "texts", "answers", F.lit(0).alias("z"), F.lit(0).cast("long").alias("i"), F.lit("").alias("text"))
    none = F.array().cast("array<struct<bucket:bigint,bits:binary>>")
    texts = base.select("at", F.lit(0).cast("long").alias("texts"), none.alias("answers"), "z", "i", "text")
    met = heads.union(texts).repartition(F.shiftright("at", 33)).sortWithinPartitions("at", F.desc("texts"))
    return met.mapInArrow(_cut(window, buckets), _KEPT)
