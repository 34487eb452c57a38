"""Near-duplicate groups by SimHash fingerprints (operator 3).

A 64-bit fingerprint is cut into 32 segments of two bits.  A segment's bit count
(0, 1 or 2) is kept in unary, so that the Manhattan distance of two count vectors
is the number of differing bits of two longs; it never exceeds the Hamming
distance of the fingerprints.  The vector is cut into ``GROUPS`` groups of
segments.  Vectors at a distance of at most ``max_bits`` agree in at least
``GROUPS - max_bits`` of them, so every choice of that many groups is one grid
whose cell is the vector restricted to them: two linked fingerprints meet in a
cell of at least one grid.  Inside a cell the Manhattan distance is tested first
and the Hamming distance decides.

A cell gives the edges of a spanning forest, not its pairs: what it emits grows
with its members.  A cell of more than ``BLOCK`` fingerprints is dealt as pairs of
blocks, so no task holds an unbounded group and no link is lost.

That exact grid serves few differing bits.  Copies of a five-word Jaccard similarity
of 0.8 differ in about 15 % of the bits, where no choice of whole groups agrees.  For
them (``similar_pairs``) the fingerprint has 256 bits, 128 segments, and each grid
keeps the counts of some segments drawn once: as many that a cell holds few unlike
texts however many there are, and as many grids that a pair of that similarity meets in
one with a chance of ``RECALL``.  Meeting rows are tested by Manhattan and Hamming
distance and by their numbers of shingles.  A cell sends the shortest edges that connect
what passed, and the members of each connected set.  Every edge is then verified by the
exact Jaccard similarity of the shingle sets.  Sets whose members verified edges do not
join are met again, and the pairs between what is still apart are verified too, so a
false edge hides no true one, and no text is dropped without a verified path.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import connected_components, documents, written

GROUPS = 8
BLOCK = 1024
WORDS = 4
SIMILARITY = 0.8
#: Chance that two texts of that similarity meet in a grid.
RECALL = 0.975
#: Differing bits of 256 up to which a pair is verified; at a similarity of 0.8 some 39 differ, with a deviation of 6.
SIMILAR_BITS = 54
#: Rows of a cell that meet in one task, and pairs that a task holds at once.
SIMILAR_BLOCK, PAIRS = 512, 1 << 18
#: Rows with unlike fingerprints that a cell holds by chance; sets the segments a grid keeps.
STRANGERS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; counted in pieces, so a very long text takes little memory."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text``, A-Z lower-cased; no words give 0."""
    return _majority(_shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id long, fp long)`` of every document; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def _forest(unary: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the components that links make among one block."""
    label = np.arange(len(fp))
    for i in range(len(fp)):  # each row merges what it links; labels are component minima
        near = np.flatnonzero(np.bitwise_count(unary[i + 1 :] ^ unary[i]) <= max_bits) + i + 1
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= max_bits]
        if len(near):
            met = np.unique(label[near])
            met = np.union1d(met, label[i : i + 1])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return [(int(fp[i]), int(fp[label[i]])) for i in np.flatnonzero(label != np.arange(len(fp)))]


def _cell_links(max_bits: int):
    def run(batches):
        held = None
        for batch in batches:
            part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            new = np.ones(len(held[0]), bool)
            new[1:] = False
            for col in held[:4]:
                new[1:] |= col[1:] != col[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:  # the last cell may go on in the next batch
                yield _links_of([c[: starts[-1]] for c in held], starts[:-1], max_bits)
                held = [c[starts[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield _links_of(held, np.array([0]), max_bits)

    return run


def _unary(fp: np.ndarray) -> np.ndarray:
    """The bit count of each two-bit segment, in unary."""
    half, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((fp | (fp >> one)) & half) | (((fp & (fp >> one)) & half) << one)


def _links_of(cols: list, starts: np.ndarray, max_bits: int) -> pa.RecordBatch:
    fp = cols[4].view(np.uint64)
    unary = _unary(fp)
    sizes = np.diff(np.append(starts, len(fp)))
    two = starts[sizes == 2]
    two = two[(np.bitwise_count(unary[two] ^ unary[two + 1]) <= max_bits) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits)]
    a, b = [fp[two]], [fp[two + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if edges := _forest(unary[s : s + n], fp[s : s + n], max_bits):
            x, y = np.array(edges, dtype=np.uint64).T
            a.append(x), b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _unary_column(name: str) -> Column:
    half, shifted = F.lit(0x5555555555555555), F.shiftrightunsigned(name, 1)
    low = F.col(name).bitwiseOR(shifted).bitwiseAND(half)
    return low.bitwiseOR(F.shiftleft(F.col(name).bitwiseAND(shifted).bitwiseAND(half), 1))


def links(fps: DataFrame, max_bits: int = 4, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all those within ``max_bits`` bits.

    The edges are spanning forests of cells, so they connect the same fingerprints
    as all links do.  ``groups`` must divide 8-bit wise: 8 groups of four segments.
    """
    if groups != 8 or not 0 <= max_bits < groups:
        raise ValueError("8 groups and fewer bits than groups are supported")
    masks = [sum(0xFF << (8 * g) for g in keep) for keep in combinations(range(groups), groups - max_bits)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        fps.repartition(parts, "fp")  # 70 rows each follow, so few small partitions must not be put together
        .select("fp", _unary_column("fp").alias("unary"))
        .select("fp", "unary", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("grid", "mask"))
        .select("grid", F.col("unary").bitwiseAND(F.col("mask")).alias("cell"), "fp")
    )
    shared = dealt.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    many = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), many).cast("int")
    met = (
        dealt.join(shared.hint("merge"), ["grid", "cell"])  # Spark sizes the exploded rows like the few before, and would broadcast them
        .select("grid", "cell", "fp", mine.alias("i"), F.explode(F.sequence(F.lit(0), many - 1)).alias("j"))
        .select("grid", "cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
        .repartition("grid", "cell", "lo", "hi")
        .sortWithinPartitions("grid", "cell", "lo", "hi")
    )
    return met.mapInArrow(_cell_links(max_bits), "a long, b long")


def near_duplicate_groups(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs (doc_id, text, ...)``.

    fingerprint: 16 lower-case hex digits.  component_id: the smallest doc_id that
    links of at most ``max_bits`` differing bits reach.  Null and blank texts have
    the fingerprint zero and are linked like any other; equal texts share a
    fingerprint; a repeated row keeps its own output row; a null doc_id keeps its
    row and never names a component with other ids.  An empty table gives an empty
    result; further columns of ``docs`` are not read.
    """
    prints = written(fingerprints(docs, shingle, seed), "simhash")
    texts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(texts, max_bits)).withColumnRenamed("node", "fp")
    rooted = texts.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, and their numbers; a text of fewer words is one shingle."""
    data = tv.LOWER[data]
    starts, ends = tv.spans(data, offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    word = np.concatenate([[np.uint64(0)], np.cumsum(tv.hashes(data, starts, ends) * tv.powers(len(starts))[0][: len(starts)])])
    last = np.cumsum(count)
    short = np.flatnonzero((count > 0) & (count < shingle))
    whole = np.flatnonzero(text[: max(len(text) - shingle + 1, 0)] == text[shingle - 1 :])
    at, to = np.concatenate([whole, (last - count)[short]]), np.concatenate([whole + shingle, last[short]])
    hash_ = tv.mix((word[to] - word[at]) * tv.powers(len(starts))[1][at] + (to - at).astype(np.uint64))
    owner = np.concatenate([text[whole], short])
    by = np.lexsort((hash_, owner))
    hash_, owner = hash_[by], owner[by]
    new = np.append(True, (hash_[1:] != hash_[:-1]) | (owner[1:] != owner[:-1]))[: len(hash_)]
    return hash_[new], np.bincount(owner[new], minlength=len(offsets) - 1)


def _wide(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of each text's shingles, as four words; zero without shingles.

    Byte lanes of 64-bit sums count eight bits at once, over at most 255 shingles a sum.
    """
    out = np.zeros((len(counts), WORDS), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    parts = -(-n // 255)
    first = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    of = np.cumsum(parts) - parts
    lanes = np.uint64(0x0101010101010101)
    for k in range(WORDS):
        h = hashes if k == 0 else tv.mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        ones = np.empty((len(some), 64), np.int64)
        for bit in range(8):
            sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, first)
            ones[:, bit::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        out[some, k] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _prints(shingle: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tv.pieces(batch.column(5)):
                hashes, counts = _shingles(data, offsets, shingle)
                wide = _wide(hashes, counts).view(np.int64)
                cols = [pa.array(np.ascontiguousarray(wide[:, k])) for k in range(WORDS)]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:5]], pa.array(counts.astype(np.int64)), *cols], [*_KEY, "t", "n", *_WIDE])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in tv.pieces(batch.column(1)):
                hashes, counts = _shingles(data, offsets, shingle)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))], ["id", "shingles"])

    return run


def _near(ids: list, fp: np.ndarray, n: np.ndarray, starts: np.ndarray, max_bits: int, similarity: float, label: np.ndarray | None = None) -> tuple:
    """Pairs of rows of one cell within the bounds, for many cells at once: ``(a, b, bits)``; rows of one label are no pair."""
    unary = _unary(fp)
    end = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
    i, lag, found = np.arange(len(fp)), 0, []
    while True:
        lag += 1
        i = i[i + lag < end[i]]
        if not len(i):
            break
        a = i if label is None else i[label[i] != label[i + lag]]
        a = a[np.minimum(n[a], n[a + lag]) >= similarity * np.maximum(n[a], n[a + lag])]
        a = a[np.bitwise_count(unary[a] ^ unary[a + lag]).sum(axis=1, dtype=np.int64) <= max_bits]
        bits = np.bitwise_count(fp[a] ^ fp[a + lag]).sum(axis=1, dtype=np.int64)
        close = bits <= max_bits
        found.append((a[close], a[close] + lag, bits[close]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[k] for x in found] or [none]) for k in range(3))


def _connecting(a: np.ndarray, b: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs connect the ``n`` rows as all pairs do, shortest first, and the label of each row's connected set."""
    by = np.argsort(bits, kind="stable")
    label, live, chosen = np.arange(n), by, []
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.concatenate(chosen or [live]), label
        la, lb = label[a[live]], label[b[live]]
        best = np.full(n, len(live))
        np.minimum.at(best, la, np.arange(len(live)))
        np.minimum.at(best, lb, np.arange(len(live)))
        take = np.unique(best[best < len(live)])
        chosen.append(live[take])
        low, high = np.minimum(la[take], lb[take]), np.maximum(la[take], lb[take])
        np.minimum.at(label, high, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def _cells(batches, keys: int, work):
    """Whole cells of sorted batches: ``work(columns, starts)`` for rows whose first ``keys`` columns name the cell.

    Cells are worked on together as long as they have at most ``PAIRS`` pairs, so the
    pairs held at once are bounded by those of one block pair.
    """

    def some(cols: list, starts: np.ndarray):
        ends = np.append(starts[1:], len(cols[0]))
        turn = np.cumsum((ends - starts) ** 2) // (2 * PAIRS)
        cut = np.flatnonzero(np.append(True, turn[1:] != turn[:-1]))
        for a, z in zip(cut, np.append(cut[1:], len(starts))):
            yield from work([c[starts[a] : ends[z - 1]] for c in cols], starts[a:z] - starts[a])

    held = None
    for batch in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        new = np.zeros(len(held[0]), bool)
        new[:1] = True
        for col in held[:keys]:
            new[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:  # the last cell may go on in the next batch
            yield from some([c[: starts[-1]] for c in held], starts[:-1])
            held = [c[starts[-1] :] for c in held]
    if held is not None and len(held[0]):
        yield from some(held, np.array([0]))


def _words_of(cols: list) -> np.ndarray:
    return np.stack(cols, axis=1).view(np.uint64)


_FOUND = ["kind", "a", "b"]


def _edges_and_sets(max_bits: int, similarity: float):
    """Of cells ``(cell, lo, hi, id, n, w0..w3)``: rows ``(0, a, b)`` for edges, ``(1, set, member)`` for connected sets of three and more."""

    def work(cols: list, starts: np.ndarray):
        ids, n, fp = cols[3], cols[4], _words_of(cols[5:])
        a, b, bits = _near(ids, fp, n, starts, max_bits, similarity)
        take, label = _connecting(a, b, bits, len(ids))
        name = np.zeros(len(ids), np.uint64)
        np.add.at(name, label, tv.mix(ids.view(np.uint64)))  # equal sets of several grids have one name
        many = np.flatnonzero(np.bincount(label, minlength=len(ids))[label] > 2)
        kind = np.concatenate([np.zeros(len(take), np.int32), np.ones(len(many), np.int32)])
        left = np.concatenate([np.minimum(ids[a[take]], ids[b[take]]), name[label[many]].view(np.int64)])
        right = np.concatenate([np.maximum(ids[a[take]], ids[b[take]]), ids[many]])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(left), pa.array(right)], _FOUND)

    return lambda batches: _cells(batches, 3, work)


def _pairs_between(max_bits: int, similarity: float):
    """Of sets ``(set, id, root, n, w0..w3)`` the pairs of members with different roots."""

    def work(cols: list, starts: np.ndarray):
        ids, root, n, fp = cols[1], cols[2], cols[3], _words_of(cols[4:])
        a, b, _ = _near(ids, fp, n, starts, max_bits, similarity, root)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    return lambda batches: _cells(batches, 1, work)


def grid_plan(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Segments that a grid keeps, and grids, for so many distinct fingerprints.

    Counts of a segment agree by chance with 3/8.  For two texts of the similarity a
    bit differs with q, and the counts agree with (1 - q)^2 + q^2 / 2.
    """
    segments = min(32, max(6, math.ceil(math.log(max(rows, 1) / STRANGERS, 8 / 3)))) if rows > STRANGERS else 6
    q = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meets = ((1 - q) ** 2 + q * q / 2) ** segments
    return segments, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def similar_pairs(classes: DataFrame, max_bits: int = SIMILAR_BITS, similarity: float = SIMILARITY, recall: float = RECALL, block: int | None = None) -> DataFrame:
    """``(kind, a, b)`` for ``classes (id, n, w0..w3)``: edges (kind 0) and members of connected sets (kind 1), as ``_edges_and_sets`` says.

    ``id`` is unique.  A cell of more than ``block`` rows (``SIMILAR_BLOCK``) is dealt as pairs of blocks.
    """
    spark, block = classes.sparkSession, block or SIMILAR_BLOCK
    segments, grids = grid_plan(classes.count(), similarity, recall)
    rng = np.random.default_rng(1)
    kept = [rng.choice(32 * WORDS, segments, replace=False) for _ in range(grids)]
    masks = [[sum(3 << (2 * int(s) % 64) for s in g if s // 32 == w) for w in range(WORDS)] for g in kept]
    signed = [[m - (1 << 64) if m >= 1 << 63 else m for m in row] for row in masks]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.repartition(parts, "id").select("id", "n", *_WIDE, *[_unary_column(w).alias(f"u{k}") for k, w in enumerate(_WIDE)])
    cells = [F.xxhash64(F.lit(g), *[F.col(f"u{k}").bitwiseAND(F.lit(signed[g][k]).cast("long")) for k in range(WORDS)]) for g in range(grids)]
    dealt = dealt.select("id", "n", *_WIDE, F.explode(F.array(*cells)).alias("cell"))
    shared = dealt.groupBy("cell").agg(F.count("*").alias("_m")).where("_m > 1")
    many = F.ceil(F.col("_m") / block).cast("int")
    met = (
        dealt.join(shared.hint("merge"), "cell")  # neither side is broadcast, as in ``links``
        .select("cell", "id", "n", *_WIDE, F.pmod(F.xxhash64("id"), many).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), many - 1)).alias("j"))
        .select("cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "id", "n", *_WIDE)
        .repartition("cell", "lo", "hi")
        .sortWithinPartitions("cell", "lo", "hi")
    )
    return met.mapInArrow(_edges_and_sets(max_bits, similarity), "kind int, a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs (a, b)`` whose shingle sets have at least the similarity; ``texts (id, text)`` holds each id once."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = written(texts.join(needed, "id", "left_semi").mapInArrow(_sets(shingle), "id long, shingles array<long>"), "shingles")
    one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    met = pairs.join(one, "a").join(two, "b").where(both / (F.size("_a") + F.size("_b") - both) >= similarity)
    return written(met.select("a", "b"), "verified")


_KEY = ["z", "i", "h", "g"]
_WIDE = [f"w{k}" for k in range(WORDS)]


def one_of_each_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, max_bits: int = SIMILAR_BITS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of texts that paths of verified pairs connect one row, with all its columns.

    A pair is verified if the Jaccard similarity of its distinct ``shingle``-word
    shingles (A-Z lower-cased) is at least ``similarity``; a text of fewer words is
    one shingle.  Pairs are found by chance, above ``recall`` less what ``max_bits``
    loses; nothing that was not verified is linked.  The row that stays is that of
    the smallest id (null last); of several rows of that id the one whose text, then
    whose other columns have the smallest hash; rows equal in all columns are one.
    Null and blank texts form a group and are linked to no other text.  A text of
    any length is fingerprinted in one task.  An empty table stays empty.
    """
    i, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    key = [i.isNull().cast("int").alias("z"), F.coalesce(i, F.lit(0)).alias("i"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), *docs.columns).alias("g")]
    schema = "z int, i long, h long, g long, t long, n long, " + ", ".join(f"{w} long" for w in _WIDE)
    prints = written(docs.select(*key, F.xxhash64(F.lit(3), text).alias("t"), text.alias("text")).mapInArrow(_prints(shingle), schema), "simhash")
    some = F.col("n") > 0
    first = prints.groupBy(F.when(some, F.col("h")).alias("id"), F.when(some, F.col("t")).alias("t")).agg(F.min(F.struct(*_KEY)).alias("k"), F.min(F.struct("n", *_WIDE)).alias("s"))
    lead = (F.col("t") == F.min("t").over(Window.partitionBy("id"))).alias("lead")  # another text of the same hash is linked to none
    first = written(first.select("id", "t", "k", "s", lead), "classes")
    leads = first.where("lead")
    texts = docs.select(*key, text.alias("text")).join(leads.select("id", "k.*"), _KEY).dropDuplicates(["id"]).select("id", "text")
    classes = leads.select("id", "s.*")

    found = written(similar_pairs(classes, max_bits, similarity, recall), "similar")
    edges = found.where("kind = 0").select("a", "b")
    good = _verified(edges, texts, shingle, similarity)
    roots = written(connected_components(good), "roots")
    members = found.where("kind = 1").select(F.col("a").alias("set"), F.col("b").alias("id"))
    members = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = members.groupBy("set").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo != _hi").select("set")
    again = members.join(apart, "set").join(classes, "id").select("set", "id", "root", "n", *_WIDE).repartition("set").sortWithinPartitions("set")
    more = again.mapInArrow(_pairs_between(max_bits, similarity), "a long, b long").distinct().join(edges, ["a", "b"], "left_anti")
    good = good.union(_verified(written(more, "between"), texts, shingle, similarity))

    roots = connected_components(good).withColumnRenamed("node", "id")
    roots = roots.withColumn("lead", F.lit(True))
    kept = first.join(roots, ["id", "lead"], "left").groupBy(F.coalesce("root", "id"), F.when(F.col("root").isNull(), F.col("t"))).agg(F.min("k").alias("k")).select("k.*")
    rows = docs.select(*key, F.struct(*docs.columns).alias("_row"))
    return rows.join(kept, _KEY, "left_semi").dropDuplicates(_KEY).select("_row.*")
