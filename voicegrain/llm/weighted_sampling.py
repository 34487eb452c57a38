"""Document fingerprints by consistent weighted sampling (operator 2).

A text is a set of words weighted by their counts.  For each of ``samples`` slots,
a word of weight S draws from its own hash r, c ~ Gamma(2, 1) and b ~ U(0, 1) and
takes t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the slot holds a hash
of the (word, t) with the smallest a.  Two texts agree in a slot with a probability
that is their generalised Jaccard similarity.

Only DataFrame functions are used.  A slot's minimum is taken over one long: ln a
as a fixed-point number above, the 24-bit hash of (word, t) below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLES = 48
LANE = 4
_GAP = r"[\x09-\x0D\x20]+"
_NULL_ID = -(1 << 63)


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number inside (0, 1) from ``width`` bits of a long."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) * (2.0**-width)


def _draws(slot: Column) -> list[Column]:
    """r, ln c and b of the word hash ``th`` in a slot."""
    one, two = F.xxhash64("th", 2 * slot), F.xxhash64("th", 2 * slot + 1)
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    ln_c = F.ln(-F.ln(_uniform(two, 0, 22) * _uniform(two, 22, 21)))
    return [r, ln_c, _uniform(two, 43, 21)]


def _packed(slot: Column, ln_w: Column, r: Column, ln_c: Column, b: Column) -> Column:
    """ln a above, 24 bits that tell (word, t) below; null without a weight."""
    t = F.floor(ln_w / r + b)
    fixed = ((ln_c - r * (t - b + 1) + 128) * float(1 << 30)).cast("long")
    return F.shiftleft(fixed, 24).bitwiseOR(F.xxhash64("th", slot, t).bitwiseAND(F.lit(0xFFFFFF)))


def fingerprints_of_pairs(pairs: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and the slots ``f0``, ``f1`` (array<int>, -1: no words) of the texts ``t0``, ``t1``.

    ``copies`` says how many equal rows of ``pairs`` share the keys.  If ``pairs`` is
    partitioned by the keys already, nothing is shuffled.  Slots are drawn ``LANE``
    at a time, one row for each word and lane: r, c and b are computed once for the
    weights of both texts, and generated code stays small enough to be compiled.
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("t0").alias("body")), F.struct(F.lit(1).alias("side"), F.col("t1").alias("body"))))
    bodies = pairs.select(*keys, "copies", sides.alias("s"))
    terms = (
        bodies.select(*keys, "copies", "s.side", F.explode(F.split("s.body", _GAP)).alias("term"))
        .groupBy(*keys, "copies", "term")
        .agg(F.sum(1 - F.col("side")).alias("w0"), F.sum("side").alias("w1"))
    )
    # a word of no weight has no logarithm (null), and the empty string is no word
    logs = [F.when((F.col(w) > 0) & (F.col("term") != ""), F.ln(F.col(w) / F.col("copies"))).alias(n) for w, n in (("w0", "l0"), ("w1", "l1"))]
    lanes = F.explode(F.array(*[F.lit(i) for i in range(0, samples, LANE)])).alias("lane")
    drawn = terms.select(*keys, F.xxhash64("term").alias("th"), *logs).select("*", lanes)
    slot = [F.col("lane") + j for j in range(LANE)]
    drawn = drawn.select(*keys, "lane", "th", "l0", "l1", *[c.alias(f"{n}{j}") for j in range(LANE) for n, c in zip("rcb", _draws(slot[j]))])
    least = [F.min(_packed(slot[j], F.col(f"l{side}"), *[F.col(f"{n}{j}") for n in "rcb"])).alias(f"m{side}_{j}") for j in range(LANE) for side in (0, 1)]
    mins = drawn.groupBy(*keys, "lane").agg(*least)
    held = lambda side: F.array(*[F.coalesce(F.col(f"m{side}_{j}").bitwiseAND(F.lit(0xFFFFFF)), F.lit(-1)).cast("int") for j in range(LANE)])
    by_lane = mins.select(*keys, F.struct("lane", held(0).alias("f0"), held(1).alias("f1")).alias("s"))
    whole = by_lane.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return whole.select(*keys, *[F.flatten(F.col(f"s.{f}")).alias(f) for f in ("f0", "f1")])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of slots in which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))


def as_text(slots: Column) -> Column:
    """Six lower-case hex digits a slot; dashes where a text has no words."""
    return F.array_join(F.transform(slots, lambda v: F.when(v < 0, F.lit("------")).otherwise(F.lower(F.lpad(F.hex(v), 6, "0")))), "")


def _in_a_ring(keys: DataFrame) -> DataFrame:
    """Adds ``next_i, next_h``: the key that follows in descending order of (i, h); the first follows the last.

    The keys are range-partitioned; a window inside each partition finds the
    neighbours, and one row a partition links the partitions.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("i").desc(), F.col("h").desc()]
    dealt = written(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ring")
    inner = Window.partitionBy("part").orderBy(*order)
    every = Window.orderBy("part")
    heads = dealt.groupBy("part").agg(F.max(F.struct("i", "h")).alias("head"))
    after = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("after"))
    led = dealt.withColumn("follows", F.lead(F.struct("i", "h")).over(inner)).join(F.broadcast(after), "part")
    follows = F.coalesce("follows", "after")
    return led.select("i", "h", "n", "copies", follows["i"].alias("next_i"), follows["h"].alias("next_h"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; one row per row of ``docs``.

    The edited text has its last floor(n / 3) code points replaced by the first as
    many (or all) of the next document, in descending doc_id and after the last the
    first.  A null text is empty; texts without words are alike among themselves
    and unlike others; equal ids are ordered by a hash of the text, equal rows are
    one place of the order but keep a row each; a null id comes last; a lone
    document follows itself; an empty table gives no rows; other columns are not
    read.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("i", F.xxhash64("text").alias("h"), "text")
    ring = _in_a_ring(base.select("i", "h", F.char_length("text").alias("n")).groupBy("i", "h", "n").agg(F.count("*").alias("copies")))
    ring = written(ring, "ring-next")
    giver = ring.select(F.col("next_i").alias("i"), F.col("next_h").alias("h"), F.col("i").alias("to_i"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    placed = ring.join(giver, ["i", "h"])

    # both uses below read one exchange of the texts
    joined = base.repartition(parts, "i", "h").join(placed, ["i", "h"])
    pieces = joined.groupBy("i", "h").agg(F.first("to_i").alias("to_i"), F.first("to_h").alias("to_h"), F.first(F.substring("text", F.lit(1), F.col("k"))).alias("piece"))
    pieces = pieces.select(F.col("to_i").alias("i"), F.col("to_h").alias("h"), "piece").repartition(parts, "i", "h")
    both = joined.join(pieces, ["i", "h"])
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), F.col("piece"))
    both = both.select("i", "h", "n", "copies", "next_i", "next_h", F.col("text").alias("t0"), edited.alias("t1"))

    prints = fingerprints_of_pairs(both.select("i", "h", "copies", "t0", "t1"), ["i", "h"], samples)
    facts = both.select("i", "h", "n", F.sha2("t1", 256).alias("edited_sha256"), "next_i", "next_h")
    own = written(facts.join(prints, ["i", "h"]), "prints")
    other = own.select(F.col("i").alias("next_i"), F.col("h").alias("next_h"), F.col("f0").alias("g0")).distinct()
    return own.join(other, ["next_i", "next_h"]).select(
        F.when(F.col("i") != _NULL_ID, F.col("i")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("f0")).alias("fingerprint"),
        as_text(F.col("f1")).alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1"), samples).alias("near_edited"),
        likeness(F.col("f0"), F.col("g0"), samples).alias("near_next"),
    )


def standard_error(similarity: float, samples: int = SAMPLES) -> float:
    """The standard error of ``likeness`` at a true similarity."""
    return math.sqrt(similarity * (1 - similarity) / samples)
