"""Benchmark decontamination by a prefix-filtered containment join (operator 10).

A window (``window`` consecutive words of a benchmark item, or a whole shorter
item) occurs in a document only if each of its words does, so its one rarest word
is a sufficient prefix for an exact containment join.  Words are ordered by how
often the documents hold them.  The positions of prefix words in the items are
joined to the positions of the same words in the documents; each meeting is an
alignment of an item with a document, kept if the length and position bounds leave
room for a window, and then verified word by word over the item's size.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table made from the benchmark is broadcast if its rows have at most so many bytes, as counted; a larger one is joined by shuffles.
BROADCAST_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct word sequence: ``(item, item_ids, item_words)``."""
    seen = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("item_words"))
    return (
        seen.where(F.size("item_words") > 0)
        .groupBy("item_words")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .select(F.sha2(F.array_join("item_words", " "), 256).alias("item"), "item_ids", "item_words")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
    keep: tuple = (),
) -> DataFrame:
    """``docs`` with what of each text occurs in ``benchmark``; every row of ``docs`` stays once.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``item_ids``
    (sorted array of the items with occurring windows) and ``contaminated`` to the
    id and text.  Null and empty texts have no words; items without words have no
    windows; items of equal words share their hits; null item ids are left out of
    ``item_ids`` but their windows count as hits; rows with equal id and text are
    judged alike; either table may be empty.  Of the other columns of ``docs`` those
    named in ``keep`` follow; the rest are dropped, so names cannot clash.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("_h"))
    base = base.withColumn("_k", F.xxhash64("doc_id", "_h"))
    rest = [F.struct(*[F.col(c) for c in keep]).alias("_rest")] if keep else []
    full = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("_h"), *rest).withColumn("_k", F.xxhash64("doc_id", "_h"))
    items = _items(benchmark, item_id_col, item_text_col)
    items = written(items, "items")

    def small(table: DataFrame, *texts: str) -> DataFrame:
        """``table``, broadcast if what its rows hold is within the bound."""
        size = table.agg(F.sum(sum((F.octet_length(F.concat_ws(" ", c)) for c in texts), F.lit(64))).alias("n")).first()["n"] or 0
        return F.broadcast(table) if size <= BROADCAST_BYTES else table

    # rarity: how often the documents hold each word of the benchmark
    vocabulary = items.select(F.explode("item_words").alias("word")).distinct()
    counts = base.select(F.explode(words(F.col("text"))).alias("word")).join(small(vocabulary, "word"), "word").groupBy("word").agg(F.count("*").alias("n"))

    placed = items.select("item", F.size("item_words").alias("len"), F.posexplode("item_words").alias("at", "word"))
    rarity = placed.join(counts, "word", "left").fillna(0, ["n"])
    w = F.least(F.col("len"), F.lit(window))
    prefix = (
        rarity.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - w + 1), F.least(F.col("at"), F.col("len") - w))))
        .groupBy("item", "len", "start")
        .agg(F.min(F.struct("n", "word", "at")).alias("rarest"))
        .where("rarest.n > 0")
        .select("item", "len", F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"))
        .distinct()
    )
    prefix = written(prefix, "prefix-words")

    held = base.select("doc_id", "_h", "_k", words(F.col("text")).alias("_w"))
    held = held.select("doc_id", "_h", "_k", F.size("_w").alias("n"), F.posexplode("_w").alias("pos", "word"))
    met = held.join(small(prefix, "item", "word"), "word").withColumn("shift", F.col("pos") - F.col("at"))
    room = F.least(F.col("n"), F.col("shift") + F.col("len")) - F.greatest(F.lit(0), F.col("shift"))
    # an alignment is kept once before the words of its item are fetched
    kept = met.where(room >= w).select("_k", "doc_id", "_h", "item", "shift").distinct()
    aligned = (
        kept.join(small(items.select("item", "item_ids", "item_words"), "item", "item_ids", "item_words"), "item")
        .groupBy("_k", "doc_id", "_h")
        .agg(F.collect_list(F.struct("shift", "item_ids", "item_words")).alias("_met"))
        .select(F.col("_k").alias("_j"), F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), "_met")
    )

    same = (F.col("_k") == F.col("_j")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g"))
    both = full.join(aligned, same, "left")
    # a generator of one row: the optimiser cannot move the split into each expression that reads the words
    both = both.select("doc_id", "text", F.explode(F.array(words(F.col("text")))).alias("_w"), "_met", *["_rest"] * bool(keep))

    def starts(met: Column) -> Column:
        """Where, in the document, windows of the item occur under this alignment."""
        size = F.least(F.size(met["item_words"]), F.lit(window))
        first = F.greatest(F.lit(0), -met["shift"])
        last = F.least(F.size(met["item_words"]), F.size("_w") - met["shift"]) - size
        fits = F.filter(
            F.sequence(first, last),
            lambda j: F.slice(F.col("_w"), met["shift"] + j + 1, size) == F.slice(met["item_words"], j + 1, size),
        )
        return F.struct(F.transform(fits, lambda j: j + met["shift"]).alias("at"), size.alias("size"), met["item_ids"].alias("ids"))

    verified = F.filter(F.transform("_met", starts), lambda v: F.size(v["at"]) > 0)
    both = both.withColumn("_v", F.coalesce(verified, F.array().cast("array<struct<at:array<int>,size:int,ids:array<string>>>")))
    covered = F.flatten(F.transform("_v", lambda v: F.flatten(F.transform(v["at"], lambda s: F.sequence(s, s + v["size"] - 1)))))
    return both.select(
        "doc_id",
        "text",
        F.size("_w").cast("long").alias("n_words"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_v", lambda v: v["ids"])))).alias("item_ids"),
        (F.size("_v") > 0).alias("contaminated"),
        *["_rest.*"] * bool(keep),
    )
