"""Imports, labels and lists: inserting what is absent, folding order lines, overriding by people, paging, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is new, one for each key. A null key is never a duplicate."""
    keyed = incoming.where(F.col(key).isNotNull()).dropDuplicates([key])
    return keyed.join(existing.select(key), key, "left_anti").unionByName(incoming.where(F.col(key).isNull()).select(keyed.columns))


def insert_report(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: how many rows ``insert_absent`` takes and how many it leaves."""
    new = insert_absent(existing, incoming, key).agg(F.count("*").alias("inserted"))
    return incoming.agg(F.count("*").alias("n")).crossJoin(F.broadcast(new)).select("inserted", (F.col("n") - F.col("inserted")).alias("duplicates"))


def fold_order_lines(lines: DataFrame, order: str, line: str, quantity: str, amount: str) -> DataFrame:
    """Orders of several lines as one row: the quantities summed, the first amount that is there (the smaller of equal lines)."""
    first = F.min(F.when(F.col(amount).isNotNull(), F.struct(F.col(line).alias("l"), F.col(amount).alias("a"))))
    return lines.groupBy(F.col(order).alias("order_id")).agg(F.sum(quantity).alias("quantity"), first["a"].alias("amount"), F.count("*").alias("lines"))


def human_labels(items: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """People's labels over the machine's, which stay in ``machine_<column>``; a null label leaves the machine's.

    ``labels`` has one row for each key.
    """
    said = labels.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_said"))
    rows = items.join(said, key, "left")
    for c in columns:
        rows = rows.withColumn(f"machine_{c}", F.col(c)).withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return rows.withColumn("by_human", F.coalesce("_said", F.lit(False))).drop("_said")


def review_override(items: DataFrame, labels: DataFrame, key: str = "feedback_id") -> DataFrame:
    """Bands and weights after review: valid rows count with their tier's weight and do not age, spam and fakes count nothing."""
    return overridden(labelled(items, labels, key))


def labelled(items: DataFrame, labels: DataFrame, key: str = "feedback_id") -> DataFrame:
    """``items`` with the ``_label`` of their review, if any; ``labels`` holds each key once."""
    return items.join(labels.select(key, F.col("label").alias("_label")), key, "left")


def overridden(rows: DataFrame) -> DataFrame:
    """``review_override`` of rows that are ``labelled``."""
    valid, spam, fake = (F.col("_label") == x for x in ("valid", "spam", "inauthentic"))
    band = F.when(valid, "ACCEPTED").when(spam, "SPAM").when(fake, "LIKELY_INAUTHENTIC").otherwise(F.col("band"))
    weight = F.when(valid, F.col("tier_weight")).when(spam | fake, 0.0).otherwise(F.col("weight"))
    return rows.withColumn("band", band).withColumn("weight", weight).drop("_label")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page ``number`` (from 1) of ``size`` rows, 200 at most."""
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def audit_sample(rows: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows without replacement, the same for the same seed: those of the smallest SHA-1 of key and seed."""
    return rows.orderBy(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key).limit(size)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def overlap(docs: DataFrame, words: Column, a: str, b: str) -> DataFrame:
    """One row: how the rows that hold the term ``a`` overlap with those that hold ``b``."""
    has = docs.select(F.array_contains(words, a).alias("a"), F.array_contains(words, b).alias("b"))
    n = has.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") | F.col("b")).alias("either"), F.least(F.count_if("a"), F.count_if("b")).alias("_least"))
    share = lambda d: F.round(F.try_divide(F.col("shared").cast("double"), F.col(d)), 6)
    return n.select("shared", "either", share("either").alias("jaccard"), share("_least").alias("overlap"))


def fingerprint(*tables: tuple[DataFrame, str]) -> DataFrame:
    """One row with ``count:largest key`` of each table, to tell whether anything changed."""
    parts = [t.agg(F.concat_ws(":", F.count("*").cast("string"), F.max(k).cast("string")).alias(f"p{i}")) for i, (t, k) in enumerate(tables)]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # one row each
    return one.select(F.concat_ws(":", *one.columns).alias("version"))
