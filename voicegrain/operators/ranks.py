"""Ranks, running values and exact medians over all rows, without a task that holds them all.

Rows are put in order by a range exchange and written.  A running value is one window
inside each range, combined with one offset row for each range; those rows number as
the shuffle partitions, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

_FOLD = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with ``rank``, from 1, by ``order``, and ``_part``, the range.  The order should be total."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = kept(at, "ranks").withColumn("_part", F.shiftright("_at", 33))
    each = at.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = each.select("_part", (before + 1 - F.col("_first")).alias("_offset"))
    return at.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_offset")


def running(ordered: DataFrame, value: Column, name: str, kind: str = "sum", upwards: bool = False) -> DataFrame:
    """``ordered`` (``in_order``) with ``name``: the ``kind`` of ``value`` over all rows up to this one, or from it on."""
    fold, both = _FOLD[kind]
    rows = ordered.withColumn("_v", value)
    inside = (Window.unboundedPreceding, 0) if not upwards else (0, Window.unboundedFollowing)
    outside = (Window.unboundedPreceding, -1) if not upwards else (1, Window.unboundedFollowing)
    each = rows.groupBy("_part").agg(fold("_v").alias("_all"))  # a row a range
    others = each.select("_part", fold("_all").over(Window.orderBy("_part").rowsBetween(*outside)).alias("_others"))
    here = rows.withColumn("_here", fold("_v").over(Window.partitionBy("_part").orderBy("rank").rowsBetween(*inside)))
    return here.join(F.broadcast(others), "_part").withColumn(name, both(F.col("_here"), F.col("_others"))).drop("_v", "_here", "_others")


def median(rows: DataFrame, value: str) -> DataFrame:
    """One row ``(n, median)`` of the values that are not null: the middle one, or the mean of the two in the middle."""
    ordered = in_order(rows.where(F.col(value).isNotNull()).select(value), value)
    n = ordered.agg(F.count("*").alias("n"))
    middle = ordered.crossJoin(F.broadcast(n)).where(F.col("rank").isin(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))  # n: one row
    found = middle.agg(F.avg(value).alias("median"))
    return n.crossJoin(F.broadcast(found))  # one row each
