"""Filters that every question shares, and what feeds the review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_of() -> Column:
    """When a row happened; null where its date was only inferred at import."""
    return F.when(~F.coalesce(F.col("time_inferred"), F.lit(False)), F.col("ts"))


def within(at: Column, since: str | None, until: str | None) -> Column:
    """``since <= at <= until``; an open end does not narrow, and with any bound a null time is outside."""
    low = [at >= F.lit(since).cast("timestamp")] if since else []
    high = [at <= F.lit(until).cast("timestamp")] if until else []
    fits = F.lit(True)
    for part in low + high:
        fits = fits & part
    return F.coalesce(fits, F.lit(False))


def common_filter(rows: DataFrame, since: str | None = None, until: str | None = None, **equal: str | None) -> DataFrame:
    """Rows of the given source, product and region (``All`` or None: any) inside the time bounds; inferred dates fail any bound."""
    for column, value in equal.items():
        if value not in (None, "All"):
            rows = rows.where(F.col(column) == value)
    return rows.where(within(time_of(), since, until)) if since or until else rows


def order_scope(orders: DataFrame, since: str | None = None, until: str | None = None, **equal: str | None) -> DataFrame:
    """Orders in the scope of the same filter: by day of delivery, else of ordering; orders have no channel, so it cannot narrow them."""
    for column, value in equal.items():
        if column != "source" and value not in (None, "All"):
            orders = orders.where(F.col(column) == value)
    return orders.where(within(F.coalesce("delivered_at", "ordered_at"), since, until)) if since or until else orders


def any_after(rows: DataFrame, now: str) -> DataFrame:
    """One row: whether any row lies after ``now`` (a store that replays a future period)."""
    return rows.where(F.col("ts") > F.lit(now).cast("timestamp")).limit(1).agg((F.count("*") > 0).alias("replay"))


def in_audit_queue(mode: str) -> Column:
    """Which rows a review queue shows: suspected sarcasm that no person has judged, rows that need review, or any."""
    if mode == "sarcasm":
        return F.coalesce(F.col("suspected") & (F.coalesce("suspected_by", F.lit("")) != "human"), F.lit(False))
    return F.coalesce(F.col("needs_review"), F.lit(False)) if mode == "review" else F.lit(True)


def newest_first(rows: DataFrame, key: str) -> DataFrame:
    """The order in which rows are scanned; ties by key, so it is total."""
    return rows.orderBy(F.desc("ts"), key)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A random sample of ``n`` rows that depends on seed and key alone; a top-n, never a full sort."""
    return rows.orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def guess_columns(header: list[str], wanted: list[tuple[str, list[str], list[str]]], fold=str.lower) -> dict[str, str]:
    """Which column of a file's header holds which field.

    ``wanted`` has, for each field in order, the words its header may contain and
    words that rule a column out; a column serves one field.
    """
    found: dict[str, str] = {}
    for field, words, never in wanted:
        free = [h for h in header if h not in found.values() and not any(x in fold(h) for x in never)]
        hit = next((h for w in words for h in free if w in fold(h)), None)
        if hit is not None:
            found[field] = hit
    return found
