"""The analysis context: trust-weighted items over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import trust
from ..sources import adapters
from ..sources.files import kept


def items(spark: SparkSession, sf_dir: str, now: str = adapters.NOW, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Feedback that is not in the future, with tier, signals, band and weight.

    The joined rows are written once, since coverage, accounts, bursts and the result
    all read them.  ``prepare`` adds columns to them before, so that what these come
    from, as the long ids, need not go through the shuffles of the trust layer.
    """
    rows = adapters.feedback(spark, sf_dir)
    rows = rows.where((rows.ts <= now) | rows.ts.isNull())
    rows = kept(prepare(rows) if prepare else rows, "feedback")
    return trust.weigh(rows, adapters.transactions(spark, sf_dir), now)
