"""Time as Column expressions; the shop's day is UTC+7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(ts: Column, now: str) -> Column:
    return (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(ts)) / 86_400_000_000.0


def shop_day_start(ts: Column) -> Column:
    seven = F.expr("INTERVAL 7 HOURS")
    return F.date_trunc("day", ts + seven) - seven


def hour_band(ts: Column) -> Column:
    hour = F.hour(ts + F.expr("INTERVAL 7 HOURS"))
    return F.concat_ws("-", F.lpad((F.floor(hour / 4) * 4).cast("string"), 2, "0"), F.lpad((F.floor(hour / 4) * 4 + 4).cast("string"), 2, "0"))


def time_bounds(spec: str, now: str) -> tuple[str | None, str | None]:
    """Bounds of "Today" (the shop's day), "This Week", "This Month" (rolling) or "Custom:a:b"; none for anything else."""
    from datetime import datetime, timedelta

    at = datetime.fromisoformat(now)
    if spec == "Today":
        return str((at + timedelta(hours=7)).replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(hours=7)), now
    if spec in ("This Week", "This Month"):
        return str(at - timedelta(days=7 if spec == "This Week" else 30)), now
    if spec.startswith("Custom:"):
        try:
            a, b = sorted(str(datetime.fromisoformat(x)) for x in spec.split(":", 2)[1:])
        except ValueError:
            return None, None
        return a, b
    return None, None
