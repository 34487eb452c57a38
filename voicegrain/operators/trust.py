"""The trust layer: source tiers, five inauthenticity signals, and one weight per row.

Input is the feedback shape of ``sources.adapters``; every function adds columns and
keeps all rows.  A null time leaves a row out of time-based signals; null ratings,
sentiments and orders make their signal unavailable (score 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANONYMOUS_AUTHOR, AUTHENTICITY, IDENTIFIED_SOURCES, RECONCILABLE_SOURCES, TIER_WEIGHT, TRUST
from ..functions.times import age_days
from ..sources.files import kept


def tier(source: str = "source", author: str = "author", age: str = "account_age_days", order: str = "order_id", customer: str = "customer_id", verified: Column | None = None) -> Column:
    """P1 (order on a reconcilable source) to P5 (anonymous or new account)."""
    anonymous = F.col(author).isNull() | F.trim(F.col(author)).rlike(ANONYMOUS_AUTHOR)
    new = F.coalesce(F.col(age) < TRUST.new_account_days, F.lit(False))
    bought = F.col(order).isNotNull() | F.coalesce(verified if verified is not None else F.lit(False), F.lit(False))
    reconcilable, identified = (F.coalesce(F.col(source).isin(x), F.lit(False)) for x in (RECONCILABLE_SOURCES, IDENTIFIED_SOURCES))
    return F.when(anonymous | new, "P5").when(bought & reconcilable, "P1").when(identified & F.col(customer).isNotNull(), "P2").when(reconcilable, "P3").otherwise("P4")


def tier_weight(tier: Column) -> Column:
    weight = F.lit(None).cast("double")
    for name, value in TIER_WEIGHT.items():
        weight = F.when(tier == name, value).otherwise(weight)
    return weight


def star_mismatch(rating: Column, sentiment: Column, vague: Column | None = None) -> Column:
    polarity = F.when(sentiment == "Positive", 1.0).when(sentiment == "Negative", -1.0).otherwise(0.0)
    gap = F.greatest(F.lit(0.0), (F.abs((rating - 3) / 2 - polarity) / 2 - 0.25) / 0.75)
    extra = F.when(F.coalesce(vague, F.lit(False)) & (rating <= 2), 0.4).otherwise(0.0) if vague is not None else F.lit(0.0)
    return F.when(rating.isNull() | sentiment.isNull(), 0.0).otherwise(F.least(F.lit(1.0), gap + extra))


def with_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Adds ``order_found`` and ``order_delivered_at`` of the matching order (the latest delivery of a repeated id)."""
    book = orders.groupBy("order_id").agg(F.max("delivered_at").alias("order_delivered_at")).withColumn("order_found", F.lit(True))
    # rows without an order take no part in the join, where they would all meet in one task
    known = items.where("order_id is not null").join(book, "order_id", "left").withColumn("order_found", F.coalesce("order_found", F.lit(False)))
    none = {"order_delivered_at": F.lit(None).cast(book.schema["order_delivered_at"].dataType), "order_found": F.lit(False)}
    return known.unionByName(items.where("order_id is null").withColumns(none))


def order_coverage(items: DataFrame) -> DataFrame:
    """One row: rows with an order id, those found in the order book, and the share."""
    has = F.count("order_id")
    found = F.count_if(F.col("order_id").isNotNull() & F.col("order_found"))
    return items.agg(has.alias("with_order"), found.alias("matched"), F.try_divide(found.cast("double"), has).alias("coverage"))


def transaction_mismatch(coverage: Column) -> Column:
    """Written over 12 hours before delivery .95; an unknown order .6 if the book covers enough."""
    early = F.unix_seconds("order_delivered_at") - F.unix_seconds("ts") > TRUST.early_hours * 3600
    unknown = F.when(F.coalesce(coverage, F.lit(0.0)) >= TRUST.coverage_floor, 0.6).otherwise(0.0)
    return F.when(F.col("order_id").isNull(), 0.0).when(~F.col("order_found"), unknown).otherwise(F.when(F.coalesce(early, F.lit(False)), 0.95).otherwise(0.0))


def bursts(items: DataFrame, key: str = "product_name") -> DataFrame:
    """Adds ``near``, ``burst_z`` and ``burst``: how far the rows within 30 minutes exceed what is usual for the product.

    Robust z: distance from the upper median over 1.4826 times the upper median of
    the deviations (or 1), for products of at least 8 timed rows.
    """
    span = TRUST.burst_minutes * 60
    timed = items.withColumn("_s", F.unix_seconds("ts"))
    new = F.coalesce(F.col("account_age_days") < TRUST.new_account_days, F.lit(False))
    # one row a product and second, in its own bucket and the neighbour's where that is near, so a hot product is many groups
    seconds = timed.where("_s is not null").groupBy(key, "_s").agg(F.count("*").alias("_rows"), F.count_if(new).alias("_new"))
    place = lambda s: F.floor(s / (8 * span))
    own = place(F.col("_s"))
    dealt = seconds.select(key, "_s", "_rows", "_new", own.alias("_own"), F.explode(F.array_distinct(F.array(own, place(F.col("_s") - span), place(F.col("_s") + span)))).alias("_bucket"))
    frame = Window.partitionBy(key, "_bucket").orderBy("_s").rangeBetween(-span, span)
    sums = dealt.select(key, "_s", "_rows", "_own", "_bucket", F.sum("_rows").over(frame).alias("near"), (F.sum("_new").over(frame) / F.sum("_rows").over(frame)).alias("new_share"))
    sums = sums.where("_own = _bucket").select(F.col(key).alias("_key"), F.col("_s").alias("_at"), "_rows", "near", "new_share")
    # medians over the distinct counts of a product with their multiplicity, so no array grows with the rows
    counts = sums.groupBy(F.col("_key").alias(key), "near").agg(F.sum("_rows").alias("w"))
    middle = _weighted_upper_median(counts, key, "near").withColumnRenamed("median", "_median")
    off = counts.join(middle, key).withColumn("near", F.abs(F.col("near") - F.col("_median"))).groupBy(key, "near").agg(F.sum("w").alias("w"))
    spread = _weighted_upper_median(off, key, "near").withColumnRenamed("median", "_mad").drop("rows")
    usual = middle.join(spread, key)
    # what is usual goes to the seconds of a product, and to one more without a time, so that the rows are joined once
    untimed = usual.select(F.col(key).alias("_key"), *[F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in ("_at", "near", "new_share")])
    known = sums.select("_key", "_at", "near", "new_share").union(untimed).join(usual.withColumnRenamed(key, "_key"), "_key", "left")
    out = timed.join(known, F.col(key).eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_at")), "left").drop("_s", "_key", "_at")
    z = (F.col("near") - F.col("_median")) / F.coalesce(F.nullif(1.4826 * F.col("_mad"), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("burst_z", F.when(F.col("rows") >= TRUST.burst_min_rows, z).otherwise(0.0))
    burst = F.when(F.col("burst_z") > TRUST.burst_z, F.least(F.lit(1.0), F.col("burst_z") / 6 * (0.5 + F.col("new_share")))).otherwise(0.0)
    return out.withColumn("burst", F.coalesce(burst, F.lit(0.0))).drop("_median", "_mad", "rows")


def _weighted_upper_median(counts: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median, rows)``: the element at floor(n / 2) of the sorted values, each ``w`` times."""
    order = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum("w").over(order)).withColumn("_n", F.sum("w").over(Window.partitionBy(key)))
    return summed.where(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(key).agg(F.min(value).alias("median"), F.max("_n").alias("rows"))


def account_features(items: DataFrame, key: str = "customer_id") -> DataFrame:
    """Per account: rows, least age, rows a day, share of extreme stars, regularity of the gaps, and rule risk."""
    gaps = items.withColumn("_gap", (F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(Window.partitionBy(key).orderBy("ts"))) / 60)
    rated = F.count("rating")
    span = F.greatest(F.lit(1.0), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 86400)
    out = gaps.groupBy(key).agg(
        F.count("*").alias("reviews"),
        F.coalesce(F.min("account_age_days"), F.lit(365.0)).alias("least_age"),
        (F.count("*") / span).alias("per_day"),
        F.coalesce(F.try_divide(F.count_if(F.col("rating").isin(1, 5)).cast("double"), rated), F.lit(0.5)).alias("extreme"),
        F.when(F.count("_gap") >= 2, 1 / (1 + F.log1p(F.coalesce(F.var_samp("_gap"), F.lit(0.0))))).otherwise(0.0).alias("regularity"),
    )
    new = F.col("least_age") < TRUST.new_account_days
    risk = F.greatest(
        F.when(new & (F.col("reviews") <= 2) & (F.col("extreme") >= 0.99), 0.75).when(new, 0.45).otherwise(0.0),
        F.when(F.col("per_day") > 5, 0.6).otherwise(0.0),
        F.when((F.col("regularity") > 0.85) & (F.col("reviews") >= 4), 0.65).otherwise(0.0),
    )
    return out.withColumn("risk", risk)


def authenticity(duplicate: Column, burst: Column, account: Column, star: Column, transaction: Column, model: dict[str, float] | None = None) -> Column:
    """The logistic score of the five signals, with given or learnt coefficients (``fit_authenticity``)."""
    c = AUTHENTICITY if model is None else model
    return 1 / (1 + F.exp(-(c["intercept"] + c["duplicate"] * duplicate + c["burst"] * burst + c["account"] * account + c["star"] * star + c["transaction"] * transaction)))


SIGNALS = ("duplicate", "burst", "account", "star", "transaction")


def fit_authenticity(samples: DataFrame, label: str = "label", rate: float = 0.1, epochs: int = 500, signals: tuple[str, ...] = SIGNALS) -> dict[str, float]:
    """Coefficients of a logistic regression by full-batch gradient descent from zero.

    ``samples`` has a column a signal (null counts as 0) and a 0/1 label.  Equal
    samples become one row with a count, kept in the shared folder; a step is one
    partial sum a task and one row for the driver.  An empty table leaves zeros.
    """
    columns = [F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in signals]
    rows = kept(samples.select(F.col(label).cast("double").alias("_y"), *columns).groupBy("_y", *signals).agg(F.count("*").alias("_m")), "samples").persist()
    total = rows.agg(F.sum("_m")).first()[0] or 0
    model = {"intercept": 0.0} | dict.fromkeys(signals, 0.0)
    for _ in range(epochs if total else 0):
        z = F.lit(model["intercept"])
        for s in signals:
            z = z + F.lit(model[s]) * F.col(s)
        off = F.col("_m") * (1 / (1 + F.exp(-z)) - F.col("_y"))
        gradient = rows.select(off.alias("_off"), *signals).agg(F.sum("_off").alias("intercept"), *[F.sum(F.col("_off") * F.col(s)).alias(s) for s in signals]).first()
        model = {k: v - rate * gradient[k] / total for k, v in model.items()}
    rows.unpersist()
    return model


def band(a: Column, spam: Column | None = None) -> Column:
    found = F.when(a >= TRUST.reject, "LIKELY_INAUTHENTIC").when(a >= TRUST.gray, "GRAY_ZONE").otherwise("ACCEPTED")
    return found if spam is None else F.when(spam, "SPAM").otherwise(found)


def weigh(items: DataFrame, orders: DataFrame, now: str, half_life: float = TRUST.half_life_days, duplicates: DataFrame | None = None, spam: Column | None = None, key: str = "feedback_id", model: dict[str, float] | None = None) -> DataFrame:
    """The trust layer: tier, signals, score, band, and weight = tier weight * (1 - A) * 0.5 ^ (age / half-life).

    ``duplicates`` is ``(key, duplicate)``, the signal of near-equal texts
    (``near_duplicates.duplicate_signal``); without it the signal is 0.  ``spam`` marks
    rows of the SPAM band; ``model`` has learnt coefficients.  Spam and rejected rows weigh 0; ``uncertainty`` is highest
    midway.  Scores and weights are rounded to 4 places.
    """
    rows = with_orders(items.withColumn("tier", tier()), orders)
    rows = rows.crossJoin(F.broadcast(order_coverage(rows).select("coverage")))  # one row
    # the order's signal is known here, so that what it comes from need not go through the shuffles that follow
    rows = bursts(rows.withColumn("transaction", transaction_mismatch(F.col("coverage"))))
    rows = rows.join(account_features(items).select("customer_id", F.col("risk").alias("account")), "customer_id", "left")
    rows = rows.withColumn("star", star_mismatch(F.col("rating"), F.col("sentiment"))).withColumn("tier_weight", tier_weight(F.col("tier")))
    duplicate = F.lit(0.0)
    if duplicates is not None:
        rows, duplicate = rows.join(duplicates.select(key, "duplicate"), key, "left"), F.coalesce("duplicate", F.lit(0.0))
    a = authenticity(duplicate, F.col("burst"), F.coalesce("account", F.lit(0.0)), F.col("star"), F.col("transaction"), model)
    rows = rows.withColumn("score", F.round(a, 4)).withColumn("band", band(F.col("score"), spam))
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.coalesce(age_days(F.col("ts"), now), F.lit(0.0))) / half_life)
    weight = F.when(F.col("band").isin("LIKELY_INAUTHENTIC", "SPAM"), 0.0).otherwise(F.round(F.col("tier_weight") * (1 - F.col("score")) * decay, 4))
    return rows.withColumn("weight", weight).withColumn("uncertainty", F.round(1 - F.abs(F.col("score") - 0.5) * 2, 4)).drop("coverage")


def funnel(items: DataFrame, now: str, expected_channels: int = 5) -> DataFrame:
    """One row: rows of each band, channels, median age, and the data-health score of 0 to 100."""
    total = F.count("*")
    days = age_days(F.col("ts"), now)
    base = items.agg(
        total.alias("collected"), *[F.count_if(F.col("band") == b).alias(n) for b, n in (("SPAM", "spam"), ("LIKELY_INAUTHENTIC", "inauthentic"), ("GRAY_ZONE", "pending"), ("ACCEPTED", "accepted"))],
        F.countDistinct("source").alias("channels"), F.count_if(F.col("tier").isin("P1", "P2")).alias("reconcilable"), F.round(F.sum("weight"), 2).alias("effective_weight"), F.min(days).alias("newest_days"),
    )
    share = F.try_divide(F.col("accepted") + F.col("pending"), F.col("collected").cast("double"))
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("newest_days") * 24 - 1) / 23))
    score = 0.4 * share + 0.2 * F.least(F.lit(1.0), F.col("channels") / float(expected_channels)) + 0.2 * fresh + 0.2 * F.col("reconcilable") / F.col("collected")
    return base.withColumn("health", F.floor(score * 100 + 0.5).cast("long")).drop("newest_days")


def review_queue(items: DataFrame, limit: int = 50, key: str = "feedback_id") -> DataFrame:
    """Rows of the gray zone, the most uncertain first."""
    return items.where(F.col("band") == "GRAY_ZONE").orderBy(F.desc("uncertainty"), key).limit(limit)


def isolation_scores(features: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 2026) -> DataFrame:
    """``(key, score)`` of an isolation forest fitted to a bounded sample of ``sample * 8`` rows; all rows are scored.

    The sample holds the rows of the smallest key hashes.  Fewer than 8 rows score 0.5.
    """
    import numpy as np
    import pandas as pd

    pool = features.orderBy(F.xxhash64(key), key).limit(8 * sample).select(*columns).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    forest = []
    height = int(np.ceil(np.log2(max(2, min(sample, len(pool) or 2)))))

    def grow(x, depth):
        if depth >= height or len(x) <= 1:
            return len(x)
        f = int(rng.integers(x.shape[1]))
        lo, hi = x[:, f].min(), x[:, f].max()
        if lo == hi:
            return len(x)
        cut = rng.uniform(lo, hi)
        return f, cut, grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1)

    few = len(pool) < 8
    size = min(sample, len(pool))
    for _ in range(0 if few else trees):
        forest.append(grow(pool[rng.integers(len(pool), size=size)], 0))

    def usual(n):
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def depth_of(node, x, rows, depth, out):
        if not isinstance(node, tuple):
            out[rows] += depth + usual(node)
            return
        f, cut, left, right = node
        less = x[rows, f] < cut
        if less.any():
            depth_of(left, x, rows[less], depth + 1, out)
        if (~less).any():
            depth_of(right, x, rows[~less], depth + 1, out)

    def run(parts):
        for pdf in parts:
            x = pdf[columns].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for tree in forest:
                depth_of(tree, x, np.arange(len(x)), 0, total)
            score = np.full(len(x), 0.5) if few else 2 ** (-(total / trees) / max(usual(size), 1e-9))
            yield pd.DataFrame({key: pdf[key], "score": score})

    return features.select(key, *columns).mapInPandas(run, f"{key} {features.schema[key].dataType.simpleString()}, score double")
