"""The shared test tables as feedback, transactions and live comments; and readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES

NOW = "2001-06-30 00:00:00"
SOURCES = {"1-URGENT": "Hotline", "2-HIGH": "Shopee", "3-MEDIUM": "Tiki", "4-NOT SPECIFIED": "Facebook"}
ALL_CATEGORIES = [*CATEGORIES, "Other"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table; times without a zone are taken in the session's zone."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def category_dim(spark: SparkSession) -> DataFrame:
    """``(category, impact)``; a fixed handful of rows."""
    return spark.createDataFrame([(c, CATEGORIES.get(c, (0.25, []))[0]) for c in ALL_CATEGORIES], "category string, impact double")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feedback row for each order line; every column is derived from the line, its order, customer and part."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # customers and nations go to the orders, which are fewer than the lines
    placed = order.join(customer, order.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    # parts come first: their few names pack better in the next shuffle than those of customers
    joined = line.join(part, line.l_partkey == part.p_partkey).join(placed, line.l_orderkey == placed.o_orderkey)
    source = F.lit("Website")
    for key, name in SOURCES.items():
        source = F.when(F.col("o_orderpriority") == key, name).otherwise(source)
    categories = F.array(*[F.lit(c) for c in ALL_CATEGORIES])
    planted = (F.col("l_shipdate") >= F.lit("2001-06-23").cast("timestamp")) & (F.col("l_partkey") % 3 == 0)
    category = F.when(planted, "Delivery").otherwise(F.element_at(categories, (F.col("l_suppkey") % 8 + 1).cast("int")))
    cause = F.when(planted, "LateDelivery").otherwise(F.concat(category, F.lit("-"), (F.col("l_partkey") % 5).cast("string")))
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("feedback_id"),
        source.alias("source"),
        F.col("c_name").alias("author"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") % 700).cast("double").alias("account_age_days"),
        (F.col("l_quantity").cast("long") % 5 + 1).cast("int").alias("rating"),
        F.when(planted | (F.col("l_returnflag") == "R"), "Negative").when(F.col("l_returnflag") == "A", "Neutral").otherwise("Positive").alias("sentiment"),
        category.alias("category"),
        cause.alias("cause"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.col("n_name").alias("region"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_orderkey")).alias("order_id"),
        F.col("l_shipdate").alias("ts"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    days = (F.col("o_orderkey") % 4 * 400).cast("int")
    return order.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ordered_at"),
        (F.col("o_orderdate") - F.make_dt_interval(days)).alias("delivered_at"), F.col("o_totalprice").alias("amount"),
    )


def live_comments(events: DataFrame) -> DataFrame:
    """Live comments of the event table (batch or stream): intent, product, quantity and author of each event."""
    intent = (
        F.when(F.col("event_type") == "error", "complaint").when(F.col("event_type") == "view", "question").when(F.col("event_type") == "purchase", "order").when(F.col("event_type") == "signup", "praise").otherwise("chatter")
    )
    return events.select(
        F.col("event_id").alias("comment_id"), "ts", F.col("user_id").alias("author"), intent.alias("intent"),
        F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(20)).alias("product_id"), (1 + F.pmod(F.floor("value"), F.lit(3))).cast("long").alias("quantity"),
    )
