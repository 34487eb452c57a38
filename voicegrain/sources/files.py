"""CSV as people export it: sniffed delimiters in, quoted files out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

DELIMITERS = (",", ";", "\t")


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs most often, outside quotes, in the first line of a CSV file or folder."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"].lstrip("﻿") if first else ""
    bare = "".join(part for k, part in enumerate(line.split('"')) if k % 2 == 0)
    return max(DELIMITERS, key=bare.count)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, all columns as strings; quoted fields may hold line feeds."""
    return spark.read.csv(path, header=True, sep=delimiter or sniff(spark, path), quote='"', escape='"', multiLine=True)


def write_csv(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    rows.write.csv(path, header=True, sep=delimiter, quote='"', escape='"')


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``); only a local master may go without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="voicegrain-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read back: later readers do not compute them again, and a lost executor costs no step before."""
    path = shared_path(rows.sparkSession, name)
    conf, tidy = rows.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(tidy, "false")
    conf.set(tidy, "true")  # the shuffle files of this write go when it ends
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(tidy, before)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def csv_round_trip(rows: DataFrame, delimiter: str) -> DataFrame:
    """``rows`` written to the shared folder and read back."""
    path = shared_path(rows.sparkSession, "csv")
    write_csv(rows, path, delimiter)
    return read_csv(rows.sparkSession, path)


def csv_export_round_trip(rows: DataFrame) -> DataFrame:
    """``rows`` exported as CSV files that begin with a byte-order mark, as spreadsheets want, and read back."""
    path = shared_path(rows.sparkSession, "export")
    first, *rest = rows.columns
    write_csv(rows.withColumnRenamed(first, "\ufeff" + first), path)
    back = read_csv(rows.sparkSession, path, ",")
    return back.toDF(*[c.lstrip("\ufeff") for c in back.columns])


def as_json(rows: DataFrame) -> str:
    """The folder of JSON lines that ``rows`` were written to."""
    path = shared_path(rows.sparkSession, "json")
    rows.write.json(path)
    return path


def json_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders from JSON lines: keys trimmed, texts canonical, bad dates null, bad amounts 0; rows without a key go."""
    raw = spark.read.schema("orderId string, region string, orderedAt string, deliveredAt string, amount string").json(path)
    key = F.trim("orderId")
    return raw.where(key != "").select(
        key.alias("order_id"), text.canonical(F.col("region")).alias("region"), F.try_to_timestamp("orderedAt").alias("ordered_at"), F.try_to_timestamp("deliveredAt").alias("delivered_at"), F.coalesce(F.expr("try_cast(amount as double)"), F.lit(0.0)).alias("amount")
    )


def imported_feedback(raw: DataFrame, day: str) -> DataFrame:
    """Rows ``(row_id, text, rating, date)`` of an uploaded file as feedback of the import on ``day``.

    Rows without text go; a rating outside 1 to 5 is null, else rounded; a missing date
    or one more than a day ahead becomes the day of import and is marked as inferred.
    """
    now = F.lit(day).cast("timestamp")
    inferred = F.col("date").isNull() | (F.col("date") > now + F.expr("interval 1 day"))
    words = F.trim("text")
    return raw.where(words != "").select("row_id", words.alias("text"), F.when(F.col("rating").between(1, 5), F.round("rating").cast("int")).alias("rating"), inferred.alias("time_inferred"), F.when(inferred, now).otherwise(F.col("date")).alias("ts"))
