"""Running a stream to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def drained(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of ``build`` over the event file read as a stream, once all of it is processed (``AvailableNow``).

    The result table is complete, so it is kept in memory only for results of a
    bounded number of groups.
    """
    events = event_stream(spark, sf_dir)
    name = f"drained_{uuid.uuid4().hex}"
    running = build(events).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(_folder(spark, f"{sf_dir}/events.parquet"))
    return events.withColumn("ts", events["ts"].cast("timestamp"))


def _folder(spark: SparkSession, path: str) -> str:
    """A stream reads folders: the path itself, or a glob that names a lone file."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return path if fs.getFileStatus(p).isDirectory() else path[: -len("events.parquet")] + "events.parque[t]"
