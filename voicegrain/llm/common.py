"""Helpers that several operators share: work tables, columns, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is ``spark.checkpoint.dir`` of the session.  Where that is unset, a local
    master gets a temporary folder for the session; on a cluster it is an error,
    as executors would write to folders that others cannot see.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="voicegrain-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks at hand, not the work
    before, and several readers do not compute the same rows again.  The table
    remembers its path, for ``drop_written``.
    """
    path = new_path(df.sparkSession, name)
    conf, tidy = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(tidy, "false")
    conf.set(tidy, "true")  # the shuffle files of this write go when it ends
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(tidy, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def drop_written(table: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in Arrow batches of some MB; by 10000 rows alone, the copies in a worker and its JVM grow with the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of a table that may have any other columns; null text is empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """``(z, i, h, g, text)``: whether the id is null, the id, two 64-bit hashes of the text; and the struct ``_rest`` of ``keep``."""
    small_batches(docs.sparkSession)
    rest = [F.struct(*[F.col(c) for c in keep]).alias("_rest")] if keep else []
    i, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(i.isNull().cast("int").alias("z"), F.coalesce(i, F.lit(0)).alias("i"), text.alias("text"), *rest)
    return base.select("z", "i", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g"), "text", *["_rest"] * bool(keep))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (a, b)``; root is the smallest node reachable.

    Alternates the large-star and small-star steps, so the number of rounds grows
    with the logarithm of a component's size and no step lists the pairs of a
    group.  Each round is written to the shared folder.  Self loops and repeated
    edges are allowed; an empty table gives an empty result.
    """
    flat = edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = written(flat, "cc")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v != u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        after = written(small.where("v != u").distinct(), "cc")
        drop_written(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs whose plans are no longer referenced.

    Without this they stay until the driver happens to collect its garbage, and an
    operator of several jobs would hold the files of all of them at once.
    """
    for _ in range(2):  # a plan's objects become free only after the first collection
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
