import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from voicegrain.functions.text import cosine
from voicegrain.operators import retrieval


def _plain(rows, queries, k):
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    near = rows.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("_q")), 5).alias("cosine"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("place") <= k)


def test_nearest_equals_all_pairs_on_odd_rows_in_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0, rng.random()]) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(300, None), (301, [0.0] * 4), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, 2.0]), (304, []), (305, [float("nan"), 1.0, 1.0, 1.0]), (306, [1e200] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = table.where("vec_id % 4 = 0 or vec_id >= 298")
    got = retrieval.nearest(table, queries, block=20)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    clean = lambda df: sorted(map(str, df.collect()))
    assert clean(got) == clean(_plain(table, queries, 5))
    few = table.where("vec_id < 2 or vec_id between 300 and 303")
    assert clean(retrieval.nearest(few, few)) == clean(_plain(few, few, 5))
    assert clean(retrieval.nearest(few, few.limit(0))) == [] == clean(retrieval.nearest(few.limit(0), few))
