"""Text retrieval: postings, BM25, salient terms, nearest vectors, product name groups."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(term, key, tf, length)``: how often each text holds each term, and its number of terms."""
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    return words.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """The ``limit`` best rows for the query terms."""
    held = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("length"), F.filter("w", lambda w: w.isin(query)).alias("w"))
    totals = held.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))  # one row
    found = held.where(F.size("w") > 0).select(key, "length", F.explode("w").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # a row for each query term, and one
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def salient_terms(docs: DataFrame, subset: str, key: str = "doc_id", text: str = "text", limit: int = 20) -> DataFrame:
    """Terms of the rows under the condition ``subset`` by their share there times their idf in all rows."""
    rows = docs.select(key, F.expr(subset).alias("_in"), F.explode(tokens(F.col(text))).alias("term"))
    terms = rows.groupBy("term").agg(F.count_if("_in").alias("n"), F.countDistinct(key).alias("df"))
    total = docs.agg(F.count("*").alias("docs"))
    inside = rows.where("_in").agg(F.count("*").alias("total"))
    scored = terms.where("n >= 2").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(inside))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return scored.select("term", "n", "df", F.round(F.col("n") / F.col("total") * idf, 6).alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column, and the number of components of each; -1 where the vector or a component is null."""
    rows = [None if v is None or None in v else v for v in column.to_pylist()]
    size = np.array([-1 if v is None else len(v) for v in rows])
    data = np.zeros((len(rows), max(size.max(initial=0), 1)))
    for i, v in enumerate(rows):
        if v:
            data[i, : len(v)] = v
    return data, size


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up in the order of the components as Spark does."""
    out = np.zeros(len(a))
    for j in range(min(a.shape[1], b.shape[1])):
        out = out + a[:, j] * b[:, j]
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` to five places, halves up by their decimal digits as Spark does."""
    scaled = np.abs(x) * 1e5
    out = np.sign(x) * np.floor(scaled + 0.5) / 1e5
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.00001"), ROUND_HALF_UP))
    return out


def _nearest_of(k: int, key_type: pa.DataType):
    """For a block of vectors and a group of queries the ``k`` best rows of the block for each query."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = [([], [], [])]
        if vectors.num_rows and queries.num_rows:
            (data, size), (asked, asked_size) = _matrix(vectors.column("_v")), _matrix(queries.column("_v"))
            ids, at = np.unique(np.array([*vectors.column("_k").to_pylist(), *queries.column("_k").to_pylist()]), return_inverse=True)
            mine, theirs = at[: len(data)], at[len(data) :]
            with np.errstate(all="ignore"):
                norm, asked_norm = (np.sqrt(_dots(m, m)) for m in (data, asked))
                units = np.where(np.isfinite(norm)[:, None], data / norm[:, None], np.nan)
                width = min(data.shape[1], asked.shape[1])
                for lo in range(0, len(asked), 256):
                    to = slice(lo, lo + 256)
                    unit = np.where(np.isfinite(asked_norm[to])[:, None], asked[to] / asked_norm[to][:, None], np.nan)
                    near = unit[:, :width] @ units[:, :width].T
                    dead = (asked_size[to][:, None] != size) | (size < 0) | (norm * asked_norm[to][:, None] == 0)
                    unsure = np.isnan(near) & ~dead  # not a number, or too long for a unit vector: looked at in any case
                    near[unsure | dead] = -3  # no cosine comes last
                    near[theirs[to][:, None] == mine] = -9
                    bound = np.partition(near, max(len(data) - k, 0), axis=1)[:, max(len(data) - k, 0)]
                    q, r = np.nonzero(((near >= bound[:, None] - 1.5e-5) | unsure) & (near > -9))  # rounding moves a cosine by half of 1e-5
                    none = dead[q, r]
                    exact = _dots(asked[to][q], data[r]) / (norm[r] * asked_norm[to][q])
                    place = np.where(none, -np.inf, np.where(np.isnan(exact), np.inf, _rounded(exact)))
                    order = np.lexsort((mine[r], -place, q))
                    first = np.searchsorted(q[order], q[order])
                    best = order[np.arange(len(order)) - first < k]
                    out.append((ids[theirs[to][q[best]]].tolist(), ids[mine[r[best]]].tolist(), [None if n else c for n, c in zip(none[best], exact[best].tolist())]))
        columns = [[x for part in out for x in part[c]] for c in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (key_type, key_type, pa.float64()))], names=["query_id", "_k", "cosine"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 5, block: int = 8192) -> DataFrame:
    """For each query row its ``k`` nearest others by cosine to five places (ties: the smaller key); exact.

    Every query meets every vector, a block of about ``block`` of each at a time: a task
    multiplies two matrices of that size and passes on ``k`` rows a query, so no task
    and no broadcast grows with the tables.  The work is their product.  A row without a
    cosine (nulls, other sizes, no length) comes last; rows without a key are left out.
    """
    sides = [rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(column).cast("array<double>").alias("_v")) for rows in (vectors, queries)]
    blocks, groups = (max(1, -(-side.count() // block)) for side in sides)
    own = lambda n: F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = sides[0].select("*", own(blocks).alias("_b"), each(groups).alias("_g"))
    asked = sides[1].select("*", own(groups).alias("_g"), each(blocks).alias("_b"))
    met = [side.repartition(blocks * groups, "_b", "_g").groupBy("_b", "_g") for side in (held, asked)]
    kind = vectors.schema[key].dataType
    found = met[0].cogroup(met[1]).applyInArrow(_nearest_of(k, to_arrow_type(kind)), f"query_id {kind.simpleString()}, _k {kind.simpleString()}, cosine double")
    near = found.select("query_id", F.col("_k").alias(key), F.round("cosine", 5).alias("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def name_groups(products: DataFrame, name: str = "product_name", least: int = 2) -> DataFrame:
    """Each name with the longest beginning of one to three words that at least ``least`` names share, else itself."""
    words = products.select(name).distinct().withColumn("_w", F.split(F.lower(F.col(name)), r"\s+"))
    starts = words.select(name, F.explode(F.sequence(F.lit(1), F.least(F.size("_w"), F.lit(3)))).alias("k"), "_w").select(name, "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("start"))
    shared = starts.groupBy("start").agg(F.countDistinct(name).alias("names")).where(F.col("names") >= least)
    best = starts.join(shared, "start").groupBy(name).agg(F.max_by("start", "k").alias("grp"))
    return words.select(name).join(best, name, "left").select(name, F.coalesce("grp", F.lower(F.col(name))).alias("product_group"))
