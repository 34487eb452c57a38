"""From raw documents to token ids: five operators, one after the other.

Each stage takes what its predecessor kept, written as Parquet and read again, and
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrain.llm import decontamination, line_dedup, sentencepiece_codec, simhash_dedup, toxicity
from voicegrain.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the rest stay as they are.

    Rows are judged one by one: a null or empty text scores like any other, null ids
    and repeated rows stay, further columns are dropped, an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs.select(*COLUMNS), labels)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; every document stays, its n_chars counted anew.

    A null text becomes an empty one.  Rows equal in id and text lose the same lines
    and stay; null ids come last; ties are settled by the text's hash.  A document
    without any line left keeps its row with an empty text.
    """
    kept = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row of the smallest id stays.

    A null id comes last; ties are settled by hashes of the row.  Null and blank texts
    are one group; rows equal in all columns are one row.
    """
    return simhash_dedup.one_of_each_similar(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or empty text has no words and stays; rows equal in id and text are judged
    alike; with an empty benchmark all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, benchmark, keep=("lang", "source", "n_chars"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text again.

    One row per row; a null text counts as empty and has no ids.
    """
    coded = sentencepiece_codec.encode_and_decode(docs)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: Learnt scores and segmentation are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
