"""Text rules on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from voicegrain.functions import text
from voicegrain.operators import filters


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, masked, kinds",
    [
        ("gọi 0912 345 678 nhé", "gọi [PHONE] nhé", ["phone"]),
        ("mail a.b+c@x-y.vn", "mail [EMAIL]", ["email"]),
        ("order AB12345 received", "[ORDER] received", ["order"]),
        ("order received", "order received", []),
        ("so 123456789012", "so [ID]", ["id"]),
        ("so 1234567890123", "so [ACCOUNT]", ["account"]),
        ("tk 12345678901", "tk [ACCOUNT]", ["account"]),
    ],
)
def test_mask_pii(spark, raw, masked, kinds):
    found = spark.createDataFrame([(raw,)], "t string").select(*[c.alias(n) for c, n in zip(text.mask_pii(F.col("t")), ("m", "k"))]).first()
    assert (found["m"], found["k"]) == (masked, kinds)


def test_canonical(spark):
    assert one(spark, text.canonical, "hàng​ to t") == "hàng to t"
    assert one(spark, text.canonical, None) == ""


def fnv_simhash(words):
    votes = [0] * 32
    for w in words:
        h = 2166136261
        for c in w:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_simhash_counts_repeats(spark):
    for words in (["a"], ["giao", "hàng", "hàng", "nhanh"], []):
        got = spark.createDataFrame([(words,)], "w array<string>").select(text.simhash32(F.col("w")).alias("h")).first()["h"]
        assert got == fnv_simhash(words)


def test_header_guess_serves_one_field_a_column():
    got = filters.guess_columns(["Name", "Product name", "Product code"], [("product", ["product"], ["code"]), ("customer", ["name"], []), ("code", ["code"], [])])
    assert got == {"product": "Product name", "customer": "Name", "code": "Product code"}
