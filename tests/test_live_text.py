"""Intents, slang and repeats on short cases with known results."""

import pytest
from pyspark.sql import functions as F

from voicegrain.functions import intent, normalize

INTENTS = [
    ("giá bao nhiêu shop", "question", "price"), ("gia bn v", "question", "price"), ("còn size M không", "question", "stock"), ("1m6 50kg mặc size gì ạ", "question", "size"), ("ship về Cà Mau mất mấy ngày", "question", "shipping"),
    ("có mã giảm giá không", "question", "promo"), ("có bị xù không", "question", "material"), ("chốt M2", "order", None), ("lấy 2 cái áo thun", "order", None), ("đơn hôm trước chưa nhận được hàng", "complaint", None),
    ("nhắn tin không ai trả lời", "complaint", None), ("đẹp quáaaa", "praise", None), ("xin chào cả nhà", "chatter", None), ("áo xin quá shop ơi", "praise", None), ("❤️❤️❤️", "chatter", None), (None, "chatter", None),
]


def test_intents(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(INTENTS)], "i int, text string")
    got = [(r.text, r.intent, r.topic) for r in intent.understood(rows).orderBy("i").collect()]
    assert got == INTENTS


def test_variant_quantity_measures(spark):
    rows = spark.createDataFrame([("chốt M2 màu đen sdt 0912345678",), ("cao 1m55 nặng 48 mặc size nào",), ("size gì vậy",)], "text string")
    a, b, c = intent.understood(rows).collect()
    assert (a.intent, a["size"], a.color, a.quantity, a.has_phone) == ("order", "M", "đen", 2, True) and "0912345678" not in a.masked
    assert (b.height_cm, b.weight_kg) == (155, 48) and c["size"] is None


def test_products(spark):
    products = spark.createDataFrame([("ao", 1, "áo thun"), ("quan", 2, "quần jean"), ("tui", 3, "túi"), ("tui-vai", 4, "túi vải")], "product_id string, code int, keyword string")
    rows = spark.createDataFrame([(1, "giỏ 2 còn hàng không"), (2, "lấy 1 cái túi"), (3, "giá bao nhiêu"), (4, "túi vải đẹp quá")], "i int, text string")
    assert {r.i: r.product_id for r in intent.with_product(rows, products).collect()} == {1: "quan", 2: "tui", 3: None, 4: "tui-vai"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("ngonnnnnn quáaaa", "ngon quá"), ("s.ản p.hẩm l-ừa đ-ảo", "sản phẩm lừa đảo"), ("sp này ko dc, giao hàng xu cà na wa", "sản phẩm này không được, giao hàng tệ quá"), ("hôm qua shop giao", "hôm qua shop giao"),
        ("size m vừa", "size m vừa"), ("Sp tốt.giao nhanh", "sản phẩm tốt. giao nhanh"), ("<b>đẹp</b> &amp; rẻ", "đẹp & rẻ"), ("Không có gì để chê", "rất hài lòng"), ("", ""), (None, ""),
    ],
)
def test_normalize(spark, raw, want):
    assert normalize.normalized(spark.createDataFrame([(raw,)], "t string"), "t").first()["normalized"] == want


def test_entities_syllables_mash_spam(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert one(normalize.decode_entities, "Lock&amp;Lock &#8364; &#x1F600;  &quot;x&quot;") == 'Lock&Lock € 😀 "x"'
    assert [one(normalize.is_syllable, w) for w in ("chậm", "khỏe", "hhhh", "good")] == [True, True, False, False]
    assert [one(normalize.keyboard_mash, t) for t in ("hhhhhhhh", "ngonnnnnnn quá", "", "hàng asssssssss tốt lắm nha bạn")] == [True, False, False, False]
    assert one(normalize.spam_reasons, "Chuyên sỉ hàng đẹp, lh zalo 0912345678") == ["offer_with_contact"]
    assert one(normalize.spam_reasons, "!!! ???") == ["signs_only"] and one(normalize.spam_reasons, "hàng đẹp, giao nhanh") == []
