"""Queries on review texts and live comments: sentences with known results, spread over the event table, and the expected counts in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_work as _work
from .functions import complaints, intent, normalize
from .queries import QUERIES, SQL, query
from .sources.adapters import table

__all__ = ["QUERIES", "SQL", "_work"]


def _said(spark, sf_dir, sentences):
    """The events, each with one of the sentences as its text."""
    text = F.element_at(F.array(*[F.lit(s) for s in sentences]), (F.col("event_id") % len(sentences) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def _expected(columns: str, cases: list[tuple]) -> str:
    """How many events have each of the expected results."""
    value = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {', '.join(map(value, case))})" for k, case in enumerate(cases))
    return f"SELECT {columns}, count(*) AS n FROM events JOIN (VALUES {rows}) v(k, {columns}) ON event_id % {len(cases)} = k GROUP BY ALL"


_INTENTS = [
    ("giá bao nhiêu shop", "question", "price"), ("còn size M không", "question", "stock"), ("1m6 50kg mặc size gì ạ", "question", "size"), ("ship về Cà Mau mất mấy ngày", "question", "shipping"), ("có mã giảm giá không", "question", "promo"),
    ("có bị xù không", "question", "material"), ("chốt M2", "order", None), ("lấy 2 cái áo thun", "order", None), ("đơn hôm trước chưa nhận được hàng", "complaint", None), ("nhắn tin không ai trả lời", "complaint", None),
    ("đẹp quáaaa", "praise", None), ("xin chào cả nhà", "chatter", None), ("áo xin quá shop ơi", "praise", None),
]


@query(_expected("intent", [(i,) for _, i, _ in _INTENTS]))
def cls_11_live_intents(spark, sf_dir):
    return intent.understood(_said(spark, sf_dir, [t for t, _, _ in _INTENTS])).groupBy("intent").agg(F.count("*").alias("n"))


@query(_expected("topic", [(t,) for _, i, t in _INTENTS]))
def cls_12_topics(spark, sf_dir):
    return intent.understood(_said(spark, sf_dir, [t for t, _, _ in _INTENTS])).groupBy("topic").agg(F.count("*").alias("n"))


_VARIANTS = [
    ("chốt M2 màu đen sdt 0912345678", "M", "đen", 2, None, None), ("cao 1m55 nặng 48 mặc size nào", None, None, None, 155, 48), ("lấy 3 cái size xl trắng", "XL", "trắng", 3, None, None), ("size gì vậy", None, None, None, None, None), ("mua 1 đôi size 38", "38", None, 1, None, None),
]


@query(_expected("size, color, quantity, height_cm, weight_kg", [v[1:] for v in _VARIANTS]).replace("SELECT size, color, quantity", "SELECT size, color, CAST(quantity AS INTEGER) AS quantity"))
def cls_13_variants(spark, sf_dir):
    rows = intent.understood(_said(spark, sf_dir, [v[0] for v in _VARIANTS]))
    return rows.groupBy("size", "color", "quantity", "height_cm", "weight_kg").agg(F.count("*").alias("n"))


@query(_expected("product_id", [("quan",), ("tui",), (None,), ("tui-vai",)]))
def join_17_products(spark, sf_dir):
    products = spark.createDataFrame([("ao", 1, "áo thun"), ("quan", 2, "quần jean"), ("tui", 3, "túi"), ("tui-vai", 4, "túi vải")], "product_id string, code int, keyword string")
    rows = _said(spark, sf_dir, ["giỏ 2 còn hàng không", "lấy 1 cái túi", "giá bao nhiêu", "túi vải đẹp quá"])
    return intent.with_product(rows, products).groupBy("product_id").agg(F.count("*").alias("n"))


_PLAIN = [
    ("ngonnnnnn quáaaa", "ngon quá"), ("s.ản p.hẩm l-ừa đ-ảo", "sản phẩm lừa đảo"), ("sp này ko dc, giao hàng xu cà na wa", "sản phẩm này không được, giao hàng tệ quá"), ("size m vừa", "size m vừa"), ("Sp tốt.giao nhanh", "sản phẩm tốt. giao nhanh"),
    ("<b>đẹp</b> &amp; rẻ 0912345678", "đẹp & rẻ [phone]"), ("Không có gì để chê", "rất hài lòng"),
]


@query(_expected("normalized", [(n,) for _, n in _PLAIN]))
def str_12_normalize(spark, sf_dir):
    return normalize.normalized(_said(spark, sf_dir, [t for t, _ in _PLAIN])).groupBy("normalized").agg(F.count("*").alias("n"))


def _each(name, pairs, column):
    """A query that applies ``column`` to the sentences of ``pairs`` and counts the results."""

    def run(spark, sf_dir):
        return _said(spark, sf_dir, [t for t, _ in pairs]).select(column(F.col("text")).alias("result")).groupBy("result").agg(F.count("*").alias("n"))

    run.__name__ = name
    query(_expected("result", [(r,) for _, r in pairs]))(run)


_each("str_04_entities", [("Lock&amp;Lock", "Lock&Lock"), ("5 &#8364;", "5 €"), ("&quot;x&quot;  &lt;y&gt;", '"x" <y>')], normalize.decode_entities)
_each("str_06_joined_letters", [("s.ản p.hẩm", "sản phẩm"), ("tốt.giao chậm", "tốt. giao chậm"), ("l-ừa", "lừa")], normalize.joined_letters)
_each("str_07_emoji", [("hàng 👍", "hàng  tích cực "), ("😡", " tiêu cực "), ("😭 quá", " tiêu cực  quá"), ("🙄", " trung tính ")], normalize.emoji_words)
_each("str_08_repeats", [("chậmmmm quáaaa tệêêê", "chậm quá tệ"), ("ngoan", "ngoan"), ("okkkk", "ok")], normalize.collapse_repeats)
_each("str_09_syllables", [("chậm", True), ("khỏe", True), ("hhhh", False), ("good", False)], normalize.is_syllable)
_each("str_11_slang", [("ship kiến, chờ mãi", "giao hàng rất chậm, chờ mãi"), ("k, dc", "không, được"), ("vitamin c", "vitamin c")], normalize.translate_slang)
_each("str_14_keyboard_mash", [("hhhhhhhh", True), ("ngonnnnnnn quá", False), ("asdffffffff", True)], normalize.keyboard_mash)
_each("str_13_spam_signals", [("lh zalo", "contact"), ("chuyên sỉ", "commerce"), ("xem bit.ly/x", "url"), ("mã ABC123", "promo"), ("hàng đẹp", "")], lambda t: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in normalize.spam_signals(t).items()])), ","))
_each("mth_18_spam_filter", [("Chuyên sỉ hàng đẹp, lh zalo 0912345678", "offer_with_contact"), ("!!! ???", "signs_only"), ("hàng đẹp, giao nhanh", ""), ("xả kho www.x.com", "offer_with_link"), ("hhhhhhhhh", "keyboard_mash")], lambda t: F.array_join(normalize.spam_reasons(t), ","))

_CAUSES = [
    ("Shipper cáu gắt, quát khách", "CourierAttitude"), ("Anh shipper thân thiện nhưng hộp bị móp", "DamagedInTransit"), ("Nhân viên thái độ không tốt", "BadAttitude"), ("Thùng carton bị rách, ướt hết", "DamagedInTransit"), ("hàng giả rồi", "SuspectedCounterfeit"),
    ("Shipper thân thiện, giao nhanh", None), ("Nhân viên thái độ rất tốt", None), ("Cổng thanh toán nhanh gọn", None), ("App không lag chút nào", None), ("Shipper giao hàng nhanh, không hề cáu gắt", None), ("chưa hoàn tiền, trừ hai lần", "DoubleCharge"), ("app lag quá", "AppSlowOrCrash"), ("thanh toán mãi vẫn lỗi", "GatewayError"),
]


@query(_expected("cause", [(c,) for _, c in _CAUSES]))
def cls_01_rules(spark, sf_dir):
    """The surest cause of each review; one of equals is the first of the taxonomy."""
    rows = normalize.normalized(_said(spark, sf_dir, [t for t, _ in _CAUSES]))
    found = rows.withColumn("found", complaints.complaints(F.col("normalized")))
    return found.groupBy(F.get("found", F.lit(0))["cause"].alias("cause")).agg(F.count("*").alias("n"))


_FEELINGS = [
    ("Không có gì để chê", None, "Positive"), ("Hàng không lỗi, đóng gói kỹ", None, "Positive"), ("App không lag chút nào", None, "Positive"), ("Sản phẩm không tốt", None, "Negative"), ("chẳng đẹp gì cả", None, "Negative"),
    ("Nhân viên mất lịch sự", None, "Negative"), ("nệm xẹp", 1, "Negative"), ("bình thường", 5, "Positive"), ("bình thường", None, "Neutral"),
]


@query(_expected("sentiment", [(s,) for _, _, s in _FEELINGS]))
def cls_06_sentiment(spark, sf_dir):
    rows = normalize.normalized(_said(spark, sf_dir, [t for t, _, _ in _FEELINGS]))
    stars = F.element_at(F.array(*[F.lit(r).cast("int") for _, r, _ in _FEELINGS]), (F.col("event_id") % len(_FEELINGS) + 1).cast("int"))
    said = rows.withColumn("found", complaints.complaints(F.col("normalized"))).withColumn("sentiment", complaints.sentiment(F.col("normalized"), F.col("found"), stars))
    return said.groupBy("sentiment").agg(F.count("*").alias("n"))


_IRONY = [("Giao nhanh ghê, đặt mùng 1 mà 15 ngày mới tới", 1, True), ("tuyệt vời, hỏng sau một tuần, đúng là hàng tốt", 5, True), ("hàng đẹp, tuyệt vời", 5, False), ("hỏng rồi", 1, False), ("chuyên nghiệp", 2, True)]


@query(_expected("suspected", [(s,) for _, _, s in _IRONY]))
def cls_08_sarcasm(spark, sf_dir):
    rows = normalize.normalized(_said(spark, sf_dir, [t for t, _, _ in _IRONY]))
    stars = F.element_at(F.array(*[F.lit(r) for _, r, _ in _IRONY]), (F.col("event_id") % len(_IRONY) + 1).cast("int"))
    return rows.groupBy(complaints.sarcasm(F.col("normalized"), stars, F.lit(None).cast("string")).alias("suspected")).agg(F.count("*").alias("n"))
