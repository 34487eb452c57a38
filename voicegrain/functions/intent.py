"""What a live comment wants: intent, topic, variant, quantity and measures, by rules on folded text; Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import canonical, fold, mask_pii


def _words(*patterns: str) -> str:
    return f"(?<![a-z0-9])(?:{'|'.join(patterns)})(?![a-z0-9])"


# Word patterns of the intents, on text without marks.
COMPLAINT = _words(
    "chua (nhan|giao|thay|ve|toi|den)( duoc)?( hang| don)?", "giao (cham|lau|tre)", "lau qua", "cham qua", "doi (mai|lau)", "lua( dao)?", "bung", "phot", "report", "to cao",
    "hang loi", "bi loi", "loi roi", "hong roi", "bi hong", "rach", "bong keo", "bi xu", "xu (long|roi)", "phai mau", "bi phai", "sai (size|mau|hang|san pham|sp)", "giao (sai|nham)", "gui nham",
    "khac (hinh|anh|mo ta|quang cao)", "khong giong (hinh|anh|mo ta)", "hoan tien", "tra hang", "doi hang", "boom hang", "te qua", "qua te", "chan", "that vong", "kem chat luong",
    "khong ai (tra loi|rep|phan hoi)", "nhan tin khong (ai )?(tra loi|rep)", "seen khong rep", "(khong|chua|ko|k) (tra loi|rep|phan hoi)( tin nhan| inbox| ib)?", "don (hom truoc|tuan truoc|lan truoc|cu)",
)
QUESTION = _words(
    "bao nhieu", "bn", "nhieu", "bao lau", "khi nao", "bao gio", "may ngay", "may kg", "may", "gi", "j", "sao", "the nao", "nhu nao", "ntn", "o dau", "dau", "nao",
    "khong", "ko", "k", "hok", "hong", "kh", "hem", "chua", "nhi", "a", "co (size|mau|ship|freeship|bao hanh|ma|voucher|tang)", "con (hang|size|mau|khong|ko|k|sz)", "het (hang|size|mau)( chua)?",
    "tu van", "xin (gia|link|size)", "gia sao", "link", "gio (hang )?so",
)
YES_NO = r"(?<![a-z0-9])(co|con|duoc|het)(?![a-z0-9]).*(?<![a-z0-9])(khong|ko|k|hok|hong|kh|hem|chua)(?![a-z0-9])\s*[?.!]*\s*$"
ORDER = _words("chot( don)?", "lay", "dat( hang)?", "mua", "order", "oder", "cho (em|e|minh|m|chi|c|anh|a|toi|t)", "ib", "inbox", "coc", "len don", "gom don", "dat coc", "em lay", "e lay", "minh lay")
PRAISE = _words(
    "dep( qua| the| ghe| xiu)?", "xinh( qua| xiu)?", "xin (qua|xo)", "ung( qua)?", "thich( qua)?", "tuyet( voi)?", "chat luong", "xuat sac", "dinh( cao)?", "iu shop", "yeu shop", "ung ho shop", "uy tin",
    "da nhan (hang|duoc)", "hang dep", "ok shop", "oke shop", "mlem", "ngon", "re qua", "hoi re",
)
# Topics of a question; the first that fits holds.
TOPICS = [
    ("promo", _words("ma (giam|live|khuyen mai|freeship|uu dai)( gia)?", "voucher", "khuyen mai", "km", "sale", "giam gia", "giam", "tang( kem)?", "qua tang", "flash sale", "deal", "combo", "freeship", "free ship")),
    ("price", _words("(?<!giam )gia", "bao nhieu", "bn", "nhieu tien", "bao nhieu tien", "nhiu", "xin gia", "gia sao", "tien", r"\d+k")),
    ("warranty", _words("bao hanh", "doi tra", "doi (size|mau|hang)", "doi duoc", "tra hang", "hoan", "loi thi( sao)?", "bao lau duoc")),
    ("stock", _words("con hang", "het hang", "con khong", "con ko", "con k", "con size", "con mau", "con sz", "het size", "het mau", "con (s|m|l|xl|xxl)", "co hang( lai)?", "ve hang")),
    ("size", _words("size", "sz", "sai", "co nao", "mac (vua|duoc)", "vua khong", r"\d+ ?kg", r"\dm\d*", r"cao \d+", r"nang \d+", "chieu dai", "rong", "kich thuoc", "so do")),
    ("shipping", _words("ship", "giao", "van chuyen", "phi ship", "bao lau", "may ngay", "khi nao (co|nhan|toi|den)", "hoa toc", "now", "grab", "cod", "tinh", "ha noi", "hn", "hcm", "sg", "sai gon", "da nang")),
    ("material", _words("chat lieu", "bi xu", "xu", "phai mau", "bi phai", "co gian", "mong", "day dan", "nong khong", "thoang", "vai( gi)?", "cotton", "thun", "len", "da (that|bo|pu)", "nhua", "inox", "kim loai", "thanh phan", "xuat xu", "made in", "san xuat")),
    ("color", _words("mau", "den", "trang", "do", "xanh", "hong", "be", "kem", "nau", "xam", "vang", "tim", "cam", "ghi")),
    ("payment", _words("thanh toan", "chuyen khoan", "ck", "tra gop", "stk", "tien mat", "quet ma", "vi", "momo", "zalopay")),
    ("authenticity", _words("chinh hang", "auth", "real", "fake", "hang that", "hang gia", "nhai", "rep 1:1", "tem", "bill", "hoa don")),
    ("howToOrder", _words("dat (sao|nhu nao|the nao|o dau)", "mua (sao|o dau|nhu nao)", "link( dau| o dau)?", r"gio (hang )?(so )?\d*", "chot (sao|nhu nao)", "ib (sao|o dau)")),
    ("usage", _words("dung (sao|the nao|nhu nao)", "su dung", "cach dung", "giat", "bao quan", "dung duoc (cho|khong)", "phu hop", "hop (voi|khong)", "da (dau|kho|nhay cam)")),
]
COLORS = {"đen": "den", "trắng": "trang", "đỏ": "do", "xanh dương": "xanh duong", "xanh lá": "xanh la", "xanh": "xanh", "hồng": "hong", "be": "be", "kem": "kem", "nâu": "nau", "xám": "xam", "vàng": "vang", "tím": "tim", "cam": "cam", "ghi": "ghi", "bạc": "bac"}
SIZES = [
    r"(?<![a-z0-9])(?:size|sz)\s*(xxxl|xxl|xl|xs|s|m|l|2xl|3xl|[2-4]\d)(?![a-z0-9])", r"(?<![a-z0-9])(xxxl|xxl|xl|xs|2xl|3xl)(?![a-z0-9])", r"(?<![a-z0-9])(?:chot|lay|con|mac)\s+(?:\d\s+)?(s|m|l)(?:\s*\d)?(?![a-z0-9])",
    r"(?<![a-z0-9])(?:chot|lay)(?:\s+[a-z]+){0,2}\s+(s|m|l)\s*$", r"(?<![a-z0-9])(xxl|xl|xs|s|m|l)\d(?![a-z0-9])",
]
QUANTITIES = [
    r"(?<![a-z0-9])(?:x|lay|chot|mua|dat|order|cho (?:em|e|minh|m|chi|c|anh|a))\s*(\d{1,2})(?![0-9])", r"(?<![0-9])(\d{1,2})\s*(?:cai|chiec|bo|hop|doi|sp|san pham|cay|lo|chai|goi)(?![a-z])", r"(?<![a-z0-9])(?:s|m|l|xl)(\d)(?![a-z0-9])",
]
SIZE_CODE = r"(?<![a-z0-9])(?:s|m|l|xl|xxl)\d(?![a-z0-9])"


def _first(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that fits, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def understood(comments: DataFrame, text_col: str = "text") -> DataFrame:
    """``comments`` with ``masked``, ``has_phone``, ``intent``, ``topic``, ``size``, ``color``, ``quantity``, ``height_cm``, ``weight_kg``.

    A null text is chatter.  Complaints come before questions, these before orders,
    then praise; a question with an order word and no question mark is an order.
    """
    masked, kinds = mask_pii(F.trim(F.regexp_replace(canonical(F.col(text_col)), r"\s+", " ")))
    f = F.replace(F.regexp_replace(fold(masked), r"([a-z])\1{2,}", "$1"), F.lit("[phone]"), F.lit(" "))
    rows = comments.withColumn("masked", masked).withColumn("has_phone", F.array_contains(kinds, "phone")).withColumn("_f", f)
    f = F.col("_f")
    yes_no, mark = f.rlike(YES_NO), F.contains(F.col("masked"), F.lit("?"))
    complaint = f.rlike(COMPLAINT) & ~(f.rlike("(?<![a-z])co (bi|hay bi|de bi)(?![a-z])") & yes_no)
    asks = mark | yes_no | F.regexp_replace(f, r"(?<![a-z])(chot|lay)\s+\w+\s+(khong|ko|k)\s*$", "").rlike(QUESTION)
    order = f.rlike(ORDER) | f.rlike(SIZE_CODE) | f.rlike(r"^\s*\+\s*\d") | F.col("has_phone")
    firm = order & ~mark & f.rlike("(?<![a-z])(chot|lay|dat|coc)(?![a-z])") & ~f.rlike("(?<![a-z])(sao|nao|dau|bao nhieu|bn)(?![a-z])")
    intent = F.when(complaint, "complaint").when(asks & ~firm, "question").when(order, "order").when(f.rlike(PRAISE), "praise").otherwise("chatter")
    rows = rows.withColumn("intent", intent)
    topic = F.coalesce(*[F.when(f.rlike(p), F.lit(name)) for name, p in TOPICS], F.lit("other"))
    color = F.coalesce(*[F.when(f.rlike(f"(?<![a-z]){plain}(?![a-z])"), F.lit(name)) for name, plain in COLORS.items()])
    metres = F.coalesce(F.nullif(F.regexp_extract(f, r"(\d)\s*m\s*(\d{1,2})", 1), F.lit("")), F.lit(None))
    height = F.coalesce((metres.cast("int") * 100 + F.rpad(F.regexp_extract(f, r"(\d)\s*m\s*(\d{1,2})", 2), 2, "0").cast("int")), F.nullif(F.regexp_extract(f, r"(1[4-9]\d)\s*cm", 1), F.lit("")).cast("int"))
    weight = _first(f, [r"(\d{2,3})\s*(?:kg|ky|ki|can)(?![a-z])", r"(?<![a-z])nang\s*(\d{2,3})(?![0-9])"]).cast("int")
    wants = F.col("intent").isin("question", "order")
    return rows.select(
        *comments.columns, "masked", "has_phone", "intent", F.when(F.col("intent") == "question", topic).alias("topic"), F.upper(_first(f, SIZES)).alias("size"), color.alias("color"),
        F.when(F.col("intent") == "order", F.coalesce(_first(f, QUANTITIES).cast("int"), F.lit(1))).alias("quantity"), F.when(wants, height).alias("height_cm"), F.when(wants, weight).alias("weight_kg"),
    )


def with_product(comments: DataFrame, products: DataFrame, text_col: str = "text") -> DataFrame:
    """``comments`` with ``product_id`` of the catalogue ``products (product_id, code, keyword)``: by cart number, else by the longest keyword in the text.

    A session's catalogue has some hundred keywords, so it is gathered to one row of
    an array and every comment looks through it: no pairs are made, and it works on a stream.
    """
    f = fold(canonical(F.col(text_col)))
    number = F.nullif(F.regexp_extract(f, r"(?<![a-z0-9])(?:gio(?: hang)?|so|sp|ma|mau so|link)\s*(?:so\s*)?(\d{1,3})(?![0-9])", 1), F.lit(""))
    catalogue = products.agg(F.collect_list(F.struct("product_id", F.col("code").cast("string").alias("code"), fold(F.col("keyword")).alias("keyword"))).alias("_all"))
    rows = comments.crossJoin(F.broadcast(catalogue)).withColumn("_f", F.concat(F.lit(" "), F.regexp_replace(f, "[^a-z0-9]+", " "), F.lit(" "))).withColumn("_n", number)
    coded = F.filter("_all", lambda p: p["code"] == F.col("_n"))
    named = F.filter("_all", lambda p: (F.char_length(p["keyword"]) >= 2) & F.contains(F.col("_f"), F.concat(F.lit(" "), p["keyword"], F.lit(" "))))
    longest = F.array_max(F.transform(named, lambda p: F.struct(F.char_length(p["keyword"]).alias("n"), p["product_id"].alias("product_id"))))
    return rows.withColumn("product_id", F.coalesce(F.get(coded, F.lit(0))["product_id"], longest["product_id"])).drop("_all", "_f", "_n")
