"""Review texts made plain: masked, joined, shortened, and slang put into words; Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import canonical, mask_pii, once

# A starting dictionary of abbreviations and slang; pass your own, larger one.
SLANG = {
    "k": "không", "ko": "không", "kg": "không", "khong": "không", "hok": "không", "kh": "không", "kp": "không phải", "kt": "kiểm tra", "dc": "được", "đc": "được", "r": "rồi", "vs": "với",
    "m": "mình", "mk": "mình", "b": "bạn", "sp": "sản phẩm", "sop": "shop", "gh": "giao hàng", "cskh": "chăm sóc khách hàng", "nv": "nhân viên", "ship": "giao hàng", "shipper": "nhân viên giao hàng",
    "dt": "điện thoại", "ht": "hoàn tiền", "ok": "tốt", "oke": "tốt", "km": "khuyến mãi", "bh": "bảo hành", "tt": "thanh toán", "j": "gì", "z": "vậy", "wa": "quá", "iu": "yêu", "vl": "rất",
    "trc": "trước", "ntn": "như thế nào", "nhma": "nhưng mà", "cx": "cũng", "lm": "làm", "lun": "luôn", "toang": "hỏng", "lởm": "kém chất lượng", "fake": "hàng giả", "auth": "chính hãng",
    "ib": "nhắn tin riêng", "inbox": "nhắn tin riêng", "chát": "đắt", "c": "chị", "a": "anh", "e": "em", "chê": "không hài lòng",
    "xu cà na": "tệ", "xu ca na": "tệ", "chốt đơn": "đặt hàng", "ship kiến": "giao hàng rất chậm", "rùa bò": "rất chậm", "cắt cổ": "giá quá cao", "chặt chém": "giá cao bất hợp lý", "lồi lõm": "khó chịu",
    "không có gì để chê": "rất hài lòng", "chẳng có gì để chê": "rất hài lòng", "không có gì phải chê": "rất hài lòng", "chẳng có gì phải chê": "rất hài lòng", "hết chỗ chê": "rất tốt", "khỏi chê": "rất tốt", "không chê": "hài lòng",
}
# A single letter after these is a size or a kind, not an abbreviation.
LETTER_CONTEXT = ["size", "sz", "cỡ", "vitamin", "loại", "hạng"]
# Signs of feeling and the words that stand for them.
EMOJI = [
    (r"[\x{1F600}-\x{1F60F}\x{1F970}\x{1F495}\x{2764}\x{1F44D}]", " tích cực "), (r"[\x{1F620}-\x{1F62B}\x{1F44E}\x{1F62D}]", " tiêu cực "), (r"[\x{1F610}-\x{1F614}\x{1F644}]", " trung tính "),
]
# Each vowel with its five toned forms.
TONED = {"a": "àáảãạ", "ă": "ằắẳẵặ", "â": "ầấẩẫậ", "e": "èéẻẽẹ", "ê": "ềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọ", "ô": "ồốổỗộ", "ơ": "ờớởỡợ", "u": "ùúủũụ", "ư": "ừứửữự", "y": "ỳýỷỹỵ"}
# Parts of a syllable.
ONSETS = "ngh ng gh gi kh nh ph th tr ch qu b c d đ g h k l m n p r s t v x".split()
NUCLEI = (
    "a ă â e ê i o ô ơ u ư y ai ao au ay âu ây eo êu ia iê iu oa oă oe oi ôi ơi oo ua uâ uê ui uô uơ uy ưa ưi ưu ươ yê iêu yêu oai oay oeo uây uôi uya uyê uyu ươi ươu"
).split()
CODAS = "ch ng nh c m n p t".split()
# Signs of an advertisement.
SPAM = {
    "contact": r"(?iu)(?:inbox|\bib\b|\blh\b|liên hệ|zalo|call|gọi ngay|nhắn tin riêng)",
    "commerce": r"(?iu)(?:sỉ lẻ|chuyên sỉ|bán buôn|đại lý|ctv|cộng tác viên|tuyển|vay nhanh|vay tiền|lãi suất|hoa hồng|kiếm tiền|việc nhẹ|xả kho|giá sốc|giá gốc|rẻ nhất thị trường|freeship toàn quốc|nhận đặt hàng|hàng quảng châu|cam kết rẻ)",
    "url": r"(?i)(?:https?://|www\.|\.com|\.vn/|bit\.ly|shope\.ee)",
    "promo": r"(?iu)(?<![\p{L}\p{N}])(?:mã|code|voucher)\s*[:#]?\s*[A-Z0-9]{5,}(?![\p{L}\p{N}])",
    "phone": r"(?:\+?84|0)(?:[\s.-]?\d){8,10}\b",
}


def decode_entities(text: Column) -> Column:
    """Numeric and the six common named entities as characters; blanks collapsed."""
    numbered = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#x?[0-9a-fA-F]+;)"), F.lit(1)))

    def put(so_far: Column, entity: Column) -> Column:
        wide = F.lower(entity).startswith("&#x")
        digits = F.regexp_extract(entity, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.lpad(F.when(wide, digits).otherwise(F.conv(digits, 10, 16)), 8, "0")
        return F.replace(so_far, entity, F.decode(F.unhex(code), "UTF-32"))

    out = F.aggregate(numbered, text, put)
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def joined_letters(text: Column) -> Column:
    """Letters that a mark keeps apart (``s.ản``) joined, and words that a mark runs together (``tốt.giao``) split."""

    def joined(t: Column) -> Column:
        one = F.regexp_replace(t, r"(?<![\p{L}\p{M}])(\p{L}\p{M}*)[.\-_*]+(?=\p{L})", "$1")
        two = F.regexp_replace(one, r"(\p{L}\p{M}*)([.,!?;:]+)(?=\p{L})", "$1$2 ")
        return F.when(t.rlike(r"[.\-_*,!?;:]\p{L}"), two).otherwise(t)

    return once(text, joined)


def emoji_words(text: Column) -> Column:
    any_sign = "|".join(signs for signs, _ in EMOJI)
    put = lambda t: reduce(lambda x, e: F.regexp_replace(x, *e), EMOJI, t)
    return once(text, lambda t: F.when(t.rlike(any_sign), put(t)).otherwise(t))


def collapse_repeats(text: Column) -> Column:
    """A letter three or more times in a row once, and no plain vowel after the same vowel with a tone."""
    doubled = "|".join(f"[{toned}]{plain}" for plain, toned in TONED.items())

    def single(out: Column) -> Column:
        less = out
        for plain, toned in TONED.items():
            less = F.regexp_replace(less, f"(?iu)([{toned}]){plain}+", "$1")
        return F.when(out.rlike(f"(?iu)(?:{doubled})"), less).otherwise(out)  # few texts need the patterns of all vowels

    return once(F.regexp_replace(text, r"(?iu)(\p{L})\1{2,}", "$1"), single)


def is_syllable(word: Column) -> Column:
    """Whether a word is built like a Vietnamese syllable, tones apart."""
    bare = F.translate(F.lower(word), "".join(TONED.values()), "".join(k * 5 for k in TONED))
    part = lambda xs: "|".join(sorted(xs, key=len, reverse=True))
    return bare.rlike(f"^(?:{part(ONSETS)})?(?:{part(NUCLEI)})(?:{part(CODAS)})?$")


def keyboard_mash(text: Column) -> Column:
    """Whether at least half of the letters stand in words of a letter six or more times that no real word comes of."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    core = lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")
    letters = lambda w: F.char_length(F.regexp_replace(core(w), r"\P{L}", ""))
    junk = F.filter(words, lambda w: core(w).rlike(r"(\p{L})\1{5,}") & ~is_syllable(collapse_repeats(F.lower(core(w)))))
    total = lambda ws: F.aggregate(ws, F.lit(0), lambda n, w: n + letters(w))
    return (total(words) > 0) & (2 * total(junk) >= total(words))


def translate_slang(text: Column, slang: dict[str, str] | None = None) -> Column:
    """Lower-case text with phrases, then single words, of the dictionary replaced; marks around a word stay."""
    slang = SLANG if slang is None else slang
    phrases = sorted((k for k in slang if " " in k), key=lambda k: (-len(k), k))

    def spoken(low: Column) -> Column:
        out = low
        for phrase in phrases:
            out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])\Q{phrase}\E(?![\p{{L}}\p{{M}}\p{{N}}])", slang[phrase])
        return F.when(reduce(or_, (F.contains(low, F.lit(k)) for k in phrases), F.lit(False)), out).otherwise(low)

    known = F.create_map(*[F.lit(x) for k, v in slang.items() if " " not in k for x in (k, v)])
    core = lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")
    words = F.filter(F.split(once(F.lower(text), spoken), r"\s+"), lambda w: w != "")

    def put(words: Column, word: Column, k: Column) -> Column:
        def said(found: Column) -> Column:
            letter_code = (F.char_length(core(word)) == 1) & F.coalesce(core(F.get(words, k - 1)).isin(LETTER_CONTEXT), F.lit(False))
            turned = F.concat(F.regexp_extract(word, r"^(\p{P}*)", 1), found, F.regexp_extract(word, r"(\p{P}*)$", 1))
            return F.when(found.isNotNull() & ~letter_code, turned).otherwise(word)

        return once(F.element_at(known, core(word)), said)

    return F.array_join(once(words, lambda ws: F.transform(ws, lambda w, k: put(ws, w, k))), " ")


def spam_signals(text: Column) -> dict[str, Column]:
    return {name: text.rlike(pattern) for name, pattern in SPAM.items()}


def spam_reasons(text: Column) -> Column:
    """Why a text is an advertisement or empty of meaning, as an array of reasons (empty: it is neither)."""
    s = spam_signals(text)
    offers = [((s["contact"] | s["phone"]) & s["commerce"], "offer_with_contact"), (s["url"] & s["commerce"], "offer_with_link"), (s["promo"] & s["contact"], "code_with_contact")]
    empty = [((F.trim(text) != "") & ~text.rlike(r"\p{L}"), "signs_only"), (keyboard_mash(text), "keyboard_mash")]
    return F.array_compact(F.array(*[F.when(hit, F.lit(reason)) for hit, reason in offers + empty]))


def normalized(rows: DataFrame, text_col: str = "text", slang: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``normalized``: tags out, composed, personal data masked, letters joined, signs in words, drawn-out and Telex words put right, repeats out, slang translated; null is empty."""
    from .telex import resolver

    rows = rows.withColumn("_c", canonical(F.col(text_col)))  # a column of its own: what follows has lambdas, which cannot hold a Python function
    bare = F.regexp_replace(F.regexp_replace("_c", r"(?is)<script.*?</script>", " "), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    bare = F.when(F.contains("_c", F.lit("<")) | F.contains("_c", F.lit("&")), bare).otherwise(F.col("_c"))
    masked, _ = mask_pii(bare)
    plain = F.trim(F.regexp_replace(emoji_words(joined_letters(masked)), r"\s+", " "))
    rows = rows.withColumn("_p", plain).withColumn("_w", resolver(slang)(F.col("_p")))  # again a column of its own
    return rows.withColumn("normalized", translate_slang(collapse_repeats(F.col("_w")), slang)).drop("_c", "_p", "_w")
