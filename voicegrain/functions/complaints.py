"""What a normalised review complains of, by keywords that are neither negated nor praised; sentiment and sarcasm by rules. Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import SLANG
from .text import once

# Category and cause, keywords that name it, and nouns that count only with a complaint of the kind named last.
CAUSES = [
    ("Delivery", "LateDelivery", ["giao trễ", "ship chậm", "chờ mãi", "mấy ngày rồi chưa", "chưa thấy", "chưa nhận được hàng", "giữ hàng", "bao giờ mới", "vẫn chưa tới", "tăm hơi", "chưa giao", "quá hẹn", "trễ hẹn"], [], ""),
    ("Delivery", "LostPackage", ["thất lạc", "mất hàng", "không nhận được", "mất đơn", "không có hàng"], [], ""),
    ("Delivery", "DamagedInTransit", ["móp", "bẹp", "hộp nát", "rách nát", "vỡ khi nhận", "đóng gói ẩu", "bể khi giao", "nát bươm", "quăng quật", "dập nát", "không còn nguyên", "bẹp dúm"], ["thùng carton"], "damage"),
    ("Delivery", "WrongAddress", ["sai địa chỉ", "giao nhầm", "nhầm nhà", "giao sai người", "đưa nhầm", "nhà người khác", "tòa đối diện", "nhầm địa chỉ"], [], ""),
    ("Delivery", "CourierAttitude", ["ném hàng"], ["shipper", "tài xế", "người giao hàng"], "attitude"),
    ("ProductQuality", "NotAsDescribed", ["không giống", "khác ảnh", "không đúng mô tả", "khác quảng cáo", "khác hình", "size ghi", "mặc vào chật", "không như mô tả"], [], ""),
    ("ProductQuality", "TechnicalDefect", ["hỏng", "không lên nguồn", "chết máy", "không hoạt động", "tụt pin", "lỗi phần cứng", "yếu pin", "hết pin nhanh", "cục gạch", "không nhận sạc", "chập chờn", "dùng được mấy hôm", "dùng được đúng"], ["đèn báo"], "device"),
    ("ProductQuality", "ExpiredOrStale", ["hết hạn", "mốc", "ôi thiu", "không tươi", "cận date", "quá date", "quá hạn", "héo", "úa", "hư thối", "có mùi"], [], ""),
    ("ProductQuality", "MissingAccessory", ["thiếu phụ kiện", "thiếu cáp", "thiếu sạc", "thiếu quà", "không có dây", "chẳng có dây", "thiếu đồ", "không kèm", "thiếu món", "chẳng thấy"], [], ""),
    ("ProductQuality", "SuspectedCounterfeit", ["hàng giả", "hàng nhái", "hàng dựng", "không chính hãng"], [], ""),
    ("CustomerService", "SlowResponse", ["không trả lời", "không rep", "gọi không nghe máy", "chờ phản hồi", "không ai bắt máy", "không phản hồi", "không rep gì"], [], ""),
    ("CustomerService", "BadAttitude", ["thái độ", "hống hách", "lồi lõm", "mất lịch sự", "khó chịu ra mặt", "cáu gắt", "xấc"], [], ""),
    ("CustomerService", "WrongInformation", ["tư vấn sai", "sai thông tin", "nói một đằng", "lúc mua thì bảo", "giờ lại nói", "nói khác"], [], ""),
    ("CustomerService", "UnresolvedCase", ["chưa giải quyết", "đá qua đá lại", "vẫn chưa xong", "không ai xử lý"], [], ""),
    ("Payment", "GatewayError", ["lỗi thanh toán", "không thanh toán được", "giao dịch thất bại", "thanh toán trục trặc", "cổng cứ treo", "không đặt được hàng", "thẻ khác cũng không"], ["cổng thanh toán"], "payment"),
    ("Payment", "DoubleCharge", ["trừ hai lần", "trừ 2 lần", "trừ tiền thừa", "mất tiền oan", "trừ tiền hai"], [], ""),
    ("Payment", "WrongPromotion", ["không áp mã", "mã giảm giá lỗi", "voucher không dùng được", "chẳng thấy trừ", "không được giảm", "mã hết hạn"], [], ""),
    ("Payment", "WrongInvoice", ["sai hóa đơn", "hóa đơn lỗi", "sai số tiền", "sai mã số thuế", "sai tên công ty"], ["xuất vat", "hóa đơn xuất ra"], "invoice"),
    ("TechnicalApp", "AppSlowOrCrash", ["app lag", "app chậm", "lag", "treo app", "văng app", "đơ app", "giật lag", "muốn xỉu"], [], ""),
    ("TechnicalApp", "LoginError", ["không đăng nhập", "lỗi đăng nhập", "không vào được tài khoản", "báo sai mật khẩu", "đăng nhập không được"], [], ""),
    ("TechnicalApp", "DisplayError", ["lỗi hiển thị", "giao diện lỗi", "ảnh không hiện", "ô trắng", "không hiện", "mất chữ", "vỡ giao diện"], [], ""),
    ("TechnicalApp", "SearchError", ["tìm không ra", "lỗi tìm kiếm", "search không được", "ô tìm kiếm", "chẳng ra kết quả", "không tìm thấy sản phẩm"], [], ""),
    ("ReturnRefund", "SlowRefund", ["hoàn tiền chậm", "chưa hoàn tiền", "đợi hoàn tiền", "chưa thấy tiền"], [], ""),
    ("ReturnRefund", "ReturnRejected", ["không cho đổi", "từ chối trả hàng", "không đổi trả", "không chịu đổi"], [], ""),
    ("ReturnRefund", "ComplexProcess", ["thủ tục rườm rà", "quy trình phức tạp", "nhiều bước quá", "rắc rối quá", "rườm rà"], [], ""),
    ("PricePromotion", "HigherThanExpected", ["giá cao", "đắt", "giá chát", "không đáng tiền", "bên kia bán rẻ hơn", "rẻ hơn cả", "chặt chém", "mắc quá"], [], ""),
    ("PricePromotion", "MisleadingPromo", ["quảng cáo sai", "sale ảo", "khuyến mãi ảo", "nâng giá rồi giảm", "đội giá", "giảm sâu", "treo biển giảm"], [], ""),
]
# Patterns that count as a keyword of a cause.
CAUSE_PATTERNS = {"GatewayError": [r"thanh toán[^.,;]{0,15}(?:lỗi|không được|thất bại|trục trặc)"]}
# Complaints that make a noun one, by kind.
CUES = {
    "attitude": ["thái độ", "cáu", "gắt", "quát", "chửi", "hỗn", "láo", "thô lỗ", "mất lịch sự", "bất lịch sự", "khó chịu", "bực bội", "hống hách", "cọc", "xấc", "ném", "quăng", "vứt", "không nghe máy", "không gọi", "bắt chờ", "đòi thêm", "tự ý", "lừa", "kém", "tệ"],
    "damage": ["móp", "bẹp", "rách", "nát", "ướt", "vỡ", "bể", "dập", "thủng", "méo", "hư"],
    "device": ["nhấp nháy", "không sáng", "không lên", "chớp", "lỗi", "tắt ngúm", "báo đỏ"],
    "payment": ["lỗi", "treo", "đơ", "trục trặc", "thất bại", "không vào được", "không được", "chậm", "văng", "quay mãi"],
    "invoice": ["sai", "lỗi", "nhầm", "thiếu", "chưa", "không xuất", "mãi", "chậm", "trễ"],
}
# What before a keyword takes it back, within so many characters of its sentence; what praise after it does.
NEGATED = ["không hề", "chẳng hề", "không bị", "chẳng bị", "không có gì", "đâu có", "chả thấy", "không thấy", "nguyên vẹn", "sợ ", "lo ", "tưởng ", "nghĩ là ", "nghe nói "]
WINDOW = 18
NO = "không|chẳng|chả|chưa"
PRAISED = "tốt|thân thiện|nhiệt tình|vui vẻ|lịch sự|dễ thương|chuyên nghiệp|ổn|tuyệt|chu đáo|niềm nở|cẩn thận|hài lòng"
# Words of feeling, and what turns them round.
BAD = "chậm|hỏng|lỗi|tệ|xấu|kém|mất|thiếu|đắt|vỡ|móp|không|chưa|bực|thất vọng|tiêu cực|lag"
GOOD = "tốt|nhanh|đẹp|hài lòng|tuyệt|ưng|cẩn thận|nhiệt tình|đáng tiền|tích cực|ổn|ngon|xịn|thân thiện|dễ thương|(?<!mất |bất )lịch sự|chuyên nghiệp|chu đáo|chắc chắn"
BAD_TAKEN_BACK = r"(?:không|chẳng|chả|đâu có)\s+(?:(?:bị|có|hề|thấy)\s+)*(?:chậm|hỏng|lỗi|tệ|xấu|kém|mất|thiếu|đắt|vỡ|móp|bực|thất vọng|lag|treo|đơ|trễ|sai|nhầm|rách|ướt)(?:\s+(?:gì|nào|cả|đâu|chút nào|tí nào))*"
GOOD_TAKEN_BACK = r"(?:không|chẳng|chả|chưa|hổng|đâu có)\s+(?:(?:được|có|hề|quá|lắm|thấy|mấy)\s+)?(?:tốt|nhanh|đẹp|hài lòng|tuyệt|ưng|cẩn thận|nhiệt tình|đáng tiền|ổn|ngon|xịn|thân thiện)"
# Praise that sarcasm uses where no word takes it back, facts that belie it, and marks of tone.
SARCASM_PRAISE = rf"(?<!\p{{L}})(?<!(?<!\p{{L}})(?:{NO}|đâu có)\s(?:(?:được|có|hề|quá|lắm|thấy|mấy)\s)?)(tuyệt vời|xuất sắc|tuyệt|đỉnh|xịn|nhanh ghê|nhanh quá|nhanh thật|giỏi|hay ghê|hay quá|chuyên nghiệp|chu đáo|đáng tiền|cảm ơn shop|cám ơn shop|cảm ơn|10 điểm|mười điểm|5 sao|năm sao|hài lòng|ưng|quá ổn|tốt ghê|tốt thật|hay thật|đẹp ghê|siêu|nhất quả đất|nhất thế giới)(?!\p{{L}})"
SARCASM_FACT = r"(trễ|muộn|chậm|mãi|chưa (nhận|thấy|giao|tới|đến)|không (nhận|thấy|ai|giao|tới|đến|trả lời|phản hồi|dùng được|chạy|lên)|hỏng|vỡ|móp|rách|bể|lỗi|hư|giả|nhái|thiếu|mất|sai|lừa|chờ|đợi|tuần|tháng|\d+\s*ngày|hết hạn|hôi|ẩm|bẩn|cũ|trả hàng|hoàn tiền|bùng|ăn cắp|tệ|kém|chán)"
SARCASM_TONE = r"(ghê|quá trời|đúng là|thật là|thiệt là|thật sự là|cảm ơn .{0,20}vì|cám ơn .{0,20}vì|chúc mừng|hay thật|giỏi thật|nể thật|bái phục|ủa|haha|hihi|kkk|=\)\)|:\)\)|\)\)\)|ư\?|à\?|sao\?)"

_BEFORE = "(?<!(?:" + "|".join(rf"{c}[^.;!?\n]{{0,{WINDOW - len(c)}}}" for c in NEGATED) + r"))(?<!(?:^|\s)(?:" + NO + r"|đâu có)(?:\s(?:bị|có|hề|thấy|còn))?\s)"
_AFTER = rf"(?!(?:\s+(?!(?:{NO})(?!\p{{L}}))\p{{L}}+){{0,2}}?\s+(?:(?:rất|cực|khá|quá|siêu|luôn|cũng|vô cùng)\s+)?(?:{PRAISED})(?!\p{{L}}))"
_CLAUSE = r"[.,;!?\n]|\snhưng\s"


def _spelled(keyword: str, slang: dict[str, str]) -> list[str]:
    """A keyword as it is and as the slang dictionary turns it."""
    turned = keyword
    for phrase in sorted((k for k in slang if " " in k), key=len, reverse=True):
        turned = turned.replace(phrase, slang[phrase])
    turned = " ".join(slang.get(w, w) for w in turned.split(" "))
    return list(dict.fromkeys((keyword, turned)))


def _forms(keyword: str, slang: dict[str, str]) -> str:
    return "|".join(rf"\Q{x}\E" for x in _spelled(keyword, slang))


def _held(text: Column, keywords: list[str], slang: dict[str, str]) -> Column:
    """Whether a text holds one of the keywords at all; far cheaper than their patterns, which only such a text needs."""
    return reduce(or_, (F.contains(text, F.lit(x)) for k in keywords for x in _spelled(k, slang)))


def _not_taken_back(pattern: str) -> str:
    """The pattern with nothing before it that takes it back; what is before is looked at only where the pattern begins."""
    return f"(?={pattern}){_BEFORE}(?:{pattern})"


def stands(keyword: str, slang: dict[str, str] = SLANG) -> str:
    """The pattern of a keyword that is neither taken back before it nor praised after it."""
    return _not_taken_back(_forms(keyword, slang)) + _AFTER


def _noun_and_cue(noun: str, cue: str):
    """Whether a clause has the noun and, outside it, a complaint; neither taken back."""
    return lambda c: c.rlike(_not_taken_back(noun)) & F.regexp_replace(c, noun, "…").rlike(_not_taken_back(cue) + _AFTER)


def complaints(text: Column, slang: dict[str, str] = SLANG) -> Column:
    """``array<struct<confidence, category, cause>>`` of a normalised text, surest first; empty where nothing is complained of.

    Confidence is 0.5 and 0.15 for each keyword, at most 0.95.  A noun with a
    complaint of its kind in the same clause counts as a keyword.
    """
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: _found(low, slang))


def _found(low: Column, slang: dict[str, str]) -> Column:
    clauses = F.split(low, _CLAUSE)
    found = []
    for place, (category, cause, keywords, nouns, kind) in enumerate(CAUSES):
        named = [_held(low, [k], slang) & low.rlike(stands(k, slang)) for k in keywords]
        named += [low.rlike(p) & low.rlike(_not_taken_back(p) + _AFTER) for p in CAUSE_PATTERNS.get(cause, [])]
        hits = sum((n.cast("int") for n in named), F.lit(0))
        if nouns:
            noun = "|".join(_forms(t, slang) for t in nouns)
            cue = "|".join(_forms(c, slang) for c in CUES[kind])
            hits = hits + (_held(low, nouns, slang) & F.exists(clauses, _noun_and_cue(noun, cue))).cast("int")
        found.append(F.struct(hits.alias("hits"), F.lit(place).alias("place"), F.lit(category).alias("category"), F.lit(cause).alias("cause")))
    hit = F.filter(F.array(*found), lambda x: x["hits"] > 0)
    ordered = F.array_sort(F.transform(hit, lambda x: F.struct((-F.least(0.5 + x["hits"] * 0.15, F.lit(0.95))).alias("c"), x["place"].alias("place"), x["category"].alias("category"), x["cause"].alias("cause"))))
    return F.transform(ordered, lambda x: F.struct(F.round(-x["c"], 2).alias("confidence"), x["category"].alias("category"), x["cause"].alias("cause")))


def sentiment(text: Column, found: Column, rating: Column | None = None) -> Column:
    """Negative, Positive or Neutral of a normalised text, given its ``complaints``; stars fill in a neutral text, and one or two stars outweigh praise."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), BAD_TAKEN_BACK, " ổn ")
    turned, some = plain.rlike(GOOD_TAKEN_BACK), F.size(found) > 0
    said = F.when(plain.rlike(GOOD) & ~some & ~turned, "Positive").when(some | plain.rlike(BAD) | turned, "Negative").otherwise("Neutral")
    if rating is None:
        return said
    return F.when((rating <= 2) & (said != "Negative"), "Negative").when((rating >= 4) & (said == "Neutral"), "Positive").otherwise(said)


def sarcasm(text: Column, rating: Column, said: Column) -> Column:
    """Whether a normalised text may be sarcastic: praise, or a positive label, with few stars; or praise with a fact that belies it, and the tone or few stars."""
    praise, fact, tone = (text.rlike(p) for p in (SARCASM_PRAISE, SARCASM_FACT, SARCASM_TONE))
    low = F.coalesce(rating <= 2, F.lit(False))
    return (low & praise) | (low & F.coalesce(said == "Positive", F.lit(False))) | (praise & fact & (tone | low))
