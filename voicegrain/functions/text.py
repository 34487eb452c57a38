"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of text that are Python strings at once.
AT_ONCE = 1 << 20
_PLAIN = {"a": "áàảãạăắằẳẵặâấầẩẫậ", "e": "éèẻẽẹêếềểễệ", "i": "íìỉĩị", "o": "óòỏõọôốồổỗộơớờởỡợ", "u": "úùủũụưứừửữự", "y": "ýỳỷỹỵ", "d": "đ"}
#: What ``fold`` puts for each letter, for ``str.translate`` of lower-cased text.
FOLDED = {ord(c): k for k, v in _PLAIN.items() for c in v}
#: Order matters: a later pattern sees the text with the earlier ones already masked.  Each pattern needs a digit or an @.
PII = [
    # What counts as a phone number, an address, an order number, an identity card and an account.
    ("phone", r"(?:\+?84|0)(?:[\s.-]?\d){8,10}\b", "[PHONE]"),
    ("email", r"(?:(?<![\w.+-])|\G)[\w.+-]++@[\w-]+\.[\w.-]+", "[EMAIL]"),
    ("order", r"(?iu)(?<![\p{L}\p{N}])(?:mã đơn|ma don|đơn|don|order)[\s:#]*(?=[A-Z]*\d)[A-Z0-9]{6,}(?![\p{L}\p{N}])", "[ORDER]"),
    ("id", r"\b\d{9}\b|\b\d{12}\b", "[ID]"),
    ("account", r"\b\d{10,16}\b", "[ACCOUNT]"),
]


def fold(text: Column) -> Column:
    """Lower case without Vietnamese marks (composed letters)."""
    source = "".join(_PLAIN.values())
    target = "".join(k * len(v) for k, v in _PLAIN.items())
    return F.translate(F.lower(text), source, target)


def strip_html(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and tags gone, five entities decoded, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask_pii(text: Column) -> tuple[Column, Column]:
    """The masked text, and the sorted kinds found in order of masking."""
    kinds, masked = [], text
    for name, pattern, _ in PII:
        kinds.append(F.when(masked.rlike(pattern), F.lit(name)))
        masked = _masked(masked, name)
    return once(text, lambda t: F.when(t.rlike(r"[\d@]"), reduce(_masked, [name for name, _, _ in PII], t)).otherwise(t)), F.array_compact(F.array(*kinds))


def _masked(text: Column, kind: str) -> Column:
    return next(F.regexp_replace(text, pattern, mark) for name, pattern, mark in PII if name == kind)


def tokens(text: Column, stop: list[str] = ()) -> Column:
    """Folded runs of letters and digits longer than one, without stop words."""
    all_words = F.split(fold(text), r"[^\p{L}\p{N}]+")
    return F.filter(all_words, lambda w: (F.char_length(w) > 1) & (~w.isin(*stop) if stop else F.lit(True)))


def simhash32(words: Column) -> Column:
    """32-bit SimHash of an array of words, repeats included, by FNV-1a over code points; 0 for no words."""

    def fnv(word: Column) -> Column:
        step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.aggregate(F.split(word, ""), F.lit(2166136261).cast("long"), step)

    hashes = F.transform(words, fnv)
    vote = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.when(vote(b) > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bits), F.expr("0L"), lambda n, bit: 2 * n + bit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def mask_name(name: Column) -> Column:
    """"Quang Dinh Ha" to "Quang D. H."; a single word keeps its first letter."""
    parts = F.split(F.trim(name), r"\s+")
    many = F.concat_ws(" ", F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " "))
    return F.when(F.size(parts) > 1, many).otherwise(F.concat(F.substring(F.trim(name), 1, 1), F.lit("***")))


def pseudonym(platform: Column, customer: Column, salt: str) -> Column:
    return F.concat(F.lower(platform), F.lit(":"), F.substring(F.sha1(F.concat_ws("|", F.lit(salt), platform, customer.cast("string"))), 1, 12))


def hash_share(key: Column) -> Column:
    """A stable number from 0 to 99 of a key: the first four bytes of its SHA-1 modulo 100."""
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long"), F.lit(100))


def dedup_key(*parts: Column) -> Column:
    """SHA-1 of the parts joined by U+0001; a null part counts as empty."""
    return F.sha1(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed form of texts; no built-in function composes letters.

    Of an Arrow batch only ``AT_ONCE`` bytes or one text are Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1
    parts = []
    for lo, hi in zip([0, *cuts], [*cuts, len(text)]):
        parts.append(pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in text[lo:hi].to_pylist()], pa.string()))
    return pa.concat_arrays(parts)


def canonical(text: Column) -> Column:
    """Composed letters, no invisible characters, every blank a space; null is empty."""
    shown = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}]", "")
    return F.regexp_replace(shown, "[\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]", " ")


def conform(label: Column, present: list[str], old: dict[str, str]) -> Column:
    """A label of the present taxonomy: itself, what an older label stands for, or Other."""
    renamed = F.element_at(F.create_map(*[F.lit(x) for pair in old.items() for x in pair]), label)
    return F.when(label.isin(present), label).otherwise(F.coalesce(renamed, F.lit("Other")))


def author_hash(platform: Column, handle: Column, salt: str) -> Column:
    """Sixteen hex digits that stand for an author; null without a handle."""
    return F.when(F.coalesce(handle, F.lit("")) != "", F.substring(F.sha2(F.concat_ws("|", F.lit(salt), platform, handle), 256), 1, 16))
