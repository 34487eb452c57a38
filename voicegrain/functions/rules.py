"""Small rules as Column expressions: votes, quiet hours, signals in texts, prices and dates as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNALS = {
    "url": r"(?i)https?://|www\.",
    "phone": r"(?:\+84|\b0)\d{9}\b",
    "contact": r"(?i)\b(zalo|telegram|inbox|whatsapp)\b",
    "promo": r"(?i)\b(free|sale|discount|click here|buy now)\b",
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z]+",
}


def spam_signals(text: Column) -> Column:
    """A struct of booleans, one for each signal; all false for null."""
    return F.struct(*[F.coalesce(text.rlike(p), F.lit(False)).alias(k) for k, p in SIGNALS.items()])


def in_quiet(hour: Column, start: int, stop: int) -> Column:
    """Whether an hour lies in [start, stop); the span may go over midnight, and is empty if both are equal."""
    if start == stop:
        return F.lit(False)
    return (hour >= start) & (hour < stop) if start < stop else (hour >= start) | (hour < stop)


def rating_vote(stars: Column) -> Column:
    return F.when(stars >= 4, "Positive").when(stars <= 2, "Negative").when(stars == 3, "Neutral")


def resolve_votes(primary: Column, judge: Column, rating: Column) -> tuple[Column, Column]:
    """The label that two of three voters share, else the judge's or the primary's; and whether a person should look."""
    two = F.when(primary == judge, primary).when(primary == rating, primary).when(judge == rating, judge)
    return F.coalesce(two, judge, primary), two.isNull()


def collapse_repeats(text: Column) -> Column:
    """Three or more equal letters in a row become one."""
    return F.regexp_replace(text, r"(\p{L})\1{2,}", "$1")


def join_spelled(text: Column) -> Column:
    """Single letters with full stops between them ("h.e.l.l.o") become a word."""
    return F.regexp_replace(text, r"(?<=(?<![\p{L}\p{M}])\p{L}|\.\p{L})\.(?=\p{L}(?![\p{L}\p{M}]))", "")


def ungrounded_numbers(text: Column, allowed: Column) -> Column:
    """Distinct numbers of two or more digits in ``text`` that are not in ``allowed``."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"(\d{2,})"), F.lit(1)), allowed)


def fill_template(template: Column, slots: Column) -> Column:
    """``template`` with ``{name}`` replaced from a map; null if one is missing."""
    done = F.aggregate(F.map_entries(slots), template, lambda t, s: F.replace(t, F.concat(F.lit("{"), s["key"], F.lit("}")), F.coalesce(s["value"], F.lit("{?}"))))
    return F.when(~done.rlike(r"\{[\w?]+\}"), done)


def vn_number(value: Column, digits: int = 0) -> Column:
    """Full stops between thousands and a decimal comma."""
    return F.translate(F.format_number(value, digits), ",.", ".,")


def parse_date(text: Column) -> Column:
    """d/m/y or y-m-d as a timestamp; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.trim(text), r"[.-]", "/"), F.lit(f)) for f in ("d/M/yyyy", "yyyy/M/d", "d/M/yy")])


def parse_money(text: Column) -> Column:
    """Whole units of a price: thousands marks and signs are dropped, "k" is a thousand and "tr" a million."""
    low = F.lower(F.trim(text))
    digits = F.regexp_replace(low, r"[^0-9]", "")
    short = F.regexp_extract(low, r"^([0-9]+)(?:[.,]([0-9]+))?\s*(k|tr)", 0) != ""
    unit = F.when(low.contains("tr"), 1_000_000).otherwise(1_000)
    plain = F.regexp_replace(F.regexp_extract(low, r"^([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".")
    return F.when(short, F.round(plain.try_cast("double") * unit).cast("long")).otherwise(digits.try_cast("long"))


def size_for(guide: Column, kg: Column, cm: Column) -> Column:
    """The first row of a size guide that holds both measures, else its last."""
    fits = F.filter(guide, lambda g: (kg <= g["max_kg"]) & (cm <= g["max_cm"]))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at(guide, F.lit(-1)))["size"]


def leaf(crumbs: Column, name: Column) -> Column:
    """The last breadcrumb that is not the product's own name."""
    return F.try_element_at(F.filter(crumbs, lambda c: c != name), F.lit(-1))
