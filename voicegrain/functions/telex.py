"""Words typed in Telex keys that an input method gave back as typed (``chaamj`` for ``chậm``), and words drawn out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .normalize import CODAS, NUCLEI, ONSETS, SLANG, TONED

# Tone keys in the order of the toned forms in TONED, and the keys of marked letters.
TONE_KEYS = "fsrxj"
MARKED = {"uow": "ươ", "aa": "â", "aw": "ă", "ee": "ê", "oo": "ô", "ow": "ơ", "uw": "ư", "w": "ư"}

_longest = lambda parts: "|".join(sorted(parts, key=len, reverse=True))
_SYLLABLE = re.compile(f"({_longest(ONSETS)})?({_longest(NUCLEI)})({_longest(CODAS)})?")
_KEYS = re.compile(_longest(MARKED))
_RUN = re.compile(r"([^\W\d_])\1{2,}", re.IGNORECASE)
_EDGES = re.compile(r"[^\w\s]|_")
_BARE = str.maketrans({toned: plain for plain, forms in TONED.items() for toned in forms})


def with_tone(onset: str, nucleus: str, coda: str, tone: str) -> str:
    """A syllable with its tone over the marked vowel, else the last before a coda, else the middle of three, else the first."""
    if not tone:
        return onset + nucleus + coda
    marked = [k for k, c in enumerate(nucleus) if c in "ăâêôơư"]
    at = nucleus.index("ơ") if "ươ" in nucleus else marked[-1] if marked else len(nucleus) - 1 if coda else len(nucleus) == 3
    toned = TONED[nucleus[at]][TONE_KEYS.index(tone)]
    return f"{onset}{nucleus[:at]}{toned}{nucleus[at + 1 :]}{coda}"


def restored(word: str) -> str | None:
    """The syllable that the keys of ``word`` type, or None.

    It takes two signs of Telex (tone key after a vowel, marked letters, ``dd``, a
    letter drawn out), one of them other than a marked vowel, and a syllable as result.
    """
    typed = word.lower()
    if not (typed.isascii() and typed.isalpha()):
        return None
    keys = _RUN.sub(r"\1", typed)
    drawn = keys != typed
    start = next((k for k, c in enumerate(keys) if c in "aeiouy"), None)
    if start is None:
        return None
    tone, letters = "", list(keys[: start + 1])
    for key in keys[start + 1 :]:
        if key in TONE_KEYS:
            tone = key
        else:
            letters.append(key)
    while len(letters) > 1 and letters[-1] == letters[-2] and letters[-1] not in "aeiouy":
        letters.pop()
    plain, signs = "".join(letters), 0
    if plain.startswith("dd"):
        plain, signs = "đ" + plain[2:], 2
    plain, marked = _KEYS.subn(lambda m: MARKED[m[0]], plain)
    if not (tone or drawn or typed.startswith("dd")) or signs + marked + bool(tone) + drawn < 2:
        return None
    parts = _SYLLABLE.fullmatch(plain)
    return with_tone(parts[1] or "", parts[2], parts[3] or "", tone) if parts else None


def shortened(word: str) -> str:
    """A letter three or more times in a row once, and no plain vowel after the same vowel with a tone."""
    out = _RUN.sub(r"\1", word)
    for plain, forms in TONED.items():
        out = re.sub(f"([{forms}]){plain}+", r"\1", out)
    return out


def understood(core: str, slang: dict[str, str]) -> str | None:
    """What a word drawn out or typed in Telex keys stands for, or None if it is neither."""
    low = core.lower()
    if _RUN.search(core):
        short = shortened(low)
        return short if _SYLLABLE.fullmatch(short.translate(_BARE)) or short in slang else restored(low)
    return None if low in slang else restored(low)


def resolver(slang: dict[str, str] | None = None):
    """A Column function that puts every drawn-out or Telex word of a text right; marks around a word stay.

    Texts come in Arrow batches; each distinct word of a batch is looked at once.
    """
    known = {k: v for k, v in (SLANG if slang is None else slang).items() if " " not in k}

    @F.pandas_udf(StringType())
    def resolve(texts: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def put(token: str) -> str:
            if token not in seen:
                a, z = 0, len(token)
                while a < z and _EDGES.match(token[a]):
                    a += 1
                while z > a and _EDGES.match(token[z - 1]):
                    z -= 1
                found = understood(token[a:z], known) if a < z else None
                seen[token] = token if found is None else token[:a] + found + token[z:]
            return seen[token]

        return texts.map(lambda t: None if t is None else " ".join(map(put, t.split(" "))))

    return resolve
