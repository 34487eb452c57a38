import unicodedata

from pyspark.sql import functions as F

from voicegrain.functions import normalize, telex

MARKS = {"â": "aa", "ă": "aw", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}


def keys_of(word):
    """The Telex keys of a syllable, its tone key last."""
    tone, out = "", ""
    for c in unicodedata.normalize("NFC", word):
        for plain, forms in normalize.TONED.items():
            if c in forms:
                c, tone = plain, telex.TONE_KEYS[forms.index(c)]
        out += c
    out = out.replace("ươ", "uow")
    return "".join(MARKS.get(c, c) for c in out) + tone


def test_known_cases():
    said = {"chaamjmmmm": "chậm", "ddepjppppp": "đẹp", "khoongg": None, "hangf": None, "ddungs": "đúng", "nguowif": "người", "thuyrrr": "thủy", "Toots": "tốt"}
    assert {k: telex.restored(k) for k in said} == said
    assert [telex.restored(w) for w in ("max", "box", "bus", "good", "free", "wow", "shop", "size", "hhhh", "", "đẹp", "a1")] == [None] * 12


def test_every_marked_syllable_comes_back():
    n = 0
    for onset in ("", "ch", "ngh", "đ", "kh", "tr"):
        for nucleus in normalize.NUCLEI:
            for coda in ("", "m", "ng"):
                for tone in telex.TONE_KEYS:
                    word = telex.with_tone(onset, nucleus, coda, tone)
                    if not any(c in MARKS for c in onset + nucleus):
                        continue  # one sign alone is not enough
                    keys = keys_of(word)
                    if keys.endswith(("uowuf", "uowus")) or telex._KEYS.sub(lambda m: telex.MARKED[m[0]], keys.replace("dd", "đ", 1) if keys.startswith("dd") else keys)[:-1] != onset + nucleus + coda:
                        continue  # keys that type another syllable
                    assert telex.restored(keys) == word, (keys, word)
                    n += 1
    assert n > 1000


def test_whole_texts_and_nulls(spark):
    said = [("ngonnnnnn quáaaa", "ngon quá"), ("Shop giao chaamjmmmm!!", "shop giao chậm!!"), ("(ddepjppppp) lắm", "(đẹp) lắm"), ("okkkk free size m", "tốt free size m"), ("", ""), (None, "")]
    rows = spark.createDataFrame(said, "text string, want string")
    assert [r.normalized for r in normalize.normalized(rows).collect()] == [w for _, w in said]


def test_texts_without_telex_do_not_change(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("text")
    spaced = docs.select(F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    got = spaced.select("t", telex.resolver()(F.col("t")).alias("r")).collect()
    for t, r in ((x.t, x.r) for x in got):
        changed = [(a, b) for a, b in zip(t.split(" "), r.split(" ")) if a != b]
        assert len(t.split(" ")) == len(r.split(" ")) and all(len(b) <= len(a) for a, b in changed)
