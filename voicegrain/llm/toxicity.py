"""Toxicity: boosted trees over dense features, isotonically calibrated (operator 9).

The lexicon is learnt: of the words and word beginnings of the training rows, those
that toxic texts use far more often.  Features are densities of lexicon words, how
near they stand to a second-person pronoun, capitals, punctuation and rates of
obfuscated spelling.  Three of the four training folds give the lexicon and fit the
trees; the fourth, which neither has seen, fits the calibration.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .labelled import collect_features, scored, training_rows, with_score

#: At most so many labelled rows are learnt from.
TRAINING_ROWS = 8000
#: At most so many word beginnings form the lexicon; each stands in so many toxic texts at least.
LEXICON = 300
LEAST_TEXTS = 4
CUT = 0.5
NEAR = 6
_BEGIN, _END = 4, 8  # lengths of the word beginnings that are counted
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus tus".split())
#: Characters that stand for letters in disguised spelling.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_TOKEN = re.compile(r"[^\s|]+")
_EDGE = "#$%&*!?.,;:\"'()[]{}<>-_|"


def plain(token: str) -> str:
    """A token in lower case without the marks around it; letters behind digits and signs are restored."""
    word = token.strip(_EDGE).lower()
    return word if word.isalpha() or word.isdigit() else re.sub(r"[^\w]", "", word.translate(DISGUISE))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Word beginnings (and whole words) with how much oftener toxic texts use them, as a logarithm.

    Counted by Spark over the bounded training rows; only the ``size`` strongest
    come to the driver.
    """
    words = rows.select("doc_id", "y", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''")
    total = words.groupBy("y").agg(F.count("*").alias("n")).collect()
    n = {r["y"]: float(r["n"]) for r in total}
    if not n.get(0) or not n.get(1):
        return {}
    cut = F.explode(F.transform(F.sequence(F.lit(_BEGIN), F.lit(_END + 1)), lambda k: F.when(k <= _END, F.when(F.char_length("w") >= k, F.concat(F.substring("w", F.lit(1), k), F.lit("*")))).otherwise(F.col("w"))))
    per_doc = words.groupBy("doc_id", "y", "w").agg(F.count("*").alias("c")).select("doc_id", "y", "c", cut.alias("t")).where("t is not null")
    per_doc = per_doc.groupBy("t", "doc_id", "y").agg(F.sum("c").alias("c"))
    stats = per_doc.groupBy("t").agg(*[F.sum(F.when(F.col("y") == y, v).otherwise(0)).alias(f"{k}{y}") for y in (0, 1) for k, v in (("d", F.lit(1)), ("c", F.col("c")))])
    ratio = F.log((F.col("c1") + 0.5) / n[1]) - F.log((F.col("c0") + 0.5) / n[0])
    weighed = stats.where(F.col("d1") >= LEAST_TEXTS).withColumn("ratio", ratio).where("ratio > 1.2")
    best = weighed.withColumn("gain", F.col("c1") * F.col("ratio")).orderBy(F.desc("gain"), "t").limit(4 * size).collect()
    chosen: dict[str, float] = {}
    for r in best:
        t = r["t"].rstrip("*")
        if not any(t.startswith(c[:-1]) for c in chosen if c.endswith("*")) and len(chosen) < size:
            chosen[r["t"]] = float(r["ratio"])
    return chosen


class Features:
    """Dense features of a text, for a given lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.starts = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        """The strength of a token in the lexicon, 0 if it is not in it; negative for second-person words."""
        found = self.known.get(token)
        if found is None:
            word = plain(token)
            found = max([self.words.get(word, 0.0), *(self.starts.get(word[:k], 0.0) for k in range(_BEGIN, _END + 1) if len(word) >= k)])
            if not found and word in SECOND_PERSON:
                found = -1.0
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = found
        return found

    def __call__(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text)
        n = max(len(tokens), 1)
        w = np.fromiter(map(self.weight, tokens), np.float64, len(tokens))
        hit, you = np.flatnonzero(w > 0), np.flatnonzero(w < 0)
        strong = int((w > 3).sum())
        near = 0
        if len(hit) and len(you):
            at = np.searchsorted(you, hit)
            left = np.where(at > 0, hit - you[np.maximum(at - 1, 0)], 1 << 30)
            right = np.where(at < len(you), you[np.minimum(at, len(you) - 1)] - hit, 1 << 30)
            near = int((np.minimum(left, right) <= NEAR).sum())
        window = np.convolve(w > 0, np.ones(25), "valid").max() if len(w) >= 25 else float(len(hit))
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        count = np.bincount(data, minlength=256)
        size = max(len(data), 1)
        mixed = len(_DISGUISED.findall(text))
        return [
            len(hit) / n,
            float(len(hit)),
            w[hit].sum() / n,
            strong / n,
            float(strong),
            float(w.max()) if len(w) and w.max() > 0 else 0.0,
            float(len(set(tokens[i] for i in hit))),
            float(window),
            near / n,
            len(you) / n,
            float(np.log1p(len(tokens))),
            count[65:91].sum() / size,
            count[ord("!")] / size,
            count[ord("?")] / size,
            (count[ord(".")] + count[ord(",")]) / size,
            mixed / n,
            count[[ord(c) for c in "#$%&*@"]].sum() / size,
        ]


_DISGUISED = re.compile(r"[^\W\d_][0-9@$*]+[^\W\d_]|([^\W\d_])\1\1")


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; score: how likely label 1 is.

    Learns ``labels.toxic`` from at most ``rows`` labelled documents outside the
    held-out fold.  A null text is empty and is scored like one; a null doc_id
    counts as held out; repeated rows each get their row; without labels of both
    classes every score is the smoothed share of label 1; other columns are not read.
    """
    features, score = learn(docs, labels, rows)
    return scored(docs, features, score, cut)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS):
    """The features of a text and the calibrated score of feature rows, learnt from at most ``rows`` labelled documents."""
    known = training_rows(docs, labels, "toxic", rows)
    features = Features(learn_lexicon(known.where("part <> 4")))
    x, y, part = collect_features(known, features)
    model = boosting.fit(x[part != 4], y[part != 4], trees=60)
    calibrate = boosting.isotonic(model.probability(x[part == 4]), y[part == 4])
    return features, lambda z: calibrate(model.probability(z))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``cut``."""
    features, score = learn(docs, labels, rows)
    return with_score(docs, features, score, "_toxicity").where(F.col("_toxicity") < cut).drop("_toxicity")
