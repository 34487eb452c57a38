"""Quality classifier: boosted trees over document statistics (operator 8)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from . import boosting
from .labelled import collect_features, scored, training_rows

#: At most so many labelled rows are learnt from.
TRAINING_ROWS = 8000
CUT = 0.3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*@^~<>{}[]\\_=+")] = True
_ENDS = (".", "!", "?", '."', ".'")


def features(text: str) -> list[float]:
    """Statistics of a whole text; shares are of words or bytes, and 0 for an empty text."""
    words = text.split()
    n = max(len(words), 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    many = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        lengths.mean() if len(words) else 0.0,
        lengths.std() if len(words) else 0.0,
        float(lengths.max()) if len(words) else 0.0,
        len(many) / n,
        max(many.values(), default=0) / n,
        repeats / n,
        pairs / max(len(words) - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        sum(x.endswith(_ENDS) for x in lines) / max(len(lines), 1),
        many.get("|", 0) / n,
        count[_SYMBOLS].sum() / size,
        count[ord("!")] / size,
        count[65:91].sum() / size,
        count[97:123].sum() / size,
        count[48:58].sum() / size,
        count[128:].sum() / size,
        (count[ord(".")] + count[ord(",")]) / size,
        len(re.findall(r"https?://|www\.|@", text)) / n,
    ]


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; score: how likely label 1 is.

    Learns ``labels.quality`` from at most ``rows`` labelled documents outside the
    held-out fold.  A null text is empty and is scored like one; a null doc_id
    counts as held out; repeated rows each get their row; without labels of both
    classes every score is the smoothed share of label 1; other columns are not read.
    """
    x, y, _ = collect_features(training_rows(docs, labels, "quality", rows), features)
    model = boosting.fit(x, y)
    return scored(docs, features, model.probability, cut)
