import json
import sys

import pytest
from pyspark import cloudpickle

from voicegrain.operators import cascade

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def _answer(sentiment, category="Other", **more):
    return json.dumps({"sentiment": sentiment, "category": category, **more})


class Stub:
    """Answers the texts that it knows."""

    def __init__(self, name, known, short=False):
        self.name, self.known, self.short = name, known, short

    def answers(self, texts, ratings):
        assert len(texts) == len(ratings)
        return [self.known.get(t) for t in texts][: len(texts) - self.short]


ROWS = [
    (1, "hàng đẹp lắm", 5),
    (2, "máy hỏng rồi", 1),
    (3, "app lag quá", None),
    (4, "tuyệt vời, chờ cả tuần, đúng là giao nhanh", 1),
    (5, "tuyệt vời, chờ cả tháng, đúng là nhanh", 5),
    (6, "hàng lỗi", 5),
    (7, None, None),
    (8, "", 4),
    (9, "hoàn tiền chậm", 2),
    (9, "hoàn tiền chậm", 2),
]


def _got(spark, rows=ROWS, **more):
    items = spark.createDataFrame(rows, "id int, text string, rating int")
    return sorted((tuple(r) for r in cascade.labels(items, key="id", **more).collect()), key=str)


def test_fallback_order_judge_and_votes(spark):
    first = Stub("first", {"hàng đẹp lắm": _answer("Positive"), "hoàn tiền chậm": "no json"})
    second = Stub("second", {"hàng đẹp lắm": _answer("Negative"), "máy hỏng rồi": _answer("Negative", "Product", subCategory="TechnicalDefect"), ROWS[3][1]: _answer("Positive"), ROWS[4][1]: _answer("Positive", "Delivery"), "hàng lỗi": _answer("Negative", "ProductQuality")})
    judge = Stub("judge", {ROWS[3][1]: _answer("Negative", "Delivery", subCategory="LateDelivery", sarcastic=True), ROWS[4][1]: _answer("Negative", "Payment", sarcastic=True)})
    got = {r[0]: r[1:] for r in _got(spark, models=[first, second], judge=judge)}
    assert got[1] == ("Positive", "Other", None, "first", False, None, False)  # the second is not asked
    assert got[2] == ("Negative", "ProductQuality", "TechnicalDefect", "second", False, None, False)
    assert got[3] == ("Negative", "TechnicalApp", "AppSlowOrCrash", "rules", False, None, False)  # no model answers
    assert got[4] == ("Negative", "Delivery", "LateDelivery", "cascade", True, "sarcastic", False)
    assert got[5] == ("Positive", "Delivery", None, "second", True, "sarcastic", True)  # stars and model outvote, problems differ
    assert got[6][4:] == (True, None, True)  # flagged by its stars, and the judge is silent
    assert got[7][:4] == ("Neutral", "Other", None, "rules") and got[8][:2] == ("Positive", "Other")
    assert got[9][3] == "rules" and got[9][1] == "ReturnRefund"


def test_answers_given_beforehand_come_first(spark):
    known = spark.createDataFrame([(3, _answer("Neutral", "Payment"), "batch")], "id int, answer string, model string")
    got = {r[0]: r[1:] for r in _got(spark, known=known, models=[Stub("first", {"app lag quá": _answer("Positive")})])}
    assert got[3][:4] == ("Neutral", "Payment", None, "batch")


def test_rows_and_empty_tables(spark):
    assert [r[0] for r in _got(spark)] == sorted((r[0] for r in ROWS), key=str)  # a row each, repeated ones too
    assert _got(spark, rows=[], models=[Stub("a", {})], judge=Stub("b", {})) == []
    with pytest.raises(Exception, match="answers to"):
        _got(spark, models=[Stub("short", {}, short=True)])


def test_praise_that_is_taken_back_is_no_sarcasm(spark):
    rows = [(1, "không hài lòng, máy hỏng rồi", 1), (2, "chê, máy hỏng rồi", 1), (3, "hài lòng, máy hỏng rồi", 1), (4, "chưa thấy hài lòng", 1), (5, "không. Hài lòng quá, hỏng rồi", 1)]
    got = {r[0]: r[5] for r in _got(spark, rows=rows)}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True}


def test_doubt_ends_with_its_sentence(spark):
    rows = [(1, "hỏi cho khỏi lo nhé. app lag quá", None), (2, "cứ lo là app lag quá", None)]
    assert {r[0]: r[3] for r in _got(spark, rows=rows)} == {1: "AppSlowOrCrash", 2: None}
