import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from voicegrain.functions import complaints, normalize, text


def test_a_long_word_is_masked_in_linear_time(spark):
    """Half a million letters and no address: every start was tried before."""
    rows = spark.createDataFrame([("x" * 500_000,), ("a@b.c+d@e.f g@h.i",)], "text string")
    masked, kinds = text.mask_pii(F.col("text"))
    began = time.time()
    got = [tuple(r) for r in rows.select(F.length(masked), kinds).collect()]
    assert got == [(500_000, []), (22, ["email"])] and time.time() - began < 60


def test_a_text_is_lowered_once_for_all_keywords(spark):
    assert str(complaints.complaints(F.col("t"))._jc.toString()).count("lower(") == 1
    assert str(normalize.translate_slang(F.col("t"))._jc.toString()).count("lower(") == 1


def test_few_texts_of_a_batch_are_strings_at_a_time():
    texts = pa.array([None, "", "é " * 2000] * 3000)
    tracemalloc.start()
    got = text.nfc.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(pa.array([None, "", "\u00e9 " * 2000] * 3000))
    assert peak < 20e6  # the texts hold 24 MB, and as many again composed
