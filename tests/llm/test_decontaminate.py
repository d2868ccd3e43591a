"""Steps of decontamination that are written for speed, against plain ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagescore.llm import decontaminate as D
from pagescore.llm.common import UPPER, ascii_lower


def test_only_ascii_is_lowered(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(pd.DataFrame({"t": [f"Zb{chr(c)}Q" for c in points]}))
    wrong = rows.where(~ascii_lower(F.col("t")).eqNullSafe(F.translate("t", UPPER, UPPER.lower())))
    assert wrong.count() == 0 and spark.range(1).select(ascii_lower(F.lit(None).cast("string"))).first()[0] is None


def test_positions_are_those_of_the_shingles(spark):
    texts = ["a b c d e f", "One", "", None, "x y", "Été A-B c9 Ünd so ß", "a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_doc long, t string")
    keyed = docs.select("_doc", F.xxhash64("t").alias("_text_hash"), D.words_of(F.col("t")).alias("_words"))
    for width in (1, 2, 3):
        want = keyed.select("_doc", "_text_hash", F.size("_words").alias("_words_n"), F.posexplode(D.shingles("_words", width)).alias("_at", "_token"))
        got = D.positions(keyed, width)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
        assert "lambda" in want._jdf.queryExecution().toString() and "lambda" not in got._jdf.queryExecution().toString()
    counts = docs.select(F.coalesce(F.regexp_count("t", F.lit(D.ANY_CASE_WORD)), F.lit(0)), F.size(D.words_of(F.col("t"))))
    assert all(a == b for a, b in counts.collect())


def test_word_characters(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(pd.DataFrame({"t": [chr(c) for c in points]}))
    small, any_case = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    assert rows.where((F.col("t").rlike(D.WORD) != F.col("t").rlike(small)) | (F.col("t").rlike(D.ANY_CASE_WORD) != F.col("t").rlike(any_case))).count() == 0
    assert not D.WORD.startswith("[^")  # matching a complement took ten times as long
