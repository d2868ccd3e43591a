from __future__ import annotations

import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagescore.functions import text as T
from pagescore.functions.geometry import iou
from pagescore.operators.alignment import align, assign, best_assignment, resolve


def test_normalize_and_tokens(spark):
    rows = [("Straße  ÉTÉ-1 ¹ x̀",), ("",), (None,), ("日本語 ٣ a_b",), ("ﬁne ǅ",)]
    df = spark.createDataFrame(rows, "t string").withColumn("n", T.normalize_text(F.col("t"))).withColumn("w", T.tokens(F.col("n"))).withColumn("any", T.normalize_any_text("t"))
    got = df.collect()
    for r in got:
        if r["t"] is not None:
            folded = unicodedata.normalize("NFC", r["t"]).casefold()
            assert r["any"] == " ".join("".join(c if c.isalpha() or c.isdecimal() else " " for c in folded).split())
    assert got[0]["n"].startswith("strasse été 1 x") and got[1]["w"] == [] == got[2]["w"] and got[3]["n"] == "日本語 ٣ a b"


def test_ngrams_backoff_occurrences(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 2, "aaa", "aa"), (["a"], 3, "", ""), ([], 1, "xyx", "x"), (["a", "b"], 0, "ab", "")], "w array<string>, n int, t string, m string")
    got = df.select(T.ngrams(F.col("w"), F.col("n")).alias("g"), T.backed_off(F.col("w"), 3).alias("k"), T.occurrences(F.col("t"), F.col("m")).alias("o")).collect()
    assert [r["g"] for r in got] == [["a b", "b c"], [], [], []]
    assert [r["k"] for r in got] == [3, 1, 1, 2] and [r["o"] for r in got] == [1, 1, 2, 3]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(row[k], last[k + 1])
    return row[-1]


def test_similarities(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("abcé ", k=rng.randrange(0, 30))), "".join(rng.choices("abcé ", k=rng.randrange(0, 30)))) for _ in range(80)] + [("", ""), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.indel_ratio("a", "b").alias("r"), T.text_similarity(F.col("a"), F.col("b")).alias("s"), T.text_similarity(F.col("a"), F.col("b"), "token").alias("t"), T.edit_similarity(F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        if r["b"] is not None:
            n = len(r["a"]) + len(r["b"])
            assert r["r"] == pytest.approx(1.0 if n == 0 else 2 * lcs(r["a"], r["b"]) / n)
            x, y = " ".join(r["a"].split()), " ".join(r["b"].split())
            assert r["s"] == pytest.approx(1.0 if x == y else 0.0 if not x or not y else 2 * lcs(x, y) / (len(x) + len(y)))
    kitten = spark.range(1).select(T.edit_similarity(F.lit("kitten"), F.lit("sitting")).alias("e"), T.text_similarity(F.lit("b a"), F.lit("a b"), "token").alias("t")).first()
    assert kitten["e"] == pytest.approx(1 - 3 / 7) and kitten["t"] == 1.0


def test_iou(spark):
    rows = [(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0), (1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), (None, None, None, None, 0.0, 0.0, 1.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{s}{c} double" for s in "ab" for c in ("x0", "y0", "x1", "y1"))).select(iou("a", "b")).collect()]
    assert got[0] == pytest.approx(1 / 7) and got[1:] == [0.0, 0.0, None]


def test_assignment_against_all_permutations():
    import itertools

    import numpy as np

    rng = random.Random(2)
    for _ in range(120):
        n, m = sorted((rng.randrange(1, 6), rng.randrange(1, 6)))
        profit = np.array([[rng.choice([0, 0, round(rng.random(), 3) + m + 1]) for _ in range(m)] for _ in range(n)], float)
        best = max(sum(profit[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = best_assignment(profit)
        assert len(set(got.tolist())) == n and sum(profit[i, got[i]] for i in range(n)) == pytest.approx(best)


def test_align(spark):
    box = "page_id string, region_id string, x0 double, y0 double, x1 double, y1 double"
    gt = spark.createDataFrame([("p", "a", 0.0, 0.0, 1.0, 1.0), ("p", "b", 0.0, 0.05, 1.0, 1.05), ("p", "same", 0.0, 5.0, 1.0, 6.0), ("p", "lost", 0.0, 9.0, 1.0, 10.0), ("p", "", 0.0, 0.0, 1.0, 1.0), ("p", "nobox", None, None, None, None)], box)
    cand = spark.createDataFrame([("p", "x", 0.0, 0.0, 1.0, 1.0), ("p", "y", 0.0, -0.4, 1.0, 0.6), ("p", "same", 7.0, 7.0, 8.0, 8.0), ("q", "z", 0.0, 9.0, 1.0, 10.0)], box)
    got = {r["gt_id"]: (r["cand_id"], r["pass"]) for r in align(gt, cand).collect()}
    # the greedy choice would give x to the best overlap and leave y alone
    assert got == {"a": ("x", 2), "b": (None, None), "same": ("same", 1), "lost": (None, None), "nobox": (None, None)} or got["a"][0] == "y" and got["b"][0] == "x"


def test_resolve_keeps_free_pairs_out_of_groups(spark):
    pairs = spark.createDataFrame([("p", "a", "x", 0.9), ("p", "b", "y", 0.8), ("p", "b", "z", 0.7), ("p", "c", "y", 0.6)], "page_id string, gt_id string, cand_id string, iou double")
    assert {(r["gt_id"], r["cand_id"]) for r in resolve(pairs).collect()} == {("a", "x"), ("b", "z"), ("c", "y")}
    assert len(assign(pairs.toPandas())) == 3


def test_normalize_is_the_same_in_python_and_expressions(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(pd.DataFrame({"t": [f"Zb{chr(c)}Q" for c in points]}))
    assert rows.where(~T.normalize(F.col("t")).eqNullSafe(T.normalize_any_text("t"))).count() == 0
    # texts of Western European languages stay out of Python
    usual = spark.createDataFrame([("École – Straße, naïve… 5 €",), ("plain",), ("Łódź ž",)], "t string")
    assert usual.where(F.col("t").rlike(T.UNUSUAL)).count() == 0
    assert [r[0] for r in usual.select(T.normalize(F.col("t"))).collect()] == ["école strasse naïve 5", "plain", "łódź ž"]
