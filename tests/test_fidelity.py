"""Text fidelity of pages counted in one pass, against the bags that are exploded and joined."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagescore.functions.text import edit_similarity
from pagescore.operators import fidelity

GT = [
    ("a", "r1", "one two three four one two three"), ("a", "r2", "five six"), ("a", "r3", "seven"), ("a", "r4", "!"), ("a", "r5", "one two three eight nine"),
    ("a", "r1", "a second region of this id"), ("a", "", "no id at all here"), ("a", "", "no id at all here"),
    ("b", "r1", "x y"), ("b", "r2", "z"), ("c", "r1", "?"), ("d", "r1", "here is a text that none has"),
]
CAND = [
    ("a", "c1", "one two three five six one two three"), ("a", "c2", "five six"), ("a", "c3", "seven of nine"), ("a", "c5", "seven one two three four"), ("a", "c9", "one two three four"),
    ("b", "c1", "z x y"), ("b", "c2", ""), ("c", "c1", "some words here"),
]


def test_one_pass_counts_what_joins_count(spark):
    schema = "page_id string, region_id string, text string"
    gt, cand = (fidelity.worded(spark.createDataFrame(rows, schema)).cache() for rows in (GT, CAND))
    mapping = spark.createDataFrame([(p, r, r.replace("r", "c")) for p, r in {(p, r) for p, r, _ in GT} if r and (p, r) not in (("d", "r1"), ("a", "r4"))], "page_id string, gt_id string, cand_id string")
    aligned = fidelity.aligned_text(gt, cand, mapping)
    counted = fidelity.compared(gt, aligned, cand)
    kept, moved = fidelity.region_figures(counted, aligned)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(fidelity.page_figures(counted)) == rows(fidelity.page_containment(gt, cand))
    assert rows(kept) == rows(fidelity.retention(aligned, both=False))
    assert rows(moved) == rows(fidelity.misplacement(aligned, gt, fidelity.page_n(gt)))


def test_grams_are_not_shuffled(spark):
    schema = "page_id string, region_id string, text string"
    gt, cand = spark.createDataFrame(GT, schema), spark.createDataFrame(CAND, schema)
    mapping = spark.createDataFrame([("a", "r1", "c1")], "page_id string, gt_id string, cand_id string")
    plan = fidelity.text_fidelity(gt, cand, mapping)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bgram#", plan)


def test_a_text_is_counted_once(monkeypatch):
    asked, plain = [], fidelity.bag
    monkeypatch.setattr(fidelity, "bag", lambda words, n: asked.append(tuple(words)) or plain(words, n))
    texts = ["a b c d", "a b c e f", "g h i j"]
    rows = [{"region_id": f"r{k}", "norm": t, "c_norm": c} for k, (t, c) in enumerate(zip(texts, ["a b c d", "g h i j", "a b c e f"], strict=True))]
    assert fidelity.compared_page(rows, texts) == (3, 7, 7, 7, [("r0", 2, 2, 2, 0), ("r1", 3, 0, 0, 2), ("r2", 2, 0, 0, 3)])
    assert len(asked) == 3


def test_edit_distance_in_batches(spark):
    draw = random.Random(3)
    some = lambda: "".join(draw.choice("abé𝒳 ") for _ in range(draw.randint(0, 120)))
    rows = [(some(), some()) for _ in range(300)] + [("", ""), ("", "a"), ("ab", ""), ("a", "a"), ("e" * 700, "e" * 350 + "x" * 350), ("kitten", "sitting")]
    df = spark.createDataFrame(rows, "a string, b string")
    longer = F.greatest(F.length("a"), F.length("b"))
    want = F.when(longer == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein("a", "b") / longer)
    got = df.select("a", "b", edit_similarity(F.col("a"), F.col("b")).alias("all"), edit_similarity(F.col("a"), F.col("b"), F.length("a") % 2 == 0).alias("some"), want.alias("want"))
    for r in got.collect():
        assert r["all"] == r["want"] and r["some"] == (None if len(r["a"]) % 2 else r["want"]), r
    # the JVM's distance takes some 3 ms for texts of 500 letters, several times what a column of bits a step does
    assert "levenshtein" not in df.select(edit_similarity(F.col("a"), F.col("b")))._jdf.queryExecution().toString()


def plain_page(rows, cand, n=3):
    """compared_page, gram by gram."""
    grams = lambda text, size: Counter(zip(*(text.split()[k:] for k in range(size)), strict=False))
    page_n = max([1, *(min(n, len(r["norm"].split())) for r in rows)])
    page, made = (sum((grams(t, page_n) for t in texts), Counter()) for texts in ([r["norm"] for r in rows], cand))
    told = []
    for name in dict.fromkeys(r["region_id"] for r in rows):
        own = [(r["norm"], r["c_norm"], min(n, len(r["norm"].split()))) for r in rows if r["region_id"] == name]
        a, b, c, d = (sum((grams(x[side], size or x[2]) for x in own), Counter()) for side, size in ((0, 0), (1, 0), (0, page_n), (1, page_n)))
        mine = 0 if name is None else (c & d).total()
        told.append((name, a.total(), (a & b).total(), mine, sum(k for g, k in d.items() if g in page) - mine))
    return page_n, page.total(), (page & made).total(), made.total(), told


def test_only_texts_that_differ_are_counted(monkeypatch):
    draw = random.Random(5)
    some = lambda: " ".join(draw.choice("abc") for _ in range(draw.choice((1, 2, 3, 9))))
    for _ in range(300):
        texts = [some() for _ in range(draw.randint(0, 6))]
        rows = [{"region_id": draw.choice(("r1", "r2", f"r{k + 3}", "", None)), "norm": t, "c_norm": draw.choice((t, t, t, "", some(), *texts))} for k, t in enumerate(texts)]
        cand = [draw.choice((t, t, t, "", some())) for t in texts] + [some()] * draw.randint(0, 2)
        assert fidelity.compared_page(rows, cand) == plain_page(rows, cand)
    asked = []
    monkeypatch.setattr(fidelity, "bag", lambda words, n: asked.append(tuple(words)) or Counter())
    texts = ["a b c d", "a b c e f", "g h i j"]
    rows = [{"region_id": f"r{k}", "norm": t, "c_norm": "" if k == 2 else t} for k, t in enumerate(texts)]
    assert fidelity.compared_page(rows, texts[:2])[:4] == (3, 7, 5, 5) and asked == []
