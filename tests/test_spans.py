"""Offsets met with page spans by bins, against a plain search."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from pagescore.sources.pages import on_page


def test_offsets_of_odd_spans(spark):
    rng = random.Random(4)
    spans = [(d, p, s, s + rng.choice([0, 1, 3, 50, 400])) for d in range(6) for p, s in enumerate(rng.sample(range(900), 12))]
    offsets = [(d, o) for d in range(8) for o in [*rng.sample(range(1300), 60), -5]] + [(0, None), (0, 7), (0, 7)]
    rows = spark.createDataFrame([(*o, "kept") for o in offsets], "doc_id int, offset int, page_name string")
    got = on_page(rows, spark.createDataFrame(spans, "doc_id int, page int, start int, end int"))
    want = []
    for d, o in offsets:
        pages = [p for e, p, s, t in spans if e == d and o is not None and s <= o < t]
        want += [(d, o, "kept", p) for p in pages or [None]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_work_does_not_grow_with_offsets_times_spans(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    offsets = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") * 7919 % (10 * n)).alias("offset"))
    began = time.time()
    wrong = on_page(offsets, spans).where("page is null or page <> floor(offset / 10)").count()
    assert wrong == 0 and time.time() - began < 60
