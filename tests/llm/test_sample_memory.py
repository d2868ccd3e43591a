"""What the driver holds while it unpacks the quality sample."""

from __future__ import annotations

import tracemalloc

import numpy as np

from pagescore.llm import quality


def test_sample_is_unpacked_one_text_at_a_time(spark):
    texts = [" ".join(f"w{(k * 7919 + i * 104729) % 1000003}" for i in range(2000)) for k in range(200)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    docs.count()
    tracemalloc.start()
    try:
        rows = quality.sample_features(docs, labels, "quality", 3, 1, 8000)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(rows.label) > 100 and np.diff(np.append(rows.start, len(rows.bucket))).max() > 2000
    assert peak < 1.5 * (rows.bucket.nbytes + rows.count.nbytes)
