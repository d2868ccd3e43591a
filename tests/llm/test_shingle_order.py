"""Orders of the Jaccard join's shingles, without Spark."""

from __future__ import annotations

import numpy as np
import pytest

from pagescore.llm import jaccard


@pytest.mark.parametrize("n_texts", [3, 1 << 16, (1 << 16) + 5])
def test_order_by_text_is_stable(n_texts):
    text = np.random.default_rng(5).integers(max(0, n_texts - 40), n_texts, 5000)
    assert jaccard.by_text(text, n_texts).tolist() == np.lexsort((np.arange(5000), text)).tolist()


def test_shingles_are_distinct_and_in_order():
    texts = [b"a b c d e f a b c d e f a b c d e", b"", b"x y", b"a b c d e"]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    text, value = jaccard.shingles(data, bounds)
    assert np.bincount(text, minlength=4).tolist() == [6, 0, 1, 1] and len({*zip(text.tolist(), value.tolist(), strict=True)}) == 8
    assert np.array_equal(np.lexsort((value, text)), np.arange(8))
