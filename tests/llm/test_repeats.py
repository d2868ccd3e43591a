from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagescore.llm import repeats


SCHEMA = pa.schema([("seed", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])


def run_matched(rows, size, **options):
    """What matched yields in this process for rows in batches of `size`."""
    batches = [pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows[k : k + size]], SCHEMA) for k in range(0, len(rows), size)]

    class Rows:
        def mapInArrow(self, run, schema):
            return list(run(iter(batches)))

    return [r for b in repeats.matched(Rows(), **options) for r in b.to_pylist()]


@pytest.mark.parametrize("docs", [6000, 1])
def test_copies_of_one_segment_are_not_held(monkeypatch, docs):
    rng = random.Random(3)
    body = bytes(rng.randrange(97, 123) for _ in range(80))
    parts = [body, body[:70], body[3:]]  # the first holds all windows of the others
    rows = [(1, k, d if k == 0 else d + 7, 5 << 32, parts[k]) for k in range(3) for d in range(docs)] + [(2, 9, d, 0, body[::-1]) for d in (4, 4, 8)]
    rows += [(3, 60, 99, 7 << 32, None)]  # a task has found it removed
    sizes = []
    whole = repeats.match
    monkeypatch.setattr(repeats, "match", lambda own: sizes.append(len(own[0])) or whole(own))
    found = run_matched(rows, 100, most=20_000, index_bytes=150)
    assert max(sizes) < 10 and all(r["bytes"] is None for r in found)
    got = {}
    for r in found:
        got.setdefault((r["doc_id"], r["start"]), set()).update(range(r["start"], r["end"]))
    covered = {}
    for (d, _), own in got.items():
        covered.setdefault(d, set()).update(own)
    want = {8: set(range(80)), 99: set(range(7, 67))}
    for d in range(1, docs + 7):
        if d < docs or d >= 7:
            want[d] = want.get(d, set()) | set(range(5, 85 if d < docs else 82))
    assert covered == want


def test_equal_hashes_of_unequal_bytes_are_no_copies():
    one, two = b"a" * 60, b"b" * 60
    found = run_matched([(1, 5, 1, 0, one), (1, 5, 2, 0, two), (1, 5, 3, 0, one), (1, 5, 4, 0, two)], 3)
    removed = {}
    for r in found:
        removed.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert removed == {3: set(range(60)), 4: set(range(60))}


def test_a_task_sends_one_copy():
    first = repeats.Earliest()
    u = lambda *x: np.array(x, np.uint64)
    assert first.later(u(3, 3, 4), u(1, 1, 1), np.array([5, 6, 2])).tolist() == [False, True, False]
    # a smaller document goes on, later and equal hashes of another kind too
    assert first.later(u(3, 3, 4, 3), u(1, 1, 1, 2), np.array([4, 5, 2, 9])).tolist() == [False, True, False, False]
    assert first.later(u(3, 4), u(1, 1), np.array([9, 9])).tolist() == [True, True] and first.later(u(), u(), np.array([], np.int64)).tolist() == []


@pytest.mark.parametrize("most,index_bytes", [(0, 300), (2, 2000)])
def test_seeds_with_too_many_segments(spark, docs, most, index_bytes):
    """Every step of longer grams gives the same removed bytes."""
    told = lambda **options: sorted(map(str, repeats.remove_repeats(docs, **options).select("doc_id", "n_removed", "n_spans", F.md5("kept")).collect()))
    assert told(most=most, index_bytes=index_bytes) == told()


def test_kinds_without_a_common_window_are_not_indexed(monkeypatch):
    """Of one seed's kinds only those go to the index that share a window's hash with another document's; a run is one range."""
    rng = random.Random(5)
    word = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    common, passage = word(24), word(60)
    lone = [word(20) + common + word(30) for _ in range(50)]
    one, two = passage + common, passage[10:] + common + b"x"
    rows = sorted([(1, 9 + k, 20 + k, 0, t) for k, t in enumerate(lone)] + [(1, 3, 7, 0, one), (1, 4, 8, 5 << 32, two), (1, 5, 8, 300 << 32, one[:50])])
    seen = []

    class Index(repeats.RunIndex):
        def __init__(self, data, *rest):
            seen.append(bytes(data))
            super().__init__(data, *rest)

    monkeypatch.setattr(repeats, "RunIndex", Index)
    found = run_matched(rows, 7)
    assert seen == [one + b"\xff"]
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found) == [(8, 5, 5 + 74), (8, 300, 350)]


def test_later_copies_of_texts_have_no_part_in_seeds(spark, monkeypatch):
    """A passage that only copies of one text share isn't dealt out; one that another text has is, for the first copy."""
    rng = random.Random(7)
    word = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    text, passage = word(400), word(90)
    rows = [(d, text) for d in (3, 5, 9, 9)] + [(4, passage + word(70)), (6, word(60) + passage), (7, word(60) + passage), (9, passage)]
    asked = []
    whole = repeats.shared_seeds
    monkeypatch.setattr(repeats, "shared_seeds", lambda docs: asked.append(sorted(r["doc_id"] for r in docs.collect())) or whole(docs))
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert asked == [[3, 4, 6, 7, 9]]
    assert got == [(3, 0, 0), (4, 0, 0), (5, 400, 1), (6, 90, 1), (7, 90, 1), (9, 90, 1), (9, 400, 1), (9, 400, 1)]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_seeds_of_several_documents(monkeypatch, size):
    """Rows come by seed, a seed's documents in any order and over several batches."""
    rng = random.Random(size)
    rows = [(s, d) for s in range(40) for d in rng.choice([[5], [5, 5, 5], [2, 5], [5, 2, 5], [1, 1, 2], [3, 1, 2, 1]])]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + size], strict=True)], names=["seed", "doc_id"]) for k in range(0, len(rows), size)]
    taken = []

    class Rows:
        """What shared_seeds does to the dealt rows, in this process."""

        def mapInArrow(self, run, schema):
            if schema.startswith("seed"):
                return self
            taken.extend((r["seed"], r["doc_id"]) for b in run(iter(batches)) for r in b.to_pylist())
            return self

        def __getattr__(self, name):
            return lambda *a: self

    monkeypatch.setattr(repeats, "F", type("F", (), {"collect_list": staticmethod(lambda c: Rows())}))
    repeats.shared_seeds(Rows())
    several = {s for s in range(40) if len({d for t, d in rows if t == s}) > 1}
    assert set(taken) == {r for r in rows if r[0] in several}
