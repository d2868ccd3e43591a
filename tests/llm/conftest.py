from __future__ import annotations

import random
import tempfile

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, size string, count string"


def make_texts(seed: int = 5) -> list[str | None]:
    """Short texts with exact copies, near copies, shared passages, odd bytes, empties and nulls."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = some(40)
    texts: list[str | None] = [some(rng.randrange(1, 120)) for _ in range(40)]
    base = some(90)
    for _ in range(12):
        own = base.split(" ")
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [base] * 5 + [passage + " " + some(20), some(10) + "\n" + passage, passage.upper(), "a b c", "a b c", "x", "", "", None, None, " \t\n", "aaaa" * 40, "aaaa" * 60, "日本語 " * 30, "日本語 " * 31, "\x00 nul \x00", "!!! ... ???"]
    texts.append(some(4000))
    texts.append(texts[-1][:9000] + " " + some(300))
    return texts


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(1).shuffle(ids)
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 4}", None, "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def tables(spark, docs):
    """A folder of small tables, with extra columns whose names clash, and one of empty ones."""

    def make(folder: str, empty: bool) -> str:
        keep = (lambda df: df.limit(0)) if empty else (lambda df: df)
        keep(docs).write.parquet(f"{folder}/documents.parquet")
        rng = random.Random(9)
        labels = [(r[0], rng.randrange(2) if r[0] % 5 else None, int(r[0] % 9 == 0)) for r in docs.select("doc_id").collect()]
        keep(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
        text = docs.orderBy("doc_id").where("length(text) > 300").first()["text"]
        items = [(1, " ".join(text.split()[5:30])), (2, "A b, C"), (3, None), (4, ""), (5, "zz yy"), (10, " ".join(text.split()[7:40]))]
        keep(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
        pages = [(k, None if k % 4 == 0 else f"http://h/{k} x", None if k == 3 else "" if k == 5 else f"<p>{k % 6} é</p>" * (k % 3 * 400 + 1)) for k in range(40)] + [(None, "u", "<p>lone</p>"), (7, "u", "<p>1 é</p>" * 401)]
        keep(spark.createDataFrame(pages, "page_id long, url string, html string")).write.parquet(f"{folder}/pages.parquet")
        vectors = [(k, [rng.gauss(0, 1) for _ in range(24)]) for k in range(600)] + [(1000 + k, [0.5] * 24) for k in range(250)] + [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] + [1.0] * 23), (2300, [None] + [1.0] * 23), (2400, [1.0]), (None, [1.0] * 24)]
        keep(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).write.parquet(f"{folder}/embeddings.parquet")
        return folder

    return make(tempfile.mkdtemp(prefix="spark-") + "/full", False), make(tempfile.mkdtemp(prefix="spark-") + "/empty", True)
