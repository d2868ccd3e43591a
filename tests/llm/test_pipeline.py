"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import random
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagescore.llm import catalogue, quality
from tests.llm.test_contracts import brute_components, words6


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = some(30)
    texts = [some(rng.randrange(30, 90)) for _ in range(120)]
    texts += [" ".join(w + "%%%" for w in some(40).split()) for _ in range(40)]
    texts += texts[:10] + [t + " " + some(2) for t in texts[10:20]] + [some(15) + " " + item, item + " " + some(5), item[: len(item) // 2]]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s0", 1), (None, some(40), "en", None, 1), (500, None, None, None, None), (3, texts[3], "en", "s3", 1)]
    folder = tempfile.mkdtemp(prefix="spark-") + "/t"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int("%%%" not in t)) for k, t in enumerate(texts) if k % 2 == 0], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage(spark, corpus, k, docs):
    return corpus_pipeline.STAGES[k][1](spark, docs, corpus)


def texts_of(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    want = {(r["doc_id"], r["text"]) for r in docs.collect() if model.scores(pa.array([r["text"]], pa.string()))[0] >= 0.5}
    good = stage(spark, corpus, 0, docs)
    assert texts_of(good) == want and good.columns == docs.columns and not any("%%%" in (t or "") for _, t in want)
    rest = stage(spark, corpus, 1, docs)
    known = {d: t for d, t in texts_of(docs) if d is not None}
    keep = {d for d, (_, c) in brute_components(known).items() if c == d}
    got = texts_of(rest)
    assert {d for d, _ in got if d is not None} == keep and sum(d is None for d, _ in got) == 1 and rest.columns == docs.columns
    assert rest.count() == len(got)
    clean = stage(spark, corpus, 2, docs)
    item = words6(spark.read.parquet(f"{corpus}/benchmark.parquet").first()["text"])
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    hit = lambda t: any(tuple((w := words6(t))[k : k + 10]) in windows for k in range(len(words6(t)) - 9))
    assert texts_of(clean) == {(d, t) for d, t in texts_of(docs) if not hit(t)} and clean.count() == docs.count() - 3
    mixed = stage(spark, corpus, 3, docs)
    taken = corpus_pipeline.mix(docs.withColumn("_size", corpus_pipeline.word_count(F.col("text"))), "doc_id", "_size").where("taken > 0")
    assert mixed.columns == docs.columns and mixed.count() == taken.select(F.sum(F.size("positions"))).first()[0]
    dealt = stage(spark, corpus, 4, mixed)
    loads = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert dealt.count() == mixed.count() and max(loads) - min(loads) <= 1


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for k in range(5):
        docs = stage(spark, corpus, k, docs)
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect())) and out.count() > 50


def test_empty(spark, tables):
    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_columns_of_any_name_come_through(spark, corpus):
    """Columns named like those that stages and operators use inside keep their values; only shard and slot are replaced."""
    names = ["_id", "_doc", "_text_hash", "_size", "_crc", "_kept", "_row", "Position", "taken", "positions", "target", "source_size", "_mix_at", "_ring_pos", "n_hit", "take"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("/"))
    docs = docs.select("*", *[F.concat(key, F.lit(n)).alias(n) for n in names], F.lit("old").alias("SHARD"))
    for k in range(5):
        out = stage(spark, corpus, k, docs)
        kept = [c for c in docs.columns if c != "SHARD" or k < 4]
        assert out.columns == kept + (["shard", "slot"] if k == 4 else [])
        rows = out.collect()
        assert rows and all(r[n] == f"{'none' if r['doc_id'] is None else r['doc_id']}/{n}" for r in rows for n in names)


def test_mix_and_shards_against_plain_code(spark, corpus):
    """Sources' words by their targets, and shards of sizes at most one apart with gapless slots, from the rows alone."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    size, goal = {}, {}
    for r in docs.collect():
        size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").split())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted((s for s in size if s is not None)) + [None]) if s in size}
    free, left = set(size), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        goal |= {s: 2.0 * size[s] for s in full} if full else {s: weight[s] * level for s in free}
        left -= sum(goal[s] for s in full)
        free = free - full if full else set()
    got = stage(spark, corpus, 3, docs)
    words: dict = {}
    most: dict = {}
    for r in got.collect():
        n = len((r["text"] or "").split())
        words[r["source"]] = words.get(r["source"], 0) + n
        most[r["source"]] = max(most.get(r["source"], 0), n)
    assert words.keys() == {s for s in size if size[s]} and all(goal[s] - 1 <= words[s] <= goal[s] + most[s] for s in words)
    slots: dict = {}
    for r in stage(spark, corpus, 4, docs).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24


def test_catalogue_has_all():
    assert sorted(int(k[2:].split("_")[0]) for k in catalogue.QUERIES) == list(range(1, 14))
