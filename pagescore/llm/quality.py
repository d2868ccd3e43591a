"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagescore.llm.common import LOWER, SPACE, learnable, mix64, pieces, span_hashes, table

#: Most labelled rows that the model is fitted on, the first in order of their doc_id's hash.
SAMPLE_ROWS = 8000
#: Most bytes of text of the rows that a model is fitted on.
SAMPLE_BYTES = 64 << 20
BUCKET_BITS = 18

#: Byte classes: white space, punctuation, and letters, digits and all non-ASCII bytes. A token is a run of one class.
_CLASS = np.full(256, 1, dtype=np.int8)
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
_CLASS[SPACE] = 0


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each token of the texts at `bounds`: runs of word bytes or of punctuation, A-Z lowered."""
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(data)]))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(bounds, starts, side="right") - 1


def features(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each token, each pair of neighbours and each equal pair at a distance of two. All pairs
    of equal tokens at one distance are one feature."""
    one, text = tokens(data, bounds)
    two = mix64(one[:-1] * np.uint64(0x9FB21C651E98DF25) + one[1:])
    two[one[:-1] == one[1:]] = 1
    inside = text[:-1] == text[1:]
    apart = np.flatnonzero((one[:-2] == one[2:]) & (text[:-2] == text[2:]))
    bucket = np.concatenate((one, two[inside], np.full(len(apart), 1 << 63, np.uint64))) >> np.uint64(64 - bits)
    return bucket.astype(np.int64), np.concatenate((text, text[:-1][inside], text[apart]))


@dataclass
class Model:
    """Weights by bucket, and the bias. A text's value in a bucket is the bucket's part of its features, times SCALE."""

    weights: np.ndarray
    bias: float
    bits: int

    SCALE = 20.0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, data, bounds in pieces(column):
            bucket, text = features(data, bounds, self.bits)
            n = len(bounds) - 1
            total = np.bincount(text, weights=self.weights[bucket], minlength=n)
            count = np.maximum(np.bincount(text, minlength=n), 1)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + self.SCALE * total / count, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Rows:
    """Labelled texts as features, one after another in flat arrays: buckets, how often each, where each text starts."""

    bucket: np.ndarray
    count: np.ndarray
    start: np.ndarray
    label: np.ndarray


def counted(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket int32, count int32, first place of each text) of the texts at `bounds`; each text's buckets are distinct."""
    bucket, text = features(data, bounds, bits)
    key, count = np.unique((text << bits) | bucket, return_counts=True)
    start = np.searchsorted(key, np.arange(len(bounds) - 1) << bits)
    return (key & ((1 << bits) - 1)).astype(np.int32), count.astype(np.int32), start


def fit(rows: Rows, bits: int = BUCKET_BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Follow the regularised leader, text by text. Without texts of both labels the score is the rate of label 1, or 0.5."""
    size, n_rows = 1 << bits, len(rows.label)
    rate = (int(rows.label.sum()) + 1) / (n_rows + 2)
    if len(np.unique(rows.label)) < 2:
        return Model(np.zeros(size), float(np.log(rate / (1 - rate))), bits)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    end = np.append(rows.start[1:], len(rows.bucket))

    def leader(at: np.ndarray) -> np.ndarray:
        own = z[at]
        penalty = np.where(at == size, 0.0, l1)
        return np.where(np.abs(own) <= penalty, 0.0, -(own - np.sign(own) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(n_rows):
            count = rows.count[rows.start[k] : end[k]]
            at = np.append(rows.bucket[rows.start[k] : end[k]], np.int32(size))
            x = np.append(Model.SCALE * count / max(int(count.sum()), 1), 1.0)
            w = leader(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - rows.label[k]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = leader(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def sampled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, _label) of up to `rows` labelled documents outside the held-out fold, the first by hash of doc_id, as
    far as their texts have `most_bytes` together. Null labels and ids don't count; of repeated ids the greatest label
    and text hold."""
    may, _ = learnable(F.col("doc_id"), modulus, held)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    chosen = labels.where(may & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sizes = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("_n"), F.max("_label").alias("_label"))
    so_far = F.sum(F.coalesce("_n", F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `rows` rows at most
    fits = sizes.withColumn("_sum", so_far).where(F.col("_sum") <= most_bytes).select("doc_id", "_label")
    return docs.join(F.broadcast(fits), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_label").alias("_label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> tuple[list[str], list[int]]:
    """The texts and labels of `sampled`, by doc_id."""
    found = sampled(docs, labels, label, modulus, held, rows).orderBy("doc_id").collect()
    return [r["text"] or "" for r in found], [int(r["_label"] == 1) for r in found]


def sample_features(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, bits: int = BUCKET_BITS) -> Rows:
    """`sampled` as features, by doc_id. Texts are hashed in the tasks; of each feature the step from the bucket before and the
    count reach the driver, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, bounds in pieces(b.column("text")):
                bucket, count, start = counted(data, bounds, bits)
                cut, n = np.append(start, len(bucket)).tolist(), len(bounds) - 1
                packed = [zlib.compress(np.concatenate((np.diff(bucket[i:j], prepend=0), count[i:j])).astype(np.int32).tobytes(), 1) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), b.column("_label").slice(row, n).cast(pa.int32()), pa.array(np.diff(cut), pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "label", "n", "packed"])

    found = sampled(docs, labels, label, modulus, held, rows).select("doc_id", "text", F.col("_label").cast("int").alias("_label"))
    got = found.mapInArrow(run, "doc_id long, label int, n long, packed binary").orderBy("doc_id").toArrow()
    sizes = got.column("n").to_numpy()
    bucket, count = np.empty(int(sizes.sum()), np.int32), np.empty(int(sizes.sum()), np.int32)
    start = np.cumsum(sizes) - sizes
    for at, n, packed in zip(start.tolist(), sizes.tolist(), got.column("packed"), strict=True):
        # one text at a time: small pieces that live side by side would keep the driver's memory after they are gone
        part = np.frombuffer(zlib.decompress(packed.as_py(), bufsize=8 * n), np.int32)
        bucket[at : at + n] = np.cumsum(part[:n])
        count[at : at + n] = part[n:]
    return Rows(bucket, count, start, (got.column("label").to_numpy() == 1).astype(np.int64))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, rows: int = SAMPLE_ROWS) -> Model:
    return fit(sample_features(docs, labels, label, modulus, held, rows))


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id and score double of every row; texts are scored whole, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose text's score is at least `least`, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) >= least)) if batch.num_rows else batch

    return docs.mapInArrow(run, docs.schema)


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, by a model of the labelled ones outside the fold crc32(doc_id) mod 3 = 1.

    Null and empty texts get the score of the bias alone; repeated rows get equal scores. Without labels all score 0.5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    _, held_out = learnable(F.col("doc_id"), 3, 1)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
