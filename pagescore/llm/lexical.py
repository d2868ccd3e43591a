"""Ranked lexical search: a two-level quantised index of documents, byte impacts for bounds and term counts for exact scores.

The statement of a score is integer arithmetic on a term's weight, its occurrences and the document's length, so the
second level gives exactly what a plain sum over all documents would.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagescore.llm.common import LOWER, Lexicon, ascii_lower, discard, pieces, runs, table, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Items searched for in one pass over the documents, and distinct terms of theirs: what a pass sends to the tasks.
ITEMS, TERMS = 1024, 16_384
#: Impacts in one dense block of documents and terms.
CELLS = 1 << 24

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A byte's impact stands for at most HIGH and at least LOW millionths of the term's weight.
HIGH = np.arange(256, dtype=np.int64) * 1_000_000 // 255
LOW = np.concatenate(([0], HIGH[:-1] + 1))

Item = tuple[object, list[str]]


def item_blocks(items: DataFrame, item: str, text: str, most_items: int = ITEMS, most_terms: int = TERMS) -> Iterator[list[Item]]:
    """The items with their distinct terms, in blocks; items without terms are left out.

    Rows that repeat an item's id are one item with the terms of all. Blocks come to the driver one at a time.
    """
    each = items.select(F.col(item).alias("item"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    block, seen = [], set()
    for row in each.groupBy("item").agg(F.array_sort(F.collect_set("term")).alias("terms")).toLocalIterator():
        if block and (len(block) >= most_items or len(seen | set(row["terms"])) > most_terms):
            yield block
            block, seen = [], set()
        block.append((row["item"], row["terms"]))
        seen |= set(row["terms"])
    if block:
        yield block


def postings(docs: DataFrame, doc: str, text: str, terms: list[str]) -> DataFrame:
    """_doc, n long (terms of the text with repeats), terms array<int> (numbers of those of `terms` that occur, ascending), tfs array<int>."""
    words = docs.sparkSession.sparkContext.broadcast([t.encode() for t in terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(words.value)
        for batch in batches:
            for row, data, bounds in pieces(batch.column(1)):
                data, count = LOWER[data], len(bounds) - 1
                starts, ends = runs(_IN_TERM[data])
                of = np.searchsorted(bounds, starts, side="right") - 1
                number = known.find(data, starts, ends)
                both, tf = np.unique(of[number >= 0] * len(words.value) + number[number >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(both, np.arange(count + 1) * len(words.value)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (both % len(words.value), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, count), pa.array(np.bincount(of, minlength=count), pa.int64()), *lists], names=["_doc", "n", "terms", "tfs"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("_doc"), text).mapInArrow(run, f"_doc {kind}, n long, terms array<int>, tfs array<int>")


def quantised(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The rows with m long, the length part of the score, and impacts array<smallint>: of each term its saturated count, a
    number of millionths, in 255ths rounded upward."""
    m = F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {n_terms}L)")
    return found.where("size(terms) > 0").withColumn("m", m).withColumn("impacts", F.expr("transform(tfs, f -> cast((((1000000000L * f) div (1000L * f + 8L * m)) * 255 + 999999) div 1000000 as smallint))"))


class Bounds:
    """Upper and lower bounds of the scores of a batch's documents, an item at a time."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray) -> None:
        self.items, self.weights = items, weights

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, end row, impacts by term and document) of the batch's rows, some at a time."""
        terms, impacts = batch.column("terms"), batch.column("impacts")
        offsets = terms.offsets.to_numpy()
        number, impact = (c.values.to_numpy() for c in (terms, impacts))
        step = max(1, CELLS // len(self.weights))
        for first in range(0, batch.num_rows, step):
            end = min(first + step, batch.num_rows)
            own = slice(int(offsets[first]), int(offsets[end]))
            dense = np.zeros((len(self.weights), end - first), dtype=np.uint8)
            dense[number[own], np.repeat(np.arange(end - first), np.diff(offsets[first : end + 1]))] = impact[own]
            yield first, end, dense

    def of(self, dense: np.ndarray, item: int, level: np.ndarray) -> np.ndarray:
        """Sum of weight and level over the item's terms; whole numbers below 2**53, so exact."""
        own = self.items[item]
        return self.weights[own] @ level.astype(np.float64)[dense[own]]


def thresholds(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, top: int = TOP) -> np.ndarray:
    """Of each item the top-th highest lower bound over all documents, 1 where fewer have one above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, best = Bounds(items, weights), [np.zeros(0)] * len(items)
        for batch in batches:
            for _, _, dense in bounds.blocks(batch):
                for k in range(len(items)):
                    low = np.concatenate((best[k], bounds.of(dense, k, LOW)))
                    best[k] = np.partition(low, len(low) - top)[-top:] if len(low) > top else low
        sizes = [len(b) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), sizes), pa.int32()), pa.array(np.concatenate(best).astype(np.int64))], names=["item", "low"])

    low = index.select("terms", "impacts").mapInArrow(run, "item int, low long").where("low > 0")
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("rank") == top)
    out = np.ones(len(items), dtype=np.int64)
    for row in ranked.select("item", "low").collect():
        out[row["item"]] = row["low"]
    return out


def rescored(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, least: np.ndarray, top: int = TOP) -> DataFrame:
    """(_item int, _doc, score long): the exact scores of every document whose upper bound reaches the item's threshold, each task's best."""

    def exact(batch: pa.RecordBatch, rows: np.ndarray, own: np.ndarray, code: np.ndarray) -> np.ndarray:
        want = rows[:, None] * len(weights) + own[None, :]
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        tf = np.where(code[at] == want, batch.column("tfs").values.to_numpy()[at].astype(np.int64), 0)
        m = batch.column("m").to_numpy()[rows][:, None]
        return ((1_000_000_000 * tf) // (1000 * tf + 8 * m) * weights[own].astype(np.int64)).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, best = Bounds(items, weights), [[] for _ in items]
        for batch in batches:
            docs, terms = batch.column("_doc"), batch.column("terms")
            code = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy())) * len(weights) + terms.values.to_numpy()
            for first, _, dense in bounds.blocks(batch):
                for k, own in enumerate(items):
                    rows = first + np.flatnonzero(bounds.of(dense, k, HIGH) >= least[k])
                    for row, score in zip(rows.tolist(), exact(batch, rows, own, code).tolist() if len(rows) else [], strict=True):
                        if score > 0:
                            doc = docs[row].as_py()
                            best[k].append((-score, doc is None, doc))
                    if len(best[k]) > top:
                        best[k] = heapq.nsmallest(top, best[k], key=lambda b: b[:2] if b[1] else b)
        flat = [(k, b[2], -b[0]) for k, found in enumerate(best) for b in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.int64())], names=["_item", "_doc", "score"])

    kind = to_arrow_type(index.schema["_doc"].dataType)
    return index.select("_doc", "m", "terms", "tfs", "impacts").mapInArrow(run, f"_item int, _doc {index.schema['_doc'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, most_items: int = ITEMS) -> DataFrame:
    """(item, rank int, doc, score long): each item's `top` documents of the highest scores above 0, equal ones by doc.

    Terms are the text's maximal runs of ASCII letters, digits and characters outside ASCII, only A-Z lowered. Null and
    empty texts have none. Every row of docs is a document, repeated ones too (their order among themselves is open),
    a null doc comes last among equal scores. Rows of one item id are one item. Other columns play no part. Without
    documents or items the result is empty. Items are searched for in blocks, each with its own index of all documents.
    """
    spark, out = docs.sparkSession, None
    kind = items.schema[item].dataType
    for block in item_blocks(items, item, item_text, most_items):
        terms = sorted({t for _, own in block for t in own})
        number = {t: k for k, t in enumerate(terms)}
        own = [np.array([number[t] for t in ts], dtype=np.int64) for _, ts in block]
        found = written(postings(docs, doc, text, terms), "postings")
        n_docs, n_terms = found.select(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()
        df = np.zeros(len(terms), dtype=np.int64)
        for row in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[row["t"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.float64)
        index = written(quantised(found, n_docs, max(n_terms, 1)), "impacts")
        discard(found)
        hits = rescored(index, own, weights, thresholds(index, own, weights, top), top)
        order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_doc"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"_k int, _id {kind.simpleString()}")
        ranked = ranked.join(F.broadcast(names), F.col("_item") == F.col("_k")).select(F.col("_id").alias(item), "rank", F.col("_doc").alias(doc), "score")
        ranked = written(ranked, "ranked")
        discard(index)
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = docs.select(F.lit(None).cast(kind).alias(item), F.lit(0).alias("rank"), F.col(doc), F.lit(0).cast("long").alias("score")).where("false")
    return out


def op12_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM low GROUP BY r, t),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS nd, CAST(coalesce(sum(n), 0) AS BIGINT) AS l FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
part AS (SELECT i.item_id, tf.r, tf.doc_id, CAST(floor(1000 * ln((2 * tot.nd + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * len.n * tot.nd) // tot.l)))) AS s
  FROM items i JOIN tf ON i.t = tf.t JOIN df ON df.t = tf.t JOIN len ON len.r = tf.r CROSS JOIN tot),
sums AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(s) AS BIGINT) AS score FROM part GROUP BY item_id, r HAVING sum(s) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM sums)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
