"""Approximate nearest neighbours: inverted lists scanned with early abandoning on rotated dimensions.

A query's nearest lists are scanned first. The distance of the k-th neighbour found there goes with the query to its other
lists, where most candidates are abandoned after their first column blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagescore.llm.common import table, written

#: Most vectors that the centroids are fitted on, the first in order of their id's hash; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Recall that the number of probed lists is fitted to, over so many vectors of the sample as queries.
RECALL, RECALL_QUERIES = 0.97, 300
#: Most lists; below it there are as many as the square root of the number of vectors.
MOST_LISTS = 4096
#: Vectors and queries that one task's group holds: larger lists are dealt out over several groups.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Dimensions of a column block, and the hypothesis test's significance: greater abandons later.
COLUMNS, EPSILON = 16, 2.1
#: Lists of the first pass, as many more as hold k + 1 vectors; the others are scanned with the bound that it gave.
FIRST_LISTS = 4
#: Vectors of a list that are taken at a time; the bound is drawn tighter after each part.
PART = 256


def usable(embedding: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Centroids, and the rotation that spreads a distance evenly over the dimensions. Its size depends on the number of
    lists and dimensions only."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, k: int, rounds: int = 10, seed: int = 7) -> "Index":
        rng = np.random.default_rng(seed)
        sample = np.unique(sample, axis=0)  # copies would take several centroids
        centroids = sample[rng.permutation(len(sample))[:lists]].astype(np.float64)
        for _ in range(rounds):
            near = nearest(sample, centroids, 1)[:, 0]
            total = np.zeros_like(centroids)
            np.add.at(total, near, sample)
            count = np.bincount(near, minlength=len(centroids))
            centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))
        return cls(centroids, rotation, probes(sample, centroids, k))


def nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centroids of each vector, nearest first."""
    out = []
    for k in range(0, len(vectors), 4096):
        part = vectors[k : k + 4096]
        far = (centroids**2).sum(axis=1) - 2 * part @ centroids.T
        out.append(np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


def probes(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """The fewest nearest lists that hold RECALL of the k nearest neighbours, measured within the sample."""
    asked = sample[np.random.default_rng(1).permutation(len(sample))[:RECALL_QUERIES]]
    home = nearest(sample, centroids, 1)[:, 0]
    near = nearest(asked, sample, k + 1)[:, 1:]  # the first is the query itself
    if not near.size:
        return 1
    order = np.argsort(nearest(asked, centroids, len(centroids)), axis=1)
    place = np.sort(np.take_along_axis(order, home[near], axis=1).ravel())
    return 1 + int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))))])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(pa.concat_arrays([column]).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def scan(original: np.ndarray, rotated: np.ndarray, ids: np.ndarray, vectors: np.ndarray, columns: list[np.ndarray], own: int, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, exact distances, components read) of up to k nearest vectors of a block, ties to smaller ids.

    bound: a distance within which the query has k neighbours in other blocks. Vectors are taken some at a time, the first
    few without a test if there is no bound. After each column block, those go whose partial distance, carried on to all
    dimensions, exceeds the k-th smallest distance so far by more than chance allows.
    """
    dims, best, best_id, read = len(original), np.zeros(0), np.zeros(0, dtype=np.int64), 0
    rows = np.flatnonzero(ids != own)
    start = 0
    while start < len(rows):
        most = (bound if len(best) < k else min(bound, best[k - 1])) ** 2 * (1 + 1e-9)
        left, partial, seen = rows[start : start + (PART if np.isfinite(most) else 2 * k)], None, 0
        start += len(left)
        for block in columns if np.isfinite(most) else ():
            width = block.shape[1]
            gap = block[left] - rotated[seen : seen + width]
            read += gap.size
            near = np.einsum("ij,ij->i", gap, gap)
            partial = near if partial is None else partial + near
            seen += width
            factor = 1.0 if seen == dims else seen / dims * (1 + EPSILON / np.sqrt(seen)) ** 2
            stay = partial <= most * factor
            left, partial = left[stay], partial[stay]
            if not len(left):
                break
        if len(left):
            gap = vectors[left] - original
            read += gap.size
            best = np.concatenate((best, np.sqrt((gap * gap).sum(axis=1))))
            best_id = np.concatenate((best_id, ids[left]))
            order = np.lexsort((best_id, best))[:k]
            best, best_id = best[order], best_id[order]
    return best_id, best, read


FOUND = "query_id long, vec_id long, score double"


def scanned(listed: DataFrame, asked: DataFrame, held: dict[int, int], index: Index, dims: int, k: int) -> DataFrame:
    """FOUND: up to k nearest of each block of a list, for every query (list, query_id, v, bound) that asks for the list.

    Large lists, and lists that many queries ask for, are dealt out over several groups. held: vectors by list.
    """
    spark = listed.sparkSession
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # as many rows as lists
    plan = [(at, -(-held[at] // BLOCK_VECTORS), -(-n // BLOCK_QUERIES)) for at, n in wanted.items() if held.get(at)]
    if not plan:
        return spark.createDataFrame([], FOUND)
    deal = F.broadcast(spark.createDataFrame(plan, "list int, parts int, asks int"))  # a row for each list at most
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = listed.select("list", "vec_id", "v").join(deal, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("ask", every("asks"))
    right = asked.join(deal, "list").withColumn("ask", F.pmod(F.xxhash64("query_id"), "asks")).withColumn("part", every("parts"))

    def group(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        q_ids, v_ids, score = [], [], []
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column("vec_id").to_numpy()
            own = matrix(vectors.column("v").combine_chunks(), dims)
            turned = own @ index.rotation
            columns = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in range(0, dims, COLUMNS)]
            asked_v = matrix(queries.column("v").combine_chunks(), dims)
            for q, bound, original, rotated in zip(queries.column("query_id").to_pylist(), queries.column("bound").to_pylist(), asked_v, asked_v @ index.rotation, strict=True):
                found, far, _ = scan(original, rotated, ids, own, columns, q, k, bound)
                q_ids.append(np.full(len(found), q))
                v_ids.append(found)
                score.append(far)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.Table.from_arrays([flat(q_ids, pa.int64()), flat(v_ids, pa.int64()), flat(score, pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["list", "part", "ask"]
    return left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "v", "bound").groupBy(*keys)).applyInArrow(group, FOUND)


def search(df: DataFrame, key: str, embedding: str, is_query: Column, k: int = 10) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: each query's k nearest of the other rows found.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or
    vectors of another length than the most frequent. Rows with a query's id are its own. Equal rows count once; if
    unequal vectors share an id, each is a candidate, and as queries they share one list of neighbours. A query probes the
    nearest lists, as many as the sample tells for the recall aimed at, and as many more as hold k + 1 vectors. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    exact = df.schema[embedding].dataType.simpleString() in ("array<float>", "array<double>")
    vector = F.col(embedding) if exact else F.col(embedding).cast("array<double>")
    valid = df.select(F.col(key).cast("long").alias("vec_id"), vector.alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    if not sizes:
        return empty
    dims, rows, kind = sizes[0]["n"], sizes[0]["count"], valid.schema["v"].dataType.simpleString()
    valid = valid.where(F.size("v") == dims)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    index = Index.fit(matrix(sample.column(0).combine_chunks(), dims), max(1, min(MOST_LISTS, int(rows**0.5))), k)
    n_lists = len(index.centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest(matrix(b.column("v"), dims), index.centroids, 1)[:, 0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("vec_id"), b.column("v")], names=["list", "vec_id", "v"])

    listed = written(valid.select("vec_id", "v").mapInArrow(assign, f"list int, vec_id long, v {kind}"), "lists")
    held = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # as many rows as lists

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, least = np.array([held.get(at, 0) for at in range(n_lists)]), index.probes
        for b in batches:
            near = nearest(matrix(b.column("v"), dims), index.centroids, n_lists)
            enough = [1 + int(np.searchsorted(np.cumsum(counts[row]), k + 1)) for row in near]
            first = pa.array([max(FIRST_LISTS, n) for n in enough], pa.int32())
            lists = [row[: max(least, n)].tolist() for row, n in zip(near, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), first, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "first", "lists"])

    probes = valid.where("q").select("vec_id", "v").mapInArrow(probe, f"query_id long, v {kind}, first int, lists array<int>")
    asked = probes.select("query_id", "v", "first", F.posexplode("lists").alias("place", "list"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def nearest_of(found: DataFrame) -> DataFrame:
        return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = asked.where("place < first").select("list", "query_id", "v", F.lit(float("inf")).alias("bound"))
    near = written(nearest_of(scanned(listed, near, held, index, dims, k)).drop("rank"), "near")
    bounds = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far")).select("query_id", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("bound"))
    far = asked.where("place >= first").join(bounds, "query_id", "left").select("list", "query_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return nearest_of(near.unionByName(scanned(listed, far, held, index, dims, k))).select("query_id", "rank", "vec_id", "score")


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
