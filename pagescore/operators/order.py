"""Reading-order agreement."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescore.functions.geometry import ratio


def positions(gt_order: DataFrame, cand_order: DataFrame, mapping: DataFrame) -> DataFrame:
    """(page_id, gt_id, pos, cand_pos): each ground-truth region in order, with its counterpart's rank, null if it has none."""
    ranks = cand_order.select("page_id", F.col("region_id").alias("cand_id"), F.col("rank").alias("cand_pos"))
    ordered = gt_order.select("page_id", F.col("region_id").alias("gt_id"), F.col("rank").alias("pos"))
    return ordered.join(mapping.select("page_id", "gt_id", "cand_id"), ["page_id", "gt_id"], "left").join(ranks, ["page_id", "cand_id"], "left").select("page_id", "gt_id", "pos", "cand_pos")


def pair_counts(ranks: np.ndarray) -> tuple[int, int]:
    """(pairs in order, pairs out of it) of a sequence, equal ones in neither. Halves are counted, then the pairs across."""
    n = len(ranks)
    if n <= 64:
        above = np.triu(np.sign(ranks[None, :] - ranks[:, None]), 1)
        return int((above > 0).sum()), int((above < 0).sum())
    left, right = ranks[: n // 2], ranks[n // 2 :]
    (a, b), (c, d) = pair_counts(left), pair_counts(right)
    ordered = np.sort(left)
    below, up_to = np.searchsorted(ordered, right, "left"), np.searchsorted(ordered, right, "right")
    return a + c + int(below.sum()), b + d + len(left) * len(right) - int(up_to.sum())


def rising(ranks: list[int]) -> int:
    """Length of the longest strictly increasing subsequence: a rank goes on the first pile whose top is not smaller."""
    tops: list[int] = []
    for rank in ranks:
        at = bisect_left(tops, rank)
        tops[at : at + 1] = [rank]
    return len(tops)


def agreement(placed: DataFrame) -> DataFrame:
    """(page_id, n_shared, missing, concordant, discordant, tau, lis), one row a page of positions.

    Pairs are of regions that both have a rank; equal ranks count nowhere, and without a pair tau is 1. lis is the length of
    the longest strictly increasing run of ranks in ground-truth order. A page's ranks are one array; arrays go through
    one Arrow pass, in n log n steps each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for ranks in batch.column("ranks"):
                own = np.array(ranks.as_py(), dtype=np.int64)
                told.append((*pair_counts(own), rising(own.tolist())))
            more = [pa.array([t[k] for t in told], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "n_shared", "missing")), *more], names=["page_id", "n_shared", "missing", "concordant", "discordant", "lis"])

    in_order = F.array_sort(F.collect_list(F.when(F.col("cand_pos").isNotNull(), F.struct(F.col("pos").cast("long").alias("pos"), F.col("cand_pos").cast("long").alias("rank")))))
    pages = placed.groupBy("page_id").agg(F.count("cand_pos").alias("n_shared"), F.count_if(F.col("cand_pos").isNull()).alias("missing"), F.transform(in_order, lambda x: x["rank"]).alias("ranks"))
    kind = placed.schema["page_id"].dataType.simpleString()
    counted = pages.mapInArrow(run, f"page_id {kind}, n_shared long, missing long, concordant long, discordant long, lis long")
    tau = ratio(F.col("concordant") - F.col("discordant"), F.col("concordant") + F.col("discordant"), 1.0)
    return counted.select("page_id", "n_shared", "missing", "concordant", "discordant", tau.alias("tau"), "lis")


def kendall_tau(placed: DataFrame) -> DataFrame:
    """(page_id, concordant, discordant, tau) of agreement."""
    return agreement(placed).select("page_id", "concordant", "discordant", "tau")


def longest_increasing(placed: DataFrame) -> DataFrame:
    """(page_id, lis) of agreement."""
    return agreement(placed).select("page_id", "lis")


def order_check(placed: DataFrame, min_coverage: float = 1.0, min_tau: float = 1.0) -> DataFrame:
    """One row a page: n_shared, missing, coverage, concordant, discordant, tau, lis_ratio, passed."""
    coverage = ratio(F.col("n_shared"), F.col("n_shared") + F.col("missing"), 1.0)
    row = agreement(placed).select("page_id", "n_shared", "missing", coverage.alias("coverage"), "concordant", "discordant", "tau", ratio(F.col("lis"), F.col("n_shared"), 1.0).alias("lis_ratio"))
    return row.withColumn("passed", (F.col("coverage") >= min_coverage) & (F.col("tau") >= min_tau))


def order_from_index(regions: DataFrame, index: str = "reading_order_index") -> DataFrame:
    """(page_id, region_id, rank) of flat regions by an index column; one without is last, ties by id."""
    by = Window.partitionBy("page_id").orderBy(F.col(index).asc_nulls_last(), "region_id")
    return regions.select("page_id", "region_id", (F.row_number().over(by) - 1).alias("rank"))
