"""Alignment of ground-truth regions with candidate regions of the same page."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_IOU = 0.5
#: Pairs after which a pass over pages hands its rows on.
BATCH_ROWS = 1 << 14

_BOX = ["x0", "y0", "x1", "y1"]


def id_matches(gt: DataFrame, cand: DataFrame) -> DataFrame:
    """Pass 1: (page_id, gt_id, cand_id) of equal ids. Both sides have one row for each id of a page."""
    both = gt.join(cand.select("page_id", "region_id"), ["page_id", "region_id"])
    return both.select("page_id", F.col("region_id").alias("gt_id"), F.col("region_id").alias("cand_id"))


def overlapping(g: np.ndarray, c: np.ndarray, min_iou: float = MIN_IOU, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of g, row of c, overlap) of boxes (n, 4) that overlap by min_iou or more.

    A sweep along one axis: an overlap of m needs a common extent of m times the longer side at least, so in order of their
    lower ends the boxes that may do it are one run for each box. The axis is the one with the shorter runs; what is
    compared, `most` pairs at once, grows with these and not with the product of both sides.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(g) or not len(c):
        return none
    sweeps = []
    for low, high in ((1, 3), (0, 2)):
        order = np.argsort(c[:, low], kind="stable")
        lower = c[order, low]
        extent = g[:, high] - g[:, low]
        slack = 1e-9 * (1 + np.abs(g[:, low]) + np.abs(g[:, high]) + extent / max(min_iou, 1e-9))
        first = np.searchsorted(lower, g[:, low] + min_iou * extent - extent / min_iou - slack) if min_iou > 0 else np.zeros(len(g), np.int64)
        last = np.searchsorted(lower, g[:, high] - min_iou * extent + slack, side="right") if min_iou > 0 else np.full(len(g), len(c))
        sweeps.append((int(np.maximum(last - first, 0).sum()), order, first, np.maximum(last - first, 0)))
    _, order, first, many = min(sweeps, key=lambda s: s[0])
    upto, found, row = np.cumsum(many), [], 0
    while row < len(g):
        before = int(upto[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(upto, before + most, side="right")))
        own = many[row:end]
        i = np.repeat(np.arange(row, end), own)
        j = order[np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + first[i]]
        width = np.maximum(np.minimum(g[i, 2], c[j, 2]) - np.maximum(g[i, 0], c[j, 0]), 0.0)
        height = np.maximum(np.minimum(g[i, 3], c[j, 3]) - np.maximum(g[i, 1], c[j, 1]), 0.0)
        inter = width * height
        area = [np.maximum(x[k, 2] - x[k, 0], 0.0) * np.maximum(x[k, 3] - x[k, 1], 0.0) for x, k in ((g, i), (c, j))]
        union = area[0] + area[1] - inter
        value = np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1.0), 0.0)
        keep = value >= min_iou
        found.append((i[keep], j[keep], value[keep]))
        row = end
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3)) if found else none


def _boxed_pages(gt: DataFrame, cand: DataFrame, matched: DataFrame) -> DataFrame:
    """(page_id, g, c): the boxes that are left over on both sides, as two arrays a page."""
    left = gt.where("x0 is not null").join(matched.select("page_id", F.col("gt_id").alias("region_id")), ["page_id", "region_id"], "left_anti")
    right = cand.where("x0 is not null").join(matched.select("page_id", F.col("cand_id").alias("region_id")), ["page_id", "region_id"], "left_anti")
    box = F.struct("region_id", *[F.col(c).cast("double").alias(c) for c in _BOX])
    both = left.select("page_id", box.alias("box"), F.lit(True).alias("own")).unionByName(right.select("page_id", box.alias("box"), F.lit(False).alias("own")))
    pages = both.groupBy("page_id").agg(F.collect_list(F.when(F.col("own"), F.col("box"))).alias("g"), F.collect_list(F.when(~F.col("own"), F.col("box"))).alias("c"))
    return pages.where("size(g) > 0 and size(c) > 0")


def _swept(gt: DataFrame, cand: DataFrame, matched: DataFrame, min_iou: float, settled: bool) -> DataFrame:
    """(page_id, gt_id, cand_id, iou) of overlapping boxes in one Arrow pass over pages; settled: each id once, as assign has it."""

    def told(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names=["page_id", "gt_id", "cand_id", "iou"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            many = 0
            for k in range(batch.num_rows):
                ids, boxes = [], []
                for side in ("g", "c"):
                    rows = batch.column(side)[k].values
                    ids.append(rows.field("region_id"))
                    boxes.append(np.stack([rows.field(name).to_numpy() for name in _BOX], axis=1))
                i, j, value = overlapping(*boxes, min_iou)
                if not len(i):
                    continue
                own, other = ids[0].take(pa.array(i)), ids[1].take(pa.array(j))
                if settled and max(np.bincount(i).max(), np.bincount(j).max()) > 1:
                    found = assign(pd.DataFrame({"page_id": 0, "gt_id": own.to_pylist(), "cand_id": other.to_pylist(), "iou": value}))
                    own, other, value = (pa.array(found[c].tolist(), t) for c, t in (("gt_id", own.type), ("cand_id", other.type), ("iou", pa.float64())))
                page = batch.column("page_id").take(pa.array(np.full(len(own), k)))
                parts.append((page, own, other, pa.array(value, pa.float64())))
                many += len(own)
                if many >= BATCH_ROWS:
                    yield told(parts)
                    parts, many = [], 0
            if parts:
                yield told(parts)

    kind = {name: gt.schema[name].dataType.simpleString() for name in ("page_id", "region_id")}
    return _boxed_pages(gt, cand, matched).mapInArrow(run, f"page_id {kind['page_id']}, gt_id {kind['region_id']}, cand_id {kind['region_id']}, iou double")


def viable_pairs(gt: DataFrame, cand: DataFrame, matched: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """(page_id, gt_id, cand_id, iou) of boxes left over on both sides that overlap by min_iou or more."""
    return _swept(gt, cand, matched, min_iou, settled=False)


def overlap_matches(gt: DataFrame, cand: DataFrame, matched: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """Pass 2: a one-to-one choice (page_id, gt_id, cand_id, iou) among viable_pairs.

    The sweep and the choice are one pass over a page's boxes; where no box has two partners, the pairs are the choice.
    """
    return _swept(gt, cand, matched, min_iou, settled=True)


def best_assignment(profit: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of greatest total profit; rows are no more than columns.

    Shortest augmenting paths with dual prices, a row at a time, each step over all columns at once; of equally good
    columns the first.
    """
    rows, columns = profit.shape
    cost, price, holder = -profit, np.zeros(columns), np.full(columns, -1)
    own = cost.min(axis=1, initial=np.inf)
    for new in range(rows):
        reach, barred, previous, passed = np.full(columns, np.inf), np.zeros(columns), np.full(columns, -1), []
        row, at, total = new, -1, 0.0
        while True:
            step = cost[row] - price
            step += total - own[row]
            step += barred
            better = step < reach
            np.copyto(reach, step, where=better)
            previous[better] = at
            ahead = reach + barred
            at = int(ahead.argmin())
            total = float(ahead[at])
            if holder[at] < 0:
                break
            barred[at] = np.inf
            passed.append(at)
            row = int(holder[at])
        own[new] += total
        if passed:
            change = total - reach[passed]
            own[holder[passed]] += change
            price[passed] -= change
        while at >= 0:
            before = int(previous[at])
            holder[at] = holder[before] if before >= 0 else new
            at = before
    out = np.full(rows, -1)
    taken = np.flatnonzero(holder >= 0)
    out[holder[taken]] = taken
    return out


def sparse_assignment(edges: list[list[tuple[int, float]]], columns: int) -> list[int]:
    """best_assignment over lists of (column, profit) by row, in order of columns; -1 for a row that stays alone, which has
    profit 0. Memory and steps follow the lists: paths grow along them, the nearest column first, from a heap."""
    own, price, holder = [-max(p for _, p in row) for row in edges], [0.0] * columns, [-1] * (columns + len(edges))
    for new in range(len(edges)):
        reach: dict[int, float] = {}
        previous: dict[int, int] = {}
        passed: dict[int, None] = {}
        heap: list[tuple[float, int]] = []
        row, at, total = new, -1, 0.0
        while True:
            base = total - own[row]
            for column, profit in edges[row]:
                if column not in passed:
                    step = base - profit - price[column]
                    if step < reach.get(column, np.inf):
                        reach[column], previous[column] = step, at
                        heappush(heap, (step, column))
            alone = columns + row  # a column of the row's own, of profit 0
            reach[alone], previous[alone] = base, at
            heappush(heap, (base, alone))
            while True:
                total, at = heappop(heap)
                if at not in passed and total == reach[at]:
                    break
            if holder[at] < 0:
                break
            passed[at] = None
            row = holder[at]
        own[new] += total
        for column in passed:
            own[holder[column]] += total - reach[column]
            price[column] -= total - reach[column]
        while at >= 0:
            before = previous[at]
            holder[at] = holder[before] if before >= 0 else new
            at = before
    out = [-1] * len(edges)
    for column in range(columns):
        if holder[column] >= 0:
            out[holder[column]] = column
    return out


def connected(rows: list[list[int]], columns: int) -> list[list[int]]:
    """The rows of each connected part of a graph given by the columns of each row, both in order."""
    by_column: list[list[int]] = [[] for _ in range(columns)]
    for row, own in enumerate(rows):
        for column in own:
            by_column[column].append(row)
    seen, seen_column, parts = [False] * len(rows), [False] * columns, []
    for first in range(len(rows)):
        if seen[first]:
            continue
        seen[first], part, queue = True, [], [first]
        while queue:
            row = queue.pop()
            part.append(row)
            for column in rows[row]:
                if not seen_column[column]:
                    seen_column[column] = True
                    for other in by_column[column]:
                        if not seen[other]:
                            seen[other] = True
                            queue.append(other)
        parts.append(sorted(part))
    return parts


def assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """Most pairs, then the greatest total overlap, each id once; ids in order decide ties.

    Connected parts of the page are settled by themselves: one where most pairs exist as a matrix, others over lists.
    """
    gt, cand = sorted(set(pairs["gt_id"])), sorted(set(pairs["cand_id"]))
    turned = len(cand) < len(gt)
    rows, columns = (cand, gt) if turned else (gt, cand)
    at_row, at_column = {k: i for i, k in enumerate(rows)}, {k: i for i, k in enumerate(columns)}
    large = float(len(columns) + 1)
    value = dict(zip(zip(pairs["cand_id"], pairs["gt_id"], strict=True) if turned else zip(pairs["gt_id"], pairs["cand_id"], strict=True), pairs["iou"], strict=True))
    edges: list[list[tuple[int, float]]] = [[] for _ in rows]
    for (r, c), overlap in value.items():
        edges[at_row[r]].append((at_column[c], large + overlap))
    for own in edges:
        own.sort()
    kept = []
    for part in connected([[c for c, _ in own] for own in edges], len(columns)):
        names = sorted({c for r in part for c, _ in edges[r]})
        number = {c: k for k, c in enumerate(names)}
        lists = [[(number[c], p) for c, p in edges[r]] for r in part]
        if 4 * sum(map(len, lists)) >= len(part) * len(names):
            profit = np.zeros((len(part), max(len(names), len(part))))
            for k, own in enumerate(lists):
                for c, p in own:
                    profit[k, c] = p
            chosen = [c if profit[k, c] > 0 else -1 for k, c in enumerate(best_assignment(profit).tolist())]
        else:
            chosen = sparse_assignment(lists, len(names))
        kept += [(rows[r], columns[names[c]]) for r, c in zip(part, chosen, strict=True) if c >= 0]
    found = [(c, r, value[r, c]) if turned else (r, c, value[r, c]) for r, c in kept]
    return pd.DataFrame({"page_id": [pairs["page_id"].iloc[0]] * len(found), "gt_id": [f[0] for f in found], "cand_id": [f[1] for f in found], "iou": [f[2] for f in found]})


def resolve(pairs: DataFrame) -> DataFrame:
    """The one-to-one choice among pairs (page_id, gt_id, cand_id, iou) that are at hand. Those that share no region with another
    are taken as they are; only pages where some are contended go to the assignment, a page a group."""
    g = pairs.groupBy("page_id", "gt_id").agg(F.count(F.lit(1)).alias("_g"))
    c = pairs.groupBy("page_id", "cand_id").agg(F.count(F.lit(1)).alias("_c"))
    counted = pairs.join(g, ["page_id", "gt_id"]).join(c, ["page_id", "cand_id"])
    free = counted.where("_g = 1 and _c = 1").select("page_id", "gt_id", "cand_id", "iou")
    contended = counted.where("_g > 1 or _c > 1").select("page_id", "gt_id", "cand_id", "iou")
    return free.unionByName(contended.groupBy("page_id").applyInPandas(assign, pairs.select("page_id", "gt_id", "cand_id", "iou").schema))


def align(gt: DataFrame, cand: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """(page_id, gt_id, cand_id, pass): each named ground-truth region with its counterpart, null if it has none.

    Equal ids first (pass 1), then boxes (pass 2). Regions without an id take no part.
    """
    gt, cand = gt.where("region_id <> ''"), cand.where("region_id <> ''")
    same = id_matches(gt, cand)
    boxes = overlap_matches(gt, cand, same, min_iou)
    found = same.withColumn("pass", F.lit(1)).unionByName(boxes.select("page_id", "gt_id", "cand_id", F.lit(2).alias("pass")))
    return gt.select("page_id", F.col("region_id").alias("gt_id")).join(found, ["page_id", "gt_id"], "left")
