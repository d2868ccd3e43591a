"""Overlaps by sweep, assignment by matrix and by lists, and order agreement, against brute force."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagescore.functions.geometry import iou
from pagescore.operators import alignment, order


def boxes_of(rng, n):
    low = rng.random((n, 2)) * 4
    return np.concatenate([low, low + rng.normal(size=(n, 2)) + 0.8], axis=1)


def test_sweep_equals_the_join_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    gt, cand = [], []
    for page in range(12):
        g = boxes_of(rng, 25)
        c = np.concatenate([g[rng.permutation(25)[:18]] + rng.normal(size=(18, 4)) * 0.2, boxes_of(rng, 6), g[:3]])
        gt += [(page, f"g{k}", *map(float, b)) for k, b in enumerate(g)] + [(page, "gnone", None, None, None, None), (page, "both", 0.0, 0.0, 1.0, 1.0)]
        cand += [(page, f"c{k}", *map(float, b)) for k, b in enumerate(c)] + [(page, "both", 0.0, 0.0, 1.0, 1.0)]
    schema = "page_id long, region_id string, x0 double, y0 double, x1 double, y1 double"
    a, b = spark.createDataFrame(gt, schema), spark.createDataFrame(cand, schema)
    matched = alignment.id_matches(a, b)
    named = lambda df, side: df.where("x0 is not null and region_id <> 'both'").select("page_id", F.col("region_id").alias(f"{side}id"), *[F.col(c).alias(side + c) for c in ("x0", "y0", "x1", "y1")])
    every = named(a, "g_").join(named(b, "c_"), "page_id").withColumn("v", iou("g_", "c_")).collect()
    for least in (0.2, 0.5, 0.9, 1.0):
        want = sorted((r["page_id"], r["g_id"], r["c_id"], r["v"]) for r in every if r["v"] >= least)
        assert sorted(map(tuple, alignment.viable_pairs(a, b, matched, least).collect())) == want and want
    assert alignment.viable_pairs(a, b, matched, 0.0).count() == len(every)
    assert alignment.viable_pairs(a.where("false"), b, matched).count() == 0


def test_work_follows_the_pairs_found():
    rng = np.random.default_rng(5)
    low = rng.random((10_000, 2)) * 100
    g = np.concatenate([low, low + 1 + rng.random((10_000, 2))], axis=1)
    began = time.time()
    i, j, _ = alignment.overlapping(g, g + 0.05)
    assert len(i) >= 9_000 and time.time() - began < 10
    column = np.stack([np.full(10_000, 0.1), np.arange(10_000.0), np.full(10_000, 0.9), np.arange(10_000.0) + 1], axis=1)
    assert len(alignment.overlapping(column, column)[0]) == 10_000 == len(alignment.overlapping(column[:, [1, 0, 3, 2]], column[:, [1, 0, 3, 2]])[0])


def greatest(profit):
    """(pairs, total) of the best choice, by trying all."""
    n, m = profit.shape
    best = (0, 0.0)
    for chosen in itertools.product(range(-1, m), repeat=n):
        used = [c for c in chosen if c >= 0]
        if len(set(used)) == len(used) and all(profit[r, c] > 0 for r, c in enumerate(chosen) if c >= 0):
            best = max(best, (len(used), round(sum(profit[r, c] for r, c in enumerate(chosen) if c >= 0), 9)))
    return best


def chosen_of(pairs):
    out = alignment.assign(pd.DataFrame(pairs, columns=["gt_id", "cand_id", "iou"]).assign(page_id="p"))
    return dict(zip(out["gt_id"], out["cand_id"], strict=True)), round(float(out["iou"].sum()), 9)


@pytest.mark.parametrize("density", [0.3, 0.6, 1.0])
def test_assignment_against_all_choices(density, monkeypatch):
    """Most pairs, then most overlap; also where greedy by overlap loses a pair, and with parts solved over lists."""
    rng, beaten = random.Random(7), 0
    for _ in range(150):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        pairs = [(f"g{g}", f"c{c}", rng.randrange(50, 100) / 100) for g in range(n) for c in range(m) if rng.random() < density]
        if not pairs:
            continue
        profit = np.zeros((n, m))
        for g, c, v in pairs:
            profit[int(g[1:]), int(c[1:])] = v
        found, total = chosen_of(pairs)
        assert (len(found), total) == greatest(profit) and len(set(found.values())) == len(found)
        taken = {}
        for g, c, v in sorted(pairs, key=lambda p: -p[2]):
            if g not in taken and c not in taken.values():
                taken[g] = c
        beaten += len(taken) < len(found)
        lists = [[(c, 10 + profit[g, c]) for c in range(m) if profit[g, c] > 0] for g in range(n)]
        lists = [own for own in lists if own]
        got = alignment.sparse_assignment(lists, m)
        whole = sum(dict(own)[c] for own, c in zip(lists, got, strict=True) if c >= 0)
        assert round(whole - 10 * len(found), 9) == total
    assert beaten or density == 1.0


def test_ties_go_by_ids_in_order():
    every = [(f"g{g}", f"c{c}", 0.7) for g in range(6) for c in range(6)]
    for shuffled in (every, every[::-1], random.Random(1).sample(every, len(every))):
        assert chosen_of(shuffled)[0] == {f"g{k}": f"c{k}" for k in range(6)}
    wide = [(f"g{g}", f"c{c}", 0.7) for g in range(2) for c in range(5)]
    assert chosen_of(wide)[0] == {"g0": "c0", "g1": "c1"}
    tall = [(f"g{g}", f"c{c}", 0.7) for g in range(5) for c in range(2)]
    assert chosen_of(tall)[0] == {"g0": "c0", "g1": "c1"}


def test_large_pages():
    one = [(f"g{k:04d}", "c", 0.5 + k / 10_000) for k in range(1100)]
    began = time.time()
    assert chosen_of(one)[0] == {"g1099": "c"} and time.time() - began < 10
    chain = [(f"g{k:04d}", f"c{j:04d}", 0.6 if j == k else 0.62) for k in range(1000) for j in (k - 1, k) if j >= 0]
    began = time.time()
    found, _ = chosen_of(chain)
    assert found == {f"g{k:04d}": f"c{k:04d}" for k in range(1000)} and time.time() - began < 20


def test_order_agreement_against_pairs(spark):
    rng = random.Random(11)
    pages = {f"p{n}": [rng.choice([None, *range(n)]) if n % 2 else rng.randrange(n + 1) for _ in range(n)] for n in (1, 2, 3, 7, 40, 63, 64, 65, 200, 301)}
    rows = [(p, f"r{k}", k, x) for p, ranks in pages.items() for k, x in enumerate(ranks)] + [("none", "r0", 0, None)]
    got = {r["page_id"]: r for r in order.agreement(spark.createDataFrame(rows, "page_id string, gt_id string, pos int, cand_pos int")).collect()}
    for p, ranks in pages.items():
        own = [x for x in ranks if x is not None]
        pairs = list(itertools.combinations(own, 2))
        up, down = sum(a < b for a, b in pairs), sum(a > b for a, b in pairs)
        best = []
        for k, x in enumerate(own):
            best.append(1 + max((best[j] for j in range(k) if own[j] < x), default=0))
        r = got[p]
        assert (r["n_shared"], r["missing"], r["concordant"], r["discordant"], r["lis"]) == (len(own), len(ranks) - len(own), up, down, max(best, default=0))
        assert r["tau"] == ((up - down) / (up + down) if up + down else 1.0)
    assert (got["none"]["missing"], got["none"]["tau"], got["none"]["lis"]) == (1, 1.0, 0)
    plan = order.agreement(spark.createDataFrame(rows, "page_id string, gt_id string, pos int, cand_pos int"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
