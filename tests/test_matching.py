"""Element matching with bounds against the plain greedy rule, and the bounds themselves."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagescore.functions.text import lcs
from pagescore.operators import matching, metrics

ELEMENT = "doc_id int, element_type string, pos int, element_id string, pages array<int>, text string, char_offset int, attributes map<string,string>"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(a, b, strategy):
    a, b = " ".join((a or "").split()), " ".join((b or "").split())
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    if strategy == "token":
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 0.0 if strategy == "exact" else ratio(a, b)


def attributes(a, b):
    if not a or not b:
        return 1.0 if not a and not b else 0.5
    common = a.keys() & b.keys()
    one = lambda x, y: 1.0 if x == y else 0.5 if x[0] == y[0] == '"' and ratio(json.loads(x), json.loads(y)) > 0.8 else 0.0
    return sum(one(a[k], b[k]) for k in common) / len(common) if common else 0.5


def plain_greedy(gt, pred, config):
    taken, out = set(), []
    for g in gt:
        best, score = None, 0.0
        for p in pred:
            if p[3] in taken or not set(g[4]) & set(p[4]):
                continue
            place = 0.5 if g[6] is None or p[6] is None else max(0.0, 1.0 - abs(g[6] - p[6]) / config.position_tolerance)
            total = config.position_weight * place + config.text_weight * similarity(g[5], p[5], config.text_strategy) + config.attributes_weight * attributes(g[7], p[7])
            if total > score and total >= config.threshold:
                best, score = p, total
        if best:
            taken.add(best[3])
            out.append((g[2], best[2], score))
    return out


def elements(rng, doc, n, side):
    words = ["alpha", "beta", "gamma", "delta", "eps", "ζeta", "  ", "a"]
    for k in range(n):
        text = rng.choice([None, "", " ", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(8)]])
        more = rng.choice([{}, {"k": '"volume one"'}, {"k": '"volume two"', "n": "1"}, {"n": "2"}, {"k": '"x"'}, {"z": "null"}])
        yield (doc, "note", k, f"{side}{rng.randrange(n) if rng.random() < 0.2 else k}", rng.sample(range(4), rng.randrange(0, 3)), text, rng.choice([None, rng.randrange(100)]), more)


@pytest.mark.parametrize("strategy,threshold", [("fuzzy", 0.5), ("token", 0.3), ("exact", 0.2), ("fuzzy", 0.0)])
def test_choice_equals_plain_greedy(spark, strategy, threshold):
    rng = random.Random(strategy + str(threshold))
    config = matching.MatchConfig(text_strategy=strategy, threshold=threshold)
    gt = {d: list(elements(rng, d, rng.randrange(0, 14), "g")) for d in range(12)}
    pred = {d: list(elements(rng, d, rng.randrange(0, 14), "p")) for d in range(12)}
    flat = lambda side: spark.createDataFrame([r for rows in side.values() for r in rows], ELEMENT)
    got = {}
    for r in matching.best_matches(flat(gt), flat(pred), config).collect():
        got.setdefault(r["doc_id"], []).append((r["g_pos"], r["p_pos"], r["score"]))
    want = {d: found for d in gt if (found := plain_greedy(gt[d], pred[d], config))}
    assert {d: sorted(v) for d, v in got.items()} == want
    # every element is accounted for once
    out = matching.match_elements(flat(gt), flat(pred), config).collect()
    kinds = Counter(r["match_type"] for r in out)
    assert kinds["exact"] + kinds["partial"] + kinds["missed"] == sum(map(len, gt.values()))
    assert kinds["spurious"] == sum(p[3] not in {pred[d][k][3] for _, k, _ in want.get(d, [])} for d in pred for p in pred[d])


def test_bounds_and_how_few_texts_are_compared():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 20))) for _ in range(2))
        assert lcs(a, b) == plain_lcs(a, b)
        assert matching.upper_bound(Counter(a), Counter(b), len(a) + len(b)) >= ratio(a, b) - 1e-12
    side = lambda k, text: matching.Side({"pos": k, "element_id": f"e{k}", "pages": [1], "text": text, "key": text, "char_offset": None, "attributes": []})
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k % 20 : k % 20 + 6]) for _ in range(60)) for k in range(80)]
    found, pairs, compared = matching.choose([side(k, t) for k, t in enumerate(texts)], [side(k, t[:-3] + "zzz") for k, t in enumerate(texts)], matching.MatchConfig())
    assert [f[:2] for f in found] == [(k, k) for k in range(80)] and pairs == 80 * 81 // 2 and compared < pairs / 5


def test_differences_and_first_seen(spark):
    gt = [(d, "note", k, f"g{k}", [1], f"some words of note number {k}", 10 * k, {"a": "1", "b": '"x"'}) for d in (1, 2) for k in range(2)]
    pred = [(d, "note", k, f"p{k}", [1], f"some words of nota number {k}", 10 * k + d, {"a": "2", "c": "[1]"}) for d in (1, 2) for k in range(2)]
    out = matching.match_elements(spark.createDataFrame(gt, ELEMENT), spark.createDataFrame(pred, ELEMENT), matching.MatchConfig(text_weight=0.3)).collect()
    told = next(r["error_details"] for r in out if r["doc_id"] == 1 and r["gt_id"] == "g0")
    assert json.loads(told["attribute_diffs"]) == {"a": {"expected": 1, "got": 2}, "b": {"expected": "x", "got": None}, "c": {"expected": None, "got": [1]}} and told["position_diff"] == "1"
    rows = [(1, "z", "partial", ["b", "a"], 0, 0), (1, "z", "missed", ["reason"], 0, 1), (0, "z", "spurious", ["reason"], 1, 0), (0, "y", "exact", None, 0, 0)]
    matches = spark.createDataFrame(rows, "doc_id int, element_type string, match_type string, keys array<string>, phase int, pos int")
    why = F.when(F.col("match_type") == "spurious", "false_positive").otherwise("not_found")
    matches = matches.withColumn("error_details", F.map_from_arrays("keys", F.transform("keys", lambda k: why)))
    top = [r["error"] for r in metrics.top_errors(metrics.error_counts(matches, ["element_type"]), 4).collect()]
    assert top == ["spurious_false_positive", "b", "a", "missed_not_found"]  # all once, in the order of documents, not by name
