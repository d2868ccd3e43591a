"""Nulls, repeats, very long texts and clashing names, operator by operator, and a plain forward pass of the network."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagescore.llm import decontaminate, mixing, quality, tokencount, toxicity
from pagescore.llm.common import pieces


def test_network_against_a_plain_forward_pass():
    """Each window word by word, with the equations of the cells written out; a text's score is that of its highest window."""
    rng = random.Random(5)
    net = toxicity.Network.new(seed=2)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "gh!", "éa"]) for _ in range(n)) for n in (1, 2, 31, 32, 33, 48, 49, 100)] + ["", None, "?!"]
    p, n, sigmoid = net.p, toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def cell(way, x, h):
        gates, inner = x @ p[f"W{way}"] + p[f"c{way}"], h @ p[f"U{way}"]
        z, r = sigmoid(gates[:n] + inner[:n]), sigmoid(gates[n : 2 * n] + inner[n : 2 * n])
        return (1 - z) * np.tanh(gates[2 * n :] + r * inner[2 * n :]) + z * h

    def logit(inputs):
        ahead, back, h = [], [], np.zeros(n)
        for x in inputs:
            ahead.append(h := cell("f", x, h))
        h = np.zeros(n)
        for x in inputs[::-1]:
            back.append(h := cell("b", x, h))
        both = [np.concatenate(pair) for pair in zip(ahead, back[::-1], strict=True)]
        weight = np.exp([np.tanh(b @ p["A"]) @ p["v"] for b in both])
        return sum(w * b for w, b in zip(weight / weight.sum(), both, strict=True)) @ p["top"] + p["bias"][0]

    want = []
    for text in texts:
        _, data, bounds = next(pieces(pa.array([text], pa.string())))
        index, _, own, grams, begin = toxicity.distinct_words(data, bounds)
        inputs = net.inputs(own, grams, begin)[index].astype(np.float64) if len(index) else []
        starts = range(0, max(len(inputs) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE) if len(index) else ()
        want.append(sigmoid(max((logit(inputs[s : s + toxicity.WINDOW]) for s in starts if s < len(inputs)), default=p["bias"][0])))
    assert np.allclose(net.scores(pa.array(texts, pa.string())), want, atol=1e-5)


def test_scores_of_repeats_and_of_a_text_longer_than_a_piece(spark):
    """Equal texts have equal scores, wherever they stand; one text of over 2 MiB is scored whole, up to its last words."""
    long = "plain words go on " * 130_000
    assert len(long) > 1 << 21
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, long), (3, long + "zzqx " * 3000), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rng = np.random.default_rng(1)
    for model in (quality.Model(rng.normal(size=1 << quality.BUCKET_BITS), 0.1, quality.BUCKET_BITS), toxicity.Network.new()):
        got = quality.scored(docs, model).collect()
        score = {}
        for r in got:
            score.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(got) == 7 and all(len(s) == 1 for s in score.values()) and score[1] == score[None] and score[4] == score[5]
        alone = [float(model.scores(pa.array([t]))[0]) for t in (long, long + "zzqx " * 3000)]
        assert [*score[2], *score[3]] == alone and alone[0] != alone[1]


def test_mix_of_null_and_repeated_keys_and_clashing_names(spark):
    rows = [(None, "a", 4, "x", "y", "z")] * 3 + [(7, "a", 5, "x", "y", "z")] * 2 + [(8, None, None, "x", "y", "z"), (9, None, 6, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target string, taken string, positions string")
    got = mixing.mix(df, "doc_id", "size").collect()
    assert len(got) == 7 and sorted(r["source_size"] for r in got) == [6, 6, 22, 22, 22, 22, 22]
    for source in ("a", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 2 * (r["size"] or 0) for r in own)


def test_decontamination_of_null_and_repeated_rows_and_clashing_names(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, item, 5, "n", "i"), (1, item + " x", 5, "n", "i"), (1, item + " x", 5, "n", "i"), (1, "clean text", None, None, None), (2, None, 5, "n", "i"), (3, "", 5, "n", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hit long, N_WORDS string, item_ids string")
    items = spark.createDataFrame([(4, item), (4, item), (None, item), (6, None)], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in decontaminate.decontaminate(df, items).collect())
    assert [g[:3] for g in got] == [(-1, 11, 11), (1, 2, 0), (1, 12, 11), (1, 12, 11), (2, 0, 0), (3, 0, 0)] and got[0][3] == "4"


def test_token_counts_of_repeats_long_words_and_control_pieces(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    known = tokencount.vocabulary()
    exact = Tokenizer(models.Unigram(known, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = ["word " * 40_000, "x" * 30_000, "a <s> b </s><unk>", "<0x41><0x42>", "same", "same", "", None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, "same"), (None, "same")]
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", known).collect()
    want = sorted((-1 if k is None else k, len(exact.encode(t, add_special_tokens=False).ids) if t else 0) for k, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == want
