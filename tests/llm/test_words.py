"""Spelling variants, ranked search and the language model against brute force; nulls, ties, repeats, long texts, clashing names."""

from __future__ import annotations

import collections
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagescore.llm import catalogue, lexical, markov, variants
from pagescore.llm.common import Lexicon, learnable, scratch, span_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lexicon_finds_words_and_nothing_else():
    rng = random.Random(2)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(300)})
    text = words + [w + b"a" for w in words] + [b"zz"]
    data = np.frombuffer(b" ".join(text) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in text]) - 1
    starts = ends - [len(w) for w in text]
    number = {w: k for k, w in enumerate(words)}
    assert Lexicon(words).find(data, starts, ends).tolist() == [number.get(w, -1) for w in text]
    assert Lexicon([]).find(data, starts, ends).max() == -1 and len(np.unique(span_hashes(data, starts, ends))) == len(set(text))


# --- spelling variants --------------------------------------------------------


def brute_words(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if x != w and one_edit(x, w)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n.get(form.get(w), 0)) for w in n)


def as_rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def word_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÿ÷") for _ in range(rng.randrange(6, 11))) for _ in range(25)]
    words = []
    for w in base:
        for _ in range(12):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÀ") + w[k:], w[:k] + rng.choice("xyzà") + w[k + 1 :], w]))
    long = "abcdefgh" * 700
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    texts += ["chained " * 1000 + "chainee " * 100 + "chaineee " * 10 + "chaineeee", "tiedword tiedworc tiedworb " * 40 + "tiedworx " * 3, f"{long} {long} {long}x {long}x" + f" {long[:-1]}q" * 30, "TIEDWORD Été", None, "", "a-b c_d 7"]
    return [(k if k % 9 else None, t, "clash", "clash", "clash") for k, t in enumerate(texts)] + [(3, texts[3], None, None, None)] * 2


def test_variants(spark, monkeypatch):
    rows = word_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string, root string")
    want = brute_variants(brute_words([r[:2] for r in rows]))
    assert as_rows(variants.spelling_variants(df)) == want and any(w[1] for w in want) and any(w[2] != w[1] != "" for w in want)
    monkeypatch.setattr(variants, "BLOCK", 5)  # keys of more words are cut into blocks
    assert as_rows(variants.spelling_variants(df)) == want


def test_every_near_pair_shares_a_key():
    n = list(brute_words([r[:2] for r in word_rows()]))
    letters = variants.Letters.shared_out(np.bincount(np.frombuffer("".join(n).encode("latin-1"), np.uint8), minlength=256))
    words = variants.Words(pa.array(n), letters)
    keys = words.keys()
    for a, b in itertools.combinations(range(len(n)), 2):
        same = [k for k in range(variants.KINDS) if keys[k][a] == keys[k][b]]
        if one_edit(n[a], n[b]):
            flips = int(words.mask[a] ^ words.mask[b]).bit_count()
            assert flips <= 2 and (any(k < 3 for k in same) if len(n[a]) == len(n[b]) else sum(k >= 3 for k in same) == 1)


def test_op11_and_its_sql(spark, tables, rows):
    got = as_rows(catalogue.QUERIES["op11_parity_variants"](spark, tables[0]))
    assert got == brute_variants(brute_words([r[:2] for r in rows])) and len(got) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet/*.parquet'")
    sql = con.execute(variants.OP11_SQL)
    names = [c[0] for c in sql.description]
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in (dict(zip(names, x, strict=True)) for x in sql.fetchall())) == got


# --- ranked search ------------------------------------------------------------


def brute_ranks(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    size = [sum(c.values()) for _, c in counts]
    N, L = sum(s > 0 for s in size), sum(size)
    df = collections.Counter(t for _, c in counts for t in c)
    own = collections.defaultdict(set)
    for i, t in items:
        own[i] |= set(terms(t))
    out = []
    for i, ts in own.items():
        found = []
        for (d, c), n in zip(counts, size, strict=True):
            m = 100 - 90 + (90 * n * N) // max(L, 1)
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_op12(spark, tables, rows):
    got = catalogue.QUERIES["op12_quantised_search"](spark, tables[0])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    items = [tuple(r) for r in spark.read.parquet(f"{tables[0]}/benchmark.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks([r[:2] for r in rows], items)


def test_search_in_blocks_with_ties_nulls_and_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["É", "日本"]
    docs = [(k, " ".join(rng.choice(words[: 5 + k % 57]) for _ in range(rng.randrange(1, 200)))) for k in range(80)]
    docs += [(200 + k, "same text w1 w1 rare") for k in range(15)] + [(None, "same text w1 w1 rare"), (None, None), (7, "rare"), (7, "rare"), (9, ""), (300, "w3 w4, " * 400_000 + "rare")]
    items = [(1, "Rare W1"), (2, "w3-w4 É"), (None, "日本 rare"), (5, "nowhere"), (6, None), (1, "w59"), (7, "w2 w2 w2")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, n string, terms int")
    i = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, score string, rank int")
    want = brute_ranks(docs, items)
    assert sorted(map(tuple, lexical.search(d, i, most_items=2).collect()), key=str) == want
    few = lexical.search(d, i, top=3).collect()
    assert sorted(map(tuple, few), key=str) == brute_ranks(docs, items, 3)


def test_bounds_hold():
    tf, m = np.arange(1, 4000)[:, None], np.array([10, 57, 100, 999, 10**6, 10**12])[None, :]
    exact = (10**9 * tf) // (1000 * tf + 8 * m)
    byte = (exact * 255 + 999_999) // 1_000_000
    assert byte.max() <= 255 and (exact <= lexical.HIGH[byte]).all() and (exact >= lexical.LOW[byte]).all()


# --- language model -----------------------------------------------------------


def tiny(seed, states=2, classes=4):
    rng = np.random.default_rng(seed)
    share = lambda *shape: (x := rng.random(shape) + 0.1) / x.sum(axis=-1, keepdims=True)
    return markov.Model(share(states), share(states), share(states, states), share(states, classes).T)


def paths(model, seq, begins=True):
    """Every path of states with its probability."""
    for path in itertools.product(range(len(model.first)), repeat=len(seq)):
        p = (model.first if begins else model.later)[path[0]] * model.emits[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.moves[path[t - 1], path[t]] * model.emits[seq[t], path[t]]
        yield path, p


def test_forward_and_expected_counts_against_all_paths():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 2, 2, 7, 3)]
    begins = np.array([True, True, False, True, False, False])
    classes, length = np.concatenate(seqs).astype(np.int32), np.array([len(s) for s in seqs])
    start = np.cumsum(length) - length
    for states in (1, 2, 3):
        model = tiny(states, states)
        got = model.log10(classes, start, length)
        assert np.allclose(got, [math.log10(sum(p for _, p in paths(model, s))) for s in seqs], rtol=1e-12)
        emitted = np.zeros_like(model.emits)
        first, later, moved, likelihood = model.expected(classes, start, length, begins, emitted)
        want = [np.zeros_like(x) for x in (first, later, moved, emitted)]
        total = 0.0
        for s, b in zip(seqs, begins, strict=True):
            every = list(paths(model, s, b))
            whole = sum(p for _, p in every)
            total += math.log(whole)
            for path, p in every:
                want[0 if b else 1][path[0]] += p / whole
                for t in range(len(s)):
                    want[3][s[t], path[t]] += p / whole
                    if t:
                        want[2][path[t - 1], path[t]] += p / whole
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip((first, later, moved, emitted), want, strict=True)) and abs(total - likelihood) < 1e-3


def test_texts_of_every_length_sum_to_one():
    """Over all texts of up to 12 tokens nearly all of the probability, and never more than one."""
    model = tiny(3)
    reach = model.first * 1.0
    ended = []
    for _ in range(400):
        ended.append(float(reach @ model.emits[markov.END]))
        reach = (reach * model.emits[1:].sum(axis=0)) @ model.moves
    assert abs(sum(ended) - 1) < 1e-9
    one_word = [np.array([c, markov.END]) for c in range(1, 4)]
    flat, length = np.concatenate(one_word), np.array([2, 2, 2])
    assert abs((10 ** model.log10(flat, np.array([0, 2, 4]), length)).sum() - ended[1]) < 1e-12


def test_cut_keeps_every_token():
    offsets = np.array([0, 1, 257, 257 + 256, 1400])
    start, length, begins = markov.cut(offsets, 256)
    assert length.sum() == 1400 and length.max() == 256 and (start[1:] == np.cumsum(length)[:-1]).all() and start[begins].tolist() == offsets[:-1].tolist()


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def check_base(rows, got, learned):
    c = collections.Counter(t for d, text in rows if learned(d) for t in tokens(text))
    N, V = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, len(w), sum(c[t] > 0 for t in w), N, sum(math.log10((c[t] + 1) / (N + V + 1)) for t in w)) for d, w in ((d, tokens(t)) for d, t in rows))
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [h[:4] for h in have] == [w[:4] for w in want] and all(math.isclose(h[4], w[4], rel_tol=1e-9) for h, w in zip(have, want, strict=True))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_op13(spark, tables, rows):
    got = catalogue.QUERIES["op13_hidden_markov"](spark, tables[0]).collect()
    learned = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    check_base([r[:2] for r in rows], got, learned)
    assert all(r["held_out"] == (not learned(r["doc_id"])) for r in got)


@pytest.mark.parametrize("own,known", [(3, 5), (1, 1), (4, 1000)])
def test_scores_with_small_vocabularies(spark, own, known):
    """Words of own classes, of shared ones and such as only the join knows; nulls, repeats, a text of over 2 MiB."""
    rng = random.Random(6)
    words = [f"{'xyz'[k % 3]}w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[: 4 + k]) for _ in range(rng.randrange(0, 40)))) for k in range(30)]
    rows += [(None, "A b"), (None, None), (5, "twice"), (5, "twice"), (31, "long text " * 230_000), (32, ""), (33, "neverseen neverseen")]
    df = spark.createDataFrame([(*r, "clash", "clash", 1.0) for r in rows], "doc_id long, text string, _row string, n string, score double")
    learn = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") != 33)
    got = markov.score_texts(df, "doc_id", "text", learn, states=3, rounds=2, own=own, known=known).collect()
    check_base(rows, got, lambda d: d is not None and d != 33)
    twice = [r["score"] for r in got if r["doc_id"] == 5 and r["n_tokens"] == 2 and r["n_known"] == 2]
    assert len(twice) >= 2 and twice[0] == twice[1]


def test_training_gains_and_beats_single_counts_on_unseen_texts(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the tables are not there")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    may, held = learnable(F.col("doc_id"), 7, 2)
    scored = markov.score_texts(docs, "doc_id", "text", may)
    own = [r for r in scored.withColumn("held", learnable(F.col("doc_id"), 7, 2)[1]).collect() if r["held"]]
    gain = sum(r["score"] - r["base_score"] for r in own) / sum(r["n_tokens"] for r in own)
    assert len(own) > 100 and gain > 0.2
    rows = docs.where(may).select("text", F.lit(0).cast("long").alias("_row"), F.lit(None).cast("long").alias("_doc"), F.lit(True).alias("learn"))
    counted = markov.word_counts(rows.select("text"))
    counted.write.parquet(path := scratch(spark, "vocabulary"))
    vocab = markov.vocabulary(spark.read.parquet(path), rows.count())
    _, seen = markov.train(markov.encoded(rows, spark.sparkContext.broadcast(vocab)), vocab.class_counts(), rounds=4)
    assert seen == sorted(seen) and seen[-1] > seen[0]
