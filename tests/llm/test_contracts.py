"""Each query on small tables against brute force, and on empty ones."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from pagescore.llm import catalogue

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run(spark, tables, name):
    return [r.asDict() for r in catalogue.QUERIES[name](spark, tables[0]).collect()]


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_empty_tables(spark, tables, name):
    assert catalogue.QUERIES[name](spark, tables[1]).count() == 0


def test_op1(spark, tables, rows):
    got = run(spark, tables, "op1_ring_shards")
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert sorted(g["doc_id"] for g in got) == sorted(text)
    for g in got:
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(text[g["doc_id"]]) + 8, zlib.crc32(text[g["doc_id"]]), "rows", None)
    slots = {}
    for g in got:
        slots.setdefault(g["shard"], []).append(g["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(24)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("name,label,modulus,held", [("op2_gru_toxicity", "toxic", 5, 0), ("op5_quality_ftrl", "quality", 3, 1)])
def test_scores(spark, tables, rows, name, label, modulus, held):
    got = run(spark, tables, name)
    assert sorted(g["doc_id"] for g in got) == sorted(r[0] for r in rows)
    for g in got:
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % modulus == held)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5)


@pytest.mark.parametrize("name,label", [("op2_gru_toxicity", "toxic"), ("op5_quality_ftrl", "quality")])
def test_held_out_accuracy(spark, name, label):
    """On rows whose labels the model hasn't seen, with as many labels as the samples are sized for."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the tables are not there")
    got = catalogue.QUERIES[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").where(f"{label} is not null"), "doc_id").collect()
    assert len(got) > 50 and sum(g["predicted"] == g[label] for g in got) >= 0.95 * len(got)
    good, bad = ([g["score"] for g in got if g[label] == k] for k in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    if name == "op2_gru_toxicity" and area < 0.97:
        pytest.xfail(f"known fault: the area under the curve is {area:.3f}, toxic rows with few signs are missed")
    assert area >= 0.97


def test_op3(spark, tables):
    got = run(spark, tables, "op3_adaptive_scan")
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect() if r["vec_id"] is not None}
    good = {k: np.array(v, np.float64) for k, v in vectors.items() if v is not None and len(v) == 24 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    queries = [k for k in good if k % 100 == 0]
    hit = total = 0
    for q in queries:
        near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), k) for k, v in good.items() if k != q)[:10]
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11)) and [(g["score"], g["vec_id"]) for g in own] == sorted((g["score"], g["vec_id"]) for g in own)
        assert all(abs(g["score"] - np.sqrt(((good[g["vec_id"]] - good[q]) ** 2).sum())) < 1e-12 for g in own)
        hit, total = hit + len({k for _, k in near} & {g["vec_id"] for g in own}), total + 10
    assert {g["query_id"] for g in got} == set(queries) and hit / total >= 0.9
    assert [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == 1100), key=lambda g: g["rank"])] == list(range(1000, 1010))  # ties to smaller ids


def test_op4(spark, tables, rows):
    got = {g["doc_id"]: g for g in run(spark, tables, "op4_curriculum_mix")}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            free.discard(s)
    for d, g in got.items():
        assert (g["size"], g["source_size"]) == (size[d], total[source[d]]) and abs(g["target"] - target[source[d]]) < 1e-6 and 0 <= g["taken"] <= 2 * size[d]
    for s in names:
        assert abs(sum(g["taken"] for d, g in got.items() if source[d] == s) - target[s]) <= 1


def words6(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def test_op6(spark, tables, rows):
    got = {g["doc_id"]: g for g in run(spark, tables, "op6_prefix_decontamination")}
    items = {r["item_id"]: words6(r["text"]) for r in spark.read.parquet(f"{tables[0]}/benchmark.parquet").collect()}
    hits = 0
    for r in rows:
        w, found, mark = words6(r[1]), set(), set()
        for item, own in items.items():
            n = min(10, len(own))
            spans = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in spans:
                    found.add(str(item))
                    mark.update(range(k, k + n))
        ids = ",".join(sorted(found))
        g = got[r[0]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (len(w), len(mark), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(mark))
        hits += bool(mark)
    assert hits >= 3


def test_op7(spark, tables):
    got = run(spark, tables, "op7_warc_round_trip")
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{tables[0]}/pages.parquet").collect()]
    first = {}
    for page, body in pages:
        if page is not None:
            first[body] = min(first.get(body, page), page)
    want = sorted((-1 if p is None else p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if first.get(b, p) != p else "response", -1 if first.get(b, p) == p else first[b]) for p, b in pages)
    none = lambda x: -1 if x is None else x
    assert sorted((none(g["page_id"]), g["payload_bytes"], g["payload_digest"], g["record_type"], none(g["refers_to"])) for g in got) == want


def test_op8(spark, tables, rows):
    got = {g["doc_id"]: g for g in run(spark, tables, "op8_run_length_dedup")}
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    first = {}
    for d in sorted(texts):
        for k in range(len(texts[d]) - 49):
            first.setdefault(texts[d][k : k + 50], d)
    some = 0
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < d:
                gone[k : k + 50] = True
        runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        g = got[d]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
        some += runs > 0
    assert some > 10


def sets9(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute_components(texts):
    sets = {d: sets9(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_op9(spark, tables, rows):
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in run(spark, tables, "op9_set_relation_join")}
    assert got == brute_components({r[0]: r[1] for r in rows})


def test_op10(spark, tables, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from pagescore.llm.tokencount import Counter, vocabulary

    pieces = vocabulary()
    exact = Tokenizer(models.Unigram(pieces, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace()
    got = {g["doc_id"]: g["n_tokens"] for g in run(spark, tables, "op10_viterbi_counts")}
    assert got == {r[0]: len(exact.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    tied = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("abc", -9.0), ("c", -1.0)]
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *tied], 0, False))
    plain.pre_tokenizer = pre_tokenizers.Metaspace()
    count = Counter([("<unk>", 0.0), *tied])
    for text in ("ab", "abab", "abc", "cab  ab", "zzab", "azzzb", "z z", " a", "ab▁b", "é"):
        assert count.text(text)[0] == len(plain.encode(text).ids), text
