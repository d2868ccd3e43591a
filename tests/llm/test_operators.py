"""The operators' own interfaces: limited movement, splits, curricula, very frequent seeds, nulls, ties and repeats."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagescore.llm import ann, jaccard, mixing, quality, repeats, sharding, toxicity, warc
from pagescore.llm.common import pieces, scratch, span_hashes
from pagescore.llm.runindex import RunIndex
from tests.llm.test_contracts import brute_components


def test_overflow_admits_in_ring_order():
    rng = random.Random(3)
    for _ in range(50):
        shards = rng.randrange(1, 6)
        ring = [rng.randrange(shards) for _ in range(12)] + list(range(shards))
        waiting = [rng.randrange(0, 30) for _ in ring]
        room = sharding.capacities(sum(waiting), shards, rng.choice([0.0, 0.2]))
        # a row at a time: all rows at their own node, then what is left at the next one
        used, queue, want = [0] * shards, [(a, a, k) for a, n in enumerate(waiting) for k in range(n)], {}
        while queue:
            later = []
            for node, arc, k in sorted(queue, key=lambda q: (q[0])):
                s = ring[node]
                if used[s] < room[s]:
                    want[arc, k] = (s, used[s])
                    used[s] += 1
                else:
                    later.append(((node + 1) % len(ring), arc, k))
            queue = later
        got = {(a, lo + k): (s, slot + k) for a, lo, hi, s, slot in sharding.overflow(ring, waiting, room) for k in range(hi - lo)}
        assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert len(set(got.values())) == len(got)


def test_rows_go_round_the_ring_one_by_one(spark):
    """Every row's shard and slot, against rows that walk the ring alone; nulls, ties and repeats too."""
    df = spark.createDataFrame([(k * 7, "a") for k in range(300)] + [(None, "a"), (None, "b"), (21, "a"), (21, "b")], "k long, t string")
    for n, nodes in ((5, 8), (3, 1)):
        arcs = sharding.ring(spark, n, nodes).collect()
        shard_of = {a["arc"]: a["shard"] for a in arcs}
        rows = df.select("k", "t", F.when(F.col("k").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("k")).alias("pos")).collect()
        home = lambda p: next(a["arc"] for a in arcs if a["lo"] < p <= a["hi"])  # noqa: B023, E731
        queue = sorted((home(r["pos"]), r["pos"], -1 if r["k"] is None else r["k"], r["t"]) for r in rows)
        queue = [(r[0], r) for r in queue]
        room, used, want = sharding.capacities(len(rows), n, 0.0), [0] * n, []
        while queue:
            later = []
            for node, row in sorted(queue, key=lambda q: q[0]):
                shard = shard_of[node]
                if used[shard] < room[shard]:
                    want.append((row[2], row[3], shard, used[shard]))
                    used[shard] += 1
                else:
                    later.append(((node + 1) % len(shard_of), row))
            queue = later
        got = [(-1 if r["k"] is None else r["k"], r["t"], r["shard"], r["slot"]) for r in sharding.shard(df, "k", ["t"], n, nodes).collect()]
        assert sorted(got) == sorted(want)


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).alias("shard"), F.lit("x").alias("SLOT"))
    place = lambda n: {r["k"]: r["shard"] for r in sharding.shard(df, "k", ["k"], n, slack=0.25).collect()}
    a, b = place(10), place(11)
    loads = np.bincount(list(b.values()), minlength=11)
    assert len(b) == 20_000 and loads.max() <= np.ceil(20_000 * 1.25 / 11)
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)  # a plain modulus moves ten in eleven


def test_shard_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a")] * 7 + [(5, "b")] * 9 + [(5, None), (6, "")], "k long, t string")
    got = sharding.shard(df, "k", ["t"], 3).collect()
    counts = np.bincount([r["shard"] for r in got], minlength=3)
    assert len(got) == 18 and counts.tolist() == [6, 6, 6]


def test_curriculum_positions(spark):
    rows = [(k, "abc"[k % 3], 50) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix(df, "doc_id", "size")
    takes = mixing.in_training_order(mixed).select("source", "position", "take.words").collect()
    at = [t["position"] for t in takes]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    words = lambda s, lo, hi: sum(t["words"] for t in takes if t["source"] == s and lo <= t["position"] < hi)
    # the early source takes 5/8 of its words in the first half, the even one half, the late one 3/8
    for s, part in (("a", 0.625), ("b", 0.5), ("c", 0.375)):
        assert abs(words(s, 0, 0.5) / words(s, 0, 1) - part) < 0.03


def test_targets_with_one_source_and_none(spark):
    got = mixing.targets(spark.createDataFrame([("only", 10)], "source string, source_size long")).collect()
    assert [r["target"] for r in got] == [15.0]
    got = mixing.targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()
    assert [r["target"] for r in got] == [0.0, 0.0]


def test_scan_abandons_candidates_and_keeps_the_near():
    """With a bound from the first lists most candidates are left after a block or two; the neighbours found stay."""
    rng = np.random.default_rng(3)
    dims, k = 64, 10
    centres = rng.normal(size=(30, dims)) * 2
    blocks = [c + rng.normal(size=(200, dims)) for c in centres]
    rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    hit = total = read = plain = 0
    for query in [b[0] for b in blocks[:10]]:
        order = np.argsort(((centres - query) ** 2).sum(axis=1))
        best, best_id, bound = np.zeros(0), np.zeros(0, np.int64), np.inf
        for place, at in enumerate(order):
            turned = blocks[at] @ rotation
            columns = [np.ascontiguousarray(turned[:, c : c + ann.COLUMNS]) for c in range(0, dims, ann.COLUMNS)]
            ids, far, cost = ann.scan(query, query @ rotation, np.arange(200) + 200 * at, blocks[at], columns, -1, k, bound)
            if place:  # beyond the first list
                read, plain = read + cost, plain + blocks[at].size
            by = np.argsort(np.concatenate((best, far)), kind="stable")[:k]
            best, best_id = np.concatenate((best, far))[by], np.concatenate((best_id, ids))[by]
            bound = best[-1] if len(best) == k else np.inf
        exact = np.argsort(((np.concatenate(blocks) - query) ** 2).sum(axis=1), kind="stable")[:k]
        hit, total = hit + len(set(exact) & set(best_id.tolist())), total + k
    assert hit / total >= 0.9 and read < 0.5 * plain


def test_scan_without_a_bound_and_with_one_of_its_own():
    vectors = np.arange(600, dtype=float).reshape(-1, 2)
    columns = [vectors]
    for bound in (np.inf, 1e9):
        ids, far, read = ann.scan(vectors[7], vectors[7], np.arange(300), vectors, columns, 7, 3, bound)
        assert ids.tolist() == [6, 8, 5] and np.allclose(far, [8**0.5, 8**0.5, 32**0.5]) and read > 0
    assert ann.scan(vectors[7], vectors[7], np.arange(300), vectors, columns, 7, 3, 0.1)[0].tolist() == []


def test_vectors_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = [(r["query_id"], r["vec_id"], round(r["score"], 3)) for r in ann.search(df, "k", "v", F.col("k") == 100).orderBy("rank").collect()]
    assert got == [(100, 2, 0.1), (100, 1, 1.414), (100, 1, 6.403)]


def test_archives_by_small_splits(spark, tables):
    pages = spark.read.parquet(f"{tables[0]}/pages.parquet").repartition(3)
    tricky = spark.createDataFrame([(900 + k, "u", "\x1f\x8b\x08" * 20 + "WARC/1.1\r\n\r\n" + "".join(random.Random(k).choices("abc \x1f", k=3000))) for k in range(6)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages.unionByName(tricky), scratch(spark, "warc"))
    whole = sorted(map(str, warc.read_archives(manifest, 1 << 30).collect()))
    assert len(whole) == pages.count() + 6
    for split in (64, 333, 4096):
        assert sorted(map(str, warc.read_archives(manifest, split).collect())) == whole


def test_magic_inside_stored_payload_is_no_record(tmp_path):
    import io
    import zlib

    inner = warc.member(b"not a record at all")
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the payload's bytes are in the archive as they are
    data = pack.compress(warc.record(1, "u", b"x" * 50 + inner, None)) + pack.flush() + warc.member(warc.record(2, "u", b"y", None))
    at = data.index(inner)
    assert [f["warc-record-id"] for f, _ in warc.members(io.BytesIO(data), at - 10, len(data), len(data))] == ["<urn:page:2>"]
    assert [f["warc-record-id"] for f, _ in warc.members(io.BytesIO(data), 0, len(data), len(data))] == ["<urn:page:1>", "<urn:page:2>"]


def test_run_index_against_search():
    rng = random.Random(1)
    for trial in range(60):
        length = 32 + rng.randrange(0, 20)
        letters = b"ab\x00" if trial % 2 else b"abcdefgh"
        base = [bytes(rng.choice(letters) for _ in range(rng.randrange(length, 90))) for _ in range(5)]

        def change():
            own = bytearray(rng.choice(base))
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = rng.choice(b"abx")
            return bytes(own[rng.randrange(0, 10) :]) or b"a"

        held, asked = [change() for _ in range(rng.randrange(1, 12))], [change() for _ in range(rng.randrange(1, 12))]
        value, own = np.array([rng.randrange(10) for _ in held]), np.array([rng.randrange(10) for _ in asked])
        starts = lambda parts, more: np.concatenate(([0], np.cumsum([len(p) + more for p in parts])[:-1]))
        index = RunIndex(np.frombuffer(b"".join(h + b"\xff" for h in held), np.uint8).copy(), starts(held, 1), value, length)
        a, b = index.long_matches(np.frombuffer(b"".join(asked), np.uint8), starts(asked, 0), np.array([len(p) for p in asked]), own)
        want = {(i, o) for i, p in enumerate(asked) for o in range(len(p) - length + 1) if any(p[o : o + length] in h and value[k] < own[i] for k, h in enumerate(held))}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_repeats_null_and_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(None, long), (7, long), (7, long + "!"), (9, "x " + long), (3, "short")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in repeats.remove_repeats(df).collect()}
    assert got == {(None, long): 0, (7, long): 0, (7, long + "!"): 0, (9, "x " + long): len(long), (3, "short"): 0}


def test_groups_of_many_changed_copies(spark):
    """Copies of one text with changes of their own: far from one another, near to the original."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = {0: " ".join(base)}
    for k in range(1, 60):
        own = list(base)
        for _ in range(5):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[k] = " ".join(own)
    texts |= {100: None, 101: "", 102: "w1 w2", 103: "W1  w2"}
    df = spark.createDataFrame([*texts.items(), (None, "alone in the world"), (None, texts[0])], "doc_id long, text string")
    got = similar = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df).collect()}
    want = {(d, n, c) for d, (n, c) in brute_components(texts).items()} | {(None, 1, None)} | {(None, next(n for d, n, _ in similar if d == 0), 0)}
    assert got == want


def test_leaders_and_the_rest_lose_no_pair():
    """In one list, each pair that the bounds allow is a leader's or among the rest."""
    rng = random.Random(8)
    for _ in range(40):
        n = rng.randrange(2, 14)
        rows = sorted((s := rng.randrange(4, 40), rng.randrange(0, s // 4 + 1)) for _ in range(n))
        size, at = [r[0] for r in rows], [r[1] for r in rows]
        batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array(size), pa.array(at), pa.array(range(n))], names=["token", "root", "size", "at", "set_id"])
        caught = {}

        class Rows:
            def mapInArrow(self, run, schema):
                caught["run"] = run

        jaccard.rest(Rows())
        got = {tuple(sorted((r["a"], r["b"]))) for b in caught["run"](iter([batch])) for r in b.to_pylist()}
        for i in range(n):
            for k in range(i + 1, n):
                need = -(-75 * (size[i] + size[k]) // 175)
                if 100 * size[i] >= 75 * size[k] and min(size[i] - at[i], size[k] - at[k]) >= need:
                    assert (i, k) in got
        for h, k in jaccard.lead(size, at):
            assert (min(h, k), max(h, k)) in got


def test_pieces_and_hashes():
    column = pa.chunked_array([pa.array(["ab", None, "", "é x"]), pa.array(["ab"])]).slice(1)
    seen = [(first, bytes(data), bounds.tolist()) for first, data, bounds in pieces(column, most=3)]
    assert b"".join(d for _, d, _ in seen) == b"  \xc3\xa9 x ab "
    data = np.frombuffer(b"same same", np.uint8)
    a, b = span_hashes(data, np.array([0, 5]), np.array([4, 9]))
    assert a == b != span_hashes(data, np.array([0]), np.array([3]))[0]


def feature_rows(texts, labels):
    """The quality model's features of texts, without Spark."""
    if not texts:
        return quality.Rows(*(np.zeros(0, np.int64) for _ in range(4)))
    _, data, bounds = next(pieces(pa.array(texts), 1 << 30))
    return quality.Rows(*quality.counted(data, bounds, quality.BUCKET_BITS), np.array(labels))


def test_quality_learns_and_survives_one_label():
    rng = random.Random(2)
    good = [" ".join(f"word{rng.randrange(500)}" for _ in range(60)) for _ in range(150)]
    bad = [g.replace(" ", "%%% ", 20) for g in good]
    model = quality.fit(feature_rows(good[:100] + bad[:100], [1] * 100 + [0] * 100))
    s = model.scores(pa.array(good[100:] + bad[100:] + [None, ""]))
    assert (s[:50] >= 0.5).mean() > 0.9 and (s[50:100] < 0.5).mean() > 0.9 and s[-1] == s[-2]
    assert quality.fit(feature_rows([], [])).scores(pa.array(["a"]))[0] == 0.5 and quality.fit(feature_rows(["a"], [1])).scores(pa.array(["b"]))[0] > 0.5


def test_quality_against_row_by_row_updates(spark):
    """The fit, its sample and the scores, against a dictionary of weights that is updated one feature at a time."""
    from collections import Counter
    from math import exp, sqrt

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "ef", "gh!", "ij"]) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    labels = [int("gh" in t) for t in texts]
    rows = feature_rows(texts, labels)
    model = quality.fit(rows, epochs=2)
    size = 1 << quality.BUCKET_BITS
    own = []
    for t in texts:
        _, data, bounds = next(pieces(pa.array([t])))
        own.append(Counter(quality.features(data, bounds, quality.BUCKET_BITS)[0].tolist()))
    value = lambda c: {**{b: 20.0 * n / sum(c.values()) for b, n in c.items()}, size: 1.0}
    z, n = Counter(), Counter()

    def weight(b):
        l1 = 0.0 if b == size else 0.02
        return 0.0 if abs(z[b]) <= l1 else -(z[b] - (l1 if z[b] > 0 else -l1)) / ((1.0 + sqrt(n[b])) / 0.3 + 0.1)

    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(60):
            x = value(own[k])
            w = {b: weight(b) for b in x}
            g = 1 / (1 + exp(-sum(w[b] * v for b, v in x.items()))) - labels[k]
            for b, v in x.items():
                z[b] += g * v - (sqrt(n[b] + (g * v) ** 2) - sqrt(n[b])) / 0.3 * w[b]
                n[b] += (g * v) ** 2
    want = [1 / (1 + exp(-sum(weight(b) * v for b, v in value(c).items()))) for c in own]
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-5)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "x")], "doc_id long, text string")
    told = spark.createDataFrame([(k, v) for k, v in enumerate(labels)] + [(3, labels[3]), (None, 1)], "doc_id long, quality int")
    from pagescore.llm.common import learnable

    learned = sorted(r[0] for r in docs.where(learnable(F.col("doc_id"), 3, 1)[0]).select("doc_id").distinct().collect())
    got = quality.sample_features(docs, told, "quality", 3, 1, 1000)
    alone = feature_rows([texts[k] for k in learned], [labels[k] for k in learned])
    for a, b in ((got.bucket, alone.bucket), (got.count, alone.count), (got.start, alone.start), (got.label, alone.label)):
        assert a.tolist() == b.tolist()
    few = quality.sampled(docs, told, "quality", 3, 1, 1000, most_bytes=40).select(F.sum(F.octet_length("text"))).first()[0]
    assert few <= 40


def test_toxicity_finds_the_one_window_with_a_bad_word():
    rng = random.Random(6)
    syllables = ["ba", "ne", "ti", "ro", "lu", "ka", "se", "do"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    clean = [" ".join(word() for _ in range(rng.randrange(3, 90))) for _ in range(700)]
    toxic = []
    for c in clean[:250]:
        own = c.split()
        own.insert(rng.randrange(len(own) + 1), "zzqx" + rng.choice(syllables))
        toxic.append(" ".join(own))
    net = toxicity.fit(clean[250:600] + toxic[:200], [0] * 350 + [1] * 200)
    s = net.scores(pa.array(clean[600:] + toxic[200:] + ["", None, "?!"]))
    assert (s[:100] < 0.5).mean() > 0.9 and (s[100:150] >= 0.5).mean() > 0.9
    assert s[150] == s[151] == s[152]


def test_toxicity_gradients():
    """Back-propagation against finite differences."""
    net = toxicity.Network.new()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, data, bounds = next(pieces(pa.array(["ab cd ef ab gh", "xy z"])))
    index, text, own, grams, begin = toxicity.distinct_words(data, bounds)
    first, words, _ = toxicity.windows(text, 2)
    at, seen = toxicity.spread(index, first, words)
    mask = np.ones((len(own), 1))

    def loss():
        logit, kept = net.forward(net.inputs(own, grams, begin, mask), at, seen, keep=True)
        return float(logit @ np.array([1.0, -2.0])), kept

    _, kept = loss()
    g = net.gradients(net.inputs(own, grams, begin, mask), at, seen, kept, np.array([1.0, -2.0]), own, grams, begin, mask)
    rng = np.random.default_rng(0)
    for name, x in net.p.items():
        rows = own if name == "words" else grams if name == "grams" else np.arange(len(x))
        for _ in range(4):
            spot = (int(rng.choice(rows)), *(int(rng.integers(n)) for n in x.shape[1:]))
            kept_value = x[spot]
            x[spot] = kept_value + 1e-5
            up = loss()[0]
            x[spot] = kept_value - 1e-5
            down = loss()[0]
            x[spot] = kept_value
            assert abs((up - down) / 2e-5 - g[name][spot]) < 1e-3, name
