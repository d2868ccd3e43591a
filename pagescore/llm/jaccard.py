"""N-gram Jaccard join by set-relation skipping.

A text's set is that of its distinct 5-word shingles. Sets are joined by prefixes under one global order of shingles,
rare first. The index lists of a shingle are sorted by set size and position, so that whole blocks are skipped by the
positional bound. Each set is first compared with one leader in a list; what that tells about two followers of one
leader bounds their overlap, and only pairs that the bounds leave open are compared themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import LOWER, SPACE, discard, mix64, pieces, runs, span_hashes, table, written
from pagescore.llm.components import components

WORDS = 5
#: Sets are linked when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Counters of the frequency sketch as a power of two, and of one part of it. Its size does not depend on the data.
SKETCH_BITS, PART_BITS = 21, 16
#: Set ids that a task remembers in order to pass over copies; when there are more it starts anew.
REMEMBERED = 1 << 18


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, by text."""
    starts, ends = runs(~SPACE[data])
    word = np.concatenate((span_hashes(LOWER[data], starts, ends), np.zeros(WORDS, np.uint64)))
    text = np.concatenate((np.searchsorted(bounds, starts, side="right") - 1, np.full(WORDS, -1)))
    n = len(starts)
    value = np.full(n, 0x51ED270B7A4F5A5D, dtype=np.uint64)
    for k in range(WORDS):
        value = mix64(value * np.uint64(0x9FB21C651E98DF25) + np.where(text[k : n + k] == text[:n], word[k : n + k], np.uint64(0)))
    full = text[WORDS - 1 : n + WORDS - 1] == text[:n]
    first = np.concatenate(([True], text[1:n] != text[: n - 1])) if n else np.zeros(0, bool)
    use = full | first  # fewer than five words: the whole sequence, at the first word
    text, value = text[:n][use], value[use]
    order = np.argsort(value)  # equal ones of a text are one shingle, so it need not be stable
    order = order[by_text(text[order], len(bounds) - 1)]
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def by_text(text: np.ndarray, n_texts: int) -> np.ndarray:
    """The stable order by text number; 16-bit numbers are sorted by their digits."""
    return np.argsort(text.astype(np.uint16) if n_texts <= 1 << 16 else text, kind="stable")


def set_ids(text: np.ndarray, value: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, size, first shingle) of each text's set; id 0 for an empty one. Equal sets have equal ids."""
    size = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    ids, some = np.zeros(n_texts, np.uint64), size > 0
    if some.any():
        total = np.add.reduceat(mix64(value), first[some])
        other = np.bitwise_xor.reduceat(mix64(value + np.uint64(0xA5A5A5A5)), first[some])
        ids[some] = mix64(total * np.uint64(0x9E3779B97F4A7C15) + other + size[some].astype(np.uint64)) | np.uint64(1)
    return ids.view(np.int64), size, first


class Unseen:
    """Tells which ids come for the first time in this task; it may forget, so others must bear repeats."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for k, i in enumerate(ids.tolist()):
            if i and i not in self.seen:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen.add(i)
                out[k] = True
        return out


def profile(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. doc: doc_id, set_id, size of each row. sketch: part, counts of one task's distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen, sketch = Unseen(), np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "set_id", "size", "part", "counts"]
        for b in batches:
            for row, data, bounds in pieces(b.column("text")):
                n = len(bounds) - 1
                text, value = shingles(data, bounds)
                ids, size, _ = set_ids(text, value, n)
                sketch += np.bincount(value[unseen(ids)[text]] >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), pa.array(ids), pa.array(size, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for k, part in enumerate(np.split(sketch, 1 << (SKETCH_BITS - PART_BITS))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([np.minimum(part, 65535).astype(np.uint16).tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id long, size long, part int, counts binary")


def frequency(profiled: DataFrame) -> np.ndarray:
    """The sketch summed over all tasks: for each hash prefix, the number of distinct sets' shingles that have it."""
    parts = 1 << (SKETCH_BITS - PART_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(counts, np.uint16)
                own[part] = own[part] + counts if part in own else counts.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in own.values()], pa.binary())], names=["part", "counts"])

    summed = profiled.where("part is not null").select("part", "counts").repartition(parts, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in summed.collect():  # a fixed number of parts
        out[r["part"] << PART_BITS : (r["part"] + 1) << PART_BITS] = np.frombuffer(r["counts"], np.int32)
    return out


def needed(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-THRESHOLD * (size + other) // (100 + THRESHOLD))


def postings(docs: DataFrame, order) -> DataFrame:
    """(token, set_id, size, at): the prefix of each distinct set, in order of its shingles' frequency, then hash.

    A linked set shares one of the first size - ceil(0.75 * size) + 1 shingles. Copies within a task are passed over.
    A shingle whose counter stands at one set is in no other, and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen, counts = Unseen(), order.value
        for b in batches:
            for _, data, bounds in pieces(b.column(0)):
                text, value = shingles(data, bounds)
                ids, size, first = set_ids(text, value, len(bounds) - 1)
                fresh = unseen(ids)[text]
                text, value = text[fresh], value[fresh]
                often = counts[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # those in no other set stand first, and need no order among themselves
                lone = np.bincount(text[often <= 1], minlength=len(size))
                text, value, often = text[often > 1], value[often > 1], often[often > 1]
                by = np.argsort(often, kind="stable")  # a text's shingles come in order of their hashes
                by = by[by_text(text[by], len(size))]
                text, value = text[by], value[by]
                start = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
                at = np.arange(len(text)) - np.repeat(start, np.diff(np.append(start, len(text)))) + lone[text]
                own = size[text]
                use = at < own - -(-THRESHOLD * own // 100) + 1
                yield pa.RecordBatch.from_arrays([pa.array(value[use].view(np.int64)), pa.array(ids[text[use]]), pa.array((own[use] << 32) | at[use])], names=["token", "set_id", "size_at"])

    return docs.select("text").mapInArrow(run, "token long, set_id long, size_at long")


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole index lists, some lists at a time, from rows sorted by token."""
    held: list[list[np.ndarray]] = []  # batches that all belong to one list, but for what the first begins with
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(new[0], new[0][-1]))  # the last list may go on
        if held and (cut or held[-1][0][-1] != new[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in new], strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in new]
        held.append([c[cut:] for c in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def leaders(sorted_postings: DataFrame) -> DataFrame:
    """Rows of two kinds. pair: a, b, size_a, size_b of a set and its leader. entry: token, a (a set), size_a, at.

    A set's leader in a list is the first one of a linkable size and position; lists with one set are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, set_id, size_at in lists(batches):
            new = np.ones(len(token), bool)  # copies that several tasks sent
            new[1:] = (token[1:] != token[:-1]) | (set_id[1:] != set_id[:-1]) | (size_at[1:] != size_at[:-1])
            token, set_id, size_at = token[new], set_id[new], size_at[new]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(start, len(token)))
            size, at = size_at >> 32, size_at & 0xFFFFFFFF
            pairs: list[np.ndarray] = []
            for s, e in zip(start[count > 1].tolist(), (start + count)[count > 1].tolist(), strict=True):
                pairs.append(s + np.array(lead(size[s:e].tolist(), at[s:e].tolist()), dtype=np.int64).reshape(-1, 2))
            many = np.repeat(count > 1, count)
            if pairs:
                p = np.concatenate(pairs)
                got = np.unique(np.column_stack((set_id[p[:, 0]], set_id[p[:, 1]], size[p[:, 0]], size[p[:, 1]])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(got), pa.int64()), *(pa.array(got[:, k]) for k in range(4)), pa.nulls(len(got), pa.int64())], names=["token", "a", "b", "size_a", "size_b", "at"])
            none = pa.nulls(int(many.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(set_id[many]), none, pa.array(size[many]), none, pa.array(at[many])], names=["token", "a", "b", "size_a", "size_b", "at"])

    return sorted_postings.mapInArrow(run, "token long, a long, b long, size_a long, size_b long, at long")


def lead(size: list[int], at: list[int]) -> list[tuple[int, int]]:
    """(leader, follower) index pairs of one list. Sets that no leader fits lead themselves.

    The sets are taken by position: the fewer rarer shingles stand before the common one, the more of its shingles a set
    shares with others, so that of many copies with changes the original comes before its copies. Sets at a position at
    which none of the same size can be linked by this shingle don't lead, so leaders differ in size.
    """
    out: list[tuple[int, int]] = []
    heads: list[int] = []
    for k in sorted(range(len(size)), key=lambda k: (at[k], size[k])):
        own, left = size[k], size[k] - at[k]
        for h in heads:
            other = size[h]
            need = -(-THRESHOLD * (own + other) // (100 + THRESHOLD))
            if need <= left and need <= other - at[h] and 100 * min(own, other) >= THRESHOLD * max(own, other):
                out.append((h, k))
                break
        else:
            if left >= -(-THRESHOLD * 2 * own // (100 + THRESHOLD)):
                heads.append(k)
    return out


def rest(entries: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b): pairs of one list that can be linked and aren't in one component yet.

    Rows (token, root, size, at, set_id) come sorted by token, size, position. For each set the list's blocks of equal
    size are cut at the last position that the bound allows; lists whose sets are all in one component go at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "size_a", "size_b"]
        for token, root, size, at, set_id in lists(batches):
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(start, len(token)))
            mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
            found: list[np.ndarray] = []
            pending = 0
            for s, n in zip(start[mixed].tolist(), count[mixed].tolist(), strict=True):
                sz, ps, rt = size[s : s + n], at[s : s + n], root[s : s + n]
                block = np.flatnonzero(np.concatenate(([True], sz[1:] != sz[:-1])))
                block_end = np.append(block[1:], n)
                for k in range(1, n):
                    for lo, hi in zip(block[(100 * sz[block] >= THRESHOLD * sz[k]) & (block < k)].tolist(), block_end[(100 * sz[block] >= THRESHOLD * sz[k]) & (block < k)].tolist(), strict=True):
                        need = int(needed(sz[k], sz[lo]))
                        if sz[k] - ps[k] < need:
                            break  # larger blocks need more
                        hi = lo + int(np.searchsorted(ps[lo : min(hi, k)], sz[lo] - need, side="right"))
                        other = lo + np.flatnonzero(rt[lo:hi] != rt[k])
                        if len(other):
                            found.append(np.column_stack((set_id[s + other], np.full(len(other), set_id[s + k]), sz[other], np.full(len(other), sz[k]))))
                            pending += len(other)
                    if pending > 1 << 18:
                        got = np.unique(np.concatenate(found), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(got[:, c]) for c in range(4)], names=names)
                        found, pending = [], 0
            if found:
                got = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, c]) for c in range(4)], names=names)

    return entries.mapInArrow(run, "a long, b long, size_a long, size_b long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, tokens) of the sets named by wanted (doc_id, set_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, bounds in pieces(b.column("text")):
                n = len(bounds) - 1
                text, value = shingles(data, bounds)
                ids, size, first = set_ids(text, value, n)
                right = np.flatnonzero(ids == b.column("set_id").slice(row, n).to_numpy())  # of repeated doc_ids with other texts
                keep = np.isin(text, right)
                offsets = np.concatenate(([0], np.cumsum(size[right])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[right]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[keep].view(np.int64)))], names=["set_id", "tokens"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("set_id", "text").mapInArrow(run, "set_id long, tokens array<long>").dropDuplicates(["set_id"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact overlap to pairs."""
    a, b = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("_x")), sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("_y"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "size_a", "size_b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("overlap"))


_LINKED = f"100 * overlap >= {THRESHOLD} * (size_a + size_b - overlap)"


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles long, set_id long, component_id long: one row for each row of docs (doc_id long, text string).

    component_id is the smallest doc_id that links reach; equal sets are linked. Empty and null texts have no shingles
    and no links, and keep their own doc_id. A null doc_id has its component's smallest id, if there is one. Sets are
    told apart by 64-bit hashes of shingles and sets. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profiled = written(profile(docs), "sets")
    rows = profiled.where("part is null").select("doc_id", "set_id", "size")
    order = spark.sparkContext.broadcast(frequency(profiled))
    shuffled = postings(docs, order).repartition("token").sortWithinPartitions("token", "size_at", "set_id")
    led = written(leaders(shuffled), "lists")
    order.destroy()
    pairs = led.where("token is null").select("a", "b", "size_a", "size_b").distinct()
    first_doc = written(rows.where("size > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "first")

    def members(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()

    tokens: list[DataFrame] = []

    def fetched(ids: DataFrame) -> DataFrame:
        tokens.append(written(sets_of(docs, first_doc.join(ids, "set_id").select("doc_id", "set_id")), "tokens"))
        return tokens[-1]

    sets = fetched(members(pairs))
    answers = written(overlaps(pairs, sets), "answers")
    # what the leader x tells of followers y and z: |y & z| >= |x & y| + |x & z| - |x|, and <= |x & y| + |z| - |x & z|
    links = answers.where(_LINKED).select("a", "b")
    known = components(links)
    entries = led.where("token is not null").select("token", F.col("a").alias("set_id"), F.col("size_a").alias("size"), "at")
    rooted = entries.join(known, F.col("set_id") == F.col("node"), "left").select("token", F.coalesce("root", "set_id").alias("root"), "size", "at", "set_id")
    open_pairs = rest(rooted.repartition("token").sortWithinPartitions("token", "size", "at", "set_id")).distinct().join(answers.select("a", "b"), ["a", "b"], "left_anti")
    open_pairs = written(open_pairs, "open")
    told = answers.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("size_a").alias("size_x"), F.col("overlap").alias("o"))
    told = told.unionByName(answers.select(F.col("a").alias("x"), F.col("a").alias("y"), F.col("size_a").alias("size_x"), F.col("size_a").alias("o")).distinct())
    # a follower's closest leader; two followers of the same one bound each other
    near = told.groupBy("y").agg(F.max_by(F.struct("x", "size_x", "o"), F.struct("o", "x")).alias("t"))
    bounded = (
        open_pairs.join(near.select(F.col("y").alias("a"), F.col("t").alias("ta")), "a", "left").join(near.select(F.col("y").alias("b"), F.col("t").alias("tb")), "b", "left")
        .withColumn("same", F.coalesce(F.col("ta.x") == F.col("tb.x"), F.lit(False)))
        .withColumn("most", F.when(F.col("same"), F.least(F.col("ta.o") + F.col("size_b") - F.col("tb.o"), F.col("tb.o") + F.col("size_a") - F.col("ta.o"))))
        .withColumn("least", F.when(F.col("same"), F.col("ta.o") + F.col("tb.o") - F.col("ta.size_x")))
    )
    bounded = written(bounded.select("a", "b", "size_a", "size_b", "most", "least"), "bounded")
    sure = bounded.where(_LINKED.replace("overlap", "least"))
    compare = bounded.where(f"not coalesce({_LINKED.replace('overlap', 'least')}, false) and coalesce({_LINKED.replace('overlap', 'most')}, true)").select("a", "b", "size_a", "size_b")
    missing = written(members(compare).join(sets.select("set_id"), "set_id", "left_anti"), "missing")
    if not missing.isEmpty():
        sets = sets.unionByName(fetched(missing))
    more = overlaps(compare, sets).where(_LINKED).select("a", "b").unionByName(sure.select("a", "b"))
    linked = Observation()
    more = written(more.observe(linked, F.count(F.lit(1)).alias("n")), "more")
    # the components known so far, each a star round its root, stand for their links
    found = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if linked.get["n"] else known
    # each side of these joins is dealt out plainly, so that a component of very many sets, and a set of very many copies,
    # are split among tasks
    inside = first_doc.join(found, F.col("set_id") == F.col("node"))
    least = written(inside.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = inside.select(F.col("set_id").alias("_set"), "root").join(least, "root")
    named = written(first_doc.join(named, F.col("set_id") == F.col("_set"), "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    discard(led, answers, open_pairs, bounded, missing, more, first_doc, least, *tokens)
    out = rows.join(named, "set_id", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the size of their sets and their components."""
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n i ON x = i.doc_id JOIN n j ON y = j.doc_id WHERE 100 * c >= 75 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.c, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON d.doc_id = m.x
"""
