"""Suffix-array dedup: passages that an earlier document holds, found by a run-length index of the repeated segments.

Every LENGTH-byte window has a seed: the least hash of its grams. Equal windows have equal seeds, so windows are brought
together by seed, a run of neighbouring windows of one seed as one segment. First only seeds are dealt out, to find those
that several documents have; then the segments of these, both but for texts that are copies as a whole. Of segments that
are equal as a whole only the earliest document's are kept, by each task before they are dealt out and again after it. Of
the different segments of a seed those parts are indexed that by their windows' hashes a later document has too, and those
streamed through the index that an earlier one has.
A seed with too many for one index is cut up by longer grams, so that equal windows still meet, in smaller groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import discard, mix64, pieces, powers, span_hashes, table, written
from pagescore.llm.runindex import END, RunIndex

LENGTH = 50
#: Bytes of the grams by which windows are dealt out: at first, and for seeds that have too many segments at the step before.
#: The shorter the first, the more windows share it by chance, and the more so in larger tables.
GRAMS = (24, 36, LENGTH)
#: Windows hashed at a time, so that the arrays stay in a processor's cache.
BLOCK = 1 << 15
#: Bytes of different segments that are indexed together; a seed is never split over two indexes.
INDEX_BYTES = 1 << 20
#: Most different segments of one seed in an index; those of a seed with more are dealt out again by the next longer gram.
MOST_SEGMENTS = 20_000
#: Segments whose earliest document a task remembers; when there are more it starts anew.
REMEMBERED = 1 << 17

_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` bytes, the same wherever they stand; not mixed."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=prefix[1:])
    return (prefix[gram:] - prefix[:-gram]) * powers(pow(_BASE, -1, 1 << 64), len(data))[: len(data) - gram + 1]


def seeds(data: np.ndarray, bounds: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, seed) of each segment: a run of windows of one seed, as many as a window has grams at most.
    No window spans texts."""
    n, grams = len(data) - LENGTH + 1, LENGTH - gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    least = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        own = mix64(gram_hashes(data[at : at + BLOCK + LENGTH - 1], gram))
        width = 1
        while width * 2 <= grams:
            own = np.minimum(own[:-width], own[width:])
            width *= 2
        least[at : at + BLOCK] = np.minimum(own[: len(own) - (grams - width)], own[grams - width :])
    inside = np.ones(n, bool)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        inside[max(end - LENGTH, start) : end] = False  # a text ends one byte before the next bound
    change = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]))))
    size = np.diff(np.append(change, n))
    keep = inside[change]
    change, size = change[keep], size[keep]
    many = -(-size // grams)
    of = np.repeat(np.arange(len(change)), many)
    step = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * grams
    return change[of] + step, np.minimum(size[of] - step, grams), least[change][of]


def shared_seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, seeds array<long>) of the seeds that documents of other ids have too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, bounds in pieces(b.column("text")):
                first, _, seed = seeds(data, bounds)
                text = np.searchsorted(bounds, first, side="right") - 1
                order = np.argsort(seed ^ mix64(np.arange(len(bounds) - 1, dtype=np.uint64))[text])  # equal seeds of a text together
                seed, text = seed[order], text[order]
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
                ids = b.column("doc_id").slice(row, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(seed[new].view(np.int64)), ids.take(pa.array(text[new]))], names=["seed", "doc_id"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_seed, held_doc, many = None, None, False  # the last seed so far, a document of it, and whether it has others
        for b in batches:
            if not b.num_rows:
                continue
            seed, doc = b.column("seed").to_numpy(), b.column("doc_id").to_numpy()
            if held_seed is not None:
                seed, doc = np.append(held_seed, seed), np.append(held_doc, doc)
            start = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
            size = np.diff(np.append(start, len(seed)))
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            several[0] |= many
            use = np.repeat(several, size)
            # the last seed goes on in the next batch: one row of it is held, as others are of the same document or leave now
            held_seed, held_doc, many = seed[-1], doc[-1], bool(several[-1])
            use[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(seed[use])], names=["doc_id", "seed"])
        if held_seed is not None and many:
            yield pa.RecordBatch.from_arrays([pa.array([held_doc]), pa.array([held_seed])], names=["doc_id", "seed"])

    dealt = docs.mapInArrow(deal, "seed long, doc_id long").repartition("seed").sortWithinPartitions("seed")  # one long, which Spark sorts by radix
    return dealt.mapInArrow(several, "doc_id long, seed long").groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"))


def mark_of(text: str) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, place, start, end): the whole range of each text that a smaller doc_id has too."""
    keyed = docs.select("doc_id", F.md5("text").alias("md5"), mark_of("text").alias("place"), F.octet_length("text").cast("long").alias("end"))
    first = keyed.groupBy("md5").agg(F.min("doc_id").alias("least"))
    return keyed.join(first, "md5").where("doc_id > least").select("doc_id", "place", F.lit(0).cast("long").alias("start"), "end")


#: Of rows with later copies' marks in the column gone: the text is none of them.
NOT_GONE = "gone is null or not array_contains(gone, mark)"
SEGMENT = "seed long, whole long, doc_id long, place long, bytes binary"


class Earliest:
    """The earliest document so far of each kind of segment in a task, kinds told apart by two 64-bit hashes."""

    def __init__(self) -> None:
        self.one, self.two, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def later(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a smaller document has a segment's kind, here or before. It may forget, so others must bear copies."""
        if not len(doc):
            return np.zeros(0, bool)
        by = np.lexsort((doc, two, one))
        a, b, d = one[by], two[by], doc[by]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        kind, a, b, least = np.cumsum(new) - 1, a[new], b[new], d[new]
        at = np.searchsorted(self.one, a)
        inside = at < len(self.one)
        met = np.flatnonzero(inside)[self.one[at[inside]] == a[inside]]
        known = met[self.two[at[met]] == b[met]]
        least[known] = np.minimum(self.doc[at[known]], least[known])
        self.doc[at[known]] = least[known]
        out = np.zeros(len(doc), bool)
        out[by] = d > least[kind]
        fresh = np.ones(len(a), bool)
        fresh[met] = False
        fresh[1:] &= a[1:] != a[:-1]
        if len(self.one) + int(fresh.sum()) > REMEMBERED:
            self.one, self.two, self.doc = a[fresh], b[fresh], least[fresh]
        else:
            self.one, self.two, self.doc = (np.concatenate(x) for x in ((self.one, a[fresh]), (self.two, b[fresh]), (self.doc, least[fresh])))
            order = np.argsort(self.one, kind="stable")
            self.one, self.two, self.doc = self.one[order], self.two[order], self.doc[order]
        return out


def _segment_rows(data: np.ndarray, first: np.ndarray, windows: np.ndarray, seed: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    length = windows + LENGTH - 1
    offsets = np.concatenate(([0], np.cumsum(length)))
    take = np.arange(int(offsets[-1])) + np.repeat(first - offsets[:-1], length)
    body = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(place), body], names=["seed", "whole", "doc_id", "place", "bytes"])


def segments(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The segments of shared seeds, of all texts but later copies of others, whose marks are in shared's column gone.

    place holds the first byte's offset and 32 bits of the text's hash, for texts whose doc_id repeats; whole is a hash
    of the bytes. A segment that a smaller document of the same task has too comes without bytes: nothing is to be looked
    for, its range is removed. Its seed is no seed but deals it out evenly, and whole is its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest = Earliest()
        for b in batches:
            mark = b.column("mark").to_numpy()
            for row, data, bounds in pieces(b.column("text")):
                n = len(bounds) - 1
                first, windows, seed = seeds(data, bounds)
                text = np.searchsorted(bounds, first, side="right") - 1
                asked = b.column("seeds").slice(row, n)
                size = np.diff(asked.offsets.to_numpy())
                wanted = np.sort(mix64(asked.flatten().to_numpy().view(np.uint64) ^ mix64(np.repeat(np.arange(n), size).astype(np.uint64))))
                own = mix64(seed ^ mix64(text.astype(np.uint64)))  # seed and text as one number
                at = np.searchsorted(wanted, own)
                use = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == own) if len(wanted) else np.zeros(len(own), bool)
                first, windows, text, seed = first[use], windows[use], text[use], seed[use]
                end = first + windows + LENGTH - 1
                whole, other = span_hashes(data, first, end), span_hashes(data[::-1], len(data) - end, len(data) - first)
                doc = b.column("doc_id").slice(row, n).to_numpy()[text]
                place = ((first - bounds[text]) << 32) | mark[row : row + n][text]
                gone = earliest.later(whole, other, doc)
                if gone.any():
                    spread = mix64(doc[gone].view(np.uint64) ^ mix64(place[gone].view(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array((end - first)[gone]), pa.array(doc[gone]), pa.array(place[gone]), pa.nulls(int(gone.sum()), pa.binary())], names=["seed", "whole", "doc_id", "place", "bytes"])
                yield _segment_rows(data, *(x[~gone] for x in (first, windows, seed, whole, doc, place)))

    joined = docs.withColumn("mark", mark_of("text")).join(shared, "doc_id").where(NOT_GONE)
    return joined.select("doc_id", "text", "mark", "seeds").mapInArrow(run, SEGMENT)


def finer(deferred: DataFrame, gram: int) -> DataFrame:
    """Segments of deferred rows (FOUND, with bytes) by a longer gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, mark, start = (b.column(c).to_numpy() for c in ("doc_id", "place", "start"))
            for row, data, bounds in pieces(b.column("bytes")):
                first, windows, seed = seeds(data, bounds, gram)
                text = np.searchsorted(bounds, first, side="right") - 1
                place = ((start[row + text] + first - bounds[text]) << 32) | mark[row + text]
                yield _segment_rows(data, first, windows, seed, span_hashes(data, first, first + windows + LENGTH - 1), doc[row + text], place)

    return deferred.mapInArrow(run, SEGMENT)


def _rows(held: list) -> tuple[np.ndarray, ...]:
    """seed, whole, doc, place and the byte offsets and bytes of record batches, joined."""
    whole = pa.Table.from_batches(held).combine_chunks()
    body = whole.column("bytes").combine_chunks() if whole.num_rows else pa.array([], pa.binary())
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
    return (*(whole.column(c).to_numpy() for c in ("seed", "whole", "doc_id", "place")), offsets, data)


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans, one after another (with END if asked): bytes, starts."""
    full = size + int(end)
    starts = np.cumsum(full) - full
    out = np.full(int(full.sum()), END, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at + np.repeat(starts, size)] = data[at + np.repeat(begin, size)]
    return out, starts


def kinds(seed: np.ndarray, whole: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each row's bytes differ from the row's before; bytes are compared where the hashes agree."""
    new, size = np.ones(len(seed), bool), np.diff(offsets)
    at = np.flatnonzero((seed[1:] == seed[:-1]) & (whole[1:] == whole[:-1]) & (size[1:] == size[:-1]))
    if len(at):
        begin = np.cumsum(size[at]) - size[at]
        step = np.arange(int(size[at].sum())) - np.repeat(begin, size[at])
        differ = data[np.repeat(offsets[at], size[at]) + step] != data[np.repeat(offsets[at + 1], size[at]) + step]
        new[at + 1] = np.add.reduceat(differ, begin, dtype=np.int64) > 0
    return new


def alike(data: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(row, first byte, bytes) of the parts of rows to hold, and to ask for: from the first to the last window whose hash is
    in a row of larger least too, or in one of smaller.

    What has neither has no window in common with a row of another document, so the index can do without it.
    """
    data, starts = _gather(data, begin, size, False)
    windows = size - LENGTH + 1
    row = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = gram_hashes(data, LENGTH)[at + starts[row]]
    by = np.argsort(hashes)
    new = np.concatenate(([True], hashes[by[1:]] != hashes[by[:-1]]))
    many = np.diff(np.append(np.flatnonzero(new), len(by)))
    by, many = by[np.repeat(many > 1, many)], many[many > 1]
    own, first = least[row[by]], np.cumsum(many) - many
    none = np.zeros(0, np.int64)
    if not len(by):
        return (none,) * 3, (none,) * 3

    def parts(use: np.ndarray) -> tuple[np.ndarray, ...]:
        window = np.sort(by[use])
        of = row[window]
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else none
        one = np.append(0, last[:-1] + 1) if len(of) else none
        return of[last], at[window[one]], at[window[last]] - at[window[one]] + LENGTH

    return parts(own < np.repeat(np.maximum.reduceat(own, first), many)), parts(own > np.repeat(np.minimum.reduceat(own, first), many))


FOUND = "doc_id long, place long, start long, end long, bytes binary"


def _found(doc: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, body: pa.Array | None = None) -> pa.RecordBatch:
    body = pa.nulls(len(doc), pa.binary()) if body is None else body
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, place & 0xFFFFFFFF, start, end)), body], names=["doc_id", "place", "start", "end", "bytes"])


def match(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges of the segments of whole seeds, of each kind its earliest document's, sorted by seed and whole.

    Where a seed has several kinds, their windows are looked for in the other kinds, of smaller documents. Parts of
    them that by their windows' hashes have nothing in common with another are neither indexed nor looked for.
    """
    seed, whole, doc, place, offsets, data = rows
    kind_new = kinds(seed, whole, offsets, data)
    kind_start = np.flatnonzero(kind_new)
    kind = np.cumsum(kind_new) - 1
    least, start = doc[kind_start], place >> 32
    kind_seed = seed[kind_start]
    same = kind_seed[1:] == kind_seed[:-1]  # sorted by seed
    several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    if not len(several):
        return
    begin = offsets[kind_start[several]]
    (hold, hold_at, hold_size), (ask, ask_at, ask_size) = alike(data, begin, offsets[kind_start[several] + 1] - begin, least[several])
    if not len(ask):
        return
    text, starts = _gather(data, begin[hold] + hold_at, hold_size, True)
    index = RunIndex(text, starts, least[several[hold]], LENGTH)
    body, starts = _gather(data, begin[ask] + ask_at, ask_size, False)
    pattern, offset = index.long_matches(body, starts, ask_size, least[several[ask]])
    if not len(pattern):
        return
    # ranges of a kind, for each of its rows
    hit_kind, offset = several[ask[pattern]], offset + ask_at[pattern]
    by = np.lexsort((offset, hit_kind))
    hit_kind, offset = hit_kind[by], offset[by]
    new = np.concatenate(([True], (hit_kind[1:] != hit_kind[:-1]) | (offset[1:] > offset[:-1] + LENGTH)))
    size = (offset[np.append(np.flatnonzero(new)[1:], len(offset)) - 1] - offset[new]) + LENGTH
    hit_kind, offset = hit_kind[new], offset[new]
    own = np.arange(len(doc))
    lo, hi = np.searchsorted(hit_kind, kind), np.searchsorted(hit_kind, kind, side="right")
    row = np.repeat(own, hi - lo)
    hit = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    first = start[row] + offset[hit]
    yield _found(doc[row], place[row], first, first + size[hit])


def earliest(b: pa.RecordBatch, last: tuple[pa.RecordBatch, int] | None) -> tuple[pa.RecordBatch, pa.RecordBatch, tuple[pa.RecordBatch, int]]:
    """Of rows sorted by seed, whole and document: the ranges of those that an earlier document has as a whole, the other
    rows, and the last row with the earliest document of its kind. last: that of the rows before."""
    seed, whole, doc, place, offsets, data = _rows([last[0], b] if last else [b])
    new = kinds(seed, whole, offsets, data)
    least = doc[new]
    if last:
        least[0] = last[1]
    least = least[np.cumsum(new) - 1]
    copy, start = doc > least, place >> 32
    if last:
        copy[0] = False
    gone = copy[1:] if last else copy
    return _found(doc[copy], place[copy], start[copy], (start + np.diff(offsets))[copy]), b.filter(pa.array(~gone)), (b.slice(b.num_rows - 1), int(least[-1]))


def _deferred(b: pa.RecordBatch) -> pa.RecordBatch:
    place = b.column("place").to_numpy()
    start = place >> 32
    return _found(b.column("doc_id").to_numpy(), place, start, start + pc.binary_length(b.column("bytes")).to_numpy(), b.column("bytes"))


def matched(sorted_segments: DataFrame, most: int = MOST_SEGMENTS, index_bytes: int = INDEX_BYTES, final: bool = False) -> DataFrame:
    """Removed ranges, from rows sorted by seed, whole and document; segments of seeds with too many come back with bytes.

    Copies of a whole segment leave as they come; held are the rows of each kind's earliest document, of up to `most` rows
    a seed. final: seeds are hashes of whole windows, so that copies are all that there is to find.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit, hot, last = 0, index_bytes, None, None
        for b in batches:
            known = pc.is_null(b.column("bytes"))
            done, b = b.filter(known), b.filter(pc.invert(known))
            if done.num_rows:
                place = done.column("place").to_numpy()
                yield _found(done.column("doc_id").to_numpy(), place, place >> 32, (place >> 32) + done.column("whole").to_numpy())
            if not b.num_rows:
                continue
            out, b, last = earliest(b, last)
            if out.num_rows:
                yield out
            if final or not b.num_rows:
                continue
            if hot is not None:  # a seed with too many segments goes on
                n = int(np.searchsorted(b.column("seed").to_numpy(), hot, side="right"))
                if n:
                    yield _deferred(b.slice(0, n))
                if n == b.num_rows:
                    continue
                hot, b = None, b.slice(n)
            held.append(b)
            size += b.column("bytes").nbytes
            if size < limit:
                continue
            joined = pa.Table.from_batches(held).combine_chunks()
            seed = joined.column("seed").to_numpy()
            cut = int(np.searchsorted(seed, seed[-1]))
            if cut:
                yield from match(_rows(joined.slice(0, cut).to_batches()))
            rest = joined.slice(cut)
            if rest.num_rows > most:
                yield from map(_deferred, rest.to_batches())
                hot, held, size, limit = seed[-1], [], 0, index_bytes
            else:
                held, size = rest.to_batches(), 0
                limit = max(index_bytes, rest.column("bytes").nbytes)  # a seed that goes on is looked at again when it has doubled
        if held:
            yield from match(_rows(held))

    return sorted_segments.mapInArrow(run, FOUND)


def remove_repeats(docs: DataFrame, most: int = MOST_SEGMENTS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, text, n_bytes long, n_removed long, n_spans long, kept binary: one row for each row of docs (doc_id long, text).

    Each byte goes that a LENGTH-byte string covers which also starts in a text of a smaller doc_id; matches are judged
    on the input, within texts, in UTF-8 bytes. n_spans counts maximal removed runs. Null texts are empty. Rows of one
    doc_id are not earlier than one another; a row without doc_id loses nothing and takes nothing from others. An empty
    table gives an empty result. Bytes are compared but for copies in one task, of whole segments by two 64-bit hashes and
    of whole texts by MD5.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    real = docs.where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    copies = written(later_copies(real), "copies")
    gone = copies.groupBy("doc_id").agg(F.collect_set("place").alias("gone"))
    first = real.withColumn("mark", mark_of("text")).join(gone, "doc_id", "left").where(NOT_GONE).select("doc_id", "text")
    shared = written(shared_seeds(first).join(gone, "doc_id", "left"), "seeds")
    ranges, todo = copies, segments(real, shared)
    for gram in GRAMS:
        dealt = todo.repartition("seed").sortWithinPartitions("seed", "whole", "doc_id")
        found = written(matched(dealt, most, index_bytes, gram == LENGTH), "ranges")
        ranges = ranges.unionByName(found.where("bytes is null").drop("bytes"))
        deferred = found.where("bytes is not null")
        if gram == LENGTH or deferred.isEmpty():
            break
        todo = finer(deferred, GRAMS[GRAMS.index(gram) + 1])
    discard(shared)
    by_doc = ranges.groupBy("doc_id", "place").agg(F.collect_list(F.struct("start", "end")).alias("ranges")).withColumnRenamed("doc_id", "_d").withColumnRenamed("place", "_p")
    joined = docs.withColumn("_mark", mark_of("text")).join(by_doc, (F.col("doc_id") == F.col("_d")) & (F.col("_mark") == F.col("_p")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [removed(t.as_py().encode(), r) for t, r in zip(b.column("text"), _ranges(b.column("ranges")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary")


def _ranges(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The (start, end) rows of each list; None for null."""
    flat = column.flatten()
    pairs = np.column_stack((flat.field(0).to_numpy(), flat.field(1).to_numpy())) if len(flat) else np.zeros((0, 2), np.int64)
    at = 0
    for n in (len(x) if x.is_valid else None for x in column):
        yield None if n is None else pairs[at : at + n]
        at += n or 0


def removed(text: bytes, ranges: np.ndarray | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, runs, kept bytes) of a text without these ranges, which may overlap."""
    if ranges is None or not len(ranges):
        return len(text), 0, 0, text
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    starts, ends = ranges[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True))
    return len(text), len(text) - len(kept), len(starts), kept


def op8_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of earlier ones."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
w AS (SELECT doc_id, s, substr(t, 2 * s + 1, 100) AS g FROM (SELECT doc_id, t, unnest(generate_series(0, len(t) // 2 - 50)) AS s FROM d WHERE len(t) >= 100)),
f AS (SELECT g, min(doc_id) AS f FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT doc_id, s FROM w JOIN f USING (g) WHERE doc_id > f),
n AS (SELECT doc_id, s, max(s + 50) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
r AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM n),
x AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM r GROUP BY doc_id, k),
y AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS prior FROM x),
z AS (SELECT y.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
        string_agg(substr(t, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY k) || substr(any_value(t), 2 * max(b) + 1) AS kept FROM y JOIN d ON y.doc_id = d.doc_id GROUP BY y.doc_id)
SELECT d.doc_id, CAST(len(d.t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, d.t))) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""
