"""Reading tables, shared scratch space, and byte-level text helpers for numpy tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs in one local
    process, as in tests, a new folder of our own; elsewhere an error, as a machine's own disk would not be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them back. The shuffle files of the query,
    which nothing reads again, go when it ends. The table stays until `discard`, or until its folder is cleared."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What lower() may change beside A-Z, characters that only a newer Unicode knows included.
_OTHER_UPPER = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}\p{Cn}]]"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay. translate() looks up each character, so only texts go through it that lower() would
    change beside A-Z."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def unsigned_crc32(value: Column) -> Column:
    """CRC-32 of a string's UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.encode(F.coalesce(value, F.lit("")), "utf-8"))


def learnable(doc_id: Column, modulus: int, held: int) -> tuple[Column, Column]:
    """(rows whose labels may be learned, rows held out), by the CRC-32 of doc_id as text. A null doc_id is neither."""
    fold = F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus
    held_out = F.coalesce(fold == held, F.lit(False))
    return F.coalesce(fold != held, F.lit(False)), held_out


# --- numpy side -------------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[base] = np.multiply.accumulate(grown, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over prefix sums, shifted to its start and mixed with its length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(data))[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow string column, some rows at a time: (first row, their bytes, their offsets).

    A piece holds up to `most` bytes, or one longer text. Every text is followed by one space, which is not part
    of it, so that no token spans two texts. A null is an empty text.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        own = bounds[first : last + 1]
        sizes = np.diff(own)
        at = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        data = np.full(int(at[-1]), 32, dtype=np.uint8)
        here = np.ones(len(data), dtype=bool)
        here[at[1:] - 1] = False
        data[here] = body[own[0] : own[-1]]
        yield first, data, at
        first = last



def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans end to end, and their offsets."""
    length = ends - starts
    offsets = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    return data[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], length)], offsets


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    body, offsets = gathered(data, starts, ends)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.string())


class Lexicon:
    """Distinct words, none empty, numbered in the order given; finds the numbers of the byte spans of a text.

    A span is told by its length, its first and last eight bytes and a 64-bit hash, so words of up to 16 bytes exactly.
    """

    def __init__(self, words: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        ends = np.cumsum(np.array([len(w) + 1 for w in words], dtype=np.int64)) - 1
        starts = ends - np.array([len(w) for w in words], dtype=np.int64)
        hashes = span_hashes(data, starts, ends)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]
        self.marks = [m[self.number] for m in self._marks(data, starts, ends)]
        self.alike = int(np.unique(hashes, return_counts=True)[1].max()) if words else 0

    def __len__(self) -> int:
        return len(self.number)

    @staticmethod
    def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        length = ends - starts
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        keep = np.minimum(length, 8)
        unused = ((8 - keep) * 8).astype(np.uint64)
        return [length, at[starts] << unused, at[ends - keep] << unused]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """The number of each span's word, -1 for other spans."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(starts) or not len(self):
            return out
        hashes = span_hashes(data, starts, ends) if hashes is None else hashes
        marks = self._marks(data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        for step in range(self.alike):
            here = np.minimum(at + step, len(self) - 1)
            same = self.hashes[here] == hashes
            for own, mark in zip(self.marks, marks, strict=True):
                same &= own[here] == mark
            out[same] = self.number[here[same]]
        return out
