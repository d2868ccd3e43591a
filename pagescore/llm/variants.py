"""Spelling variants: words one edit apart, found by equal bands of their letter-parity masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import ascii_lower, discard, mix64, table, written

SHORTEST, LEAST_COUNT, TIMES = 7, 2, 10
#: One run of letters in so many loses a letter before it is counted.
SLIPS = 31
#: Words of a key in one block; keys with more words are compared a pair of blocks at a time.
BLOCK = 4096
#: Pairs compared at once, and the width of the matrix in which short words are compared.
PAIRS, WIDTH = 1 << 21, 32

#: Letters are Latin-1 bytes here; a band has so many bits of the mask.
BAND_BITS = 21
#: Keys of a word: one for each band, and one for each two of them.
KINDS = 6


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without the letter that the CRC-32 of `<doc_id>:<run>` picks where SLIPS divides it. A null id counts as no text."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted_words(docs: DataFrame, doc: str, text: str, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n long): words of at least `shortest` letters that occur `least` times. Runs of fewer letters make no such word."""
    runs = docs.select(F.col(doc).alias("_doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]{%d,}" % shortest), F.lit(0))).alias("_run"))
    words = runs.select("_doc", ascii_lower(F.col("_run")).alias("_run")).select(slipped(F.col("_doc"), F.col("_run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


@dataclass(frozen=True)
class Letters:
    """Each letter's band and its bit in the mask. The bands have about equal shares of all letters; letters that share a
    bit, where a band has more than BAND_BITS, keep the bound of two flips."""

    band: np.ndarray
    bit: np.ndarray

    @classmethod
    def shared_out(cls, counts: np.ndarray) -> "Letters":
        band, bit, load, used = np.zeros(256, np.int64), np.zeros(256, np.uint64), [0, 0, 0], [0, 0, 0]
        for letter in np.argsort(-counts, kind="stable").tolist():
            own = load.index(min(load))
            band[letter], bit[letter] = own, BAND_BITS * own + used[own] % BAND_BITS
            load[own] += int(counts[letter]) or 1
            used[own] += 1
        return cls(band, bit)


class Words:
    """Words of a batch as Latin-1 bytes, a letter each, with their parity masks and the keys under which they meet.

    A letter replaced changes the counts of two letters, so at most two bits of the mask, and leaves one band of the three
    as it was; a letter put in changes one count, and leaves two bands. The letters of such a band are then the same
    too, in the same order, and at the same places where a letter is replaced. So a key holds the bits of its bands and
    these letters: it is finer than the bits alone, and loses no pair.
    """

    def __init__(self, column: pa.Array, letters: Letters) -> None:
        self.words = [w.encode("latin-1") for w in column.to_pylist()]
        self.letters = letters
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        self.mask = np.bitwise_xor.reduceat(np.uint64(1) << letters.bit[self.data], self.start) if len(self.words) else np.zeros(0, np.uint64)

    def _summed(self, values: np.ndarray) -> np.ndarray:
        """Sums of the letters' values by word, modulo 2**64."""
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return upto[self.start + self.length] - upto[self.start]

    def keys(self) -> np.ndarray:
        """(KINDS, word): kind b is that of words of one length that agree in band b, kind 3 + b of those that agree in all others."""
        out = np.zeros((KINDS, len(self.words)), dtype=np.uint64)
        band, code = self.letters.band[self.data], self.data.astype(np.uint64)
        place = np.arange(len(self.data)) - np.repeat(self.start, self.length)
        for b in range(3):
            own = np.where(band == b, mix64(code + place.astype(np.uint64) * np.uint64(256) + np.uint64(1)), np.uint64(0))
            bits = self.mask & np.uint64(((1 << BAND_BITS) - 1) << (BAND_BITS * b))
            out[b] = mix64(self._summed(own) ^ mix64(bits + self.length.astype(np.uint64)))
            others = band != b
            before = np.concatenate(([0], np.cumsum(others)))
            rank = before[:-1] - np.repeat(before[self.start], self.length)  # the letter's number among those of its bands
            rest = np.where(others, mix64(code + rank.astype(np.uint64) * np.uint64(256) + np.uint64(2)), np.uint64(0))
            out[3 + b] = mix64(self._summed(rest) ^ mix64(self.mask & ~np.uint64(((1 << BAND_BITS) - 1) << (BAND_BITS * b))))
        return out

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether distinct words a and b, as long as a or a letter longer, differ by one edit: what they share in front and
        at the end leaves one letter of b at most."""
        la, lb = self.length[a], self.length[b]
        out = np.zeros(len(a), dtype=bool)
        short = np.flatnonzero(lb <= WIDTH)
        if len(short):
            width = int(lb[short].max())
            step = np.arange(width)
            sa, sb, la, lb = self.start[a[short]], self.start[b[short]], la[short], lb[short]
            last = len(self.data) - 1
            inside = step[None, :] < la[:, None]
            front = (self.data[np.minimum(sa[:, None] + step, last)] == self.data[np.minimum(sb[:, None] + step, last)]) & inside
            back = (self.data[np.maximum((sa + la)[:, None] - 1 - step, 0)] == self.data[np.maximum((sb + lb)[:, None] - 1 - step, 0)]) & inside
            count = lambda m: np.where(m.all(axis=1), width, np.argmin(m, axis=1))
            out[short] = count(front) + count(back) >= lb - 1
        for k in np.flatnonzero(self.length[b] > WIDTH).tolist():
            x, y = self.words[a[k]], self.words[b[k]]
            xs, ys = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            differ = np.flatnonzero(xs != ys[: len(xs)])
            p = int(differ[0]) if len(differ) else len(xs)
            out[k] = x[p + (len(x) == len(y)) :] == y[p + 1 :]
        return out


def near_pairs(words: Words, keys: np.ndarray, kind: np.ndarray, group: np.ndarray, block: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that are one edit apart, each once. Rows are ordered by group and length."""
    n = len(words.words)
    code = group * (int(words.length.max()) + 2) + words.length
    longer = kind >= 3  # the second is a letter longer there; else all of a group are as long
    first = np.where(longer, np.searchsorted(code, code + 1), np.arange(1, n + 1))
    many = np.searchsorted(code, code + longer, side="right") - first
    upto = np.cumsum(many)
    row = 0
    while row < n:
        before = int(upto[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        own = many[row:end]
        a = np.repeat(np.arange(row, end), own)
        b = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + first[a]
        keep = (np.bitwise_count(words.mask[a] ^ words.mask[b]) <= 2) & (~crossed[a] | (block[a] != block[b]))
        for k in range(2):  # two words that agree in an earlier band met there
            keep &= (kind[a] <= k) | longer[a] | (keys[k][a] != keys[k][b])
        a, b = a[keep], b[keep]
        keep = words.one_edit(a, b)
        yield a[keep], b[keep]
        row = end


def letter_counts(words: DataFrame) -> np.ndarray:
    """How often each letter stands in the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["letter", "n"])

    out = np.zeros(256, np.int64)
    for row in words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        out[row["letter"]] = row["n"]
    return out


def keyed(words: DataFrame, letters: Letters) -> DataFrame:
    """(kind, key, word, n): each word under its KINDS keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = Words(batch.column(0), letters).keys().view(np.int64)
                for kind in range(KINDS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, kind), pa.int32()), pa.array(keys[kind]), *batch.columns], names=["kind", "key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "kind int, key long, word string, n long")


CELL = ("kind", "key", "lo", "hi")


def best_of(batches: Iterator[pa.RecordBatch], letters: Letters) -> Iterator[pa.RecordBatch]:
    """Rows (CELL, block, length, word, n), in this order: of the words with a near one, how many near words and the best."""
    held: list[pa.RecordBatch] = []  # the last cell's rows so far; it may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in CELL):
            yield from _near(pa.Table.from_batches(held), letters)
            held = []
        same = np.logical_and.reduce([(v := batch.column(c).to_numpy()) == v[-1] for c in CELL])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from _near(pa.Table.from_batches([*held, batch.slice(0, cut)]), letters)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _near(pa.Table.from_batches(held), letters)


def _near(rows: pa.Table, letters: Letters) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    col = lambda name: rows.column(name).to_numpy()
    kind, key, lo, hi, n = (col(c) for c in (*CELL, "n"))
    change = np.zeros(len(kind), dtype=bool)
    for c in (kind, key, lo, hi):
        change[1:] |= c[1:] != c[:-1]
    words = Words(rows.column("word"), letters)
    found = list(near_pairs(words, words.keys(), kind, np.cumsum(change), col("block"), lo != hi))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    if not len(a):
        return
    left, right = np.concatenate((a, b)), np.concatenate((b, a))
    used = np.unique(right)
    rank = np.zeros(len(n), dtype=np.int64)
    rank[sorted(used.tolist(), key=words.words.__getitem__)] = np.arange(len(used))
    order = np.lexsort((rank[right], -n[right], left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.diff(left, prepend=-1))
    column = rows.column("word").combine_chunks()
    best = pa.StructArray.from_arrays([pa.array(-n[right[first]]), column.take(pa.array(right[first]))], names=["less", "word"])
    yield pa.RecordBatch.from_arrays([column.take(pa.array(left[first])), pa.array(np.diff(np.append(first, len(left)))), best], names=["word", "near", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near long, best struct<less, word>): each word with a near one, the near words' number and the one of greatest n.

    words: (word string, n long), distinct words of letters up to U+00FF. A key with more than BLOCK words is cut into
    blocks by hash, and each pair of blocks is a cell of its own.
    """
    letters = Letters.shared_out(letter_counts(words))
    rows = keyed(words, letters)
    large = rows.groupBy("kind", "key").count().where(F.col("count") > BLOCK).select(F.col("kind").alias("_b"), F.col("key").alias("_k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("_m"))
    dealt = rows.join(large, (F.col("kind") == F.col("_b")) & (F.col("key") == F.col("_k")), "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("_m")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    cells = dealt.select("kind", "key", F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi"), "block", F.char_length("word").alias("length"), "word", "n")
    found = cells.repartition(*CELL).sortWithinPartitions(*CELL, "length").mapInArrow(lambda batches: best_of(batches, letters), "word string, near long, best struct<less: long, word: string>")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of (word, form): the last of the forms that follow one another. They may not go in a circle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps taken
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        seen = Observation()
        joined = now.join(ahead, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        before, now = now, written(joined.observe(seen, F.sum(F.col("_moved").cast("long")).alias("moved")).drop("_moved"), "roots")
        discard(before)
        if not seen.get["moved"]:
            return now


def spelling_variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): frequent words with the near word that each is likely a slip of.

    Null and empty texts have no words; every row counts, repeated ones too; a null id counts as empty in the CRC. A
    run of letters of any length is one word. Of near words of equal n the first in code-point order is the form. Other
    columns of docs play no part, whatever their names. Without words the result is empty.
    """
    words = written(counted_words(docs, doc, text), "words")
    near = near_words(words).withColumnRenamed("word", "_w")
    likely = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    out = words.join(near, F.col("word") == F.col("_w"), "left").withColumn("_best", likely)
    out = written(out.select("word", F.col("_best.word").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("_best.less")).alias("form_n")), "variants")
    discard(words)
    last = roots(out.where("form is not null")).withColumnRenamed("word", "_w")
    return out.join(last, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_parity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The CRC-32 table is made from its polynomial, 0xEDB88320; bytes are read from hexadecimal.
OP11_SQL = r"""
WITH RECURSIVE bit AS (SELECT i, 0 AS k, CAST(i AS UINTEGER) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS UINTEGER) ELSE CAST(0 AS UINTEGER) END) FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
each AS (SELECT d, r, count(*) AS n, hex(encode(d || ':' || r)) AS x FROM runs WHERE length(r) >= 7 GROUP BY d, r),
crc AS (SELECT d, r, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda k: CAST(instr('0123456789ABCDEF', x[2 * k + 1]) * 16 + instr('0123456789ABCDEF', x[2 * k + 2]) - 17 AS UINTEGER))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UINTEGER)) AS h FROM each, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN r[:CAST(h % length(r) AS BIGINT)] || r[CAST(h % length(r) AS BIGINT) + 2:] ELSE r END AS word, n FROM crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gap AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS g FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.g = b.g AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM gap a JOIN v ON a.g = v.word
  UNION SELECT v.word, a.word, a.n FROM gap a JOIN v ON a.g = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min({'w': other, 'n': n}, {'m': -n, 'w': other}) AS b FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.b.n >= 10 * v.n THEN best.b.w END AS form, CASE WHEN best.b.n >= 10 * v.n THEN best.b.n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
up AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.nxt = f.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.nxt IS NULL
"""
