"""A hidden Markov language model: states trained by Baum-Welch over all training texts, likelihoods by the scaled forward recursion.

States emit word classes. The most frequent words are classes of their own, all others share classes by their ending; a
word of a shared class has its add-one share of the class, so that the probabilities of all texts sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import LOWER, SPACE, Lexicon, discard, learnable, mix64, pieces, runs, span_hashes, span_strings, table, written

#: Words with a class of their own, classes that all others share, and words whose counts go to every task.
OWN, SHARED, KNOWN = 1 << 14, 1 << 11, 1 << 18
STATES, ROUNDS = 8, 5
#: Tokens of one training sequence at most: a longer text is cut, and has a start vector of its own for the later parts.
CUT = 256
#: Tokens worked on at once.
BATCH = 1 << 19
#: Weight of the class's overall share in a state's emissions, in tokens, and of an even share in its moves.
PRIOR, MOVES = 200.0, 1.0

END = 0  # the class of the token that ends a text


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(~SPACE[data])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c long) over all texts of the one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, _ in pieces(batch.column(0)):
                data = LOWER[data]
                starts, ends = spans(data)
                _, first, count = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([span_strings(data, starts[first], ends[first]), pa.array(count, pa.int64())], names=["word", "c"])

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shared class of each word, from its last three bytes."""
    code = np.zeros(len(starts), dtype=np.uint64)
    for back in range(1, 4):
        inside = ends - back >= starts
        code = code * np.uint64(257) + np.where(inside, data[np.where(inside, ends - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix64(code + np.uint64(1)) % np.uint64(SHARED)).astype(np.int64)


@dataclass
class Vocabulary:
    """What tasks need to know of the training corpus. Its size is bounded by OWN, SHARED and KNOWN."""

    words: list[bytes]  # the most frequent first
    counts: np.ndarray  # of each
    own: int  # so many of them are classes of their own
    texts: int  # the end token's count
    tokens: int
    distinct: int
    shared: np.ndarray  # tokens + distinct words + 1 of each shared class

    @property
    def classes(self) -> int:
        return 1 + self.own + len(self.shared)

    def class_counts(self) -> np.ndarray:
        return np.concatenate(([self.texts], self.counts[: self.own], self.shared)).astype(np.float64)


def vocabulary(counted: DataFrame, texts: int, own: int = OWN, known: int = KNOWN) -> Vocabulary:
    """counted: (word, c), every distinct word of the training texts."""
    tokens, distinct = counted.select(F.coalesce(F.sum("c"), F.lit(0).cast("long")), F.count(F.lit(1))).first()
    top = counted.orderBy(F.desc("c"), "word").limit(known).toArrow()
    words = [w.encode() for w in top.column("word").to_pylist()]
    own = min(own, len(words))
    alone = counted.sparkSession.sparkContext.broadcast(words[:own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, total = Lexicon(alone.value), np.zeros((SHARED, 2), dtype=np.int64)
        for batch in batches:
            row = 0
            for _, data, bounds in pieces(batch.column(0)):
                starts, ends = bounds[:-1], bounds[1:] - 1
                c = batch.column(1).to_numpy()[row : row + len(starts)]
                row += len(starts)
                other = lexicon.find(data, starts, ends) < 0
                ending = endings(data, starts[other], ends[other])
                total += np.stack([np.bincount(ending, weight, SHARED).astype(np.int64) for weight in (c[other], None)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(total.sum(axis=1))], names=["ending", "n"])

    shared = np.ones(SHARED, dtype=np.int64)
    for row in counted.select("word", "c").mapInArrow(run, "ending long, n long").groupBy("ending").agg(F.sum("n").alias("n")).collect():
        shared[row["ending"]] += row["n"]
    return Vocabulary(words, top.column("c").to_numpy().astype(np.int64), own, texts, tokens + texts, distinct + (texts > 0), shared)


def encoded(docs: DataFrame, vocab: Broadcast) -> DataFrame:
    """docs: _row, _doc, learn, text. Adds n long (tokens), classes array<int>, n_known and the log10 of (count + 1), summed over
    words of own classes (own_log) and other known ones (shared_log), and the words that are not known here with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        lexicon, log = Lexicon(v.words), np.log10(v.counts + 1.0)
        for batch in batches:
            for row, data, bounds in pieces(batch.column("text")):
                data, count = LOWER[data], len(bounds) - 1
                starts, ends = spans(data)
                of = np.searchsorted(bounds, starts, side="right") - 1
                hashes = span_hashes(data, starts, ends)
                number = lexicon.find(data, starts, ends, hashes)
                own = (number >= 0) & (number < v.own)
                kind = np.where(own, number + 1, 0)
                kind[~own] = 1 + v.own + endings(data, starts[~own], ends[~own])
                each = np.where(number >= 0, log[number], 0.0) if len(log) else np.zeros(len(of))
                n = np.bincount(of, minlength=count)
                at = np.zeros(count + 1, dtype=np.int64)
                np.cumsum(n + 1, out=at[1:])
                classes = np.full(int(at[-1]), END, dtype=np.int32)
                inner = np.ones(len(classes), dtype=bool)
                inner[at[1:] - 1] = False
                classes[inner] = kind
                rare = np.flatnonzero(number < 0)
                order = rare[np.lexsort((hashes[rare], of[rare]))]
                new = np.flatnonzero(np.diff(of[order], prepend=-1) | (np.diff(hashes[order], prepend=hashes[order[:1]]) != 0)) if len(order) else order
                times, first = np.diff(np.append(new, len(order))), order[new]
                parts = pa.array(np.searchsorted(of[first], np.arange(count + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row, count) for c in ("_row", "_doc", "learn")), pa.array(n + 1, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(classes)),
                        pa.array(np.bincount(of, number >= 0, count).astype(np.int64)), pa.array(np.bincount(of, each * own, count)), pa.array(np.bincount(of, each * ~own, count)),
                        pa.ListArray.from_arrays(parts, span_strings(data, starts[first], ends[first])), pa.ListArray.from_arrays(parts, pa.array(times, pa.int32())),
                    ],
                    names=["_row", "_doc", "learn", "n", "classes", "n_known", "own_log", "shared_log", "rare", "rare_n"],
                )

    schema = f"_row long, _doc {docs.schema['_doc'].dataType.simpleString()}, learn boolean, n long, classes array<int>, n_known long, own_log double, shared_log double, rare array<string>, rare_n array<int>"
    return docs.select("_row", "_doc", "learn", "text").mapInArrow(run, schema)


def side_by_side(classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, as a matrix (step, sequence), and how many go on at each step."""
    steps = np.arange(int(length[0]))
    seen = steps[:, None] < length[None, :]
    return np.where(seen, classes[np.where(seen, start[None, :] + steps[:, None], 0)], END), seen.sum(axis=1)


def batches_of(length: np.ndarray, most: int = BATCH) -> Iterator[np.ndarray]:
    """Sequence numbers, longest first, in batches whose matrix has up to `most` cells, or one sequence."""
    order = np.argsort(-length, kind="stable")
    k = 0
    while k < len(order):
        end = k + max(1, most // max(int(length[order[k]]), 1))
        yield order[k:end]
        k = end


@dataclass
class Model:
    """First states of texts and of later parts, moves (from, to), and emissions (class, state)."""

    first: np.ndarray
    later: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def new(cls, counts: np.ndarray, states: int = STATES, seed: int = 7) -> "Model":
        """States that tend to stay, with emissions near the overall ones."""
        rng = np.random.default_rng(seed)
        emits = counts[:, None] * np.exp(rng.normal(size=(len(counts), states)))
        moves = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
        even = np.full(states, 1 / states)
        return cls(even, even, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))

    def log10(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 of each sequence's probability, by forward steps that are scaled to sum to one."""
        out = np.zeros(len(start))
        for rows in batches_of(length):
            seen, active = side_by_side(classes, start[rows], length[rows])
            total, x = np.zeros(len(rows)), np.broadcast_to(self.first, (len(rows), len(self.first)))
            for t, a in enumerate(active.tolist()):
                x = (x if t == 0 else x[:a] @ self.moves) * self.emits[seen[t, :a]]
                scale = x.sum(axis=1)
                x /= scale[:, None]
                total[:a] += np.log10(scale)
            out[rows] = total
        return out

    def expected(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, begins: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, of later parts' first states and of moves, and the log-likelihood; emissions are added to `emitted`."""
        states = len(self.first)
        first, later, moved, likelihood = np.zeros(states), np.zeros(states), np.zeros((states, states)), 0.0
        A, E = self.moves.astype(np.float32), self.emits.astype(np.float32)
        for rows in batches_of(length):
            seen, active = side_by_side(classes, start[rows], length[rows])
            active = active.tolist()
            x = np.where(begins[rows][:, None], self.first, self.later).astype(np.float32)
            ahead, scaled = [], []
            for t, a in enumerate(active):
                emit = E[seen[t, :a]]
                x = (x if t == 0 else x[:a] @ A) * emit
                scale = x.sum(axis=1, keepdims=True)
                x /= scale
                likelihood += float(np.log(scale).sum(dtype=np.float64))
                emit /= scale
                ahead.append(x)
                scaled.append(emit)
            back, share = np.ones((active[-1], states), np.float32), [np.zeros(0)] * len(active)
            for t in range(len(active) - 1, -1, -1):
                a = active[t]
                if a > len(back):
                    back = np.concatenate((back, np.ones((a - len(back), states), np.float32)))  # texts that end here
                share[t] = ahead[t] * back
                if t:
                    w = scaled[t] * back
                    moved += ahead[t - 1][:a].T @ w
                    back = w @ A.T
            own = begins[rows]
            first += share[0][own].sum(axis=0, dtype=np.float64)
            later += share[0][~own].sum(axis=0, dtype=np.float64)
            at, share = np.concatenate([seen[t, :a] for t, a in enumerate(active)]), np.concatenate(share)
            for k in range(states):
                emitted[:, k] += np.bincount(at, share[:, k], len(emitted))
        return first, later, moved * A, likelihood


def cut(offsets: np.ndarray, most: int = CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, end to end, in parts of up to `most` tokens: (start, length, whether a text begins there)."""
    length = np.diff(offsets)
    parts = -(-length // most)
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(offsets[:-1], parts) + step * most, np.minimum(most, np.repeat(length, parts) - step * most), step == 0


def gather_counts(texts: DataFrame, model: Model) -> tuple[dict[str, np.ndarray], float]:
    """One round's expected counts over all texts (classes array<int>), and the log-likelihood. Tasks send a row for each
    class that they saw; rows of negative class carry the other counts."""
    sent, states = texts.sparkSession.sparkContext.broadcast(model), len(model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        emitted, likelihood = np.zeros_like(m.emits), 0.0
        first, later, moved = np.zeros(states), np.zeros(states), np.zeros((states, states))
        for batch in batches:
            column = batch.column(0)
            offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
            if len(offsets) < 2:
                continue
            f, g, mv, gain = m.expected(values, *cut(offsets), emitted)
            first, later, moved, likelihood = first + f, later + g, moved + mv, likelihood + gain
        used = np.flatnonzero(emitted.any(axis=1))
        rest = np.vstack([first, later, np.full(states, likelihood / states), moved])
        rows = np.vstack([rest, emitted[used]])
        number = np.concatenate((-1 - np.arange(len(rest)), used))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *(pa.array(rows[:, k]) for k in range(states))], names=["class", *(f"s{k}" for k in range(states))])

    schema = "class int, " + ", ".join(f"s{k} double" for k in range(states))
    got = texts.select("classes").mapInArrow(run, schema).groupBy("class").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toArrow()
    sent.destroy()
    number, rows = got.column("class").to_numpy(), np.stack([got.column(f"s{k}").to_numpy() for k in range(states)], axis=1)
    counts = {"rest": np.zeros((3 + states, states)), "emits": np.zeros_like(model.emits)}
    counts["emits"][number[number >= 0]] = rows[number >= 0]
    counts["rest"][-1 - number[number < 0]] = rows[number < 0]
    return counts, float(counts["rest"][2].sum())


def updated(counts: dict[str, np.ndarray], overall: np.ndarray) -> Model:
    """The model that the expected counts make likeliest, with some weight on the overall shares."""
    rest, even = counts["rest"], lambda x: (x + MOVES) / (x + MOVES).sum(axis=-1, keepdims=True)
    emits = counts["emits"] + PRIOR * (overall / overall.sum())[:, None]
    return Model(even(rest[0]), even(rest[1]), even(rest[3:]), emits / emits.sum(axis=0))


def train(texts: DataFrame, overall: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after `rounds` rounds over all texts, and the log-likelihood before each."""
    model, seen = Model.new(overall, states), []
    for _ in range(rounds):
        counts, likelihood = gather_counts(texts, model)
        seen.append(likelihood)
        model = updated(counts, overall)
    return model, seen


def likelihoods(texts: DataFrame, model: Model, vocab: Broadcast) -> DataFrame:
    """_row, _doc, n, n_known, own_log, shared_log and score double: the classes' log10 probability less the log10 of the size of
    each shared class."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    kept = ["_row", "_doc", "learn", "n", "n_known", "own_log", "shared_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        size = np.concatenate((np.zeros(1 + v.own), np.log10(v.shared)))
        for batch in batches:
            if batch.num_rows:
                column = batch.column("classes")
                offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
                score = sent.value.log10(values, offsets[:-1], np.diff(offsets)) - np.add.reduceat(size[values[: offsets[-1]]], offsets[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    return texts.select(*kept, "classes").mapInArrow(run, texts.select(*kept).schema.add("score", "double"))


def score_texts(docs: DataFrame, doc: str, text: str, learn, states: int = STATES, rounds: int = ROUNDS, own: int = OWN, known: int = KNOWN) -> DataFrame:
    """doc, n_tokens, n_known, train_tokens long, base_score, score double of each row; learn: Column, the rows to learn from.

    Null and empty texts have the end token alone. Every row is a text of its own, repeated ones too; rows where learn is
    null are not learned from. Without any training text V and N are 0, so the base score of each token is 0, and the model
    knows one shared class by ending only. Other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("_doc"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    counted = written(word_counts(rows.where("learn").select("text")), "vocabulary")
    vocab = vocabulary(counted, rows.where("learn").count(), own, known)
    sent = spark.sparkContext.broadcast(vocab)
    texts = written(encoded(rows, sent).sortWithinPartitions("n"), "texts")
    model, _ = train(texts.where("learn"), vocab.class_counts(), states, rounds)
    # words that the tasks did not know are looked up in the whole vocabulary
    least = int(vocab.counts[-1]) if len(vocab.counts) >= known else -1
    rare = texts.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("_row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    others = counted.where(F.col("c") <= least).select(F.col("word").alias("_w"), "c")
    looked = rare.join(others, F.col("word") == F.col("_w"), "left").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0).cast("long")) + 1.0)).alias("rare_log"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times"))), F.lit(0)).cast("long").alias("rare_known")
    ).withColumnRenamed("_row", "_r")
    scores = likelihoods(texts, model, sent).join(looked, F.col("_row") == F.col("_r"), "left")
    rare_log, end_log = F.coalesce("rare_log", F.lit(0.0)), F.lit(float(np.log10(vocab.texts + 1.0)))
    base = F.col("own_log") + F.col("shared_log") + rare_log + end_log - F.col("n") * F.lit(float(np.log10(vocab.tokens + vocab.distinct + 1.0)))
    return scores.select(
        F.col("_doc").alias(doc), F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("rare_known", F.lit(0).cast("long")) + F.lit(int(vocab.texts > 0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.col("shared_log") + rare_log).alias("score"),
    )


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by what those outside the fold crc32(doc_id) mod 7 = 2 teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    may, held_out = learnable(F.col("doc_id"), 7, 2)
    return score_texts(docs, "doc_id", "text", may).withColumn("held_out", learnable(F.col("doc_id"), 7, 2)[1]).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
