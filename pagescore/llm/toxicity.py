"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import LOWER, learnable, mix64, pieces, runs, span_hashes, table
from pagescore.llm.quality import _CLASS, sample, scored

#: Most labelled rows that the network is fitted on, the first in order of their doc_id's hash.
SAMPLE_ROWS = 3000
#: Words of a window and from one window's start to the next: every word but the first and last few is in two windows.
WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS, INPUT, HIDDEN, ATTEND = 13, 12, 12, 8, 8


def distinct_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, A-Z lowered: (index into the distinct words, text number) of each, and of the distinct words
    the word bucket, the buckets of their character trigrams end to end, and where each word's trigrams start.

    A trigram is any three bytes of the word between two marks."""
    low = LOWER[data]
    starts, ends = runs(_CLASS[data] == 2)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    text = np.searchsorted(bounds, starts, side="right") - 1
    hashes = span_hashes(low, starts, ends)
    own, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    length = ends - starts  # as many trigrams as bytes: the k-th is centred on byte k
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    at = np.arange(int(length.sum())) - np.repeat(begin - starts, length)
    padded = np.concatenate((low, [0])).astype(np.uint64)
    left = np.where(at == np.repeat(starts, length), 1, padded[at - 1])
    right = np.where(at == np.repeat(ends - 1, length), 2, padded[at + 1])
    grams = mix64((left * np.uint64(65536) + padded[at] * np.uint64(256) + right).astype(np.uint64) + np.uint64(7)) >> np.uint64(64 - GRAM_BITS)
    return index, text, (own >> np.uint64(64 - WORD_BITS)).astype(np.int64), grams.astype(np.int64), begin


def windows(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows over words that are numbered by text: (first word, words, text) of each. A text of up to
    WINDOW words has one; a text without words has none."""
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    many = np.where(count > 0, 1 + -(-np.maximum(count - WINDOW, 0) // STRIDE), 0)
    of = np.repeat(np.arange(n_texts), many)
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return first[of] + step * STRIDE, np.minimum(WINDOW, count[of] - step * STRIDE), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(size: int, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by index."""
    return np.stack([np.bincount(index, rows[:, c], size) for c in range(rows.shape[1])], axis=1).astype(rows.dtype)


@dataclass
class Network:
    """Parameters by name; forward passes run over batches of windows, all windows of a batch a step at a time."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        p = {"words": draw(1 << WORD_BITS, INPUT, by=0.01), "grams": draw(1 << GRAM_BITS, INPUT, by=0.3), "top": draw(2 * HIDDEN, by=0.3), "bias": np.full(1, -1.0, np.float32)}
        for way in "fb":
            p |= {f"W{way}": draw(INPUT, 3 * HIDDEN, by=INPUT**-0.5), f"U{way}": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p | {"A": draw(2 * HIDDEN, ATTEND, by=0.3), "v": draw(ATTEND, by=0.3)})

    def inputs(self, words: np.ndarray, grams: np.ndarray, begin: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Each distinct word's input: its own vector plus the mean of its trigrams' vectors."""
        length = np.diff(np.concatenate((begin, [len(grams)])))[:, None]
        own = self.p["words"][words]
        return (own if keep is None else own * keep) + np.add.reduceat(self.p["grams"][grams], begin, axis=0) / length

    def _sweep(self, gates: np.ndarray, seen: np.ndarray, way: str, trace: list | None) -> list[np.ndarray]:
        """States of one direction over gates (time, window, 3 * HIDDEN); steps that are not `seen` hold the state at 0."""
        U, n, h = self.p[f"U{way}"], HIDDEN, np.zeros((gates.shape[1], HIDDEN), np.float32)
        steps, states = range(len(gates)) if way == "f" else range(len(gates) - 1, -1, -1), [h] * len(gates)
        for t in steps:
            inner = h @ U
            zr = _sigmoid(gates[t][:, : 2 * n] + inner[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(gates[t][:, 2 * n :] + r * inner[:, 2 * n :])
            if trace is not None:
                trace.append((t, h, z, r, new, inner[:, 2 * n :]))
            h = ((1 - z) * new + z * h) * seen[t][:, None]
            states[t] = h
        return states

    def forward(self, vocab: np.ndarray, at: np.ndarray, seen: np.ndarray, keep: bool = False):
        """Logit of each window. vocab: inputs of distinct words; at: (time, window) index into them; seen: which are words."""
        traces = {"f": [], "b": []} if keep else {"f": None, "b": None}
        states = []
        for way in "fb":
            gates = (vocab @ self.p[f"W{way}"] + self.p[f"c{way}"])[at]
            states.append(np.stack(self._sweep(gates, seen, way, traces[way])))
        both = np.concatenate(states, axis=2)
        hidden = np.tanh(both @ self.p["A"])
        attention = np.where(seen > 0, hidden @ self.p["v"], -1e9)
        attention = np.exp(attention - attention.max(axis=0)) * seen
        attention /= np.maximum(attention.sum(axis=0), 1e-9)
        pooled = (attention[:, :, None] * both).sum(axis=0)
        logit = pooled @ self.p["top"] + self.p["bias"][0]
        return logit, (both, hidden, attention, pooled, traces) if keep else None

    def gradients(self, vocab, at, seen, kept, d_logit, words, grams, begin, mask) -> dict[str, np.ndarray]:
        """Of the sum of d_logit * logit, by back-propagation through time."""
        p, n = self.p, HIDDEN
        both, hidden, attention, pooled, traces = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["top"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["top"]
        d_both = attention[:, :, None] * d_pooled
        d_att = (both * d_pooled).sum(axis=2)
        d_att = attention * (d_att - (attention * d_att).sum(axis=0))
        g["v"] = np.einsum("tw,twk->k", d_att, hidden)
        d_hidden = d_att[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"] = np.einsum("twh,twk->hk", both, d_hidden)
        d_both = d_both + d_hidden @ p["A"].T
        d_vocab = np.zeros_like(vocab)
        for way, own in (("f", d_both[:, :, :n]), ("b", d_both[:, :, n:])):
            U, d_h = p[f"U{way}"], np.zeros((at.shape[1], n), np.float32)
            d_gates = np.zeros((*at.shape, 3 * n), np.float32)
            for t, h, z, r, new, inner in reversed(traces[way]):
                d = (d_h + own[t]) * seen[t][:, None]
                d_new = d * (1 - z) * (1 - new**2)
                d_in = np.concatenate((d * (h - new) * z * (1 - z), d_new * inner * r * (1 - r), d_new * r), axis=1)
                g[f"U{way}"] += h.T @ d_in
                d_h = d * z + d_in @ U.T
                d_gates[t] = d_in
                d_gates[t][:, 2 * n :] = d_new
            flat = d_gates.reshape(-1, 3 * n)
            per_word = _sum_rows(len(vocab), at.ravel(), flat)
            g[f"W{way}"], g[f"c{way}"] = vocab.T @ per_word, flat.sum(axis=0)
            d_vocab += per_word @ p[f"W{way}"].T
        length = np.diff(np.concatenate((begin, [len(grams)])))
        g["words"] = _sum_rows(len(p["words"]), words, d_vocab * mask)
        g["grams"] = _sum_rows(len(p["grams"]), grams, np.repeat(d_vocab / length[:, None], length, axis=0))
        return g

    def window_logits(self, vocab: np.ndarray, index: np.ndarray, first: np.ndarray, words: np.ndarray, batch: int = 4096) -> np.ndarray:
        out = np.zeros(len(first), np.float32)
        for k in range(0, len(first), batch):
            at, seen = spread(index, first[k : k + batch], words[k : k + batch])
            out[k : k + batch] = self.forward(vocab, at, seen)[0]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """A text's score is that of its window with the greatest; a text without words has the score of the bias."""
        out = []
        for _, data, bounds in pieces(column):
            index, text, own, grams, begin = distinct_words(data, bounds)
            best = np.full(len(bounds) - 1, -np.inf)
            if len(index):
                first, words, of = windows(text, len(best))
                np.maximum.at(best, of, self.window_logits(self.inputs(own, grams, begin), index, first, words))
            best[np.isneginf(best)] = self.p["bias"][0]
            out.append(1 / (1 + np.exp(-np.clip(best, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def spread(index: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) word indices and which of them are words."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    seen = np.arange(WINDOW)[:, None] < words[None, :]
    return index[np.where(seen, at, first[None, :])], seen.astype(np.float32)


def fit(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 3) -> Network:
    """Adam on cross-entropy, for more epochs (40 at most) where there are so few texts that these make under 350 steps. All windows of a text of label 0 are of label 0 (a few are drawn, and the highest one);
    of a text of label 1, the window that scores highest. Without texts of both labels the network is left at its bias."""
    net, rng = Network.new(), np.random.default_rng(seed)
    if len(set(labels)) < 2:
        net.p["top"][:] = 0
        net.p["bias"][0] = 0 if not labels else (3.0 if labels[0] else -3.0)
        return net
    y = np.array(labels, np.float32)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = max(epochs, min(40, -(-350 * batch // len(texts))))
    weight = np.where(y == 1, min(4.0, (1 - y).sum() / y.sum()), 1.0).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            joined = list(pieces(pa.array([texts[i] for i in rows]), most=1 << 40))
            _, data, bounds = joined[0]
            index, text, own, grams, begin = distinct_words(data, bounds)
            if not len(index):
                continue
            mask = (rng.random((len(own), 1)) < 0.6).astype(np.float32)  # words are left out now and then, so that characters count
            vocab = net.inputs(own, grams, begin, mask)
            first, words, of = windows(text, len(rows))
            high = net.window_logits(vocab, index, first, words)
            top = np.lexsort((rng.random(len(of)), high, of))
            top = top[np.flatnonzero(np.diff(np.append(of[top], -1)))]
            drawn = np.flatnonzero((y[rows][of] == 0) & (rng.random(len(of)) < 0.08))
            use = np.union1d(top, drawn)
            at, seen = spread(index, first[use], words[use])
            logit, kept = net.forward(vocab, at, seen, keep=True)
            target = y[rows][of[use]]
            d = ((_sigmoid(logit) - target) * weight[rows][of[use]] / batch).astype(np.float32)
            g = net.gradients(vocab, at, seen, kept, d, own, grams, begin, mask)
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for name, x in g.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                m[name] += 0.1 * (x - m[name])
                v[name] += 0.01 * (x * x - v[name])
                net.p[name] -= (rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def op2_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, by a network fitted on the labelled ones outside the fold crc32(doc_id) mod 5 = 0.

    Texts without words, empty or null, get the score of the bias; repeated rows get equal scores.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit(*sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, SAMPLE_ROWS))
    _, held_out = learnable(F.col("doc_id"), 5, 0)
    return scored(docs, network).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
