"""Token counts of a unigram tokenizer: vocabulary matches by an Aho-Corasick automaton, best path by dynamic programming.

The vocabulary's pieces and scores come from a public SentencePiece file and are read as a unigram model, with a word
mark (U+2581) for each space and in front of each text, words being tokenised one by one, and byte pieces for what no
piece covers. Only a path's score and its number of pieces are carried; no pieces are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.llm.common import table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: What an uncovered character costs beyond the lowest score, and the word mark: fixed values of the tokenizer format.
UNKNOWN_PENALTY, MARK = 10.0, "▁"
#: Words whose counts a Python worker remembers before it starts anew.
REMEMBERED = 300_000

Vocabulary = list[tuple[str, float]]
_counters: dict[int, "Counter"] = {}


def vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    """(piece, score) by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation of words.

    Ties: a position keeps the path that reached it first, in order of the starts of the last pieces; so of equal
    scores the longest last piece wins, and a piece wins over an uncovered character.
    """

    def __init__(self, pieces: Vocabulary) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        scores = dict(reversed(pieces))
        for piece, score in scores.items():
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.best(word)
        return found

    def best(self, word: str) -> tuple[int, float]:
        n, unknown = len(word), self.unknown
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        open_end = [False] * (n + 1)  # the path ends in uncovered characters, which count as one without byte pieces
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for at, match in self.find.iter(word):
            ends[at].append(match)  # longest first
        single = [any(m[0] == 1 for m in ms) for ms in ends]
        for end in range(1, n + 1):
            best, pieces, uncovered = None, 0, False
            for length, gain in ends[end - 1]:
                total = score[end - length] + gain
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
            if not single[end - 1]:
                total = score[end - 1] + unknown
                if best is None or total > best:
                    new = len(word[end - 1].encode("utf-8", "replace")) if self.bytes_known else int(not open_end[end - 1])
                    best, pieces, uncovered = total, count[end - 1] + new, True
            score[end], count[end], open_end[end] = best, pieces, uncovered
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a whole text; (0, 0) for null or empty."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        words = marked.split(MARK)
        count, score, word = 0, 0.0, self.word
        # a text that starts with a mark gets no other in front
        for part in words[1:] if marked[0] == MARK else words:
            pieces, gain = word(MARK + part)
            count += pieces
            score += gain
        return count, score


def counter(pieces: Vocabulary) -> Counter:
    """The worker's counter for this vocabulary."""
    key = hash(tuple(pieces))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(pieces)
    return _counters[key]


def token_counts(df: DataFrame, key: str, text: str, pieces: Vocabulary) -> DataFrame:
    """key, n_tokens long, score double (of the best segmentation), one row for each row. Null and empty texts have 0."""
    schema = df.select(key).schema.add("n_tokens", "long").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(pieces)
        for batch in batches:
            pairs = [own.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.float64())], names=[key, "n_tokens", "score"])

    return df.select(key, text).mapInArrow(run, schema)


def op10_viterbi_counts(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """The number of tokens of every whole document."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", vocabulary(model_file))
