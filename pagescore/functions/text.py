"""Text expressions: normalisation, tokens, n-grams, counts and similarities."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: [^\p{L}\p{Nd}]+, with the ASCII characters one by one, which Java looks up in a table.
NOT_WORD = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + r"[\x{80}-\x{10FFFF}&&[^\p{L}\p{Nd}]]]++"
#: Characters of texts that normalize_text may get wrong: all but ASCII, the letters and signs to U+017E whose case folding is
#: their lower case (the micro sign's, dotted I's and n with apostrophe's is not), general punctuation and currency signs.
UNUSUAL = r"[\x{80}-\x{9F}\xB5\u0130\u0149\u017F-\u1FFF\u2070-\u209F\u20C0-\x{10FFFF}]"
SPACES = r"(?U)\s+"


def normalize_text(text: Column) -> Column:
    """Case-folded words of letters and decimal digits, one space between them.

    Exact for text in composed form whose case folding is its lower case but for the sharp s; see
    normalize_any_text for all others. Null stays null.
    """
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), NOT_WORD, " "))


def _any_text(text: str | None) -> str | None:
    if text is None:
        return None
    folded = unicodedata.normalize("NFC", text).casefold()
    return " ".join("".join(c if c.isalpha() or c.isdecimal() else " " for c in folded).split())


@F.pandas_udf(StringType())
def normalize_any_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """normalize_text for any text: canonical composition and full case folding, in Arrow batches."""
    for part in texts:
        yield part.map(_any_text)


def normalize(text: Column) -> Column:
    """normalize_any_text, by the plain expression where a text has no unusual characters; only the others go to Python."""
    other = normalize_any_text(F.when(text.rlike(UNUSUAL), text))
    return F.coalesce(other, normalize_text(text))


def tokens(normalized: Column) -> Column:
    """The words of a normalised text; none for an empty or null one."""
    return F.coalesce(F.filter(F.split(normalized, " "), lambda w: w != ""), F.array().cast("array<string>"))


def ngrams(words: Column, n: Column) -> Column:
    """The contiguous n-grams of a word array, joined by spaces; none where n < 1 or there are too few words.

    words must be a column, not an expression, which would be evaluated again for each gram.
    """
    fits = (n >= 1) & (F.size(words) >= n)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.greatest(n, F.lit(1))), " "))
    return F.when(fits, grams).otherwise(F.array().cast("array<string>"))


def backed_off(words: Column, n: int) -> Column:
    """The greatest n' <= n for which the words have an n'-gram, 1 at least."""
    return F.greatest(F.lit(1), F.least(F.lit(n), F.size(words)))


def occurrences(text: Column, marker: Column) -> Column:
    """Non-overlapping occurrences of marker in text; an empty marker occurs length + 1 times."""
    removed = F.length(text) - F.length(F.replace(text, marker, F.lit("")))
    return F.when(marker == "", F.length(text) + 1).otherwise((removed / F.length(marker)).cast("int"))


def distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of bits a step: those where the distance grows and those where it falls by one."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    grows, falls = full, 0
    for c in b:
        hit = at.get(c, 0)
        level = ((((hit & grows) + grows) ^ grows) | hit | falls) & full
        more, less = ((falls | full ^ (level | grows)) << 1 | 1) & full, (level & grows) << 1 & full
        grows, falls = less | full ^ (level | more), more & level
    return len(b) + grows.bit_count() - falls.bit_count()


@F.pandas_udf(LongType())
def edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """distance of two texts that are not empty, in Arrow batches; null if either is null."""
    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(left, right, strict=True)], dtype="Int64")


def edit_similarity(a: Column, b: Column, asked: Column | None = None) -> Column:
    """1 - Levenshtein distance / longer length, in code points; 1 for two empty texts, null where it is not asked for. The
    distance, whose cost is the product of the lengths, is worked out only for texts that differ and of which neither is empty."""
    longer, asked = F.greatest(F.length(a), F.length(b)), F.lit(True) if asked is None else asked
    apart = asked & (a != b) & (a != "") & (b != "")
    found = F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.lit(1.0) - edit_distance(F.when(apart, a), F.when(apart, b)).cast("double") / longer)
    return F.when(asked, found)


def in_places(numbers: Column, places: int) -> Column:
    """Each number of an array as text with so many decimals: its exact value rounded, halves to even, as printf does.
    format_string rounds the shortest digits that tell a double from its neighbours, halves up."""

    @F.pandas_udf("array<string>")
    def shown(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else [None if x is None or x != x else f"{x:.{places}f}" for x in row])

    return shown(numbers)


def rounded(number: Column, places: int) -> Column:
    """A double rounded as SQL's round does it: its product with 10^places goes to the nearest whole number, halves away from
    zero. F.round rounds the shortest digits that tell a double from its neighbours: of 0.07125, which is a little less, to 0.0713."""
    scale = F.lit(10.0**places)
    return F.round(number * scale) / scale


#: What precedes a member's number in compact JSON: the quote that ends its key. One that begins a text follows one of :,[{ and one
#: within a text a backslash.
_KEY = r'(?<=[^\\:,\[{]":)(?<sign>-?)'


def short_numbers(json: Column) -> Column:
    """Compact JSON whose members' small doubles are written as SQL and Python do, 9.5E-4 as 0.00095 and 1.0E-5 as 1e-05."""
    plain = F.regexp_replace(json, _KEY + r"(?<a>\d)\.(?:0|(?<b>\d+))E-4(?=[,}])", "${sign}0.000${a}${b}")
    short = F.regexp_replace(plain, _KEY + r"(?<a>\d(?:\.(?!0E)\d+)?)(?:\.0)?E-(?<e>\d)(?=[,}])", "${sign}${a}e-0${e}")
    short = F.regexp_replace(short, _KEY + r"(?<a>\d(?:\.(?!0E)\d+)?)(?:\.0)?E-(?<e>\d\d+)(?=[,}])", "${sign}${a}e-${e}")
    return F.when(json.contains("E-"), short).otherwise(json)


def collapse(text: Column) -> Column:
    """Runs of white space, of any script, as one space; trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits a step."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2 * LCS / (length + length), 1 for two empty texts, in Arrow batches; null if either is null."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        return 2 * lcs(a, b) / (len(a) + len(b))

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def sorted_tokens(text: Column) -> Column:
    """The white-space tokens in order, joined by spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(text, SPACES), lambda w: w != "")), " ")


def text_similarity(a: Column, b: Column, strategy: str = "fuzzy") -> Column:
    """Of collapsed texts: 1 if equal, 0 if one is empty, else by strategy: exact (0), fuzzy or token."""
    x, y = collapse(F.coalesce(a, F.lit(""))), collapse(F.coalesce(b, F.lit("")))
    if strategy == "exact":
        other = F.lit(0.0)
    elif strategy == "token":
        other = indel_ratio(sorted_tokens(x), sorted_tokens(y))
    else:
        other = indel_ratio(x, y)
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(other)
