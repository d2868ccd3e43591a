"""Text fidelity: n-gram containment of pages, retention and misplacement of regions, and the gate over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagescore.functions.geometry import ratio
from pagescore.functions.text import backed_off, edit_similarity, ngrams, normalize, tokens

#: Thresholds of the gate. Fixed values.
N, MIN_CONTAINMENT, MIN_RETENTION, GROSS_RETENTION, MINOR_RATE, MAX_FOREIGN, MAX_MISPLACED = 3, 0.95, 0.95, 0.6, 0.05, 0.5, 0

#: Pages whose texts are Python strings at once.
BATCH_PAGES = 128


def normed(regions: DataFrame) -> DataFrame:
    """Add norm to regions (page_id, region_id, text), if it is not there."""
    return regions if "norm" in regions.columns else regions.withColumn("norm", normalize(F.coalesce("text", F.lit(""))))


def worded(regions: DataFrame) -> DataFrame:
    """Add norm and words to regions (page_id, region_id, text), if they are not there."""
    return regions if "words" in regions.columns else normed(regions).withColumn("words", tokens(F.col("norm")))


def page_n(gt: DataFrame, n: int = N) -> DataFrame:
    """(page_id, n): n, backed off until some region of the ground-truth page has an n-gram."""
    return gt.groupBy("page_id").agg(F.greatest(F.lit(1), F.least(F.lit(n), F.max(F.size("words")))).alias("n"))


def region_grams(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, region_id, gram, c): each region's bag of n-grams at its page's n. Grams don't cross regions."""
    each = regions.join(sizes, "page_id").select("page_id", "region_id", F.explode(ngrams(F.col("words"), F.col("n"))).alias("gram"))
    return each.groupBy("page_id", "region_id", "gram").agg(F.count(F.lit(1)).alias("c"))


def page_bag(grams: DataFrame) -> DataFrame:
    """(page_id, gram, c) summed over a page's regions."""
    return grams.groupBy("page_id", "gram").agg(F.sum("c").alias("c"))


def page_containment(gt: DataFrame, cand: DataFrame, n: int = N) -> DataFrame:
    """One row for each ground-truth page: n, gt_ngrams, contained, containment, cand_ngrams, precision_, excess.

    Regions need page_id, region_id and words. An empty page is contained; an empty candidate is precise.
    """
    sizes = page_n(gt, n)
    a = page_bag(region_grams(gt, sizes)).withColumnRenamed("c", "g")
    b = page_bag(region_grams(cand, sizes)).withColumnRenamed("c", "k")
    both = a.join(b, ["page_id", "gram"], "full").select("page_id", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("k", F.lit(0)).alias("k"))
    summed = both.groupBy("page_id").agg(F.sum("g").alias("gt_ngrams"), F.sum(F.least("g", "k")).alias("contained"), F.sum("k").alias("cand_ngrams"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = sizes.join(summed, "page_id", "left").select("page_id", F.col("n").cast("int").alias("n"), zero("gt_ngrams"), zero("contained"), zero("cand_ngrams"))
    return full.select(
        "page_id", "n", "gt_ngrams", "contained", ratio(F.col("contained"), F.col("gt_ngrams"), 1.0).alias("containment"), "cand_ngrams",
        ratio(F.col("contained"), F.col("cand_ngrams"), 1.0).alias("precision_"), (F.col("cand_ngrams") - F.col("contained")).alias("excess"),
    )


def aligned_text(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ground-truth regions that have words, with their counterpart's norm and words, empty if there is none."""
    other = cand.select("page_id", F.col("region_id").alias("cand_id"), F.col("norm").alias("c_norm"), F.col("words").alias("c_words"))
    mapped = gt.where(F.size("words") > 0).join(mapping.select("page_id", F.col("gt_id").alias("region_id"), "cand_id"), ["page_id", "region_id"], "left")
    return mapped.join(other, ["page_id", "cand_id"], "left").select(
        "page_id", "region_id", "cand_id", "norm", "words", F.coalesce("c_norm", F.lit("")).alias("c_norm"), F.coalesce("c_words", F.array().cast("array<string>")).alias("c_words")
    )


def aligned_norm(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """(page_id, region_id, norm, c_norm) of aligned_text, for regions that are not split into words."""
    other = cand.select("page_id", F.col("region_id").alias("cand_id"), F.col("norm").alias("c_norm"))
    mapped = gt.where("norm <> ''").select("page_id", "region_id", "norm").join(mapping.select("page_id", F.col("gt_id").alias("region_id"), "cand_id"), ["page_id", "region_id"], "left")
    return mapped.join(other, ["page_id", "cand_id"], "left").select("page_id", "region_id", "norm", F.coalesce("c_norm", F.lit("")).alias("c_norm"))


def retention(aligned: DataFrame, n: int = N, both: bool = True) -> DataFrame:
    """(page_id, region_id, by_ngram, by_chars, retention): the better of containment at the region's own n and edit similarity.

    both=False: by_chars is null where by_ngram is 1, as the edit distance then changes nothing.
    """
    sized = aligned.withColumn("n", backed_off(F.col("words"), n))
    bag = lambda words, name: (
        sized.select("page_id", "region_id", F.explode(ngrams(F.col(words), F.col("n"))).alias("gram")).groupBy("page_id", "region_id", "gram").agg(F.count(F.lit(1)).alias(name))
    )
    kept = bag("words", "g").join(bag("c_words", "k"), ["page_id", "region_id", "gram"], "left")
    contained = kept.groupBy("page_id", "region_id").agg(ratio(F.sum(F.least("g", F.coalesce("k", F.lit(0)))), F.sum("g"), 0.0).alias("by_ngram"))
    chars = edit_similarity(F.col("norm"), F.col("c_norm"), None if both else F.col("by_ngram") < 1)
    graded = sized.select("page_id", "region_id", "norm", "c_norm").join(contained, ["page_id", "region_id"])
    graded = graded.withColumn("by_chars", chars)
    return graded.select("page_id", "region_id", "by_ngram", "by_chars", F.greatest("by_ngram", "by_chars").alias("retention"))


def worst(rows: DataFrame, value: str, lowest: bool = True, k: int | None = None) -> DataFrame:
    """(page_id, offenders array<struct<value, region_id>>): a page's regions by a value, worst first, ties by id; the first k
    if k is given."""
    entry = F.struct((F.col(value) if lowest else -F.col(value)).alias("v"), F.col("region_id").alias("r"))
    shown = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct((x["v"] if lowest else -x["v"]).alias("value"), x["r"].alias("region_id")))
    return rows.groupBy("page_id").agg((F.slice(shown, 1, k) if k else shown).alias("offenders"))


def misplacement(aligned: DataFrame, gt: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, region_id, own_matched, foreign_, foreign_ratio) of regions whose counterpart has grams of the page.

    A counterpart's gram is the region's own as often as the region has it; beyond that it is foreign if any region of
    the page has it, and counts nowhere if none does.
    """
    theirs = region_grams(aligned.select("page_id", "region_id", F.col("c_words").alias("words")), sizes)
    own = region_grams(gt, sizes).withColumnRenamed("c", "o")
    page = page_bag(own.withColumnRenamed("o", "c")).select("page_id", "gram", F.lit(1).alias("on_page"))
    seen = theirs.join(own, ["page_id", "region_id", "gram"], "left").join(page, ["page_id", "gram"], "left")
    mine = F.least("c", F.coalesce("o", F.lit(0)))
    summed = seen.groupBy("page_id", "region_id").agg(
        F.sum(mine).cast("long").alias("own_matched"), F.sum(F.when(F.col("on_page") == 1, F.col("c") - mine).otherwise(0)).cast("long").alias("foreign_")
    )
    total = F.col("own_matched") + F.col("foreign_")
    return summed.where(total > 0).withColumn("foreign_ratio", F.col("foreign_").cast("double") / total.cast("double"))


def bag(words: list[str], n: int) -> Counter:
    """How often each n-gram of the words occurs."""
    return Counter(zip(*(words[k:] for k in range(n)), strict=False))


def compared_page(regions: list[dict], cand: list[str], n: int = N) -> tuple[int, int, int, int, list[tuple]]:
    """(n, gt_ngrams, contained, cand_ngrams, regions) of one page: regions (region_id, norm, c_norm) of the ground truth that
    have words, with their counterparts' texts, and the norms of all candidate regions. For each region_id: its grams at the
    regions' own n, those of them that are kept, own_matched and foreign_ as in misplacement. Rows of one id count together.

    A text that both sides have adds as many grams to both bags, and so its number of grams to what they share: only other texts
    are counted gram by gram, each once."""
    words: dict[str, list[str]] = {}
    known: dict[tuple[str, int], Counter] = {}

    def split(text: str) -> list[str]:
        if text not in words:
            words[text] = text.split()
        return words[text]

    def counted(text: str, size: int) -> Counter:
        if (text, size) not in known:
            known[text, size] = bag(split(text), size)
        return known[text, size]

    def many(text: str, size: int) -> int:
        return max(0, len(split(text)) - size + 1) if size else 0

    def summed(texts: Iterable[tuple[str, int]]) -> Counter:
        out: Counter = Counter()
        for text, size in texts:
            if many(text, size):
                out.update(counted(text, size))
        return out

    by_id: dict[str, list[tuple[str, str, int]]] = {}
    for r in regions:
        by_id.setdefault(r["region_id"], []).append((r["norm"], r["c_norm"], min(n, len(split(r["norm"])))))
    page_n = max([1, *(size for rows in by_id.values() for *_, size in rows)])
    own_texts, made = Counter(r["norm"] for r in regions), Counter(cand)
    page: set | None = None  # its grams, asked for only where a counterpart has another text
    told = []
    for name, rows in by_id.items():
        grams, theirs = sum(many(text, size) for text, _, size in rows), sum(many(other, page_n) for _, other, _ in rows)
        if all(text == other for text, other, _ in rows):
            mine = 0 if name is None else theirs
            told.append((name, grams, grams, mine, theirs - mine))
            continue
        b = summed((other, size) for _, other, size in rows)
        kept = sum(min(c, b[g]) for g, c in summed((text, size) for text, _, size in rows).items()) if b else 0
        mine = foreign = 0
        if theirs:
            own, other = summed((text, page_n) for text, *_ in rows), summed((other, page_n) for _, other, _ in rows)
            page = set().union(*(counted(text, page_n) for text in own_texts)) if page is None else page
            mine = 0 if name is None else sum(min(c, own[g]) for g, c in other.items())
            foreign = sum(c for g, c in other.items() if g in page) - mine
        told.append((name, grams, kept, mine, foreign))
    total = lambda texts: sum(k * many(text, page_n) for text, k in texts.items())
    both = own_texts & made
    left, right = (summed((text, page_n) for text in (side - both).elements()) for side in (own_texts, made)) if own_texts != both and made != both else (Counter(), Counter())
    return page_n, total(own_texts), total(both) + sum(min(c, right[g]) for g, c in left.items()), total(made), told


def lists(column: pa.ListArray) -> list[list]:
    """The lists of an Arrow column, null ones empty; structs as dicts."""
    entries = column.flatten()
    if pa.types.is_struct(entries.type):
        names = [f.name for f in entries.type]
        flat: list = [dict(zip(names, row, strict=True)) for row in zip(*(c.to_pylist() for c in entries.flatten()), strict=True)]
    else:
        flat = entries.to_pylist()
    ends = [0, *accumulate(n or 0 for n in column.value_lengths().to_pylist())]
    return [flat[i:j] for i, j in pairwise(ends)]


def compared(gt: DataFrame, aligned: DataFrame, cand: DataFrame, n: int = N) -> DataFrame:
    """One row for each ground-truth page: page_id, n, gt_ngrams, contained, cand_ngrams, and regions, which has what retention
    and misplacement count of each region_id: array<struct<region_id, grams, kept, own_matched, foreign_>>.

    A page's normalised texts meet as one row, and its grams are counted in one Arrow pass: they are never shuffled. gt and
    cand need page_id and norm; aligned is what aligned_text gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = pa.struct([("region_id", pa.string()), *((c, pa.int64()) for c in ("grams", "kept", "own_matched", "foreign_"))])
        for batch in batches:
            told: list[tuple] = []
            for part in (batch.slice(k, BATCH_PAGES) for k in range(0, batch.num_rows, BATCH_PAGES)):
                told += [compared_page(a, b, n) for a, b in zip(lists(part.column("regions")), lists(part.column("cand")), strict=True)]
            counts = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            each = [r for t in told for r in t[4]]
            fields = [pa.array([r[k] for r in each], region[k].type) for k in range(len(region))]
            ends = pa.array([0, *accumulate(len(t[4]) for t in told)], pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(region)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *counts, rows], names=["page_id", "n", "gt_ngrams", "contained", "cand_ngrams", "regions"])

    texts = aligned.groupBy("page_id").agg(F.collect_list(F.struct("region_id", "norm", "c_norm")).alias("regions"))
    made = cand.groupBy("page_id").agg(F.collect_list("norm").alias("cand"))
    pages = gt.select("page_id").distinct().join(texts, "page_id", "left").join(made, "page_id", "left").select("page_id", "regions", "cand")
    kind = gt.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, n int, gt_ngrams long, contained long, cand_ngrams long, regions array<struct<region_id: string, grams: long, kept: long, own_matched: long, foreign_: long>>")


def page_figures(counted: DataFrame) -> DataFrame:
    """The rows of page_containment, from compared."""
    return counted.select(
        "page_id", "n", "gt_ngrams", "contained", ratio(F.col("contained"), F.col("gt_ngrams"), 1.0).alias("containment"), "cand_ngrams",
        ratio(F.col("contained"), F.col("cand_ngrams"), 1.0).alias("precision_"), (F.col("cand_ngrams") - F.col("contained")).alias("excess"),
    )


def region_figures(counted: DataFrame, aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of retention, with by_chars only where by_ngram is less than 1, and of misplacement, from compared."""
    each = counted.select("page_id", F.inline("regions"))
    graded = aligned.select("page_id", "region_id", "norm", "c_norm").join(each.select("page_id", "region_id", ratio(F.col("kept"), F.col("grams"), 0.0).alias("by_ngram")), ["page_id", "region_id"])
    graded = graded.withColumn("by_chars", edit_similarity(F.col("norm"), F.col("c_norm"), F.col("by_ngram") < 1))
    total = F.col("own_matched") + F.col("foreign_")
    moved = each.where(total > 0).select("page_id", "region_id", "own_matched", "foreign_", (F.col("foreign_").cast("double") / total.cast("double")).alias("foreign_ratio"))
    return graded.select("page_id", "region_id", "by_ngram", "by_chars", F.greatest("by_ngram", "by_chars").alias("retention")), moved


def text_gate(pages: DataFrame, retained: DataFrame, misplaced: DataFrame) -> DataFrame:
    """One row for each page of page_containment: its figures, region defects, worst_retention (null if none was scored), passed."""
    graded = retained.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("regions_scored"), F.count_if(F.col("retention") < GROSS_RETENTION).alias("gross"),
        F.count_if((F.col("retention") >= GROSS_RETENTION) & (F.col("retention") < MIN_RETENTION)).alias("minor"), F.min("retention").alias("worst_retention"),
    )
    moved = misplaced.where(F.col("foreign_ratio") > MAX_FOREIGN).groupBy("page_id").agg(F.count(F.lit(1)).alias("misplaced"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    row = pages.join(graded, "page_id", "left").join(moved, "page_id", "left").select(*pages.columns, *map(zero, ("regions_scored", "gross", "minor", "misplaced")), "worst_retention")
    allowance = F.when(F.col("regions_scored") > 0, F.greatest(F.lit(1), F.ceil(F.lit(MINOR_RATE) * F.col("regions_scored")))).otherwise(0).cast("long")
    passed = (F.col("containment") >= MIN_CONTAINMENT) & (F.col("gross") == 0) & (F.col("minor") <= F.col("minor_allowed")) & (F.col("misplaced") <= MAX_MISPLACED)
    return row.withColumn("minor_allowed", allowance).withColumn("passed", passed).withColumn("reward_ready", F.lit(False))


def text_fidelity(gt: DataFrame, cand: DataFrame, mapping: DataFrame, n: int = N) -> DataFrame:
    """The whole check over regions with text; cand has one row for each id that counts."""
    gt, cand = normed(gt), normed(cand)
    aligned = aligned_norm(gt, cand, mapping)
    counted = compared(gt, aligned, cand, n)
    return text_gate(page_figures(counted), *region_figures(counted, aligned))
