"""Fuzzy matching of predicted elements with ground-truth elements of a document."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescore.functions.text import collapse, indel_ratio, lcs, sorted_tokens, text_similarity


@dataclass(frozen=True)
class MatchConfig:
    """Weights and thresholds of a match. Fixed defaults."""

    threshold: float = 0.5
    position_weight: float = 0.3
    text_weight: float = 0.5
    attributes_weight: float = 0.2
    position_tolerance: int = 50
    text_strategy: str = "fuzzy"


EXACT = 0.95


def attribute_similarity(a: str, b: str) -> Column:
    """Of JSON-valued maps: both empty 1; one empty or no common key 0.5; else the mean of 1 for equal values and 0.5 for
    strings of a ratio over 0.8. The strings' ratios come from columns <a>_ratios by key."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    each = F.transform(keys, lambda k: F.when(F.element_at(F.col(a), k) == F.element_at(F.col(b), k), F.lit(1.0)).when(F.coalesce(F.element_at(F.col("_ratios"), k), F.lit(0.0)) > 0.8, F.lit(0.5)).otherwise(F.lit(0.0)))
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(keys)
    none_a, none_b = F.coalesce(F.size(a), F.lit(0)) == 0, F.coalesce(F.size(b), F.lit(0)) == 0
    return F.when(none_a & none_b, F.lit(1.0)).when(none_a | none_b, F.lit(0.5)).when(F.size(keys) == 0, F.lit(0.5)).otherwise(mean)


def scored_pairs(gt: DataFrame, pred: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs of one document and type that share a page, with position, text, attribute and total similarity.

    Both sides: doc_id, element_type, pos int (order), element_id, pages, text, char_offset, attributes. An element
    without pages is in no pair. The pages are the join's key, so texts are compared only where a page is shared.
    """
    paged = lambda df, side: df.select("doc_id", "element_type", F.col("pos").alias(f"{side}_pos"), F.explode("pages").alias("page"))
    near = paged(gt, "g").join(paged(pred, "p"), ["doc_id", "element_type", "page"]).select("doc_id", "element_type", "g_pos", "p_pos").distinct()
    named = lambda df, side: df.select("doc_id", "element_type", *[F.col(c).alias(f"{side}_{c}") for c in ("pos", "element_id", "text", "char_offset", "attributes")])
    pairs = near.join(named(gt, "g"), ["doc_id", "element_type", "g_pos"]).join(named(pred, "p"), ["doc_id", "element_type", "p_pos"])
    offset = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("g_char_offset") - F.col("p_char_offset")).cast("double") / F.lit(float(config.position_tolerance)))
    position = F.when(F.col("g_char_offset").isNotNull() & F.col("p_char_offset").isNotNull(), offset).otherwise(F.lit(0.5))
    # ratios of unequal string attributes, a row for each
    plain = lambda m: F.get_json_object(F.concat(F.lit("["), m, F.lit("]")), "$[0]")
    keys = pairs.select("doc_id", "element_type", "g_pos", "p_pos", F.explode(F.array_intersect(F.map_keys("g_attributes"), F.map_keys("p_attributes"))).alias("k"), "g_attributes", "p_attributes")
    strings = keys.withColumn("x", F.element_at("g_attributes", F.col("k"))).withColumn("y", F.element_at("p_attributes", F.col("k"))).where("x <> y and x like '\"%' and y like '\"%'")
    ratios = strings.withColumn("r", indel_ratio(plain(F.col("x")), plain(F.col("y")))).groupBy("doc_id", "element_type", "g_pos", "p_pos").agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("_ratios"))
    full = pairs.join(ratios, ["doc_id", "element_type", "g_pos", "p_pos"], "left")
    total = F.lit(config.position_weight) * F.col("position_similarity") + F.lit(config.text_weight) * F.col("text_similarity") + F.lit(config.attributes_weight) * F.col("attribute_similarity")
    return (
        full.withColumn("position_similarity", position).withColumn("text_similarity", text_similarity(F.col("g_text"), F.col("p_text"), config.text_strategy))
        .withColumn("attribute_similarity", attribute_similarity("g_attributes", "p_attributes")).withColumn("score", total).drop("_ratios")
    )


def upper_bound(a: Counter, b: Counter, length: int) -> float:
    """No less than the indel ratio of two texts with these characters and this length together: a common subsequence has
    no character oftener than either has."""
    if len(a) > len(b):
        a, b = b, a
    return 2 * sum(min(n, b[c]) for c, n in a.items() if c in b) / length if length else 1.0


class Side:
    """One element of a group, with the bag of its text's characters at hand once that is asked for."""

    def __init__(self, row: dict) -> None:
        self.row, self.text, self.key = row, row["text"] or "", row["key"] or ""
        self.attributes = dict(row["attributes"] or [])
        self._bag: Counter | None = None

    @property
    def bag(self) -> Counter:
        if self._bag is None:
            self._bag = Counter(self.key)
        return self._bag


def position_of(g: Side, p: Side, config: MatchConfig) -> float:
    a, b = g.row["char_offset"], p.row["char_offset"]
    return 0.5 if a is None or b is None else max(0.0, 1.0 - abs(a - b) / float(config.position_tolerance))


def attributes_of(g: Side, p: Side) -> float:
    """attribute_similarity, with a string's ratio worked out only where its length allows what is asked."""
    a, b = g.attributes, p.attributes
    if not a or not b:
        return 1.0 if not a and not b else 0.5
    total, common = 0.0, [k for k in a if k in b]
    for k in common:
        x, y = a[k], b[k]
        if x == y:
            total += 1.0
        elif x is not None and y is not None and x[:1] == y[:1] == '"':
            x, y = json.loads(x), json.loads(y)
            if 2 * min(len(x), len(y)) > 0.8 * (len(x) + len(y)) and 2 * lcs(x, y) / (len(x) + len(y)) > 0.8:
                total += 0.5
    return total / len(common) if common else 0.5


def choose(gt: list[Side], pred: list[Side], config: MatchConfig) -> tuple[list[tuple], int, int]:
    """The greedy choice within a group: (g_pos, p_pos, score, position, text) of each match, the pairs that share a page, and how
    many of them had their texts compared.

    Every pair has a bound of its score: by the text's lengths, then by its bag of characters. Candidates are taken up by
    falling bound, and texts compared only while the bound still beats the best score, or equals it for an earlier element.
    """
    by_page: dict = {}
    for k, p in enumerate(pred):
        for page in set(p.row["pages"] or ()):
            by_page.setdefault(page, []).append(k)
    taken, out, pairs, compared = set(), [], 0, 0
    whole = lambda position, text, attributes: config.position_weight * position + config.text_weight * text + config.attributes_weight * attributes
    for g in gt:
        near = sorted({k for page in set(g.row["pages"] or ()) for k in by_page.get(page, ()) if pred[k].row["element_id"] not in taken})
        pairs += len(near)
        waiting = []
        for k in near:
            p = pred[k]
            position, attributes = position_of(g, p, config), attributes_of(g, p)
            if g.text == p.text:
                text = 1.0
            elif not g.text or not p.text or config.text_strategy == "exact":
                text = 0.0
            else:
                text = None
            both = len(g.key) + len(p.key)
            bound = whole(position, text if text is not None else 2 * min(len(g.key), len(p.key)) / both if both else 1.0, attributes)
            if bound >= config.threshold and bound > 0:
                heappush(waiting, (-bound, k, text, position, attributes, text is not None))
        best = None  # (score, -k, ...)
        while waiting:
            bound, k, text, position, attributes, tight = heappop(waiting)
            if best is not None and (-bound, -k) < best[:2]:
                break
            p = pred[k]
            if text is None and not tight:  # once more, with the finer bound
                bound = whole(position, upper_bound(g.bag, p.bag, len(g.key) + len(p.key)), attributes)
                if bound >= config.threshold and bound > 0:
                    heappush(waiting, (-bound, k, None, position, attributes, True))
                continue
            if text is None:
                compared += 1
                text = 1.0 if g.key == p.key else 2 * lcs(g.key, p.key) / (len(g.key) + len(p.key))
            score = whole(position, text, attributes)
            if score >= config.threshold and score > 0 and (best is None or (score, -k) > best[:2]):
                best = (score, -k, position, text)
        if best is not None:
            p = pred[-best[1]]
            taken.add(p.row["element_id"])
            out.append((g.row["pos"], p.row["pos"], best[0], best[2], best[3]))
    return out, pairs, compared


def best_matches(gt: DataFrame, pred: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(doc_id, element_type, g_pos, p_pos, score, position_similarity, text_similarity): in ground-truth order, the best pair at or
    over the threshold whose predicted id is free, ties to the first; the ids of a document and type are taken once.

    A document's elements of a type meet as two arrays; these go through one Arrow pass, in which each pair is looked at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                sides = [sorted((Side(r) for r in batch.column(name)[k].as_py()), key=lambda x: x.row["pos"]) for name in ("g", "p")]
                rows += [(k, *found) for found in choose(*sides, config)[0]]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("element_type").take(at), *columns], names=["doc_id", "element_type", "g_pos", "p_pos", "score", "position_similarity", "text_similarity"])

    plain = collapse(F.coalesce(F.col("text"), F.lit("")))
    key = sorted_tokens(plain) if config.text_strategy == "token" else plain
    entry = F.struct(F.col("pos").cast("int").alias("pos"), "element_id", "pages", plain.alias("text"), key.alias("key"), F.col("char_offset").cast("long").alias("char_offset"), "attributes")
    both = gt.select("doc_id", "element_type", entry.alias("e"), F.lit(True).alias("own")).unionByName(pred.select("doc_id", "element_type", entry.alias("e"), F.lit(False).alias("own")))
    groups = both.groupBy("doc_id", "element_type").agg(F.collect_list(F.when(F.col("own"), F.col("e"))).alias("g"), F.collect_list(F.when(~F.col("own"), F.col("e"))).alias("p"))
    kind = gt.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, element_type string, g_pos int, p_pos int, score double, position_similarity double, text_similarity double"
    return groups.where("size(g) > 0 and size(p) > 0").mapInArrow(run, schema)


def error_details(row_text_similarity: str = "text_similarity") -> Column:
    """Of a pair's columns: a map of what differs, as strings; null if nothing does. attribute_diffs is JSON: by key in order, the
    expected value and the one got, null where there is none."""
    g, p = collapse(F.col("g_text")), collapse(F.col("p_text"))
    differs = F.zip_with(F.split(g, ""), F.split(p, ""), lambda x, y: F.coalesce(x != y, F.lit(False)))
    first = F.array_position(differs, F.lit(True)) - 1
    low = F.col(row_text_similarity) < 0.95
    shown = F.concat(F.lit("expected '"), F.substring(g, first.cast("int") + 1, F.lit(1)), F.lit("', got '"), F.substring(p, first.cast("int") + 1, F.lit(1)), F.lit("'"))
    keys = F.array_sort(F.array_union(F.map_keys("g_attributes"), F.map_keys("p_attributes")))
    odd = F.filter(keys, lambda k: ~F.try_element_at(F.col("g_attributes"), k).eqNullSafe(F.try_element_at(F.col("p_attributes"), k)))
    value = lambda side, k: F.coalesce(F.try_element_at(F.col(f"{side}_attributes"), k), F.lit("null"))
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1)  # noqa: E731 - with JSON's escapes
    differing = lambda k: F.concat(name(k), F.lit(':{"expected":'), value("g", k), F.lit(',"got":'), value("p", k), F.lit("}"))
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    entries = F.array(
        F.when(low & (F.length(g) != F.length(p)), entry("text_length_diff", F.length(p) - F.length(g))), F.when(low & (g != p), entry("text_mismatch", F.lit("true"))),
        F.when(low & (first >= 0), entry("first_diff_pos", first)), F.when(low & (first >= 0), entry("first_diff", shown)),
        F.when(F.col("g_char_offset") != F.col("p_char_offset"), entry("position_diff", F.col("p_char_offset") - F.col("g_char_offset"))),
        F.when(F.size(odd) > 0, entry("attribute_diffs", F.concat(F.lit("{"), F.array_join(F.transform(odd, differing), ","), F.lit("}")))),
    )
    kept = F.filter(entries, lambda e: e.isNotNull())
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


def match_elements(gt: DataFrame, pred: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """doc_id, element_type, gt_id, pred_id, match_type, score, position_similarity, text_similarity, error_details, phase, pos.

    Matched pairs, then ground truth without a match (missed) and predictions whose id no match took (spurious). phase and
    pos give the order of a document's matches of a type: ground truth by its place (phase 0), then what is spurious (1).
    """
    chosen = best_matches(gt, pred, config)
    named = lambda df, side: df.select("doc_id", "element_type", *[F.col(c).alias(f"{side}_{c}") for c in ("pos", "element_id", "text", "char_offset", "attributes")])
    hit = named(gt, "g").join(chosen, ["doc_id", "element_type", "g_pos"], "left").join(named(pred, "p"), ["doc_id", "element_type", "p_pos"], "left")
    kind = F.when(F.col("p_pos").isNull(), "missed").when(F.col("score") >= EXACT, "exact").otherwise("partial")
    reason = lambda text: F.create_map(F.lit("reason"), F.lit(text))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    found = hit.select(
        "doc_id", "element_type", F.col("g_element_id").alias("gt_id"), F.col("p_element_id").alias("pred_id"), kind.alias("match_type"), *map(zero, ("score", "position_similarity", "text_similarity")),
        F.when(F.col("p_pos").isNull(), reason("not_found")).when(F.col("score") < EXACT, error_details()).alias("error_details"), F.lit(0).alias("phase"), F.col("g_pos").cast("int").alias("pos"),
    )
    taken = pred.join(chosen.select("doc_id", "element_type", F.col("p_pos").alias("pos")), ["doc_id", "element_type", "pos"]).select("doc_id", "element_type", "element_id")
    spurious = pred.join(taken, ["doc_id", "element_type", "element_id"], "left_anti")
    lone = spurious.select(
        "doc_id", "element_type", F.lit(None).cast("string").alias("gt_id"), F.col("element_id").alias("pred_id"), F.lit("spurious").alias("match_type"), *[F.lit(0.0).alias(c) for c in ("score", "position_similarity", "text_similarity")],
        reason("false_positive").alias("error_details"), F.lit(1).alias("phase"), F.col("pos").cast("int").alias("pos"),
    )
    return found.unionByName(lone)
