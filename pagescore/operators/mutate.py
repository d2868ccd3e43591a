"""Deterministic changes of region rows, to make candidates whose verdicts are known."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescore.operators.regions import kind


def corrupt_letters(regions: DataFrame, rate: float, replacement: str = "x") -> DataFrame:
    """Replace every round(1 / rate)-th letter of body regions, counted along a page's regions in order of region_id.

    The running count is a sum over earlier regions plus the place within one's own text.
    """
    step = max(1, round(1 / rate))
    body = F.col("block_type") == "body"
    letters = F.when(body, F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).otherwise(0)
    before = Window.partitionBy("page_id").orderBy("region_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = regions.withColumn("_before", F.coalesce(F.sum(letters).over(before), F.lit(0)))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.col("_before").alias("n"))
    fold = F.aggregate(
        chars, start,
        lambda a, c: F.when(
            c.rlike(r"^\p{L}$"), F.struct(F.concat(a["out"], F.when((a["n"] + 1) % step == 0, F.lit(replacement)).otherwise(c)).alias("out"), (a["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
    )
    return counted.withColumn("text", F.when(body, fold["out"]).otherwise(F.col("text"))).drop("_before")


def strip_standalone(text: Column, marker: str) -> Column:
    """Remove a marker's occurrences that have no letter or digit on either side."""
    quoted = "\\Q" + marker.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])", "")


def drop_anchors(regions: DataFrame) -> DataFrame:
    """Remove every declared marker from its region's text, and the declarations."""
    cleaned = F.aggregate("text_anchors", F.col("text"), lambda t, m: F.when(m == "", t).otherwise(F.replace(t, m, F.lit(""))))
    return regions.withColumn("text", cleaned).withColumn("text_anchors", F.array().cast("array<string>"))


def smear_page_text(regions: DataFrame) -> DataFrame:
    """Give every region the text of the whole page."""
    own = regions.where("text <> ''").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "text"))), lambda x: x["text"]), "\n").alias("_page"))
    return regions.join(own, "page_id", "left").withColumn("text", F.coalesce("_page", F.lit(""))).drop("_page")


def swap_values(regions: DataFrame, a: str, b: str, column: str) -> DataFrame:
    """Swap a column's values of two regions on every page that has both: texts, or indices for swapped blocks."""
    pair = regions.where(F.col("region_id").isin(a, b)).groupBy("page_id").agg(
        F.max(F.when(F.col("region_id") == a, F.struct(column))).alias("_a"), F.max(F.when(F.col("region_id") == b, F.struct(column))).alias("_b")
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    value = F.when(both & (F.col("region_id") == a), F.col(f"_b.{column}")).when(both & (F.col("region_id") == b), F.col(f"_a.{column}")).otherwise(F.col(column))
    return regions.join(pair, "page_id", "left").withColumn(column, value).drop("_a", "_b")


def blank_text(regions: DataFrame, region_id: str) -> DataFrame:
    return regions.withColumn("text", F.when(F.col("region_id") == region_id, "").otherwise(F.col("text")))


def single_char_error(regions: DataFrame, region_id: str, old: str, new: str) -> DataFrame:
    """Replace the first occurrence in one region."""
    at = F.instr("text", old)
    changed = F.when((F.col("region_id") == region_id) & (at > 0), F.overlay("text", F.lit(new), at, F.lit(len(old)))).otherwise(F.col("text"))
    return regions.withColumn("text", changed)


def mislabel(regions: DataFrame, region_id: str, label: str, block_type: str) -> DataFrame:
    own = F.col("region_id") == region_id
    return regions.withColumn("label", F.when(own, label).otherwise(F.col("label"))).withColumn("block_type", F.when(own, block_type).otherwise(F.col("block_type")))


def duplicate_region(regions: DataFrame, region_id: str) -> DataFrame:
    return regions.unionByName(regions.where(F.col("region_id") == region_id))


def rename_ids(regions: DataFrame, prefix: str) -> DataFrame:
    """Number a page's regions in order of their ids, behind a prefix."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("region_id"))
    return regions.withColumn("region_id", F.concat(F.lit(prefix), place.cast("string")))


def reverse_indices(regions: DataFrame, index: str = "reading_order_index") -> DataFrame:
    """Reverse the indices of a page's regions, those without one left out."""
    page = Window.partitionBy("page_id")
    return regions.withColumn(index, F.min(index).over(page) + F.max(index).over(page) - F.col(index))


# --- whole documents: pages (page_id, doc variant) with members of doc replaced


def _with(value: Column, **members: Column) -> Column:
    """A variant object with these members, variants, in place of its own of those names."""
    own = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin(*members))
    added = F.map_from_arrays(F.array(*map(F.lit, members)), F.array(*members.values()))
    return F.parse_json(F.to_json(F.map_concat(own, added)))


def _regions() -> Column:
    return F.coalesce(F.try_variant_get("doc", "$.regions", "array<variant>"), F.array().cast("array<variant>"))


def _listed(entries: Column) -> Column:
    return F.parse_json(F.to_json(entries))


def _changed(pages: DataFrame, **members: Column) -> DataFrame:
    return pages.withColumn("doc", _with(F.col("doc"), **members))


def reverse_root_indices(pages: DataFrame, order: Column | None = None) -> DataFrame:
    """Number the root regions backwards from their places; order: a variant that becomes the declared order as well."""
    entries = _regions()
    last = F.size(entries) - 1
    numbered = F.transform(entries, lambda r, k: F.when(kind(r) == "OBJECT", _with(r, reading_order_index=F.parse_json((last - k).cast("string")))).otherwise(r))
    return _changed(pages, regions=_listed(numbered), **({} if order is None else {"reading_order": order}))


def truncate_reading_order(pages: DataFrame, keep: int = 1) -> DataFrame:
    """Declare only the first `keep` ids of the declared order, and number the roots backwards."""
    declared = F.coalesce(F.try_variant_get("doc", "$.reading_order", "array<variant>"), F.array().cast("array<variant>"))
    return reverse_root_indices(pages, _listed(F.slice(declared, 1, keep)))


def phantom_reading_order(pages: DataFrame, ids: list[str]) -> DataFrame:
    """Declare an order of ids that need not be there, and number the roots backwards."""
    return reverse_root_indices(pages, F.parse_json(F.lit(json.dumps(ids))))


def mistype_reading_order(pages: DataFrame, value: object = 7) -> DataFrame:
    """Put any JSON value in place of the declared order."""
    return _changed(pages, reading_order=F.parse_json(F.lit(json.dumps(value))))


def append_region(pages: DataFrame, entry: object) -> DataFrame:
    """Append any JSON value to the regions: null or a scalar, which is no region, or an object without an id."""
    return _changed(pages, regions=_listed(F.concat(_regions(), F.array(F.parse_json(F.lit(json.dumps(entry)))))))


def nest_regions(pages: DataFrame, levels: int) -> DataFrame:
    """Hang a chain of `levels` regions below the first one, each the only child of the one above."""
    chain: list[dict] = []
    for k in range(levels, 0, -1):
        chain = [{"id": f"below{k}", "label": "text_block", "text": f"words {k} levels down", **({"children": chain} if chain else {})}]
    hung = F.transform(_regions(), lambda r, k: F.when((k == 0) & (kind(r) == "OBJECT"), _with(r, children=F.parse_json(F.lit(json.dumps(chain))))).otherwise(r))
    return _changed(pages, regions=_listed(hung))
