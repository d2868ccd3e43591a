"""The structural contract of raw page documents: offenders by kind of violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescore.operators.regions import blocks, canonical, kind, member, of_tree, string_member, walk

#: Kinds of violation, in the order of reports. Fixed values.
KINDS = (
    "non_object_regions", "regions_without_id", "duplicate_region_ids", "regions_below_depth_cap", "non_integer_reading_order_index", "reading_order_not_a_list",
    "non_string_order_entries", "duplicate_order_entries", "order_refs_no_region", "order_omits_regions", "order_breaks_block_structure", "order_contradicts_indices",
)


_WHOLE = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def _told(*cases: tuple[Column, str, Column]) -> Column:
    """A row's violations, an array of (kind, offender): those of the cases (condition, kind, offender) that hold."""
    made = [F.when(holds, F.struct(F.lit(name).alias("kind"), offender.cast("string").alias("offender"))) for holds, name, offender in cases]
    return F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("v")


def tree_violations(tree: DataFrame) -> DataFrame:
    """(page_id, kind, offender) that single entries of the region tree (regions.walk) are, in one pass."""
    what, depth = kind(F.col("value")), F.size("path") - 1
    name, index = string_member("value", "id"), member("value", "reading_order_index")
    at = F.concat(F.lit("depth "), depth.cast("string"), F.lit(" index "), F.element_at("path", -1).cast("string"))
    is_entry, own = F.col("part") == "entry", F.col("object")
    return tree.select("page_id", _told(
        (~is_entry, "non_object_regions", F.concat(F.lit("depth "), F.size("path").cast("string"), F.lit(": "), what)),
        (is_entry & ~own, "non_object_regions", F.concat(at, F.lit(": "), what)),
        (own & (name == ""), "regions_without_id", at),
        (own & (name != "") & index.isNotNull() & ~kind(index).isin(*_WHOLE), "non_integer_reading_order_index", F.concat(name, F.lit(": "), kind(index))),
        (own & F.col("below"), "regions_below_depth_cap", F.when(name == "", "None").otherwise(name)),
    )).select("page_id", "v.*")


def violations(pages: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(page_id, kind, offender), distinct, of pages (page_id, doc variant).

    Three parts read the region tree, however deep it is: its entries one by one, its ids against the declared order,
    and its blocks against that order. tree: what regions.walk gives for the pages, if it is at hand, as when it was
    written; else each part walks the pages. Ids of a page meet in one grouping by page and id.
    """
    tree = walk(pages) if tree is None else tree
    order = pages.select("page_id", member("doc", "reading_order").alias("value")).where("value is not null")
    is_list = kind(F.col("value")) == "ARRAY"
    entry = order.where(is_list).select("page_id", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("at", "entry"))
    what = F.coalesce(kind(F.col("entry")), F.lit("VOID"))
    odd = order.select("page_id", _told((~is_list, "reading_order_not_a_list", kind(F.col("value"))))).unionByName(
        entry.select("page_id", _told((what != "STRING", "non_string_order_entries", F.concat(F.lit("index "), F.col("at").cast("string"), F.lit(": "), what))))
    ).select("page_id", "v.*")
    once = entry.where(what == "STRING").groupBy("page_id", F.variant_get("entry", "$", "string").alias("region_id")).agg(F.count(F.lit(1)).alias("listed"), F.max("at").alias("at"))
    root_index = F.when((F.size("path") == 1) & kind(member("value", "reading_order_index")).isin(*_WHOLE), F.struct("path", F.try_variant_get("value", "$.reading_order_index", "bigint").alias("index")))
    named = tree.where("object").select("page_id", string_member("value", "id").alias("region_id"), root_index.alias("root"))
    ids = named.where("region_id <> ''").groupBy("page_id", "region_id").agg(F.count(F.lit(1)).alias("found"), F.max("root")["index"].alias("index"))
    has_list = order.where(is_list).select("page_id", F.lit(True).alias("has_list"))
    met = ids.join(once, ["page_id", "region_id"], "full").join(has_list, "page_id", "left")
    both = F.col("index").isNotNull() & F.col("at").isNotNull()
    by_index = Window.partitionBy("page_id", both).orderBy("index", "region_id")
    by_list = Window.partitionBy("page_id", both).orderBy("at")
    ranked = met.withColumn("i", F.when(both, F.row_number().over(by_index))).withColumn("j", F.when(both, F.row_number().over(by_list)))
    by_id = ranked.select("page_id", _told(
        (F.col("found") > 1, "duplicate_region_ids", F.col("region_id")),
        (F.col("listed") > 1, "duplicate_order_entries", F.col("region_id")),
        (F.col("found").isNull(), "order_refs_no_region", F.col("region_id")),
        (F.col("listed").isNull() & F.col("has_list"), "order_omits_regions", F.col("region_id")),
        (F.col("i") != F.col("j"), "order_contradicts_indices", F.col("region_id")),
    )).select("page_id", "v.*")
    return tree_violations(tree).unionByName(odd).unionByName(by_id).unionByName(block_violations(pages, order.where(is_list), tree)).distinct()


def block_violations(pages: DataFrame, listed: DataFrame, tree: DataFrame) -> DataFrame:
    """(page_id, kind, offender) where a declared list is not made of whole blocks: the ids in it that are inside a block, or
    the list itself if there is none. listed (page_id): the pages that declare a list."""
    regions, pages = (rows.join(listed.select("page_id"), "page_id", "left_semi") for rows in (of_tree(tree), pages))
    own = blocks(regions).groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("block"))).alias("ids"), F.collect_set("root_id").alias("roots"))
    broken = canonical(pages, regions).where("not canonical").join(own, "page_id", "left")
    none = F.array().cast("array<string>")
    inner = F.array_distinct(F.array_except(F.array_intersect("declared", F.coalesce("ids", none)), F.coalesce("roots", none)))
    whole = F.array(F.lit("the declared list does not keep root blocks together"))
    return broken.select("page_id", F.lit("order_breaks_block_structure").alias("kind"), F.explode(F.when(F.size(inner) > 0, inner).otherwise(whole)).alias("offender"))


def sorted_offenders(offenders: DataFrame) -> DataFrame:
    """(page_id, kind, n, offenders array<string>): the distinct offenders of each kind and page, in order."""
    return offenders.groupBy("page_id", "kind").agg(F.array_sort(F.collect_set("offender")).alias("offenders")).select("page_id", "kind", F.size("offenders").alias("n"), "offenders")


def contract_check(pages: DataFrame, offenders: DataFrame, side: str) -> DataFrame:
    """One row a page: the number of distinct offenders of each kind as <side>_<kind>, and passed."""
    counts = offenders.groupBy("page_id").pivot("kind", list(KINDS)).agg(F.countDistinct("offender"))
    row = pages.select("page_id").join(counts, "page_id", "left").select("page_id", *[F.coalesce(k, F.lit(0)).alias(f"{side}_{k}") for k in KINDS])
    return row.withColumn("passed", F.expr(" and ".join(f"{side}_{k} = 0" for k in KINDS)))
