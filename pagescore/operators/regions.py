"""Page documents to region rows: tolerant projections, flattening, block structure and reading order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deepest level that is seen; children below it are a violation, never flattened. Fixed value.
DEPTH_CAP = 32
#: Rows and characters of documents after which walk hands its rows on: several pages make a batch, large ones one each.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22
#: Vocabulary of region labels. Fixed values.
NOTE_SEMANTICS = ("note", "footnote", "endnote")
NOTE_LABELS = ("note_area", "note_continuation", "marginal_note", "footnote_area", "endnote_area")
HEADING_LABELS = ("section_header", "title")
BODY_LABELS = ("text_block", "block_quote", "abstract", "list_item")


def kind(value: Column) -> Column:
    """The JSON kind of a variant: STRING, BIGINT, BOOLEAN, VOID (JSON null), ARRAY, OBJECT, ...; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def member(value: str, path: str) -> Column:
    return F.try_variant_get(F.col(value), f"$.{path}", "variant")


def string_member(value: str, path: str) -> Column:
    """A JSON string, else ''."""
    return F.when(kind(member(value, path)) == "STRING", F.try_variant_get(F.col(value), f"$.{path}", "string")).otherwise(F.lit(""))


def strings_member(value: str, path: str) -> Column:
    """The strings of a JSON list, else none."""
    each = F.try_variant_get(F.col(value), f"$.{path}", "array<variant>")
    own = F.transform(F.filter(each, lambda v: kind(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    return F.coalesce(F.when(kind(member(value, path)) == "ARRAY", own), F.array().cast("array<string>"))


def integer_member(value: str, path: str) -> Column:
    """A JSON integer, else null: no boolean, no 1.0."""
    whole = kind(member(value, path)).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    return F.when(whole, F.try_variant_get(F.col(value), f"$.{path}", "bigint"))


def walk(pages: DataFrame, path: str = "regions") -> DataFrame:
    """Every entry of the region tree of pages (page_id, doc variant), in one pass over each document, whatever its depth.

    page_id, path array<int>, parent_id, part, object boolean, below boolean, value variant. part entry: one list entry, without
    its children; object tells that it is one; below tells that it has children deeper than DEPTH_CAP, which are not entered.
    part list: a list of regions that is no list, at the path of its owner. Null lists are passed over.
    """

    kinds = (pa.list_(pa.int32()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string())

    def told(rows: list[tuple], page: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (page, *kinds), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "path", "parent_id", "part", "object", "below", "json"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            length = 0
            for page, text in zip(batch.column(0).to_pylist(), (text.as_py() for text in batch.column(1)), strict=True):
                open_lists = [((), "", json.loads(text))]
                while open_lists:
                    owner, parent, entries = open_lists.pop()
                    if not isinstance(entries, list):
                        if entries is not None:
                            rows.append((page, owner, parent, "list", False, False, json.dumps(entries)))
                        continue
                    for place, entry in enumerate(entries):
                        at, children = (*owner, place), entry.pop("children", None) if isinstance(entry, dict) else None
                        below = children is not None and len(at) > DEPTH_CAP
                        rows.append((page, at, parent, "entry", isinstance(entry, dict), below, json.dumps(entry)))
                        if children is not None and not below:
                            name = entry.get("id")
                            open_lists.append((at, name if isinstance(name, str) else "", children))
                length += len(text)
                if rows and (len(rows) >= BATCH_ROWS or length >= BATCH_CHARS):
                    yield told(rows, batch.column(0).type)
                    rows, length = [], 0
            if rows:
                yield told(rows, batch.column(0).type)

    kind_of_page = pages.schema["page_id"].dataType.simpleString()
    lists = pages.select("page_id", F.to_json(member("doc", path)).alias("json")).where("json is not null")
    rows = lists.mapInArrow(run, f"page_id {kind_of_page}, path array<int>, parent_id string, part string, object boolean, below boolean, json string")
    return rows.withColumn("value", F.parse_json("json")).drop("json")


def is_note(label: Column, semantic: Column) -> Column:
    return F.arrays_overlap(semantic, F.array(*map(F.lit, NOTE_SEMANTICS))) | label.isin(*NOTE_LABELS)


def block_type(label: Column, semantic: Column) -> Column:
    return (
        F.when(is_note(label, semantic), "footnote").when(label.isin(*HEADING_LABELS), "heading").when(label.isin(*BODY_LABELS), "body").otherwise("other")
    )


def project(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Region columns of object entries; fields of a wrong kind count as absent."""
    box = F.array(*[F.try_variant_get(F.col("value"), f"$.bbox.{c}", "double") for c in ("x0", "y0", "x1", "y1")])
    sound = ~F.exists(box, lambda x: x.isNull())  # only an object has members
    typed = rows.select(
        *keep, string_member("value", "id").alias("region_id"), F.lower(string_member("value", "label")).alias("label"), string_member("value", "text").alias("text"),
        F.transform(strings_member("value", "semantic_labels"), F.lower).alias("semantic_labels"), strings_member("value", "text_anchors").alias("text_anchors"),
        integer_member("value", "reading_order_index").alias("reading_order_index"), *[F.when(sound, box[k]).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))],
    )
    return typed.withColumn("is_note", is_note(F.col("label"), F.col("semantic_labels"))).withColumn("block_type", block_type(F.col("label"), F.col("semantic_labels")))


def flatten(pages: DataFrame) -> DataFrame:
    """Region rows of pages (page_id, doc): the tree in depth-first order of `path`, down to DEPTH_CAP.

    page_id, depth, path array<int>, parent_id, and the columns of project. Entries that are no objects, and lists that
    are no lists, are passed over.
    """
    return of_tree(walk(pages))


def of_tree(tree: DataFrame) -> DataFrame:
    """flatten, of a tree that was walked before."""
    objects = tree.where("object").withColumn("depth", F.size("path") - 1)
    return project(objects, ["page_id", "depth", "path", "parent_id"])


def last_by_id(regions: DataFrame, side: list[str]) -> DataFrame:
    """One row for each id of a page, the last in depth-first order; rows without an id go."""
    last = Window.partitionBy(*side, "region_id").orderBy(F.desc("path"))
    return regions.where("region_id <> ''").withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def declared(pages: DataFrame) -> DataFrame:
    """(page_id, declared array<string>): the strings of the page's reading_order list; none if it is no list."""
    return pages.select("page_id", strings_member("doc", "reading_order").alias("declared"))


def blocks(regions: DataFrame) -> DataFrame:
    """(page_id, root_pos, root_id, block array<string>): each root's id and its descendants' ids, depth first."""
    named = regions.groupBy("page_id", F.element_at("path", 1).alias("root_pos")).agg(
        F.array_sort(F.collect_list(F.struct("path", "region_id"))).alias("all"), F.max_by("region_id", -F.col("depth")).alias("root_id")
    )
    ids = F.filter(F.transform("all", lambda x: x["region_id"]), lambda i: i != "")
    return named.select("page_id", "root_pos", "root_id", ids.alias("block"))


def canonical(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, declared, canonical): whether the declared order names whole blocks of named roots, each once, and all regions.

    The blocks, in the order in which the list names their roots, must spell the list; they are built only for pages that
    declare one.
    """
    named = declared(pages)
    listed = regions.join(named.where(F.size("declared") > 0).select("page_id"), "page_id", "left_semi")
    # of roots that share an id the last one's block counts
    root = blocks(listed).where("root_id <> ''").groupBy("page_id", "root_id").agg(F.max_by("block", "root_pos").alias("block"))
    placed = named.select("page_id", F.posexplode("declared").alias("at", "root_id")).groupBy("page_id", "root_id").agg(F.min("at").alias("at"))
    spelled = root.join(placed, ["page_id", "root_id"]).groupBy("page_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda x: x["block"])).alias("spelled")
    )
    every = regions.where("region_id <> ''").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    joined = named.join(spelled, "page_id", "left").join(every, "page_id", "left")
    whole = (F.col("declared") == F.coalesce("spelled", F.array().cast("array<string>"))) & (F.size("declared") == F.coalesce("n", F.lit(0)))
    return joined.select("page_id", "declared", whole.alias("canonical"))


def reading_order(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, signal, region_id, rank): the first occurrence of each id along the one signal that orders the page.

    declared, if that is canonical and not empty; else indices, if a root has one: roots by index, one without at the
    place of the number of roots, ties by place; else array. Descendants follow their root depth first.
    """
    order = canonical(pages, regions).withColumn("by_list", F.col("canonical") & (F.size("declared") > 0))
    roots = regions.where("depth = 0").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_roots"), F.count("reading_order_index").alias("n_indices"))
    signal = order.join(roots, "page_id", "left").select(
        "page_id", "declared", "n_roots", F.when(F.col("by_list"), "declared").when(F.col("n_indices") > 0, "indices").otherwise("array").alias("signal")
    )
    root_index = regions.where("depth = 0").select("page_id", F.element_at("path", 1).alias("root_pos"), F.col("reading_order_index").alias("root_index"), F.col("region_id").alias("root_id"))
    placed = regions.withColumn("root_pos", F.element_at("path", 1)).join(root_index, ["page_id", "root_pos"]).join(signal, "page_id")
    key = (
        F.when(F.col("signal") == "declared", F.array_position("declared", F.col("root_id")))
        .when(F.col("signal") == "indices", F.coalesce("root_index", F.col("n_roots")))
        .otherwise(F.lit(0))
    )
    placed = placed.where("region_id <> ''").withColumn("key", key)
    first = Window.partitionBy("page_id", "region_id").orderBy("key", "root_pos", "path")
    once = placed.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rank = Window.partitionBy("page_id").orderBy("key", "root_pos", "path")
    return once.select("page_id", "signal", "region_id", (F.row_number().over(rank) - 1).alias("rank"))


def full_text(regions: DataFrame, order: DataFrame) -> DataFrame:
    """(page_id, full_text): the non-empty texts in reading order, a line each; regions without a rank last."""
    ranked = regions.join(order.select("page_id", "region_id", "rank"), ["page_id", "region_id"], "left").where("text <> ''")
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("r"), "path", "text")))
    return ranked.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("full_text"))
