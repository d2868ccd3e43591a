"""Page documents from JSON files, ground-truth elements from YAML, event logs from JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """parse_pages of files: one JSON object a file; page_id is the file's name without extension. A file of no bytes at all is
    passed over by Spark's scan, so it is no page."""
    files = spark.read.format("binaryFile").load(path)  # so that one that is no UTF-8 has a null value
    return parse_pages(files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("page_id"), F.try_validate_utf8(F.col("content").cast("string")).alias("value")))


class RepeatedKey(ValueError):
    """An object has a key twice."""


class NotFinite(ValueError):
    """NaN or Infinity, which are no JSON."""


class NotAnObject(ValueError):
    """The root is something else."""


def page_error(text: str | None) -> str:
    """The name of what keeps a text from being a page: of the exception that a strict reader raises."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise RepeatedKey
        return dict(pairs)

    def finite(name: str) -> float:
        raise NotFinite(name)

    try:
        if not isinstance(json.loads(text or "", object_pairs_hook=once, parse_constant=finite), dict):
            raise NotAnObject
    except (ValueError, RecursionError) as raised:
        return type(raised).__name__
    return "Unreadable"  # the strict reader takes it, but Spark's parser doesn't: nested too deep, or too long


def parse_pages(raw: DataFrame) -> DataFrame:
    """(page_id, doc variant, error string) of raw (page_id, value string).

    A value that is no JSON object has no doc, and the name of what is wrong as its error; all others have a null error.
    NaN and repeated keys are no JSON. Only faulty values are read again to name their error.
    """
    parsed = raw.select("page_id", "value", F.try_parse_json("value").alias("doc"))
    sound = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    named = F.pandas_udf(lambda texts: texts.map(lambda t: None if t == "" else page_error(t[1:])), "string")
    fault = named(F.when(sound, F.lit("")).otherwise(F.concat(F.lit(">"), F.coalesce("value", F.lit("")))))
    return parsed.select("page_id", F.when(sound, F.col("doc")).alias("doc"), fault.alias("error"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line long, raw, event variant) of JSON-lines files, numbered within each file; event is null for a line that is no JSON.

    Files are read in splits. A split's lines are numbered by the task that reads it, and its first line by the counts of
    the splits before it, a row for each split. Blank lines are passed over, but counted.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("at")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", at, F.monotonically_increasing_id().alias("n"))
    splits = rows.groupBy("at").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("at.file").orderBy("at.block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    numbered = rows.join(splits, "at").select((F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), F.col("value").alias("raw"))
    return numbered.where(F.trim("raw") != "").select("line", "raw", F.try_parse_json("raw").alias("event"))


def primary_page(pages: Column) -> Column:
    """An element's first page, -1 if it has none."""
    return F.coalesce(F.try_element_at(pages, F.lit(1)), F.lit(-1))


ELEMENT = (
    "element_type string, element_id string, pages array<int>, text string, marker_text string, marker_page int, "
    "char_offset int, char_length int, attributes map<string,string>, tags array<string>"
)
#: Keys of the element kinds in a document, in the order in which they are read.
KINDS = (("footnotes", "footnote"), ("citations", "citation"), ("marginal_refs", "marginal_ref"), ("page_numbers", "page_number"), ("sous_rature", "sous_rature"))


def element_row(kind: str, item: dict) -> dict:
    """One element of a document as a row of ELEMENT, with the format's defaults for what is missing."""
    own = {k: item.get(k) for k in ("id", "page", "region_id", "char_offset", "tags")}
    page = own["page"] if own["page"] is not None else -1
    row = {"element_type": kind, "element_id": own["id"] or "unknown", "pages": [page], "text": "", "marker_text": None, "marker_page": None, "char_offset": own["char_offset"], "char_length": None, "tags": own["tags"] or []}
    if kind == "footnote":
        marker, pages = item.get("marker") or {}, item.get("pages") or []
        mark = marker.get("text")
        row |= {"pages": pages, "text": " ".join(part.get("text", "") for part in item.get("content") or []).strip(), "marker_text": mark, "marker_page": marker.get("page"), "char_offset": marker.get("char_offset"), "char_length": len(mark or "")}
        more = {"note_type": item.get("note_type", "author"), "is_multi_page": len(pages) > 1, "region_id": marker.get("region_id")}
    elif kind == "citation":
        raw, parsed = item.get("raw") or "", item.get("parsed") or {}
        row |= {"text": raw, "char_length": len(raw)}
        more = {"style": parsed.get("style", "unknown"), "authors": parsed.get("authors") or [], "year": parsed.get("year"), "pages": parsed.get("pages"), "region_id": own["region_id"], "bib_entry_id": item.get("bib_entry_id")}
    elif kind == "marginal_ref":
        markers = item.get("markers") or []
        texts, on = [m.get("text") or "" for m in markers], [m["page"] for m in markers if m.get("page") is not None]
        row |= {"pages": on or [-1], "text": " ".join(texts), "marker_text": next(iter(texts), None), "marker_page": next(iter(on), None), "char_offset": None}
        more = {"system": item.get("system", "custom")}
    elif kind == "page_number":
        row |= {"element_id": f"pn_{page}", "text": str(item.get("displayed", "")), "char_offset": None, "tags": []}
        more = {"normalized": item.get("normalized"), "format": item.get("format", "arabic"), "position": item.get("position", "footer")}
    else:
        row |= {"text": item.get("text") or "", "char_length": item.get("char_length")}
        more = {"display_form": item.get("display_form"), "context": item.get("context"), "region_id": own["region_id"]}
    return row | {"attributes": {k: json.dumps(v, ensure_ascii=False) for k, v in more.items()}}


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(source, position, ELEMENT) rows of YAML documents, in the order of KINDS; attributes are JSON. A missing path fails."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in batches:
            rows = []
            for source, value in zip(part["source"], part["value"], strict=True):
                elements = (yaml.safe_load(value) or {}).get("elements") or {}
                found = [element_row(kind, item) for key, kind in KINDS for item in elements.get(key) or []]
                rows += [{"source": source, "position": k} | row for k, row in enumerate(found)]
            yield pd.DataFrame(rows, columns=["source", "position", *[c.split()[0] for c in ELEMENT.split(", ")]])

    return files.mapInPandas(parse, f"source string, position int, {ELEMENT}")


def on_page(rows: DataFrame, page_spans: DataFrame) -> DataFrame:
    """Rows (doc_id, offset, ...) with the page whose span, start <= offset < end, holds the offset, else null. Where spans
    overlap, the row comes once for each. Empty spans hold nothing.

    A join of equal documents and bins: a bin is as wide as a document's spans are on average, so its spans lie in twice as
    many bins as there are spans at most, and an offset in one. A document's offsets and spans do not all meet.
    """
    spans = page_spans.where(F.col("end") > F.col("start")).select(F.col("doc_id").alias("_doc"), "page", F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"))
    width = spans.groupBy("_doc").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("_end") - F.col("_start")) / F.count(F.lit(1)))).cast("long").alias("_width"))
    bin_of = lambda at: F.floor(at / F.col("_width"))
    binned = spans.join(width, "_doc").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_start")), bin_of(F.col("_end") - 1)))).drop("_width")
    placed = rows.join(width.withColumnRenamed("_doc", "_of"), F.col("doc_id") == F.col("_of"), "left").withColumn("_at", bin_of(F.col("offset")))
    inside = (F.col("doc_id") == F.col("_doc")) & (F.col("_at") == F.col("_bin")) & (F.col("offset") >= F.col("_start")) & (F.col("offset") < F.col("_end"))
    return placed.join(binned, inside, "left").select(*rows.columns, "page")


def _pages_of() -> Column:
    return F.when(F.col("page").isNotNull(), F.array("page")).otherwise(F.array().cast("array<int>"))


def from_notes(notes: DataFrame, references: DataFrame, page_spans: DataFrame) -> DataFrame:
    """Footnote elements of a pipeline document: doc_id, element_id, text, pages, marker_text, marker_page, char_offset,
    char_length, attributes (JSON values).

    notes (doc_id, position, label, text, note_type): the last of a label holds. references (doc_id, label, offset).
    page_spans (doc_id, page, start, end): a reference outside of all has no page, and marker_page -1.
    """
    last = notes.groupBy("doc_id", "label").agg(F.max_by(F.struct("text", "note_type"), "position").alias("note"))
    return on_page(references, page_spans).join(last, ["doc_id", "label"], "left").select(
        "doc_id", F.concat(F.lit("fn_"), "label").alias("element_id"), F.coalesce("note.text", F.lit("")).alias("text"), _pages_of().alias("pages"),
        F.col("label").alias("marker_text"), F.coalesce("page", F.lit(-1)).alias("marker_page"), F.col("offset").alias("char_offset"), F.length("label").alias("char_length"),
        F.create_map(F.lit("note_type"), F.concat(F.lit('"'), F.coalesce("note.note_type", F.lit("author")), F.lit('"')), F.lit("is_multi_page"), F.lit("false")).alias("attributes"),
    )


def from_citations(citations: DataFrame, page_spans: DataFrame) -> DataFrame:
    """Citation elements of a pipeline document: doc_id, element_id, text, pages, char_offset, char_length, attributes.

    citations (doc_id, offset, raw, parsed): parsed is a map of JSON values, null if the citation wasn't parsed."""
    return on_page(citations, page_spans).select(
        "doc_id", F.concat(F.lit("cite_"), F.col("offset").cast("string")).alias("element_id"), F.col("raw").alias("text"), _pages_of().alias("pages"),
        F.col("offset").alias("char_offset"), F.length("raw").alias("char_length"), F.coalesce("parsed", F.create_map().cast("map<string,string>")).alias("attributes"),
    )
