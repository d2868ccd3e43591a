"""Notes, anchors and block types of aligned regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescore.functions.geometry import ratio
from pagescore.functions.text import occurrences


def counterparts(gt: DataFrame, cand: DataFrame, mapping: DataFrame, carry: list[str]) -> DataFrame:
    """Ground-truth regions with the `carry` columns of their counterparts as c_<name>; c_found tells if there is one."""
    other = cand.select("page_id", F.col("region_id").alias("cand_id"), *[F.col(c).alias(f"c_{c}") for c in carry], F.lit(True).alias("c_found"))
    mapped = gt.join(mapping.select("page_id", F.col("gt_id").alias("region_id"), "cand_id"), ["page_id", "region_id"], "left")
    return mapped.join(other, ["page_id", "cand_id"], "left").withColumn("c_found", F.coalesce("c_found", F.lit(False)))


def note_presence(paired: DataFrame) -> DataFrame:
    """(page_id, gt_notes, notes_matched, missing_notes, mistyped_notes) from counterparts that carry is_note."""
    note = F.col("is_note")
    return paired.groupBy("page_id").agg(
        F.count_if(note).alias("gt_notes"), F.count_if(note & F.col("c_found") & F.col("c_is_note")).alias("notes_matched"),
        F.count_if(note & ~F.col("c_found")).alias("missing_notes"), F.count_if(note & F.col("c_found") & ~F.col("c_is_note")).alias("mistyped_notes"),
    )


def spans(paired: DataFrame) -> DataFrame:
    """(page_id, region_id, marker, gt_count, cand_count, state) for each declared anchor of counterparts that carry text.

    state: skipped if the region's own text lacks it; else missing, preserved, under or duplicated.
    """
    each = paired.select("page_id", "region_id", F.explode("text_anchors").alias("marker"), "text", "c_text", "c_found")
    counted = each.withColumn("gt_count", occurrences(F.col("text"), F.col("marker"))).withColumn("cand_count", F.when(F.col("c_found"), occurrences(F.col("c_text"), F.col("marker"))))
    state = (
        F.when(F.col("gt_count") == 0, "skipped").when(~F.col("c_found"), "missing").when(F.col("cand_count") == F.col("gt_count"), "preserved")
        .when(F.col("cand_count") < F.col("gt_count"), "under").otherwise("duplicated")
    )
    return counted.select("page_id", "region_id", "marker", "gt_count", "cand_count", state.alias("state"))


def anchor_check(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a page: note and span counts, and passed."""
    paired = counterparts(gt, cand, mapping, ["text", "is_note"])
    told = spans(paired).groupBy("page_id").agg(
        F.count_if(F.col("state") != "skipped").alias("gt_spans"), F.count_if(F.col("state") == "preserved").alias("spans_preserved"),
        F.count_if(F.col("state").isin("missing", "under", "duplicated")).alias("span_defects"), F.count_if(F.col("state") == "skipped").alias("spans_skipped"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gt_spans", "spans_preserved", "span_defects", "spans_skipped")]
    row = note_presence(paired).join(told, "page_id", "left").select("page_id", "gt_notes", "notes_matched", "missing_notes", "mistyped_notes", *zero)
    return row.withColumn("passed", F.expr("missing_notes = 0 and mistyped_notes = 0 and span_defects = 0"))


def type_counts(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """(page_id, block_type, tp, fp, fn): a type is right if the counterpart has it; all else is missed or too much.

    Regions without an id are never aligned.
    """
    forth = counterparts(gt, cand, mapping, ["block_type"]).withColumn("hit", F.coalesce(F.col("c_block_type") == F.col("block_type"), F.lit(False)))
    back = mapping.where("cand_id is not null").select("page_id", F.col("cand_id").alias("gt_id"), F.col("gt_id").alias("cand_id"))
    other = counterparts(cand, gt, back, ["block_type"]).withColumn("hit", F.coalesce(F.col("c_block_type") == F.col("block_type"), F.lit(False)))
    a = forth.select("page_id", "block_type", F.col("hit").cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.col("hit")).cast("int").alias("fn"))
    b = other.select("page_id", "block_type", F.lit(0).alias("tp"), (~F.col("hit")).cast("int").alias("fp"), F.lit(0).alias("fn"))
    return a.unionByName(b).groupBy("page_id", "block_type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def type_f1() -> Column:
    """F1 of a row of type_counts."""
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 0.0)


def type_check(counts: DataFrame, max_type_errors: int = 0) -> DataFrame:
    """One row a page: false_positives, false_negatives, type_errors, micro_f1, macro_f1, passed.

    macro_f1 is rounded to 12 places, so that it does not hang on the order in which types are summed up.
    """
    row = counts.groupBy("page_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("false_positives"), F.sum("fn").alias("false_negatives"), F.round(F.avg(type_f1()), 12).alias("macro_f1"))
    errors = F.col("false_positives") + F.col("false_negatives")
    return row.select("page_id", "false_positives", "false_negatives", errors.alias("type_errors"), ratio(2 * F.col("tp"), 2 * F.col("tp") + errors, 0.0).alias("micro_f1"), "macro_f1").withColumn(
        "passed", F.col("type_errors") <= max_type_errors
    )
