"""The suite over page documents: ground truth and candidates, paired by page_id."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescore.functions.text import rounded
from pagescore.operators import contract, fidelity, order, regions, scorecard, structure
from pagescore.operators.alignment import align
from pagescore.sources.stored import stored

SIDES = ("candidate", "gt")


def contracts(gt: DataFrame, cand: DataFrame, gt_tree: DataFrame | None = None, cand_tree: DataFrame | None = None) -> DataFrame:
    """One row a ground-truth page: the counts of contract violations of both documents, detail, and passed. The trees are
    those that regions.walk gives, if they are at hand. A page without a candidate has none of its violations."""
    found = contract.violations(cand, cand_tree).withColumn("side", F.lit("candidate")).unionByName(contract.violations(gt, gt_tree).withColumn("side", F.lit("gt")))
    # a row for each side, kind and page, with few ids in it
    each = found.groupBy("page_id", "side", "kind").agg(F.array_sort(F.collect_set("offender")).alias("ids"))
    place = F.array_position(F.array(*map(F.lit, contract.KINDS)), F.col("kind"))
    told = F.concat("side", F.lit(" "), "kind", F.lit(" ["), F.array_join("ids", ", "), F.lit("]"))
    count = lambda side, kind: F.coalesce(F.max(F.when((F.col("side") == side) & (F.col("kind") == kind), F.size("ids"))), F.lit(0)).cast("long").alias(f"{side}_{kind}")
    row = each.groupBy("page_id").agg(*[count(s, k) for s in ("gt", "candidate") for k in contract.KINDS], listed(F.struct("side", place, told.alias("told")), "told", "; ").alias("detail"))
    names = [f"{s}_{k}" for s in ("gt", "candidate") for k in contract.KINDS]
    full = gt.select("page_id").join(row, "page_id", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names]
    return full.select("page_id", *zero, F.coalesce("detail", F.lit("both documents keep the contract")).alias("detail"), F.col("detail").isNull().alias("passed"))


def listed(entry: Column, field: str, mark: str = ", ") -> Column:
    """A group's entries in order, their `field` joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x[field]), mark)


def _more(label: str, column: str) -> Column:
    """What a detail adds where a list has something in it."""
    return F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(f"; {label}: "), F.col(column))).otherwise(F.lit(""))


def text_verdicts(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """Text fidelity under its metrics' names, with the regions that fail in detail."""
    own, other = fidelity.normed(gt), fidelity.normed(cand)
    aligned = stored(fidelity.aligned_norm(own, other, mapping), "aligned")
    counted = stored(fidelity.compared(own, aligned, other), "counted")
    kept, moved = fidelity.region_figures(counted, aligned)
    kept = stored(kept, "kept")
    gate = fidelity.text_gate(fidelity.page_figures(counted), kept, moved)
    short = kept.where(F.col("retention") < fidelity.MIN_RETENTION).groupBy("page_id").agg(listed(F.struct("retention", "region_id"), "region_id").alias("short"))
    away = moved.where(F.col("foreign_ratio") > fidelity.MAX_FOREIGN).groupBy("page_id").agg(listed(F.struct((-F.col("foreign_ratio")).alias("r"), "region_id"), "region_id").alias("away"))
    said = F.concat(
        F.lit("contained "), "contained", F.lit(" of "), "gt_ngrams", F.lit(" n-grams; of "), "regions_scored", F.lit(" regions "), "gross", F.lit(" gross and "), "minor", F.lit(" minor defects ("), "minor_allowed",
        F.lit(" allowed), "), "misplaced", F.lit(" misplaced"), _more("short of text", "short"), _more("misplaced", "away"),
    )
    row = gate.join(short, "page_id", "left").join(away, "page_id", "left")
    return row.select(
        "page_id", "n", "gt_ngrams", "contained", "regions_scored", (F.col("gross") + F.col("minor")).alias("region_defects"), F.col("gross").alias("gross_region_defects"), F.col("minor").alias("minor_region_defects"),
        F.col("minor_allowed").alias("minor_region_defects_allowed"), F.col("misplaced").alias("misplaced_regions"), "reward_ready", F.lit("the region-defect aggregate is not weighted by magnitude").alias("reward_block_reason"),
        F.lit(fidelity.MIN_RETENTION).alias("min_region_retention"), F.lit(fidelity.GROSS_RETENTION).alias("gross_region_retention"), F.col("worst_retention").alias("worst_region_retention"), "containment",
        F.lit(fidelity.MIN_CONTAINMENT).alias("min_containment"), F.col("precision_").alias("precision"), F.col("excess").alias("excess_ngrams"), said.alias("detail"), "passed",
    )


def order_verdicts(gt_order: DataFrame, cand_order: DataFrame, mapping: DataFrame) -> DataFrame:
    """Reading order under its metrics' names, with the signals that order each side."""
    placed = order.positions(gt_order, cand_order, mapping)
    lost = placed.where("cand_pos is null").groupBy("page_id").agg(listed(F.struct("pos", "gt_id"), "gt_id").alias("lost"))
    signal = lambda rows, name: rows.groupBy("page_id").agg(F.first("signal").alias(name))  # noqa: E731 - the same on all rows of a page
    row = order.order_check(placed).join(lost, "page_id", "left").join(signal(gt_order, "gt_order_signal"), "page_id", "left").join(signal(cand_order, "order_signal"), "page_id", "left")
    said = F.concat("n_shared", F.lit(" of "), F.col("n_shared") + F.col("missing"), F.lit(" regions placed, "), "concordant", F.lit(" pairs in order and "), "discordant", F.lit(" not"), _more("without a place", "lost"))
    return row.select("page_id", "n_shared", "coverage", F.col("tau").alias("kendall_tau"), "lis_ratio", "missing", "order_signal", "gt_order_signal", said.alias("detail"), "passed")


def note_verdicts(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """Notes and anchors, with the notes that are missing or of another type."""
    note = structure.counterparts(gt, cand, mapping, ["is_note"]).where("is_note").withColumn("state", F.when(~F.col("c_found"), "missing").when(~F.col("c_is_note"), "mistyped"))
    ids = lambda state: listed(F.when(F.col("state") == state, F.struct("region_id")), "region_id").alias(state)
    lost = note.groupBy("page_id").agg(ids("missing"), ids("mistyped"))
    row = structure.anchor_check(gt, cand, mapping).join(lost, "page_id", "left")
    said = F.concat("notes_matched", F.lit(" of "), "gt_notes", F.lit(" notes matched, "), "spans_preserved", F.lit(" of "), "gt_spans", F.lit(" anchors kept"), _more("missing notes", "missing"), _more("notes of another type", "mistyped"))
    return row.withColumn("detail", said).drop("missing", "mistyped")


def type_verdicts(gt: DataFrame, cand: DataFrame, mapping: DataFrame) -> DataFrame:
    """Block types, F1 rounded to four places, of all types and of each that a page has."""
    counts = structure.type_counts(gt, cand, mapping)
    each = counts.groupBy("page_id").agg(*[rounded(F.max(F.when(F.col("block_type") == t, structure.type_f1())), 4).alias(f"{t}_f1") for t in ("body", "footnote", "heading", "other")])
    said = F.concat("type_errors", F.lit(" type errors: "), "false_positives", F.lit(" false positives, "), "false_negatives", F.lit(" false negatives"))
    row = structure.type_check(counts).join(each, "page_id")
    return row.withColumn("micro_f1", rounded(F.col("micro_f1"), 4)).withColumn("macro_f1", rounded(F.col("macro_f1"), 4)).withColumn("detail", said)


def score(gt: DataFrame, cand: DataFrame) -> DataFrame:
    """Verdicts (scorecard.RESULT) of the suite on every ground-truth page; both sides: page_id, doc variant, a row a page, and
    error, the name of what is wrong with a page (sources.pages.parse_pages), if there is such a column.

    A page with an error on either side, or without a candidate (MissingCandidate), crashes every check and touches no
    other page; candidates without ground truth take no part. Documents, region trees, regions and the alignment are written once.
    """
    side = lambda df, name: df.select("page_id", F.col("doc").alias(name), (F.col("error") if "error" in df.columns else F.lit(None).cast("string")).alias(f"{name}_error"))
    paired = side(gt, "gt").join(side(cand, "cand").withColumn("_found", F.lit(True)), "page_id", "left")
    error = F.coalesce("gt_error", "cand_error", F.when(F.col("_found").isNull(), "MissingCandidate"), F.when(F.col("gt").isNull() | F.col("cand").isNull(), "NotAnObject"))
    paired = stored(paired.select("page_id", "gt", "cand", error.alias("error")), "pages")
    sound = paired.where("error is null")
    known, made = (sound.select("page_id", F.col(c).alias("doc")) for c in ("gt", "cand"))
    with ThreadPoolExecutor(2) as threads:  # the two sides at once
        gt_tree, cand_tree = threads.map(lambda side: stored(regions.walk(side[0]), side[1]), ((known, "gt_tree"), (made, "cand_tree")))
        all_gt, all_cand = threads.map(lambda side: stored(fidelity.normed(regions.of_tree(side[0])), side[1]), ((gt_tree, "gt"), (cand_tree, "cand")))
    own_gt, own_cand = regions.last_by_id(all_gt, ["page_id"]), stored(regions.last_by_id(all_cand, ["page_id"]), "own_cand")
    mapping = stored(align(own_gt, own_cand), "mapping")
    # a sound page without regions has no rows there, but a verdict nevertheless
    empty = lambda rows, **values: known.select("page_id").join(rows, "page_id", "left").select(
        "page_id", *[F.coalesce(c, F.lit(values[c]).cast(rows.schema[c].dataType)).alias(c) if c in values else F.col(c) for c in rows.columns if c != "page_id"]
    )
    runs = (
        lambda: contracts(known, made, gt_tree, cand_tree),
        lambda: empty(text_verdicts(all_gt, own_cand, mapping), **NOTHING["text-fidelity"]),
        lambda: empty(order_verdicts(regions.reading_order(known, all_gt), regions.reading_order(made, all_cand), mapping), **NOTHING["reading-order"]),
        lambda: empty(note_verdicts(all_gt, own_cand, mapping), **NOTHING["footnote-anchor"]),
        lambda: empty(type_verdicts(all_gt, all_cand, mapping), **NOTHING["structure-typing"]),
    )
    return scorecard.run_suite([scorecard.Checker(name, run) for name, run in zip(scorecard.SUITE, runs, strict=True)], paired.select("page_id", "error"), stored)


#: Verdicts where a page has no region to judge: nothing is wrong with it.
NOTHING: dict[str, dict] = {
    "text-fidelity": {
        "n": 1, "gt_ngrams": 0, "contained": 0, "regions_scored": 0, "region_defects": 0, "gross_region_defects": 0, "minor_region_defects": 0, "minor_region_defects_allowed": 0, "misplaced_regions": 0,
        "reward_ready": False, "containment": 1.0, "precision": 1.0, "excess_ngrams": 0, "detail": "no text to contain", "passed": True,
    },
    "reading-order": {"n_shared": 0, "coverage": 1.0, "kendall_tau": 1.0, "lis_ratio": 1.0, "missing": 0, "order_signal": "array", "gt_order_signal": "array", "detail": "no regions to place", "passed": True},
    "footnote-anchor": {"gt_notes": 0, "notes_matched": 0, "missing_notes": 0, "mistyped_notes": 0, "gt_spans": 0, "spans_preserved": 0, "span_defects": 0, "spans_skipped": 0, "detail": "no notes", "passed": True},
    "structure-typing": {"type_errors": 0, "false_positives": 0, "false_negatives": 0, "micro_f1": 0.0, "macro_f1": 0.0, "detail": "no regions to type", "passed": True},
}
