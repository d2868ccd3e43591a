"""Precision, recall and F1 by type, micro and macro, with error counts and comparison to a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescore.functions.geometry import ratio
from pagescore.functions.text import in_places


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1); 0 where nothing was predicted, expected, or either is 0."""
    precision, recall = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return precision, recall, F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))


def match_metrics(matches: DataFrame, by: list[str]) -> DataFrame:
    """From matches (match_type, text_similarity, position_similarity): counts, rates, mean similarities and support."""
    hit = F.col("match_type").isin("exact", "partial")
    counted = matches.groupBy(*by).agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("match_type") == "spurious").alias("fp"), F.count_if(F.col("match_type") == "missed").alias("fn"),
        F.count_if(F.col("match_type") == "exact").alias("exact"), F.count_if(F.col("match_type") == "partial").alias("partial"),
        F.coalesce(F.sum(F.when(hit, F.col("text_similarity"))), F.lit(0.0)).alias("text_sum"), F.coalesce(F.sum(F.when(hit, F.col("position_similarity"))), F.lit(0.0)).alias("position_sum"),
    )
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select(
        *by, "tp", "fp", "fn", "exact", "partial", p.alias("precision_"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"),
        ratio(F.col("text_sum"), F.col("tp"), 0.0).alias("mean_text_similarity"), ratio(F.col("position_sum"), F.col("tp"), 0.0).alias("mean_position_similarity"),
    )


def micro_macro(by_type: DataFrame, by: list[str]) -> DataFrame:
    """Micro rates of summed counts and macro means over types, from rows (tp, fp, fn) a type."""
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    summed = by_type.select(*by, "tp", "fp", "fn", p.alias("p"), r.alias("r"), f.alias("f")).groupBy(*by).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1")
    )
    return summed.select(*by, "tp", "fp", "fn", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")


def by_level(rows: DataFrame, run: str, kind: str, hit: str, extra: str, lost: str) -> DataFrame:
    """(run, type, tp, fp, fn, precision_, recall, f1, macro_precision, macro_recall, macro_f1) of rows with three flags, at two levels of
    one grouping: a row for each run and type, with null macro means, and one for each run (type null), whose rates are micro.

    The rows are read and shuffled once, by grouping sets; the means over types come from the first level's few rows.
    """
    counts = [F.count_if(F.col(c)).alias(name) for c, name in ((hit, "tp"), (extra, "fp"), (lost, "fn"))]
    levels = rows.groupingSets([[F.col(run), F.col(kind)], [F.col(run)]], F.col(run), F.col(kind)).agg(*counts, F.grouping(F.col(kind)).alias("_whole"))
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    rated = levels.select(F.col(run).alias("run"), F.col(kind).alias("type"), "_whole", "tp", "fp", "fn", p.alias("precision_"), r.alias("recall"), f.alias("f1"))
    types = Window.partitionBy("run")
    mean = lambda c: F.when(F.col("_whole") == 1, F.coalesce(F.avg(F.when(F.col("_whole") == 0, F.col(c))).over(types), F.lit(0.0)))
    return rated.select("run", "type", "tp", "fp", "fn", "precision_", "recall", "f1", mean("precision_").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"))


def error_counts(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, error, n, first_seen): the error keys of partial matches, and missed_<reason>, spurious_<reason>. first_seen is where
    one comes first, in the order of documents and of their matches (matching.match_elements)."""
    reason = F.coalesce(F.try_element_at("error_details", F.lit("reason")), F.lit("unknown"))
    keys = (
        F.when(F.col("match_type") == "partial", F.map_keys(F.coalesce("error_details", F.create_map().cast("map<string,string>"))))
        .when(F.col("match_type").isin("missed", "spurious"), F.array(F.concat_ws("_", "match_type", reason)))
    )
    each = matches.select(*by, "doc_id", "phase", "pos", F.posexplode(keys).alias("place", "error"))
    return each.groupBy(*by, "error").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "phase", "pos", "place")).alias("first_seen"))


def top_errors(errors: DataFrame, k: int, by: str = "element_type") -> DataFrame:
    """The k most frequent errors over all types, from error_counts by type. Ties go to what was seen first: types by name, and
    within a type by first_seen."""
    total = errors.groupBy("error").agg(F.sum("n").alias("n"), F.min(F.struct(by, "first_seen")).alias("_seen"))
    return total.orderBy(F.desc("n"), "_seen").limit(k).select("error", "n")


def baseline_delta(now: DataFrame, baseline: DataFrame, by: str) -> DataFrame:
    """(by, f1, baseline_f1, delta, shown): delta only where the baseline has the type; shown with its sign."""
    old = baseline.select(by, F.col("f1").alias("baseline_f1"))
    delta = F.col("f1") - F.col("baseline_f1")
    shown = F.concat(F.when(delta > 0, "+").otherwise(""), in_places(F.array(delta), 3)[0])
    return now.select(by, "f1").join(old, by, "left").select(by, "f1", "baseline_f1", delta.alias("delta"), F.when(delta.isNotNull(), shown).alias("shown"))


def status_class(f1: Column) -> Column:
    return F.when(f1 >= 0.9, "good").when(f1 >= 0.7, "ok").otherwise("bad")


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_first = 1").drop("_first")
