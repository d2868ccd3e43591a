"""Mixing sources to target weights along a curriculum whose weights vary over training time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagescore.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating, and the budget as a part of all sizes.
WEIGHTS, BUDGET, REPEATS = (3, 1, 2), 1.5, 2
#: Each weight's course over training time 0 to 1, as (time, factor) knots joined by straight lines: early, even, late.
COURSES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hexadecimal digits of the key's hash that make up a bin: cumulative sizes are sums over earlier bins plus a sum in one's own.
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): add course int and target double.

    The budget is shared by weight; no target is above REPEATS times its source's size, and what that leaves over is
    reshared by weight among the others. So a target is the lower of that limit and its weight times one common level,
    which is found over the sources in order of limit to weight. One row for each source, null last; an empty or
    all-empty table has targets 0.
    """
    n = len(WEIGHTS)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_place", ((F.row_number().over(by_name) - 1) % n).cast("int")).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), F.col("_place") + 1)
    ).withColumn("_limit", F.lit(REPEATS).cast("long") * F.col("source_size"))
    by_fill = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    later = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "_level",
        (F.lit(BUDGET) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0))) / F.sum("_weight").over(later),
    ).withColumn("_fill", F.row_number().over(by_fill))
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct("_fill", "_level"))).over(Window.partitionBy())
    return levels.withColumn("_common", level["_level"]).select(
        "source", "source_size", F.col("_place").alias("course"),
        F.least(F.col("_limit").cast("double"), F.col("_common") * F.col("_weight")).alias("target"),
    )


def time_of(course: Column, share: Column) -> Column:
    """The training time by which a source has met `share` (0 to 1) of its demand: its weight's integral, inverted.

    On a straight piece the integral is a quadratic; its root is taken in the form that has no cancellation.
    """
    out = F.lit(None).cast("double")
    for place, knots in enumerate(COURSES):
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
            rest = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))
            root = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest, F.lit(0.0))))
            out = F.when((course == place) & (share * F.lit(total) >= F.lit(done)), root).otherwise(out)
            done += area
    return out


def mix(df: DataFrame, key: str, size: str, source: str = "source") -> DataFrame:
    """One row for each row of df: source_size long, target double, taken long, positions array<struct<position, words, pass>>.

    The rows of a source follow one another in order of their key's MD5 (then key and size, nulls first), pass after
    pass, until the source's target, rounded down, is reached; the last row taken is taken in part. A take's position is
    the training time by which the source's demand has come to the take's first word. A null or repeated key takes its
    place among the others; a null source is a source; a null size counts as 0; a row without words is not taken. An
    empty table gives an empty result. Other columns pass through; names that start with _mix_ are used here, and
    columns named as the results are replaced.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = df.select(
        *[c for c in df.columns if c.lower() not in ("source_size", "target", "taken", "positions")],
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_mix_size"), digest.alias("_mix_hash"),
        F.substring(digest, 1, BIN_DIGITS).alias("_mix_bin"), F.col(source).alias("_mix_source"),
    )
    bins = rows.groupBy("_mix_source", "_mix_bin").agg(F.sum("_mix_size").alias("_mix_in_bin"))
    before = Window.partitionBy("_mix_source").orderBy("_mix_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bins.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_in_bin").alias("source_size"))
    goals = targets(sizes).select(F.col("source").alias("_mix_goal"), "source_size", "course", "target")
    # 16**BIN_DIGITS rows for each source at most
    bins = bins.withColumn("_mix_before", F.coalesce(F.sum("_mix_in_bin").over(before), F.lit(0)))
    bins = bins.join(goals, bins["_mix_source"].eqNullSafe(goals["_mix_goal"])).select(
        F.col("_mix_source").alias("_mix_s"), F.col("_mix_bin").alias("_mix_b"), "_mix_before", "source_size", "course", "target"
    )
    inside = Window.partitionBy("_mix_source", "_mix_bin").orderBy("_mix_hash", key, "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bins, F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_bin") == F.col("_mix_b"))).withColumn(
        "_mix_at", F.col("_mix_before") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    )

    def take(number: int) -> Column:
        first = F.col("_mix_at") + F.lit(number) * F.col("source_size")
        words = F.least(F.greatest(F.floor("target") - first, F.lit(0)), F.col("_mix_size"))
        at = time_of(F.col("course"), first.cast("double") / F.col("target"))
        return F.when(words > 0, F.struct(at.alias("position"), words.alias("words"), F.lit(number).alias("pass")))

    kept = [c for c in rows.columns if not c.startswith("_mix_")]
    return placed.withColumn("positions", F.filter(F.array(*[take(k) for k in range(REPEATS)]), lambda x: x.isNotNull())).select(
        *kept, "source_size", "target", F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), "positions"
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each take, with its position, range-sorted by position: file after file, and inside the files."""
    takes = mixed.withColumn("take", F.explode("positions")).withColumn("position", F.col("take.position"))
    return takes.repartitionByRange("position").sortWithinPartitions("position")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed; range-sorted by the position of their first take, those not taken first (null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(docs, "doc_id", "size")
    first = F.try_element_at("positions", F.lit(1))["position"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP4_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place, 2 * source_size AS cap FROM s),
v AS (SELECT *, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS fill,
        (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM v),
c AS (SELECT min_by(level, fill) FILTER (level * weight <= cap) AS common FROM l),
g AS (SELECT source, source_size, place, least(CAST(cap AS DOUBLE), common * weight) AS target FROM l, c),
p AS (SELECT d.doc_id, d.size, g.source_size, g.place, g.target,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, least(greatest(CAST(floor(target) AS BIGINT) - a, 0), size) AS t1,
        least(greatest(CAST(floor(target) AS BIGINT) - a - source_size, 0), size) AS t2, CAST(a AS DOUBLE) / target AS share FROM p)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
  CASE WHEN t1 > 0 THEN CASE place WHEN 0 THEN 2.0::DOUBLE * share / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * share, 0.0::DOUBLE)))
    WHEN 1 THEN 2.0::DOUBLE * share / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 0.0::DOUBLE * share, 0.0::DOUBLE)))
    ELSE 2.0::DOUBLE * share / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * share, 0.0::DOUBLE))) END END AS position
FROM t
"""
