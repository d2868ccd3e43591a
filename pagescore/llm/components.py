"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagescore.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node of its component. edges: a long, b long.

    Each round hangs the greater neighbours of every node on its smallest one, then the smaller ones; the rounds end
    when the edges are stars, after about as many rounds as the logarithm of the longest path. A round groups with
    partial minima and joins, so a node with very many edges isn't gathered anywhere. Its edges are written between
    rounds. Loops, repeats and nulls are left out; without edges the result is empty.
    """
    state = None
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(down, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        seen = Observation()  # what the edges sum up to comes with their writing
        before, now = now, written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        discard(before)
        new = (seen.get["n"], seen.get["x"])
        if new == state or not new[0]:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
