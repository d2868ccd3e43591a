"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagescore.llm.common import table, unsigned_crc32

VIRTUAL_NODES = 64
#: Hash bins of the ring, as a power of two: a row's rank on its arc is the count in earlier bins plus its rank in its own.
BIN_BITS = 16

_POS, _ARC, _BIN, _RANK = "_ring_pos", "_ring_arc", "_ring_bin", "_ring_rank"


def ring(spark: SparkSession, n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """The ring's arcs in clockwise order: arc, lo, hi, shard. An arc holds positions lo < p <= hi and ends at a virtual node.

    A node's position depends on its shard and number only, so one more shard leaves the other nodes in place. The arc
    that wraps round is listed as two with one number. The table has n_shards * virtual_nodes + 1 rows.
    """
    nodes = spark.range(n_shards * virtual_nodes).select(
        (F.col("id") % n_shards).cast("int").alias("shard"),
        F.xxhash64(F.lit("node"), F.col("id") % n_shards, F.floor(F.col("id") / n_shards)).alias("hi"),
    )
    clockwise = Window.orderBy("hi", "shard")
    arcs = nodes.select(
        "shard", "hi", F.lag("hi").over(clockwise).alias("lo"), (F.row_number().over(clockwise) - 1).alias("arc"), F.max("hi").over(Window.partitionBy()).alias("last")
    )
    top = arcs.where("arc = 0").select("arc", F.col("last").alias("lo"), F.lit(2**63 - 1).alias("hi"), "shard")
    return arcs.select("arc", F.coalesce("lo", F.lit(-(2**63))).alias("lo"), "hi", "shard").unionByName(top)


def overflow(shard_of: list[int], waiting: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Carry counts of rows round the ring: (arc, from rank, to rank, shard, first slot).

    In each round every node, in ring order, admits what waits at it as far as its shard has room; the rest waits at
    the next node clockwise. The lists have one entry for each virtual node or shard, whatever the number of rows.
    """
    used, out, n = [0] * len(capacity), [], len(shard_of)
    queue = {arc: [(arc, 0, count)] for arc, count in enumerate(waiting) if count}
    while queue:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for node in sorted(queue):
            shard = shard_of[node]
            for arc, lo, hi in queue[node]:
                taken = min(hi - lo, capacity[shard] - used[shard])
                if taken:
                    out.append((arc, lo, lo + taken, shard, used[shard]))
                    used[shard] += taken
                if lo + taken < hi:
                    moved.setdefault((node + 1) % n, []).append((arc, lo + taken, hi))
        queue = moved
    return out


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    """Most rows for each shard. Without slack the loads are rows // n_shards or one more, the first shards having more."""
    if slack:
        return [int(-(-rows * (1 + slack) // n_shards))] * n_shards
    return [rows // n_shards + (k < rows % n_shards) for k in range(n_shards)]


def shard(df: DataFrame, key: str, tie: list[str], n_shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Add shard int and slot long to every row.

    A row's key is hashed to a position on the ring and belongs to the node at the end of its arc; if that node's shard
    is full, to the next node clockwise whose shard has room. No shard gets more than (1 + slack) of its equal part.
    Slots number a shard's rows from 0 without gaps. Rows of one arc are admitted by position, then key, then `tie`
    columns (nulls first); rows equal in all of these are interchangeable. A null key takes the place that the tie
    columns hash to. An empty table gives an empty result. Other columns pass through, but for columns named shard or
    slot, which are replaced; names that start with _ring_ are used here.
    """
    spark = df.sparkSession
    arcs = [tuple(r) for r in ring(spark, n_shards, virtual_nodes).collect()]
    shard_of = [s for _, s in sorted({a: s for a, _, _, s in arcs}.items())]
    shift = 64 - BIN_BITS
    covers = (
        spark.createDataFrame(arcs, "_ring_arc int, _ring_lo long, _ring_hi long, _ring_owner int")
        .select("_ring_arc", "_ring_lo", "_ring_hi", F.explode(F.expr(f"sequence(shiftright(_ring_lo, {shift}), shiftright(_ring_hi, {shift}))")).alias(_BIN))
    )
    pos = F.when(F.col(key).isNull(), F.xxhash64(*tie)).otherwise(F.xxhash64(F.col(key)))
    placed = df.withColumn(_POS, pos).withColumn(_BIN, F.shiftright(_POS, shift))
    # at most 2**BIN_BITS rows and one for each arc
    placed = placed.join(F.broadcast(covers), [_BIN], "inner").where(f"{_POS} > _ring_lo and {_POS} <= _ring_hi or {_POS} = {-(2**63)} and _ring_lo = {-(2**63)}").drop("_ring_lo", "_ring_hi")
    bins = placed.groupBy(_ARC, _BIN).count()
    before = Window.partitionBy(_ARC).orderBy(_BIN).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(_ARC, _BIN, "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ring_before"))
    waiting = [0] * len(shard_of)
    for arc, count in bins.groupBy(_ARC).agg(F.sum("count")).collect():
        waiting[arc] = count
    parts = overflow(shard_of, waiting, capacities(sum(waiting), n_shards, slack))
    parts_df = spark.createDataFrame(parts, "_ring_arc int, _ring_from long, _ring_to long, _ring_shard int, _ring_slot long")
    within = Window.partitionBy(_ARC, _BIN).orderBy(_POS, key, *tie)
    ranked = (
        placed.join(bins.drop("count"), [_ARC, _BIN])
        .withColumn(_RANK, F.row_number().over(within) - 1 + F.col("_ring_before"))
        .join(F.broadcast(parts_df), [_ARC])
        .where(f"{_RANK} >= _ring_from and {_RANK} < _ring_to")
    )
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return ranked.select(*kept, F.col("_ring_shard").alias("shard"), (F.col(_RANK) - F.col("_ring_from") + F.col("_ring_slot")).alias("slot"))


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `rows`: counts differ by one at most. A null text has no bytes, CRC-32 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), unsigned_crc32(F.col("text")).alias("text_crc32")
    )
    return shard(docs, "doc_id", ["text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
