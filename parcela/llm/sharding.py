"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into CELLS equal cells. Each shard has `virtual_nodes` points on it; a cell belongs to
the first point at or after it. A row's cell is a hash of its doc_id. A shard takes rows up to its
capacity; the rows of a cell that find it full go on clockwise to the next shard with room. Rows of a
cell all walk the same way, so the walk is settled for counts per cell, a table of fixed size, and the
rows then read their shard from their rank within the cell.

With `slack` 0 the capacities add up to exactly the number of rows and differ by one at most (law `rows`).
A larger slack leaves more rows on their first shard when shards come or go.

Defined results: null doc_ids share one place on the ring; null texts count as empty; repeated rows are
rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import durable, table, text_crc32, with_ranks

CELLS = 4096


@dataclass
class Walk:
    """What each cell gives to each shard: (rows before, rows up to, shard, first slot), by cell."""

    parts: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    loads: list[int] = field(default_factory=list)


def ring(spark: SparkSession, shards: int, virtual_nodes: int, seed: int) -> list[list[int]]:
    """For each cell the shards in the order in which a clockwise walk meets them."""
    nodes = spark.range(shards * virtual_nodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.lit(seed), "id"), F.lit(CELLS)).alias("cell"),
        F.floor(F.col("id") / virtual_nodes).cast("int").alias("shard"),
    )
    points = sorted((r.cell, r.shard) for r in nodes.collect())
    order: list[list[int]] = []
    at = 0
    for cell in range(CELLS):
        while at < len(points) and points[at][0] < cell:
            at += 1
        met: dict[int, None] = {}
        for _, shard in chain(points[at:], points[:at]):
            met[shard] = None
            if len(met) == shards:
                break
        order.append(list(met))
    return order


def capacities(rows: int, wanted: list[int], slack: float) -> list[int]:
    """Each shard's capacity. Without slack the spare rows go to the shards that most rows meet first."""
    n = len(wanted)
    if slack > 0:
        return [math.ceil(rows * (1 + slack) / n)] * n
    most = sorted(range(n), key=lambda s: (-wanted[s], s))[: rows % n]
    return [rows // n + (s in most) for s in range(n)]


def walk(counts: dict[int, int], order: list[list[int]], shards: int, slack: float) -> Walk:
    """Round k sends what is left of every cell to the k-th shard that it meets, as far as there is room."""
    wanted = [0] * shards
    for cell, n in counts.items():
        wanted[order[cell][0]] += n
    room = capacities(sum(counts.values()), wanted, slack)
    left, out = dict(sorted(counts.items())), Walk(loads=[0] * shards)
    for k in range(shards):
        for cell, n in left.items():
            shard = order[cell][k]
            if taken := min(n, room[shard]):
                done = counts[cell] - n
                out.parts.setdefault(cell, []).append((done, done + taken, shard, out.loads[shard]))
                room[shard] -= taken
                out.loads[shard] += taken
                left[cell] -= taken
    return out


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = 64, slack: float = 0.0, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; slots are gapless from 0 within each shard."""
    spark = docs.sparkSession
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
    )
    cell = F.pmod(F.xxhash64(F.lit("key"), F.lit(seed), "doc_id"), F.lit(CELLS))
    rows = durable(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).withColumn("cell", cell))
    per_cell = rows.groupBy("cell").agg(F.sum("copies").alias("n"), F.count("*").alias("key_rows")).collect()
    plan = walk({r.cell: r.n for r in per_cell}, ring(spark, shards, virtual_nodes, seed), shards, slack)
    parts = spark.createDataFrame(
        [(r.cell, r.key_rows, plan.parts[r.cell]) for r in per_cell],
        "cell long, key_rows long, parts array<struct<lo: long, hi: long, shard: int, slot: long>>",
    )
    placed = rows.join(F.broadcast(parts), "cell")  # CELLS rows at most
    ranked = with_ranks(placed, ["cell"], "key_rows", ["doc_id", "size", "text_crc32"], "copies", "rank")
    each = ranked.withColumn("at", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1)))
    part = F.filter("parts", lambda p: F.col("at") < p["hi"])[0]
    return each.withColumn("part", part).select(
        "doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("at") - F.col("part.lo") + F.col("part.slot")).alias("slot"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards of which no two differ by more than one row."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
