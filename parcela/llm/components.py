"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import durable, tasks_for


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges of longs; the root is the component's smallest node.

    Each round every node links its smaller neighbours and itself to the smallest one, then its larger
    neighbours. Minima are pre-aggregated, so a node with very many neighbours is no single task's work; rounds
    grow with the logarithm of the longest path. Every round's edges are kept in the checkpoint folder, by as
    many tasks as their number asks for.
    """
    links = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n, state = links.count(), None
    while n:
        links = links.coalesce(tasks_for(n))
        down = links.groupBy("a").agg(F.min("b").alias("m"))
        small = links.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = durable(small.unionAll(down.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks_for(n)))
        both = small.unionAll(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        links = durable(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks_for(n)))
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state, n = now, now["n"]
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
