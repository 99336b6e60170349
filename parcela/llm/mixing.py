"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Whole copies of the source come first; what is left of the target
is its budget. Documents are counted by exact length. Every length gets its even share of the budget,
rounded down; the small rest is fitted by bounded-knapsack dynamic programming over the documents not yet
counted. The counts then pick documents: of each source and length, those of lowest seeded hash.

Defined results: null texts have no words; null sources are one source, the last; repeated rows are
documents of their own; documents of one length and equal draw go by doc_id and checksum, a null doc_id first;
texts of any length are counted whole; a source without words has target 0; other columns pass through
`mix`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import durable, free_name, n_words, table, text_crc32, with_ranks

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Budgets up to this many words are fitted by dynamic programming, larger rests first evenly by length.
EXACT_WORDS = 1 << 16


def best_subset(available: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take for the sum nearest to the budget (of two as near, the lower); `available` bounds each."""
    top = budget + min(EXACT_WORDS, max((x for x, n in available.items() if n > 0), default=0))
    reach, steps, window = 1, [], (1 << (top + 1)) - 1
    for x, n in sorted(available.items(), reverse=True):
        k = 1
        while n > 0 and not reach >> budget & 1:
            k = min(k, n)
            if k * x > top:
                break
            steps.append((reach, x, k))
            reach |= reach << (k * x) & window
            n, k = n - k, 2 * k
    total, over = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, reach >> (budget + 1)
    above = budget + (over & -over).bit_length()
    if over and above - budget < budget - total:
        total = above
    out: dict[int, int] = {}
    for before, x, k in reversed(steps):
        if not before >> total & 1:
            out[x] = out.get(x, 0) + k
            total -= k * x
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Documents to take of each length, so that their words come to the budget, or as near as can be."""
    counts = {x: n for x, n in sorted(counts.items(), reverse=True) if x > 0}
    whole = sum(x * n for x, n in counts.items())
    if not whole or budget <= 0:
        return {}
    budget = min(budget, whole)
    take = {x: n * budget // whole for x, n in counts.items()}
    rest = budget - sum(x * n for x, n in take.items())
    for x in sorted(counts, key=lambda x: (-(counts[x] * budget % whole), x)):
        if rest - x >= EXACT_WORDS // 2 and take[x] < counts[x]:
            take[x] += 1
            rest -= x
    for x in counts:
        more = max(0, min(counts[x] - take[x], (rest - EXACT_WORDS // 2) // x))
        take[x] += more
        rest -= more * x
    for x, n in best_subset({x: counts[x] - take[x] for x in counts}, min(rest, EXACT_WORDS)).items():
        take[x] += n
    nearer(counts, take, budget)
    return {x: n for x, n in take.items() if n}


def nearer(counts: dict[int, int], take: dict[int, int], budget: int) -> None:
    """Takes one document more, or one for another, as long as that brings the sum nearer to the budget.

    This settles what the window of the dynamic programming can't: rests among documents longer than it."""
    short = budget - sum(x * n for x, n in take.items())
    while short:
        more = sorted(x for x in counts if take[x] < counts[x])
        best = abs(short), 0, 0
        for y in (0, *(y for y in take if take[y])):  # the one given back; 0: none
            i = bisect_left(more, short + y)
            for x in (0, *more[max(0, i - 1) : i + 1]):
                if x != y:
                    best = min(best, (abs(short + y - x), x, y))
        if best[0] >= abs(short):
            return
        _, x, y = best
        if x:
            take[x] += 1
        if y:
            take[y] -= 1
        short += y - x


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds target to (source, source_size): shares by weight of `share` of all words, at most `most` times the source.

    Excess goes to the others by weight, so all targets below their bound are one level times their weight.
    Sources are sorted by bound over weight; the level is the first that its own source can bear.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before, after = Window.partitionBy(), by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level: Column = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(every)["level"])
        .select("source", "source_size", F.least("bound", F.col("level") * F.col("weight")).alias("target"))
    )


def fitted(lengths: pd.DataFrame) -> pd.DataFrame:
    """Whole copies and picked documents for each length of one source."""
    target, size = float(lengths["target"].iloc[0]), int(lengths["source_size"].iloc[0])
    full = min(int(target // size), MOST_COPIES) if size else 0
    counts = dict(zip(lengths["size"].tolist(), lengths["n"].tolist(), strict=True))
    take = fit(counts, round(target) - full * size)
    return lengths.assign(full=full, picked=[take.get(x, 0) for x in lengths["size"]])


def mix_plan(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, text_crc32, source, size, source_size, target and times (how often the mix takes it) of every document."""
    rows = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
        .groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    )
    lengths = rows.groupBy("source", "size").agg(F.sum("copies").alias("n"), F.count("*").alias("key_rows"))
    sources = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    with_target = lengths.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = durable(with_target.groupBy("source").applyInPandas(fitted, "source string, size long, n long, key_rows long, source_size long, target double, full int, picked long"))
    keyed = rows.join(plan.withColumnsRenamed({"source": "_s", "size": "_z"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    ranked = with_ranks(keyed, ["source", "size"], "key_rows", ["draw", "doc_id", "text_crc32"], "copies", "rank")
    each = ranked.withColumn("rank", F.explode(F.sequence("rank", F.col("rank") + F.col("copies") - 1)))
    times = F.col("full") + (F.col("rank") < F.col("picked")).cast("int")
    return each.select("doc_id", "text_crc32", "source", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with their columns as they were.

    Rows are found again by doc_id, source and checksum; rows equal in these are one row, taken as often as all of them.
    """
    taken = mix_plan(docs, seed).groupBy("doc_id", "source", "text_crc32").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    taken = durable(taken)
    names = {c: free_name(docs, f"_{c}") for c in taken.columns}
    right = taken.withColumnsRenamed(names)
    same = [F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"])), F.col("source").cast("string").eqNullSafe(F.col(names["source"])), text_crc32(F.col("text")) == F.col(names["text_crc32"])]
    found = docs.join(right, same[0] & same[1] & same[2])
    if not taken.where("rows > 1").isEmpty():
        repeated = F.col(names["rows"]) > 1
        found = found.where(~repeated).unionAll(found.where(repeated).dropDuplicates([names[c] for c in ("doc_id", "source", "text_crc32")]))
    turn = free_name(docs, "_turn")
    return found.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(names["times"]).cast("int")))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
