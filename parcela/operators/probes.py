"""Probes of models: which columns a fitted pipeline leans on, and whether a gain comes from rows of the same place."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.operators.experts import applied, fold_ridges
from parcela.operators.state import aggregate, attach, durable, ranked

#: Fewest rows of a probe; a gain that random folds show and group folds lack by so much is suspicious.
LEAST_ROWS, SUSPICIOUS = 50, 0.05


def column_importances(model: PipelineModel, df: DataFrame, vector: str = "features") -> DataFrame:
    """(feature, importance, rank) of a fitted pipeline whose last stage is a forest, boosted trees or a linear model.

    The vector's slots are named by its metadata; the slots of a one-hot column are summed. Trees give their importances,
    linear models the size of their coefficients. There is a row for each column of the model."""
    last = model.stages[-1]
    values = np.abs(np.asarray((last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()))
    assembler = next(s for s in reversed(model.stages) if hasattr(s, "getInputCols") and type(s).__name__ == "VectorAssembler")
    attributes = model.transform(df.limit(0)).schema[assembler.getOutputCol()].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a.get("name", "")) for kind in attributes.values() for a in kind)
    inputs = sorted(assembler.getInputCols(), key=len, reverse=True)

    def column(slot: str) -> str:
        """The column that a slot came from, without the marks of the preparation."""
        own = next((c for c in inputs if slot == c or slot.startswith(f"{c}_")), slot)
        return own[3:] if own[:3] in ("_f_", "_o_", "_i_") else own

    sums: dict[str, float] = {}
    for i, slot in slots:
        sums[column(slot)] = sums.get(column(slot), 0.0) + float(values[i])
    order = sorted(sums.items(), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(c, v, k + 1) for k, (c, v) in enumerate(order)], "feature string, importance double, rank int")


def greedy_quotas(sizes: dict[int, int], folds: int) -> list[tuple[int, int, int]]:
    """(size, fold, groups): how many groups of each size every fold gets if the largest group always goes to the lightest fold.

    Groups of one size are alike. Once the loads lie within that size of each other the folds take turns, so whole
    turns are dealt at once."""
    loads, out = [0] * folds, []
    for size in sorted(sizes, reverse=True):
        left, got = sizes[size], [0] * folds
        while left:
            if size and max(loads) - min(loads) <= size and left >= folds:
                turns = left // folds
                for f in range(folds):
                    loads[f] += turns * size
                    got[f] += turns
                left -= turns * folds
                continue
            f = loads.index(min(loads))
            loads[f] += size
            got[f] += 1
            left -= 1
        out += [(size, f, n) for f, n in enumerate(got) if n]
    return out


def with_group_folds(df: DataFrame, group: str, folds: int, name: str = "fold") -> DataFrame:
    """df with a fold for each whole group, the largest group to the lightest fold. The driver sees how many groups have each size, no group."""
    counts = aggregate(df, [group], _size=F.count("*"))
    sizes = {r["_size"]: r["n"] for r in aggregate(counts, ["_size"], n=F.count("*")).collect()}
    rows, begun = [], {}
    for size, fold, n in greedy_quotas(sizes, folds):
        rows.append((size, begun.get(size, 0), begun.get(size, 0) + n, fold))
        begun[size] = begun.get(size, 0) + n
    quotas = df.sparkSession.createDataFrame(rows, "_size long, _from long, _to long, _fold int")
    placed = ranked(counts, ["_size"], [group]).join(F.broadcast(quotas), "_size").where((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_to")))  # sizes by folds
    return attach(df, placed.select(group, F.col("_fold").alias(name)), [group])


def spatial_leakage(df: DataFrame, group: str, features: Sequence[str], target: str, folds: int, alpha: float = 10.0) -> DataFrame:
    """One row: determination of a linear probe under the folds of df and under folds of whole groups, their gap and a warning.

    Rows without any of the features or without a target take no part."""
    known = durable(df.where(F.coalesce(*(F.col(c).cast("double") for c in features)).isNotNull() & F.col(target).isNotNull()).select("fold", F.coalesce(F.col(group).cast("string"), F.lit("missing")).alias("_group"), *features, F.col(target).alias("_y")))
    size = known.agg(F.count("*").alias("n"), F.count_distinct("_group").alias("g")).first()
    if size["n"] < LEAST_ROWS:
        return df.sparkSession.createDataFrame([("skipped", size["n"], size["g"], None, None, None, "too_few_rows")], "status string, n_rows long, n_groups long, random_r2 double, grouped_r2 double, gap double, warning string")

    def determination(rows: DataFrame, name: str) -> DataFrame:
        one = rows.withColumn("_one", F.lit(0))
        seen = applied(one, fold_ridges(one, ["_one"], features, "_y", {"m": (list(features), alpha)}, folds, scaled=False), ["_one", "fold"], features, ["m"])
        return seen.agg((1 - F.sum(F.pow(F.col("_y") - F.col("z_m"), 2)) / (F.var_pop("_y") * F.count("_y"))).alias(name))

    both = attach(determination(known, "random_r2"), determination(with_group_folds(known.drop("fold"), "_group", min(folds, max(2, size["g"]))), "grouped_r2"), [])
    gap = F.col("random_r2") - F.col("grouped_r2")
    warning = F.when((F.col("random_r2") > SUSPICIOUS) & (gap > SUSPICIOUS), "lift_may_be_spatial_memorization").otherwise("")
    return both.select(F.lit("ok").alias("status"), F.lit(size["n"]).cast("long").alias("n_rows"), F.lit(size["g"]).cast("long").alias("n_groups"), "random_r2", "grouped_r2", gap.alias("gap"), warning.alias("warning"))
