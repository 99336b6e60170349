"""Fold-safe encoders: what a row gets is learned from the rows of other folds.

Statistics that add up (numbers, sums) come from one aggregation by key and fold, own fold subtracted.
Medians do not add up: each group's values are ordered once, and a fold's ranks are all ranks less its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.text import ratio
from parcela.operators.state import aggregate, attach, fold_medians, group_fold_medians, learned


def with_fold(df: DataFrame, id_: str, folds: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(id_), F.lit(folds)).cast("int"))


def to_other_folds(df: DataFrame, folds: int) -> DataFrame:
    """Each row once for every fold that may learn from it, named by `fold`."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    return df.withColumn("fold", F.explode(others))


def mean_encoding(df: DataFrame, keys: Sequence[str], target: str, smoothing: float, name: str, written: bool = False) -> DataFrame:
    """Mean of other folds' targets by key, drawn to the overall mean by `smoothing` rows; and their number.

    The means can be written at once, so that what reads the rows several times need not learn them again."""
    by_fold = aggregate(df, [*keys, "fold"], _s=F.sum(target), _n=F.count(target))
    over_key, over_all = Window.partitionBy(*keys), aggregate(by_fold, ["fold"], _fs=F.sum("_s"), _fn=F.sum("_n"))
    whole = aggregate(over_all, [], _as=F.sum("_fs"), _an=F.sum("_fn"))
    state = by_fold.withColumns({"_ks": F.sum("_s").over(over_key) - F.col("_s"), "_kn": F.sum("_n").over(over_key) - F.col("_n")}).select(*keys, "fold", "_ks", "_kn")
    if written:
        state = learned(attach(attach(state, over_all, ["fold"]), whole, []))
        out = attach(df, state, [*keys, "fold"])
    else:
        out = attach(attach(attach(df, state, [*keys, "fold"]), over_all, ["fold"]), whole, [])
    mean = ratio(F.col("_as") - F.col("_fs"), F.col("_an") - F.col("_fn"))
    n = F.coalesce("_kn", F.lit(0))
    value = ratio(F.coalesce("_ks", F.lit(0.0)) + mean * smoothing, n + F.lit(smoothing))
    return out.withColumns({name: value, f"{name}_count": n}).drop("_ks", "_kn", "_fs", "_fn", "_as", "_an")


def location_baseline(df: DataFrame, target: str, levels: Sequence[tuple[int, Sequence[str], int]], folds: int) -> DataFrame:
    """Median of other folds' targets at the first level with enough rows; its code (0: all rows) and number of rows.

    The rows' values are ordered once for a level, not copied for every fold."""
    rows = df
    broad = min((list(keys) for _, keys, _ in levels if len(keys) > 1), key=len, default=[])
    values, codes, counts = [], [], []
    for code, keys, least in levels:
        found = group_fold_medians(rows, keys, target, folds, broad if set(broad) <= set(keys) else keys)
        state = found.select(*keys, "fold", F.col("median").alias(f"_m{code}"), F.col("n").alias(f"_n{code}")).where(F.col(f"_n{code}") >= least)
        df = attach(df, learned(state), ["fold", *keys])
        found = F.col(f"_m{code}").isNotNull()
        values.append(F.col(f"_m{code}"))
        codes.append(F.when(found, F.lit(code)))
        counts.append(F.col(f"_n{code}"))
    df = attach(df, learned(fold_medians(rows, [], target, folds).select("fold", F.col("median").alias("_m0"), F.col("n").alias("_n0"))), ["fold"])
    out = df.withColumns({"baseline": F.greatest(F.lit(1.0), F.coalesce(*values, F.col("_m0"))), "baseline_level": F.coalesce(*codes, F.lit(0)), "baseline_count": F.coalesce(*counts, F.col("_n0"))})
    return out.drop(*(f"_{x}{c}" for c, _, _ in [*levels, (0, (), 0)] for x in "mn"))


def flag_premiums(df: DataFrame, flags: Sequence[str], residual: str, alpha: float = 50.0, least: int = 3) -> DataFrame:
    """(county, flag, n_with, effect): the gap of medians with and without a flag, drawn to the whole table's gap by n / (n + alpha)."""
    long = df.select("county", F.col(residual).alias("_y"), *flags).unpivot(["county", "_y"], list(flags), "flag", "on")
    on, off = F.col("on") == 1, F.col("on") == 0

    def gap(keys: Sequence[str], name: str) -> DataFrame:
        state = aggregate(long, keys, _a=F.count_if(on), _b=F.count_if(off), _with=F.median(F.when(on, F.col("_y"))), _without=F.median(F.when(off, F.col("_y"))))
        return state.select(*keys, F.col("_a").alias(f"{name}_n"), F.when((F.col("_a") >= least) & (F.col("_b") >= least), F.col("_with") - F.col("_without")).alias(name))

    out = attach(gap(["county", "flag"], "own"), gap(["flag"], "whole"), ["flag"])
    w = F.col("own_n") / (F.col("own_n") + F.lit(alpha))
    effect = F.when(F.col("own").isNull(), F.col("whole")).otherwise(w * F.col("own") + (1 - w) * F.coalesce("whole", F.lit(0.0)))
    return out.select("county", "flag", F.col("own_n").alias("n_with"), F.coalesce(effect, F.lit(0.0)).alias("effect"))


def group_rare(df: DataFrame, column: str, least: int, other: str = "other") -> DataFrame:
    """df with values of fewer than `least` rows replaced."""
    out = attach(df, aggregate(df, [column], _n=F.count("*")), [column])
    return out.withColumn(column, F.when(F.col("_n") < least, F.lit(other)).otherwise(F.col(column))).drop("_n")


def useless(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, reason) for columns that are all null or constant; one pass over the rows."""
    counted = df.agg(*(F.count(c).alias(f"n_{c}") for c in columns), *(F.min(c).eqNullSafe(F.max(c)).alias(f"s_{c}") for c in columns))
    why: list[Column] = [F.when(F.col(f"n_{c}") == 0, F.struct(F.lit(c).alias("column"), F.lit("all_null").alias("reason"))).when(F.col(f"s_{c}"), F.struct(F.lit(c).alias("column"), F.lit("constant").alias("reason"))) for c in columns]
    return counted.select(F.explode(F.array_compact(F.array(*why))).alias("r")).select("r.*")
