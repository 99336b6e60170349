"""Learned state as tables: aggregates by key, joined back to the rows that they describe."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df left joined to one state row per key; null keys match null keys. Without keys the state is one row.

    The state holds one row for a group, so it is the small side; Spark broadcasts it when its size allows."""
    if not keys:
        return df.join(F.broadcast(state))  # one row
    renamed = state.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return df.join(renamed, same, "left").drop(*(f"_k_{k}" for k in keys))


def durable(df: DataFrame) -> DataFrame:
    """df, written once to the session's checkpoint folder; only a session on one machine may have none set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parcela-checkpoint-"))
    return df.checkpoint()


#: Rows of a state that every task may hold.
FEW = 100_000


def learned(state: DataFrame) -> DataFrame:
    """A state, written once; one of few rows is marked for broadcast, so that the rows it describes need not be dealt out to meet it."""
    out = durable(state)
    return F.broadcast(out) if out.limit(FEW + 1).count() <= FEW else out


def aggregate(df: DataFrame, keys: Sequence[str], **aggregates) -> DataFrame:
    columns = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """df with, for each named value, `<name>_before`: its sum over the rows before within the group by a total order (0 for the first), and `<name>_total`: the group's sum.

    Rows are dealt to partitions by range of group and order and written once; sums are taken inside each partition,
    and those of the partitions before are added, so a group that holds most rows is spread over many tasks."""
    cuts = durable(df.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(*by, *order).withColumn("_cut", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    sizes = aggregate(cuts, [*by, "_cut"], **{f"_c_{n}": F.sum(f"_v_{n}") for n in values})
    sizes = sizes.select(
        *by, "_cut", *((F.sum(f"_c_{n}").over(group.orderBy("_cut")) - F.col(f"_c_{n}")).alias(f"_s_{n}") for n in values), *(F.sum(f"_c_{n}").over(group).alias(f"{n}_total") for n in values)
    )
    earlier = Window.partitionBy(*by, "_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = attach(cuts.withColumns({f"_r_{n}": F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)) for n in values}), sizes, [*by, "_cut"])
    return out.withColumns({f"{n}_before": F.col(f"_r_{n}") + F.col(f"_s_{n}") for n in values}).drop("_cut", *(f"_{x}_{n}" for x in "rvs" for n in values))


def summed_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, before: str, total: str) -> DataFrame:
    """df with the sum of a value over the rows before within its group by a total order (0 for the first), and the group's sum."""
    return running(df, by, order, {"_x": value}).withColumnsRenamed({"_x_before": before, "_x_total": total})


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with `rank` (from 1) within its group by a total order, and the group's `rank_of` rows."""
    return summed_before(df, by, order, F.lit(1), "rank", "rank_of").withColumn("rank", F.col("rank") + 1)


def picked(counts: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """(by, n, named percentiles) of values that stand `_n` times each, exact, interpolated as usual.

    The two values around a percentile are those whose runs of ranks hold it; a group's values may fill many tasks."""
    at = running(counts, by, [value], {"n": F.col("_n")})
    ends = {}
    for name, p in probabilities.items():
        place = (F.col("n_total") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends[f"_{name}_{side}"] = F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("_n")), F.col(value)))
        ends[f"_{name}_part"] = F.max(place - F.floor(place))
    out = aggregate(at, by, n=F.max("n_total"), **ends)
    return out.select(*by, "n", *((F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in probabilities))


def percentiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """(by, n, named percentiles) of the values that are not null: counted by value where they lie, then ranked over range partitions."""
    counts = aggregate(df.where(F.col(value).isNotNull()), [*by, value], _n=F.count("*"))
    return picked(counts, by, value, probabilities)


def fold_counts(df: DataFrame, by: Sequence[str], value: str, folds: int) -> DataFrame:
    """(by, value, all, f0, f1, ...): how often each value that is not null stands in a group, and in each fold."""
    own = {f"f{i}": F.count_if(F.col("fold") == i) for i in range(folds)}
    return aggregate(df.where(F.col(value).isNotNull()), [*by, value], all=F.count("*"), **own)


def fold_medians(df: DataFrame, by: Sequence[str], value: str, folds: int) -> DataFrame:
    """(by, fold, median, n) of the values of all other folds, for every group and fold that has any."""
    return counted_medians(fold_counts(df, by, value, folds), by, value, folds)


def counted_medians(counts: DataFrame, by: Sequence[str], value: str, folds: int) -> DataFrame:
    """(by, fold, median, n) from values with their number in every fold.

    A fold's ranks are all ranks less its own, so one ordering serves all folds and no row is copied."""
    return middles(running(counts, by, [value], {c: F.col(c) for c in ("all", *(f"f{i}" for i in range(folds)))}), by, value, folds)


def group_fold_medians(df: DataFrame, by: Sequence[str], value: str, folds: int, deal: Sequence[str] = ()) -> DataFrame:
    """The same as fold_medians for groups that are many: each group's values are ordered where they lie, none is counted or written.

    Rows are dealt out by `deal`, some of the keys; groups that share them share one shuffle."""
    rows = df.where(F.col(value).isNotNull()).select(*by, *(c for c in deal if c not in by), "fold", value).repartition(*(deal or by))
    rows = rows.withColumns({"all": F.lit(1), **{f"f{i}": (F.col("fold") == i).cast("int") for i in range(folds)}})
    order = Window.partitionBy(*by).orderBy(value)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {}
    for c in ("all", *(f"f{i}" for i in range(folds))):
        sums |= {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)), f"{c}_total": F.sum(c).over(whole)}
    return middles(rows.withColumns(sums), by, value, folds)


def fold_grid(df: DataFrame, value: str, folds: int, grid: Sequence[float]) -> DataFrame:
    """(fold, grid): the percentiles at evenly spaced points of the values of all other folds, exact, from one ordering of all values.

    A value's runs of ranks tell which points may lie in it; most hold none."""
    at = running(fold_counts(df, [], value, folds), [], [value], {c: F.col(c) for c in ("all", *(f"f{i}" for i in range(folds)))})
    last, step = len(grid) - 1, (grid[-1] - grid[0]) / (len(grid) - 1)
    points, each = F.array(*map(F.lit, grid)), []
    for i in range(folds):
        total, before, here = (F.col(f"all{x}") - F.col(f"f{i}{x}") for x in ("_total", "_before", ""))
        near = lambda rank, total=total: (rank / F.greatest(total - 1, F.lit(1)) - grid[0]) / step
        start, end = F.greatest(F.lit(0), F.ceil(near(before - 1) - 1e-6)), F.least(F.lit(last), F.floor(near(before + here) + 1e-6))
        each.append(F.when((here > 0) & (start <= end), F.struct(F.lit(i).alias("fold"), start.cast("int").alias("start"), end.cast("int").alias("end"), before.alias("before"), here.alias("here"), total.alias("total"))))
    held = at.select(F.col(value).alias("v"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("v", "x.*").withColumn("i", F.explode(F.sequence("start", "end")))
    place = (F.col("total") - 1) * F.get(points, F.col("i"))
    of = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("here")), F.col("v")))
    ends = aggregate(held, ["fold", "i"], lo=of(F.floor(place)), hi=of(F.ceil(place)), part=F.max(place - F.floor(place)))
    found = ends.select("fold", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q")).where("q is not null")
    return aggregate(found, ["fold"], grid=F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda e: e.q))


def middles(at: DataFrame, by: Sequence[str], value: str, folds: int) -> DataFrame:
    """(by, fold, median, n) from values with the numbers before them, of their own and in all, of every fold."""
    each = []
    for i in range(folds):
        total, before, here = (F.col(f"all{x}") - F.col(f"f{i}{x}") for x in ("_total", "_before", ""))
        holds = lambda rank, before=before, here=here: ((before <= rank) & (rank < before + here)).cast("int")
        weight = holds(F.floor((total - 1) / 2)) + holds(F.ceil((total - 1) / 2))
        each.append(F.when(weight > 0, F.struct(F.lit(i).alias("fold"), total.alias("n"), (F.col(value) * weight / 2).alias("part"))))
    rows = at.select(*by, F.explode(F.array_compact(F.array(*each))).alias("x")).select(*by, "x.*")
    return aggregate(rows, [*by, "fold"], median=F.sum("part"), n=F.max("n"))
