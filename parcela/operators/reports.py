"""Reports over predictions and listings: errors by group, deciles, coverage, correlations, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import ratio
from parcela.operators.state import aggregate, attach, durable, percentiles, ranked, summed_before

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def metric_columns(y: str, p: str) -> dict[str, Column]:
    """Rows, determination (plain and of logarithms), relative and absolute errors, in one pass."""
    a, b = F.col(y), F.col(p)
    relative = ratio(F.abs(b - a), a)
    la, lb = F.log1p(a), F.log1p(F.greatest(F.lit(0.0), b))
    return {
        "rows": F.count("*"), "r2": 1 - ratio(F.sum(F.pow(a - b, 2)), F.var_pop(a) * F.count(a)), "log_r2": 1 - ratio(F.sum(F.pow(la - lb, 2)), F.var_pop(la) * F.count(la)),
        "mape": F.avg(relative), "median_ape": F.median(relative), "mae": F.avg(F.abs(b - a)), "median_ae": F.median(F.abs(b - a)),
        "variance_ratio": ratio(F.var_pop(b), F.var_pop(a)), "bias": F.avg(b - a),
    }


def metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), least_rows: int = 1, spread: bool = False) -> DataFrame:
    """The errors by group, or of all rows; with `spread` the medians of all rows come from range partitions, not from one task."""
    valid = df.where((F.col(y) > 0) & F.col(p).isNotNull())
    if spread and not by:
        columns = metric_columns(y, p)
        gap = F.abs(F.col(p) - F.col(y))
        out = aggregate(valid, [], **{n: c for n, c in columns.items() if not n.startswith("median")})
        for name, c in (("median_ape", ratio(gap, F.col(y))), ("median_ae", gap)):
            out = attach(out, percentiles(valid.select(c.alias("_e")), [], "_e", {name: 0.5}).drop("n"), [])
        return out.select(*columns).where(F.col("rows") >= least_rows)
    return aggregate(valid, list(by), **metric_columns(y, p)).where(F.col("rows") >= least_rows)


def stacked_metrics(df: DataFrame, y: str, p: str, dimensions: Sequence[str], least_rows: int = 1) -> DataFrame:
    """The errors by each single dimension, one below the other, from one pass: (dimension, value, n, mape, mae, means)."""
    relative = ratio(F.abs(F.col(p) - F.col(y)), F.col(y))
    long = df.select(F.col(y).alias("_y"), F.col(p).alias("_p"), relative.alias("_e"), *(F.col(c).cast("string").alias(c) for c in dimensions))
    out = long.unpivot(["_y", "_p", "_e"], list(dimensions), "dimension", "value").groupBy("dimension", "value")
    return out.agg(F.count("*").alias("n"), F.avg("_e").alias("mape"), F.median("_e").alias("median_ape"), F.avg(F.abs(F.col("_p") - F.col("_y"))).alias("mae"), F.avg("_y").alias("mean_actual"), F.avg("_p").alias("mean_predicted")).where(F.col("n") >= least_rows)


def price_rollup(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Distribution of a value at every level of a hierarchy, each level below the other; no grand total."""
    q = F.percentile(value, F.array(*map(F.lit, QUANTILES)))
    x = F.col(value)
    out = df.rollup(*levels).agg(F.grouping_id().alias("_g"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), q.alias("_q"))
    out = out.where(F.col("_g") < (1 << len(levels)) - 1)
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("_g"), F.lit("0"), F.lit("")))
    return out.select(*levels, depth.cast("int").alias("depth"), "n", "mean", "std", "low", "high", *(F.col("_q")[i].alias(f"p{int(100 * v)}") for i, v in enumerate(QUANTILES)))


def quantile_buckets(df: DataFrame, value: str, buckets: int, name: str) -> DataFrame:
    """df with the bucket (from 0) between distinct quantile edges, closed on the right; equal edges merge."""
    grid = F.array(*(F.lit(i / buckets) for i in range(buckets + 1)))
    edges = df.agg(F.array_distinct(F.percentile(value, grid)).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bucket = F.size(F.filter(inner, lambda e: F.col(value) > e))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), bucket)).drop("_edges")


def decile_bias(df: DataFrame, y: str, p: str, buckets: int = 10) -> DataFrame:
    out = quantile_buckets(df.where(F.col(y) > 0), y, buckets, "decile")
    return aggregate(out, ["decile"], n=F.count("*"), mean_actual=F.avg(y), mean_predicted=F.avg(p), bias=F.avg(F.col(p) - F.col(y)), mape=F.avg(ratio(F.abs(F.col(p) - F.col(y)), F.col(y))))


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, id_: str) -> DataFrame:
    """The first value, by size, at which half of the group's weight is reached. Equal values are added up first."""
    grouped = aggregate(df.where(F.col(weight) > 0), [*by, value], _w=F.sum(weight))
    out = summed_before(grouped, by, [value], F.col("_w"), "_b", "_t")
    return aggregate(out.where(F.col("_b") + F.col("_w") >= 0.5 * F.col("_t")), by, weighted_median=F.min(value))


def tail_bias(df: DataFrame, y: str, p: str, by: Sequence[str], id_: str, share: float = 0.1) -> DataFrame:
    """Mean error of each group's highest and lowest tenth by actual value."""
    out = ranked(df.select(*by, y, p, id_), by, [y, id_])
    k, error = F.greatest(F.lit(1), F.floor(F.col("rank_of") * share)), F.col(p) - F.col(y)
    return aggregate(out, by, low_bias=F.avg(F.when(F.col("rank") <= k, error)), high_bias=F.avg(F.when(F.col("rank") > F.col("rank_of") - k, error)))


def correlations(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """(column, pearson, spearman) of each column with y; ranks of ties are averaged. Ranks come from counts of distinct values."""
    long = df.select(F.col(y).alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["_y"], list(columns), "column", "_x").where("_x is not null and _y is not null")
    long = durable(long)

    def ranks(value: str, name: str) -> DataFrame:
        counted = aggregate(long, ["column", value], _n=F.count("*"))
        out = summed_before(counted, ["column"], [value], F.col("_n"), "_b", "_t")
        return out.select("column", value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name))

    both = attach(attach(long, ranks("_x", "_rx"), ["column", "_x"]), ranks("_y", "_ry"), ["column", "_y"])
    return aggregate(both, ["column"], pearson=F.corr("_x", "_y"), spearman=F.corr("_rx", "_ry"))


def flag_lift(df: DataFrame, flags: Sequence[str], scope: Column) -> DataFrame:
    """Share of each flag within a scope over its share in all rows."""
    long = df.select(scope.cast("int").alias("_s"), *flags).unpivot(["_s"], list(flags), "flag", "on")
    out = aggregate(long, ["flag"], n_all=F.sum("on"), n_scope=F.sum(F.col("on") * F.col("_s")), share_all=F.avg("on"), share_scope=F.avg(F.when(F.col("_s") == 1, F.col("on"))))
    return out.withColumn("lift", ratio(F.col("share_scope"), F.col("share_all")))


def readiness(df: DataFrame, by: Sequence[str], coverage: Column, good: int = 300, ok: int = 80) -> DataFrame:
    """GOOD, OK or WEAK for each group by its number of rows, districts and coordinate coverage, with reasons."""
    out = aggregate(df, by, n=F.count("*"), n_districts=F.count_distinct("district"), coverage=F.avg(coverage.cast("double")))
    level = F.when((F.col("n") >= good) & (F.col("coverage") >= 0.65), "GOOD").when(F.col("n") >= ok, "OK").otherwise("WEAK")
    why = F.array_join(F.array_compact(F.array(F.when(F.col("n") < good, F.lit("few_rows")), F.when(F.col("coverage") < 0.65, F.lit("low_coverage")), F.when(F.col("n_districts") < 3, F.lit("few_districts")))), "|")
    return out.withColumns({"level": level, "reasons": why})


def top_errors(df: DataFrame, y: str, p: str, id_: str, n: int = 50) -> DataFrame:
    return df.withColumn("abs_error", F.abs(F.col(p) - F.col(y))).orderBy(F.desc("abs_error"), id_).limit(n)
