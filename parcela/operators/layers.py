"""Layers over predictions: segment models, residual models with guardrails, quantile mapping, comparables, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import ratio
from parcela.operators.models import blend_grid, capped, preparation, regressors
from parcela.operators.reports import metrics
from parcela.operators.state import aggregate, attach, fold_grid, learned


def out_of_fold_residual(df: DataFrame, target: str, p: str, numeric: Sequence[str], folds: int, name: str, model: str = "ridge") -> DataFrame:
    """df with the log residual that a model of the other folds expects."""
    data = df.withColumn("_z", F.ln(F.col(target) / F.col(p)))
    parts = None
    for fold in range(folds):
        known, own = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if known.isEmpty():  # nothing to learn from: no residual is expected
            part = own.withColumn(name, F.lit(0.0)).select(*df.columns, name)
        else:
            fitted = Pipeline(stages=[*preparation(numeric, []), regressors()[model]]).fit(known)
            part = fitted.transform(own).withColumn(name, F.col("prediction")).select(*df.columns, name)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def residual_layer(df: DataFrame, target: str, p: str, scope: Column, numeric: Sequence[str], folds: int, shares: Sequence[float], cap: float = 0.12) -> tuple[DataFrame, float]:
    """Predictions with a share of the expected residual within a scope, and that share.

    The share is the one of best determination in the scope among those that leave the whole table's
    relative error no worse; 0 if there is none. All shares are tried in one pass; a row for each comes back."""
    inside = F.coalesce(scope, F.lit(False))
    seen = out_of_fold_residual(df.where(inside), target, p, numeric, folds, "_r")
    rest = df.where(~inside).withColumn("_r", F.lit(0.0))
    both = seen.withColumn("_in", F.lit(True)).unionByName(rest.withColumn("_in", F.lit(False)))
    moved = F.col(p) * F.exp(F.col("_share") * F.greatest(F.lit(-cap), F.least(F.lit(cap), F.coalesce("_r", F.lit(0.0)))))
    tried = both.withColumn("_share", F.explode(F.array(*(F.lit(float(s)) for s in (0.0, *shares))))).withColumn("_p", moved)
    # the medians are not asked for, so they are not computed
    whole = {r["_share"]: r["mape"] for r in metrics(tried, target, "_p", ["_share"]).select("_share", "mape").collect()}
    part = {r["_share"]: r["r2"] for r in metrics(tried.where("_in"), target, "_p", ["_share"]).select("_share", "r2").collect()}
    able = [s for s in part if whole[s] <= whole[0.0] and part[s] >= part[0.0]]
    best = max(able, key=lambda s: (part[s], -s), default=0.0)
    return both.withColumn("_share", F.lit(best)).withColumn("layered", moved).drop("_share", "_r", "_in"), best


def segment_layer(df: DataFrame, target: str, p: str, segment: Column, expert: str, weights: Sequence[float], least_rows: int = 180) -> tuple[DataFrame, float]:
    """Predictions blended with an expert column within a segment, at the weight of least relative error; 0 if none helps or rows are few."""
    inside = df.where(F.coalesce(segment, F.lit(False)))
    grid = {r["weight"]: r["mape"] for r in blend_grid(inside, target, p, expert, [0.0, *weights]).collect()}
    enough = len(inside.limit(least_rows).take(least_rows)) >= least_rows
    best = min(grid, key=lambda w: (grid[w], w)) if enough and grid else 0.0
    mixed = (1 - F.lit(best)) * F.col(p) + F.lit(best) * F.col(expert)
    return df.withColumn("layered", F.when(F.coalesce(segment, F.lit(False)), mixed).otherwise(F.col(p))), best


def calibrate_quantiles(df: DataFrame, target: str, p: str, folds: int, points: int = 20, share: float = 0.5, cap: float = 0.1) -> DataFrame:
    """df with `calibrated` half way from a prediction to the actual value of the same quantile (0.05 to 0.95) in the other
    folds; beyond these the end points stand, and folds of fewer than 40 rows correct nothing."""
    grid = [0.05 + 0.9 * i / (points - 1) for i in range(points)]
    own = aggregate(df, ["fold"], _o=F.count("*"))
    rows = attach(own, aggregate(own, [], _w=F.sum("_o")), []).select("fold", (F.col("_w") - F.col("_o")).alias("_n"))
    for name, c in (("_x", p), ("_y", target)):
        rows = attach(rows, fold_grid(df.select("fold", F.ln(c).alias("_l")), "_l", folds, grid).withColumnRenamed("grid", name), ["fold"])
    state = learned(rows.where("_n >= 40"))
    x = F.ln(F.col(p))
    out = attach(df, state, ["fold"])
    at = F.greatest(F.lit(1), F.least(F.lit(points - 1), F.size(F.filter("_x", lambda e: e <= x))))
    low, high, a, b = F.element_at("_x", at), F.element_at("_x", at + 1), F.element_at("_y", at), F.element_at("_y", at + 1)
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))))
    mapped = a + place * (b - a)
    return out.withColumn("calibrated", capped(F.col(p), x + share * (mapped - x), cap)).drop("_x", "_y", "_n")


def comparable_features(df: DataFrame, similar: DataFrame, id_: str, value: str, fallback_keys: Sequence[str]) -> DataFrame:
    """Median, number and confidence of the similar listings' values, weighted mean by score; the group's median where there are none."""
    values = df.select(F.col(id_).alias("neighbour"), F.col(value).alias("_v"))
    stats = aggregate(similar.join(values, "neighbour"), [id_], comp_median=F.median("_v"), comp_count=F.count("*"), comp_mean=F.try_divide(F.sum(F.col("score") * F.col("_v")), F.sum("score")))
    out = attach(attach(df, stats, [id_]), aggregate(df, fallback_keys, _m=F.median(value)), fallback_keys)
    return out.withColumns({
        "comp_missing": F.col("comp_median").isNull().cast("int"), "comp_value": F.coalesce("comp_median", "_m"), "comp_count": F.coalesce("comp_count", F.lit(0)),
        "comp_confidence": F.least(F.lit(1.0), F.coalesce("comp_count", F.lit(0)) / 3.0), "comp_gap": ratio(F.coalesce("comp_median", "_m"), F.col("_m")),
    }).drop("_m")


def location_clusters(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """df's rows with coordinates with their cluster by k-means."""
    known = df.where("lat is not null and lon is not null")
    vector = VectorAssembler(inputCols=["lat", "lon"], outputCol="_v")
    return Pipeline(stages=[vector, KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster")]).fit(known).transform(known).drop("_v")
