"""Expert models of many groups at once, from sums of products.

A ridge regression needs of its rows the sums of products of features and target, no more. They are taken once
by group and fold; what a fold may learn from is the group's sums less its own, so every group, fold, set of features
and penalty is solved from one pass over the rows. A missing feature stands for the median of the rows learned from: the
sums hold, for each feature, its known values and a mark of the unknown ones apart, so the median is put in afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.text import ratio
from parcela.operators.state import aggregate, attach, durable, fold_medians, percentiles

#: Relative errors that differ by less are equal.
EQUAL = 1e-6


def products(df: DataFrame, by: Sequence[str], numeric: Sequence[str], target: str) -> DataFrame:
    """(by, sums): the sums of products of (1, known values, marks of the unknown, target) as one array a group; rows without a target count nowhere."""
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            found = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=float) for i in range(1, len(numeric) + 2)]
            x, t = np.array(found[:-1]).reshape(len(numeric), -1), found[-1]
            rows = np.vstack([np.ones_like(t), np.nan_to_num(x), np.isnan(x), t])
            code = groups.indices.to_numpy()
            sums = [(rows[:, code == i] @ rows[:, code == i].T).ravel() for i in range(len(groups.dictionary))]
            yield pa.RecordBatch.from_arrays([groups.dictionary, pa.array(sums, pa.list_(pa.float64()))], names=["_key", "sums"])

    known = df.where(F.col(target).isNotNull()).select(key.alias("_key"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*numeric, target])))
    parts = known.mapInArrow(summed, "_key string, sums array<double>")
    each = parts.select("_key", F.posexplode("sums").alias("i", "s")).groupBy("_key", "i").agg(F.sum("s").alias("s"))
    whole = each.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e.s).alias("sums"))  # width squared numbers
    schema = T.StructType([df.schema[c] for c in by])
    return whole.select(F.from_json("_key", schema).alias("k"), "sums").select("k.*", "sums")


def ridge(sums: np.ndarray, fills: np.ndarray, chosen: Sequence[int], alpha: float, scaled: bool = True) -> tuple[np.ndarray, float]:
    """Coefficients (0 for features that are not chosen) and intercept of a ridge regression on standardised features (or on them as they are)."""
    p = len(fills)
    put = np.zeros((p + 2, 2 * p + 2))  # 1, filled features, target out of the kept sums
    put[0, 0] = put[-1, -1] = 1
    put[range(1, p + 1), range(1, p + 1)] = 1
    put[range(1, p + 1), range(p + 1, 2 * p + 1)] = fills
    full = put @ sums.reshape(2 * p + 2, -1) @ put.T
    n = full[0, 0]
    mean = full[0] / n
    spread = full - n * np.outer(mean, mean)
    at = np.array([c + 1 for c in chosen])
    deviation = np.sqrt(np.maximum(spread[at, at], 0) / n)
    deviation[deviation <= 1e-12 * np.maximum(1, np.abs(mean[at]))] = 1  # constant columns move nothing
    deviation = deviation if scaled else np.ones_like(deviation)
    products_of = spread[np.ix_(at, at)] / np.outer(deviation, deviation)
    solved = np.linalg.solve(products_of + alpha * np.eye(len(at)), spread[at, -1] / deviation) / deviation
    coefficients = np.zeros(p)
    coefficients[list(chosen)] = solved
    return coefficients, float(mean[-1] - solved @ mean[at])


def solved(learned: DataFrame, medians: DataFrame, by: Sequence[str], numeric: Sequence[str], models: Mapping[str, tuple[Sequence[str], float]], scaled: bool = True) -> DataFrame:
    """(by, rows, fills, and for each model its coefficients and intercept) from (by, sums) and (by, fills)."""
    fields = [f"{m}_{x}" for m in models for x in ("c", "b")]
    types = ", ".join(f"`{m}_c` array<double>, `{m}_b` double" for m in models)
    asked = {m: ([numeric.index(c) for c in columns], alpha) for m, (columns, alpha) in models.items()}
    both = attach(learned, medians, by)
    schema = T.StructType([*(both.schema[c] for c in by), *T.StructType.fromDDL(f"rows double, fills array<double>, {types}").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, fills = (batch.column(c).to_pylist() for c in ("sums", "fills"))
            fills = [np.array([0.0 if v is None else v for v in (f or [None] * len(numeric))]) for f in fills]
            out = [[x for chosen, alpha in asked.values() for x in ridge(np.array(s), f, chosen, alpha, scaled)] for s, f in zip(sums, fills, strict=True)]
            columns = [pa.array([r[i].tolist() if i % 2 == 0 else r[i] for r in out], pa.list_(pa.float64()) if i % 2 == 0 else pa.float64()) for i in range(len(fields))]
            own = [pa.array([s[0] for s in sums], pa.float64()), pa.array([f.tolist() for f in fills], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *own, *columns], names=[*by, "rows", "fills", *fields])

    return both.mapInArrow(rows, schema)


def filled_medians(df: DataFrame, by: Sequence[str], numeric: Sequence[str], folds: int | None) -> DataFrame:
    """(by, [fold,] fills): the medians of the features among the group's rows of all other folds, or (folds None) of all rows."""
    long = df.select(*by, *(["fold"] if folds else []), *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot([*by, *(["fold"] if folds else [])], list(numeric), "_name", "_value")
    found = fold_medians(long, [*by, "_name"], "_value", folds) if folds else percentiles(long, [*by, "_name"], "_value", {"median": 0.5})
    keys = [*by, *(["fold"] if folds else [])]
    return aggregate(found, keys, fills=F.array(*(F.max(F.when(F.col("_name") == c, F.col("median"))) for c in numeric)))


def fold_ridges(df: DataFrame, by: Sequence[str], numeric: Sequence[str], target: str, models: Mapping[str, tuple[Sequence[str], float]], folds: int, scaled: bool = True) -> DataFrame:
    """(by, fold, rows, fills, coefficients): for every group and fold the models of the group's other folds; folds that leave nothing to learn from have none."""
    own = durable(products(df, [*by, "fold"], numeric, target))
    every = own.select(*by, "fold", F.posexplode("sums").alias("i", "s")).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("held <> fold")
    others = every.groupBy(*by, "held", "i").agg(F.sum("s").alias("s")).groupBy(*by, "held").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e.s).alias("sums"))
    known = df.where(F.col(target).isNotNull())
    return solved(others.withColumn("held", F.col("held").cast(df.schema["fold"].dataType)).withColumnRenamed("held", "fold"), filled_medians(known, by, numeric, folds), [*by, "fold"], numeric, models, scaled)


def applied(df: DataFrame, state: DataFrame, keys: Sequence[str], numeric: Sequence[str], models: Sequence[str]) -> DataFrame:
    """df with z_<model>: what the models of a row's keys expect; null where there is none."""
    out = attach(df, state, keys)
    for m in models:
        parts = (F.element_at(f"{m}_c", i + 1) * F.coalesce(F.col(c).cast("double"), F.element_at("fills", i + 1)) for i, c in enumerate(numeric))
        out = out.withColumn(f"z_{m}", sum(parts, F.col(f"{m}_b")))
    return out.drop("rows", "fills", *(f"{m}_{x}" for m in models for x in "cb"))


def group_importances(df: DataFrame, by: Sequence[str], numeric: Sequence[str], target: str, alpha: float = 10.0) -> DataFrame:
    """(by, feature, importance, place): how far a deviation of each feature moves every group's ridge of all rows, dearest first."""
    sums = durable(products(df, by, numeric, target))
    known = df.where(F.col(target).isNotNull())
    state = solved(sums, filled_medians(known, by, numeric, None), by, numeric, {"m": (list(numeric), alpha)})
    filled = attach(known, state.select(*by, "fills"), by)
    spread = aggregate(filled, by, **{f"_d{i}": F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.element_at("fills", i + 1), F.lit(0.0))) for i, c in enumerate(numeric)})
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(F.element_at("m_c", i + 1) * F.col(f"_d{i}")).alias("importance")) for i, c in enumerate(numeric)))).alias("x")
    out = attach(state.select(*by, "m_c"), spread, by).select(*by, each).select(*by, "x.*")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")))  # a row for each feature


def error_columns(y: Column, p: Column) -> dict[str, Column]:
    """Rows, determination, relative and absolute error, all of which add up."""
    return {"rows": F.count(y), "r2": 1 - ratio(F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count(y)), "mape": F.avg(ratio(F.abs(p - y), y)), "mae": F.avg(F.abs(p - y))}


def expert_layer(
    df: DataFrame, id_: str, by: str, target: str, p: str, baseline: str, numeric: Sequence[str], models: Mapping[str, tuple[Sequence[str], float]], folds: int,
    blends: Sequence[float], least_rows: int, overrides: Mapping[str, int] | None = None, most_models: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Predictions blended with experts of each group of `by`, where that helps; and a report with a row for each group.

    The experts learn ln(target / baseline) from the group's other folds. The best `most_models` of a group by
    relative error weigh by its inverse; every blend is tried in one pass, and the best one is taken if its
    relative error is lower than that of the prediction as it is. Groups of fewer rows than `least_rows` (or their
    own least number in `overrides`) are left alone, as are rows whose group is null."""
    named = df.where(F.col(by).isNotNull() & (F.col(target) > 0) & F.col(p).isNotNull())
    need = F.coalesce(F.element_at(F.create_map(*(x for k, v in overrides.items() for x in (F.lit(k), F.lit(v)))), F.col(by)), F.lit(least_rows)) if overrides else F.lit(least_rows)
    sizes = aggregate(named, [by], rows=F.count("*")).withColumn("min_rows_used", need)
    large = sizes.where(F.col("rows") >= F.col("min_rows_used")).select(by, F.lit(True).alias("_large"))
    data = attach(named, large, [by]).where("_large").drop("_large").withColumn("_z", F.ln(F.col(target) / F.col(baseline)))
    data = durable(data.select(id_, by, "fold", target, p, baseline, "_z", *(c for c in numeric if c not in (id_, by, "fold", target, p, baseline))))
    state = fold_ridges(data, [by], numeric, "_z", models, folds)
    seen = applied(data, state, [by, "fold"], numeric, list(models))
    value = lambda m: F.greatest(F.lit(0.0), F.col(baseline) * F.exp(f"z_{m}"))
    seen = durable(seen.select(id_, by, F.col(target).alias("_y"), F.col(p).alias("_p"), *(F.coalesce(value(m), F.col(p)).alias(m) for m in models)))
    tried = seen.unpivot([by, "_y"], list(models), "model", "_v")
    errors = aggregate(tried, [by, "model"], **error_columns(F.col("_y"), F.col("_v")))
    place = Window.partitionBy(by).orderBy("mape", "mae", "model")  # a row for each model
    best = errors.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most_models).withColumn("_w", 1 / F.greatest(F.col("mape"), F.lit(EQUAL)))
    total = F.sum("_w").over(Window.partitionBy(by))
    weights = aggregate(best.withColumn("_w", F.col("_w") / total), [by], weights=F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "_w")))))
    expert = sum((F.coalesce(F.element_at("weights", F.lit(m)), F.lit(0.0)) * F.col(m) for m in models), F.lit(0.0))
    mixed = durable(attach(seen, weights, [by]).select(id_, by, "_y", "_p", expert.alias("_e"), "weights"))
    blend = F.explode(F.array(*(F.lit(float(b)) for b in (0.0, *blends)))).alias("blend")
    grid = mixed.select(by, "_y", blend, "_p", "_e").withColumn("_v", (1 - F.col("blend")) * F.col("_p") + F.col("blend") * F.col("_e"))
    grid = aggregate(grid, [by, "blend"], **error_columns(F.col("_y"), F.col("_v")))
    now, alone = F.col("blend") == 0, F.col("blend") == 1
    of = lambda c, when: F.max(F.when(when, F.col(c)))
    chosen = aggregate(
        grid, [by], _best=F.min(F.when(~now, F.struct(F.col("mape"), F.col("mae"), (-F.col("r2")).alias("worse"), "blend"))),
        **{f"current_{c}": of(c, now) for c in ("r2", "mape", "mae")}, **{f"expert_{c}": of(c, alone) for c in ("r2", "mape", "mae")},
    )
    helps = F.col("_best.mape") < F.col("current_mape") - EQUAL
    chosen = chosen.select(
        by, *(F.col(f"{x}_{c}") for x in ("current", "expert") for c in ("r2", "mape", "mae")), (-F.col("_best.worse")).alias("blended_r2"),
        F.col("_best.mape").alias("blended_mape"), F.col("_best.mae").alias("blended_mae"), F.when(helps, F.col("_best.blend")).otherwise(0.0).alias("blend_weight"),
    )
    chosen = durable(attach(chosen, weights, [by]))
    report = attach(sizes, chosen, [by])
    status = F.when(F.col("current_mape").isNull(), "skipped_too_few_rows").when(F.col("blend_weight") > 0, "used_blend").otherwise("kept_current")
    listed = F.array(*(F.lit(k) for k in overrides)) if overrides else F.array().cast("array<string>")
    report = report.withColumns({"override_used": F.array_contains(listed, F.col(by)), "status": status, "blend_weight": F.coalesce("blend_weight", F.lit(0.0))})
    moved = attach(mixed.drop("weights"), chosen.select(by, "blend_weight"), [by]).where("blend_weight > 0")
    moved = moved.select(id_, ((1 - F.col("blend_weight")) * F.col("_p") + F.col("blend_weight") * F.col("_e")).alias("_layered"))
    return attach(df, moved, [id_]).withColumn("layered", F.coalesce("_layered", p)).drop("_layered"), report


def segment_experts(
    df: DataFrame, id_: str, segments: Mapping[str, Column], target: str, p: str, baseline: str, numeric: Sequence[str], models: Mapping[str, tuple[Sequence[str], float]],
    folds: int, blends: Sequence[float], least_rows: int = 180,
) -> tuple[DataFrame, DataFrame]:
    """Predictions blended with experts of each segment, and the report; a listing of several segments takes the last one that is used."""
    names = list(segments)
    member = F.array_compact(F.array(*(F.when(F.coalesce(s, F.lit(False)), F.lit(n)) for n, s in segments.items())))
    rows = df.withColumn("segment", F.explode(member)).withColumn("_row", F.concat_ws("/", F.col(id_).cast("string"), "segment"))
    layered, report = expert_layer(rows, "_row", "segment", target, p, baseline, numeric, models, folds, blends, least_rows)
    report = durable(report)
    used = attach(layered, report.select("segment", (F.col("status") == "used_blend").alias("_used")), ["segment"]).where("_used")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("segment"))
    last = aggregate(used, [id_], _layered=F.max_by("layered", order))
    return attach(df, last, [id_]).withColumn("layered", F.coalesce("_layered", p)).drop("_layered"), report
