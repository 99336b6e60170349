"""Layers that add a share of an expected residual to the predictions of one scope, behind guardrails.

All candidates (delta models by shares) are judged in one grouped pass over the scope's rows; the report says for each
which guardrails refuse it. What is outside the scope enters by its sums alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.text import ratio
from parcela.operators.encoders import to_other_folds
from parcela.operators.experts import applied, filled_medians, fold_ridges, products, solved
from parcela.operators.models import preparation
from parcela.operators.state import aggregate, attach, durable, ranked, running

# The ridge penalties of the delta models, the shares tried, and the bounds of the guardrails.
PENALTIES = (5.0, 10.0, 20.0, 50.0)
LARGE_SHARES, SPREAD_SHARES = (0.10, 0.15, 0.20, 0.25, 0.35), (0.05, 0.10, 0.15, 0.20, 0.25)
MOST_SCOPE_MAPE, MOST_GLOBAL_MAPE, STEP, SMALL = 0.115, 0.131, 1e-4, 1e-6
LEAST_LARGE, LEAST_SPREAD = 40, 80


def fold_rank(df: DataFrame, by: Sequence[str], p: str, folds: int, name: str = "pred") -> DataFrame:
    """df with the place of each prediction among those of all other folds of its group: `<name>_rank` (the share that is lower),
    `<name>_decile` (1 to 10) and `<name>_z`.

    Distinct predictions are ordered once for all folds, each with its number in every fold; what a fold ranks
    against is all less its own. Folds with nothing to rank against get nulls."""
    counts = aggregate(df.where(F.col(p).isNotNull()), [*by, p], all=F.count("*"), **{f"f{i}": F.count_if(F.col("fold") == i) for i in range(folds)})
    at = durable(running(counts, by, [p], {c: F.col(c) for c in ("all", *(f"f{i}" for i in range(folds)))}))
    places, edges = [], []
    for i in range(folds):
        total, before, here = (F.col(f"all{x}") - F.col(f"f{i}{x}") for x in ("_total", "_before", ""))
        places.append(F.when(F.col(f"f{i}") > 0, F.struct(F.lit(i).alias("fold"), ratio(before.cast("double"), total).alias("rank"))))
        ends = []
        for d in range(1, 11):
            place = (total - 1) * F.lit(d / 10)
            for side, r in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                ends.append(F.when((total > 0) & (before <= r) & (r < before + here), F.struct(F.lit(i).alias("fold"), F.lit(d).alias("d"), F.lit(side).alias("side"), (place - F.floor(place)).alias("part"))))
        edges += ends
    place = at.select(*by, p, F.explode(F.array_compact(F.array(*places))).alias("_x")).select(*by, p, F.col("_x.fold").alias("fold"), F.col("_x.rank").alias(f"{name}_rank"))
    edge = at.select(*by, p, F.explode(F.array_compact(F.array(*edges))).alias("x")).select(*by, p, "x.*")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col(p)))
    edge = aggregate(edge, [*by, "fold", "d"], lo=of("lo"), hi=of("hi"), part=F.max("part"))
    edge = aggregate(edge, [*by, "fold"], _edges=F.collect_list(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")))  # ten of them
    sums = aggregate(df.where(F.col(p).isNotNull()), [*by, "fold"], _n=F.count(p), _s=F.sum(p), _q=F.sum(F.col(p) * F.col(p)))
    held = aggregate(sums.withColumn("_held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_held <> fold"), [*by, "_held"], _n=F.sum("_n"), _s=F.sum("_s"), _q=F.sum("_q")).withColumnRenamed("_held", "fold")
    mean = F.col("_s") / F.col("_n")
    held = held.select(*by, "fold", mean.alias("_mean"), (F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean)) + SMALL).alias("_sd"))
    out = attach(attach(attach(df, place, [*by, p, "fold"]), edge, [*by, "fold"]), held, [*by, "fold"])
    decile = F.least(F.lit(10), F.size(F.filter("_edges", lambda e: e <= F.col(p))) + 1)
    return out.withColumns({f"{name}_decile": F.when(F.col("_edges").isNotNull() & F.col(p).isNotNull(), decile), f"{name}_z": (F.col(p) - F.col("_mean")) / F.col("_sd")}).drop("_edges", "_mean", "_sd")


def in_sample_rank(df: DataFrame, by: Sequence[str], p: str, name: str = "pred") -> DataFrame:
    """df with rank (equal predictions share the lowest), decile and z of each prediction within its own group."""
    counts = aggregate(df.where(F.col(p).isNotNull()), [*by, p], n=F.count("*"))
    at = durable(running(counts, by, [p], {"n": F.col("n")}))
    place = at.select(*by, p, (F.col("n_before") / F.greatest(F.lit(1), F.col("n_total") - 1)).alias(f"{name}_rank"))
    edges = []
    for d in range(1, 11):
        where = (F.col("n_total") - 1) * F.lit(d / 10)
        edges += [F.when((F.col("n_before") <= r) & (r < F.col("n_before") + F.col("n")), F.struct(F.lit(d).alias("d"), F.lit(side).alias("side"), (where - F.floor(where)).alias("part"))) for side, r in (("lo", F.floor(where)), ("hi", F.ceil(where)))]
    edge = at.select(*by, p, F.explode(F.array_compact(F.array(*edges))).alias("x")).select(*by, p, "x.*")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col(p)))
    edge = aggregate(edge, [*by, "d"], lo=of("lo"), hi=of("hi"), part=F.max("part"))
    edge = aggregate(edge, by, _edges=F.collect_list(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")))
    sums = aggregate(df, by, _mean=F.avg(p), _sd=F.stddev_pop(p) + SMALL)
    out = attach(attach(attach(df, place, [*by, p]), edge, by), sums, by)
    decile = F.least(F.lit(10), F.size(F.filter("_edges", lambda e: e <= F.col(p))) + 1)
    return out.withColumns({f"{name}_decile": decile, f"{name}_z": (F.col(p) - F.col("_mean")) / F.col("_sd")}).drop("_edges", "_mean", "_sd")


def boosted(df: DataFrame, id_: str, target: str, numeric: Sequence[str], folds: int, models: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(id, model, delta): boosted trees (iterations, depth) of the other folds."""
    out = None
    for fold in range(folds):
        known, own = df.where((F.col("fold") != fold) & F.col(target).isNotNull()), df.where(F.col("fold") == fold)
        if known.isEmpty():
            continue
        prepared = Pipeline(stages=preparation(numeric, [], scale=False)).fit(known)
        seen, unseen = durable(prepared.transform(known).select("features", target)), durable(prepared.transform(own).select(id_, "features"))
        for name, (iterations, depth) in models.items():
            tree = GBTRegressor(maxIter=iterations, stepSize=0.05, maxDepth=depth, subsamplingRate=0.85, seed=42, featuresCol="features", labelCol=target).fit(seen)
            part = tree.transform(unseen).select(id_, F.lit(name).alias("model"), F.col("prediction").alias("delta"))
            out = part if out is None else out.unionAll(part)
    return out if out is not None else df.select(id_, F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("delta")).where("false")


def ridge_names(penalties: Sequence[float]) -> dict[float, str]:
    return {a: f"ridge_{a:g}" for a in penalties}


def ridge_deltas(df: DataFrame, id_: str, target: str, numeric: Sequence[str], folds: int, penalties: Sequence[float]) -> DataFrame:
    """(id, model, delta): the residuals that ridges of the other folds expect, for all penalties at once."""
    names = ridge_names(penalties)
    state = fold_ridges(df.withColumn("_one", F.lit(0)), ["_one"], numeric, target, {n: (list(numeric), a) for a, n in names.items()}, folds)
    seen = applied(df.withColumn("_one", F.lit(0)), state, ["_one", "fold"], numeric, list(names.values()))
    return seen.select(id_, *(F.coalesce(f"z_{n}", F.lit(0.0)).alias(n) for n in names.values())).unpivot([id_], list(names.values()), "model", "delta")


def determination(y: Column, p: Column, where: Column) -> Column:
    own = F.when(where, y)
    return 1 - ratio(F.sum(F.when(where, F.pow(y - p, 2))), F.var_pop(own) * F.count(own))


def candidates(scope: DataFrame, deltas: DataFrame, id_: str, shares: Sequence[float], inside: str) -> DataFrame:
    """(id, y, p, ..., model, share, v): every row of the scope under every candidate; rows outside `inside` keep their prediction. The candidate '' is the prediction as it is."""
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    models = deltas.select("model").distinct().select("model", share).unionAll(scope.sparkSession.createDataFrame([("", 0.0)], "model string, share double"))
    every = scope.join(F.broadcast(models))  # a few dozen candidates
    tried = every.join(deltas.withColumnsRenamed({id_: "_did", "model": "_dm"}), (F.col(id_) == F.col("_did")) & (F.col("model") == F.col("_dm")), "left")
    return tried.withColumn("v", F.when(F.col(inside) & F.col("delta").isNotNull(), F.greatest(F.lit(0.0), F.col("_p") + F.col("share") * F.col("delta"))).otherwise(F.col("_p"))).drop("_did", "_dm", "delta")


def judged(tried: DataFrame, outside: DataFrame, measures: Mapping[str, Column], rules: Mapping[str, Column], rank: Sequence[Column]) -> DataFrame:
    """A row for each candidate: its measures, those of the prediction as it is (`before_`), the reasons against it, and its place by `rank`."""
    y, v = F.col("_y"), F.col("v")
    relative = ratio(F.abs(v - y), y)
    found = aggregate(tried, ["model", "share"], **measures, scope_mape=F.avg(relative), _s=F.sum(relative), _n=F.count(relative))
    rest = aggregate(outside, [], _rs=F.coalesce(F.sum(ratio(F.abs(F.col("_p") - y), y)), F.lit(0.0)), _rn=F.count(ratio(F.abs(F.col("_p") - y), y)))
    found = attach(found, rest, []).withColumn("global_mape", (F.col("_s") + F.col("_rs")) / (F.col("_n") + F.col("_rn"))).drop("_s", "_n", "_rs", "_rn")
    found = durable(found)
    names = [*measures, "scope_mape", "global_mape"]
    before = found.where("model = ''").select(*(F.col(c).alias(f"before_{c}") for c in names))
    both = attach(found.where("model <> ''"), before, [])
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))
    place = F.row_number().over(Window.orderBy(*rank, "model", "share"))  # a few dozen rows
    return both.withColumns({"reasons": reasons, "place": place})


def layered(df: DataFrame, id_: str, p: str, inside: str, deltas: DataFrame, report: DataFrame) -> DataFrame:
    """df with the first-placed candidate applied within the scope if nothing speaks against it."""
    best = report.where((F.col("place") == 1) & (F.size("reasons") == 0)).select(F.col("model").alias("_model"), F.col("share").alias("_share"))
    moved = deltas.join(F.broadcast(best), F.col("model") == F.col("_model")).select(id_, (F.col("_share") * F.col("delta")).alias("_d"))
    return attach(df, moved, [id_]).withColumn("layered", F.when(F.col(inside) & F.col("_d").isNotNull(), F.greatest(F.lit(0.0), F.col(p) + F.col("_d"))).otherwise(F.col(p))).drop("_d")


def no_candidates(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The report of a scope with too few rows: none was tried."""
    names = [*measures, "scope_mape", "global_mape"]
    columns = ["model string", "share double", *(f"{n} double" for n in names), *(f"before_{n} double" for n in names), "reasons array<string>", "place int"]
    return df.sparkSession.createDataFrame([], ", ".join(columns))


def enough(df: DataFrame, inside: str, least: int) -> bool:
    return len(df.where(inside).select(inside).take(least)) >= least


def large_home_layer(df: DataFrame, id_: str, target: str, p: str, county: Column, large: Column, numeric: Sequence[str], folds: int, trees: Mapping[str, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions of a county's large homes moved by a share of their expected residual, and the report, empty where the scope has too few rows.

    Ridges of four penalties and boosted trees, by five shares. The best candidate (by the large homes' and the
    county's determination, then the county's relative error) is applied if the large homes' determination rises,
    the county's does not fall, its relative error and that of all rows stay within bounds, and the county's
    other homes do not lose."""
    rows = durable(df.withColumns({"_in": F.coalesce(county & large, F.lit(False)), "_county": F.coalesce(county, F.lit(False)), "_y": F.col(target), "_p": F.col(p), "pred_current": F.col(p)}))
    if not enough(rows, "_in", LEAST_LARGE):
        return df.withColumn("layered", F.col(p)), no_candidates(df, ("large_r2", "county_r2", "other_r2"))
    features = [*numeric, "pred_current"]
    scope = rows.where("_in").withColumn("_delta", F.col("_y") - F.col("_p"))
    deltas = ridge_deltas(scope, id_, "_delta", features, folds, PENALTIES)
    if trees:
        deltas = deltas.unionByName(boosted(scope, id_, "_delta", features, folds, trees))
    deltas = durable(deltas)
    y, v = F.col("_y"), F.col("v")
    measures = {"large_r2": determination(y, v, F.col("_in")), "county_r2": determination(y, v, F.lit(True)), "other_r2": determination(y, v, ~F.col("_in"))}
    rules = {
        "large_r2_not_above": F.col("large_r2") > F.col("before_large_r2") + STEP, "county_r2_falls": F.col("county_r2") >= F.col("before_county_r2") - STEP,
        "county_mape_over": F.col("scope_mape") <= MOST_SCOPE_MAPE + SMALL, "global_mape_over": F.col("global_mape") <= MOST_GLOBAL_MAPE + SMALL,
        "other_homes_lose": F.col("before_other_r2").isNull() | (F.col("other_r2") >= F.col("before_other_r2") - STEP),
    }
    rank = [F.desc("large_r2"), F.desc("county_r2"), F.asc("scope_mape")]
    tried = candidates(rows.where("_county").select(id_, "_y", "_p", "_in"), deltas, id_, LARGE_SHARES, "_in")
    report = durable(judged(tried, rows.where("not _county"), measures, rules, rank))
    return layered(rows, id_, p, "_in", deltas, report).drop("_in", "_county", "_y", "_p", "pred_current"), report


def spread_layer(df: DataFrame, id_: str, target: str, p: str, scope: Column, numeric: Sequence[str], folds: int) -> tuple[DataFrame, DataFrame]:
    """Predictions of a scope spread towards the actual ones, and the report, empty where the scope has too few rows.

    The delta models also see where a prediction stands among those they learned from (rank, decile, z). The best
    candidate (determination, variance, relative error) is applied if determination and variance rise, the errors
    stay within bounds, and the mean error of the cheapest or the dearest tenth shrinks."""
    rows = durable(df.withColumns({"_in": F.coalesce(scope, F.lit(False)), "_y": F.col(target), "_p": F.col(p), "pred_current": F.col(p)}))
    if not enough(rows, "_in", LEAST_SPREAD):
        return df.withColumn("layered", F.col(p)), no_candidates(df, ("r2", "variance", "cheap", "rich"))
    inside = rows.where("_in").withColumn("_delta", F.col("_y") - F.col("_p"))
    features = [*numeric, "pred_current", "pred_rank", "pred_decile", "pred_z"]
    names = ridge_names(PENALTIES)
    learn = durable(in_sample_rank(to_other_folds(inside, folds), ["fold"], "pred_current"))  # a fold's name now stands for what it learns from
    state = solved(products(learn, ["fold"], features, "_delta"), filled_medians(learn, ["fold"], features, None), ["fold"], features, {n: (features, a) for a, n in names.items()})
    seen = applied(fold_rank(inside, [], "pred_current", folds), state, ["fold"], features, list(names.values()))
    deltas = durable(seen.select(id_, *(F.coalesce(f"z_{n}", F.lit(0.0)).alias(n) for n in names.values())).unpivot([id_], list(names.values()), "model", "delta"))
    tail = F.greatest(F.lit(1), F.floor(F.col("rank_of") / 10))
    placed = ranked(inside.select(id_, "_y", "_p", "_in"), [], ["_y", id_]).withColumns({"_low": F.col("rank") <= tail, "_high": F.col("rank") > F.col("rank_of") - tail}).drop("rank", "rank_of")
    y, v = F.col("_y"), F.col("v")
    measures = {
        "r2": determination(y, v, F.lit(True)), "variance": ratio(F.var_pop(v), F.var_pop(y)),
        "cheap": F.avg(F.when(F.col("_low"), v - y)), "rich": F.avg(F.when(F.col("_high"), v - y)),
    }
    rules = {
        "r2_not_above": F.col("r2") > F.col("before_r2") + STEP, "variance_not_above": F.col("variance") > F.col("before_variance") + STEP,
        "scope_mape_over": F.col("scope_mape") <= MOST_SCOPE_MAPE + SMALL, "global_mape_over": F.col("global_mape") <= MOST_GLOBAL_MAPE + SMALL,
        "tails_not_nearer": (F.abs("cheap") < F.abs("before_cheap") - 1.0) | (F.abs("rich") < F.abs("before_rich") - 1.0),
    }
    tried = candidates(placed, deltas, id_, SPREAD_SHARES, "_in")
    report = durable(judged(tried, rows.where("not _in"), measures, rules, [F.desc("r2"), F.desc("variance"), F.asc("scope_mape")]))
    return layered(rows, id_, p, "_in", deltas, report).drop("_in", "_y", "_p", "pred_current"), report
