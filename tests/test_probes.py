"""Importances, group folds and the leakage probe against plain Python and numpy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from parcela.operators import experts as X
from parcela.operators import models as L
from parcela.operators import probes as P


def greedy(sizes, folds):
    loads = [0] * folds
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


@given(st.lists(st.integers(1, 12), max_size=60), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_quotas_are_the_greedy_rule(sizes, folds):
    quotas = P.greedy_quotas({s: sizes.count(s) for s in set(sizes)}, folds)
    loads = [0] * folds
    for size, fold, n in quotas:
        loads[fold] += size * n
    assert sorted(loads) == sorted(greedy(sizes, folds)) and sum(n for *_, n in quotas) == len(sizes)


def test_group_folds_keep_groups_whole(spark):
    random = np.random.default_rng(1)
    groups = [f"g{int(g)}" for g in random.integers(0, 30, 400)] + ["big"] * 200
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "id long, g string")
    rows = P.with_group_folds(df, "g", 4).collect()
    of = {}
    for r in rows:
        of.setdefault(r.g, set()).add(r.fold)
    assert len(rows) == 600 and all(len(f) == 1 for f in of.values())
    assert sorted(sum(r.fold == f for r in rows) for f in range(4)) == sorted(greedy([groups.count(g) for g in set(groups)], 4))


def ridge_r2(x, y, fold, alpha):
    pred = np.zeros(len(y))
    for f in set(fold):
        seen = fold != f
        fill = np.nanmedian(x[seen], axis=0)
        a, b = np.where(np.isnan(x[seen]), fill, x[seen]), np.where(np.isnan(x[~seen]), fill, x[~seen])
        m = a.mean(axis=0)
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(x.shape[1]), (a - m).T @ (y[seen] - y[seen].mean()))
        pred[~seen] = (b - m) @ w + y[seen].mean()
    return 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_spatial_leakage(spark):
    random = np.random.default_rng(2)
    place = random.integers(0, 12, 300)
    effect = random.normal(0, 10, 12)
    x = np.c_[effect[place] + random.normal(0, 0.01, 300), random.normal(0, 1, 300)]
    x[random.random(300) < 0.1, 1] = np.nan
    y = np.where(place % 2 == 0, effect[place], -effect[place]) + random.normal(0, 0.1, 300)
    df = spark.createDataFrame([(i, i % 5, f"p{place[i]}", float(x[i, 0]), None if np.isnan(x[i, 1]) else float(x[i, 1]), float(y[i])) for i in range(300)], "id long, fold int, place string, a double, b double, y double")
    got = P.spatial_leakage(df, "place", ["a", "b"], "y", 5).first()
    grouped = {r.id: r.fold for r in P.with_group_folds(df.drop("fold"), "place", 5).collect()}
    assert got.random_r2 == pytest.approx(ridge_r2(x, y, np.arange(300) % 5, 10.0), abs=1e-8)
    assert got.grouped_r2 == pytest.approx(ridge_r2(x, y, np.array([grouped[i] for i in range(300)]), 10.0), abs=1e-8)
    assert got.n_groups == 12 and got.n_rows == 300 and got.gap == pytest.approx(got.random_r2 - got.grouped_r2)
    assert P.spatial_leakage(df.limit(20), "place", ["a", "b"], "y", 5).first().status == "skipped"


@pytest.mark.parametrize("name", ["forest", "ridge"])
def test_importances_go_back_to_columns(spark, name):
    random = np.random.default_rng(3)
    rows = [(float(random.normal()), float(random.normal()), ["p", "q", "r"][int(random.integers(0, 3))]) for _ in range(400)]
    df = spark.createDataFrame([(a, b, k, 10 * (k == "q") + 3 * a) for a, b, k in rows], "alpha double, alpha_b double, kind string, _z double")
    model = Pipeline(stages=[*L.preparation(["alpha", "alpha_b"], ["kind"]), L.regressors()[name]]).fit(df)
    got = {r.feature: r for r in P.column_importances(model, df).collect()}
    assert set(got) == {"alpha", "alpha_b", "kind"} and [got[c].rank for c in ("kind", "alpha", "alpha_b")] == [1, 2, 3]
    last = model.stages[-1]
    whole = np.abs((last.featureImportances if name == "forest" else last.coefficients).toArray()).sum()
    assert sum(r.importance for r in got.values()) == pytest.approx(whole)


def test_group_importances(spark):
    random = np.random.default_rng(4)
    rows = [(g, float(random.normal(0, 2)), float(random.normal()), g == "u") for g in ("u", "v") for _ in range(200)]
    df = spark.createDataFrame([(g, a, b, (3 * a if u else 5 * b)) for g, a, b, u in rows], "g string, a double, b double, y double")
    got = {(r.g, r.feature): r for r in X.group_importances(df, ["g"], ["a", "b"], "y", 1e-6).collect()}
    assert got["u", "a"].place == 1 and got["v", "b"].place == 1
    assert got["u", "a"].importance == pytest.approx(3 * np.std([r[1] for r in rows[:200]]), rel=1e-4) and got["v", "a"].importance == pytest.approx(0, abs=1e-4)
