"""States that are learned from one ordering, and tables that are written with few columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import baseline, encoders, models, reports, state
from parcela.plans import analytics, cleaning

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def valued(spark):
    random = np.random.default_rng(4)
    rows = [(i, i % 3, "ab"[i % 7 > 4], float(random.integers(0, 40)) if i % 11 else None) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id long, fold int, k string, v double").cache()


def test_grid_of_other_folds(valued):
    rows, df = valued
    grid = [0.05 + 0.9 * i / 19 for i in range(20)]
    got = {r.fold: r.grid for r in state.fold_grid(df, "v", 3, grid).collect()}
    for f in range(3):
        assert got[f] == pytest.approx(np.quantile([r[3] for r in rows if r[1] != f and r[3] is not None], grid))


def test_group_medians_of_other_folds(valued):
    rows, df = valued
    got = {(r.k, r.fold): (r.median, r.n) for r in state.group_fold_medians(df, ["k"], "v", 3).collect()}
    want = {(k, f): [r[3] for r in rows if r[2] == k and r[1] != f and r[3] is not None] for k in "ab" for f in range(3)}
    assert got == {key: (np.median(v), len(v)) for key, v in want.items()}


def test_location_baseline_copies_no_rows(valued, monkeypatch):
    rows, df = valued
    monkeypatch.setattr(encoders, "to_other_folds", lambda *_: pytest.fail("rows are copied"))
    out = {r.id: r for r in encoders.location_baseline(df, "v", [(1, ["k"], 100)], 3).collect()}
    for i, f, _, _ in rows[:30]:
        others = [r[3] for r in rows if r[1] != f and r[3] is not None]
        own = [r[3] for r in rows if r[1] != f and r[2] == rows[i][2] and r[3] is not None]
        assert (out[i].baseline, out[i].baseline_level) == ((np.median(own), 1) if len(own) >= 100 else (np.median(others), 0))


def test_levels_copy_no_values(valued, monkeypatch):
    _, df = valued
    seen, whole = [], baseline.at_levels
    monkeypatch.setattr(baseline, "at_levels", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    listed = df.select("id", F.col("k").alias("county"), F.lit("d").alias("district"), F.lit("m").alias("m2_group"), F.lit("r").alias("room_count"), "v")
    assert baseline.in_sample_baseline(listed, "v").count() == 200 and max(seen) <= 2


def test_medians_of_all_rows_over_partitions(valued):
    _, df = valued
    df = df.withColumn("p", F.col("v") * 1.5 + F.col("id"))
    one, spread = reports.metrics(df, "v", "p").first(), reports.metrics(df, "v", "p", spread=True).first()
    assert one.asDict().keys() == spread.asDict().keys() and tuple(one) == pytest.approx(tuple(spread))


def test_pair_tests_join_nothing(spark):
    class Price:
        def transform(self, df):
            return df.withColumn("prediction", 2.0 * F.col("m2"))

    df = spark.createDataFrame([(1, 50.0), (1, 80.0)], "id long, m2 double")  # rows of one id are not crossed
    assert tuple(models.pair_tests(df, Price(), {"larger": {"m2": F.col("m2") + 5}}, "id").first()) == ("larger", 2, 10.0, 1.0)


def test_few_columns_are_written(spark):
    assert analytics.predicted(spark, SF, "m2_group").columns == ["classified_id", "fold", "county", "room_count", "unit_price", "m2_group", "pred", "pred_count"]
    sales, rentals = cleaning.both_purposes(spark, SF)
    assert sales.columns == list(cleaning.SCORED) and sales.count() > rentals.count() > 0 and rentals.where("monthly_rent is null").isEmpty()
