"""A bundle after saving and loading scores a table and single records alike."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import bundle as B

NUMERIC = ["gross_m2", "building_age"]


def rows(n):
    random = np.random.default_rng(1)
    out = []
    for i in range(n):
        g, age, county = float(random.integers(50, 250)), float(random.integers(0, 45)), "xyz"[i % 3]
        out.append((i, county, f"d{i % 5}", "<=75" if g <= 75 else "76+", f"{1 + i % 4}+1", None if i % 13 == 0 else g, age, 1000 + 3 * g * (county == "y") - 5 * age + float(random.normal(0, 20))))
    return out


def test_loaded_bundle_scores_a_record_as_the_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(400), "id long, county string, district string, m2_group string, room_count string, gross_m2 double, building_age double, y double")
    fitted = B.fit(df, "y", NUMERIC, ["county"], ["ridge", "forest"], {"ridge": 0.75, "forest": 0.25}, {"large_home": 0.5, "old_building": 0.8}, {"y": 1.0})
    before = {r.id: r for r in fitted.predict(df).collect()}
    fitted.save(f"file://{tmp_path}/bundle")
    again = B.load(spark, f"file://{tmp_path}/bundle")
    after = {r.id: r for r in again.predict(df).collect()}
    assert len(before) == 400 and all(after[i].pred_final == pytest.approx(before[i].pred_final, rel=1e-12) for i in before)
    assert all(r.pred_base == pytest.approx(0.75 * r.pred_ridge + 0.25 * r.pred_forest) for r in before.values())
    for r in df.limit(400).where("id in (0, 1, 5, 13, 28)").collect():
        record = {k: v for k, v in r.asDict().items() if k not in ("id", "y")}
        assert B.predict_record(spark, again, json.dumps(record)) == pytest.approx(before[r.id].pred_final, rel=1e-9)
    moved = {r.id for r in before.values() if r.pred_final != r.pred_base}
    large = {r[0] for r in rows(400) if (r[5] or 0) >= 151 or r[4] == "4+1" or r[6] >= 26}
    assert moved == large | {r[0] for r in rows(400) if r[1] == "y"}
    error = lambda c: df.join(again.predict(df).select("id", c), "id").agg(F.avg(F.abs(F.col(c) - F.col("y")))).first()[0]
    assert error("pred_final") < error("location_baseline_m2")
    assert B.predict_record(spark, again, "{}") > 0
