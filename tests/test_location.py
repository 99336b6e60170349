"""Clusters of many groups against Lloyd's rounds in numpy, and centres with parents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import location as L


def test_group_clusters_equal_lloyd(spark):
    random = np.random.default_rng(1)
    rows = [(g, float(x), float(y)) for g in ("u", "v", None) for x, y in random.integers(0, 20, (60, 2))] + [("few", 1.0, 1.0), ("few", 2.0, 2.0), ("few", 1.0, 1.0), ("u", None, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, x double, y double")
    got = {r.id: r for r in L.group_clusters(df, ["g"], "x", "y", 3, 6).collect()}
    assert len(got) == len(rows) - 1
    hashes = {(r.x, r.y): r.h for r in df.where("x is not null").select("x", "y", F.xxhash64("x", "y").alias("h")).distinct().collect()}
    for g in ("u", "v", None, "few"):
        at = [i for i, r in enumerate(rows) if r[0] == g and r[1] is not None]
        points = np.array([rows[i][1:] for i in at])
        centre = np.array(sorted(set(map(tuple, points)), key=lambda p: (hashes[p], *p))[:3])
        for _ in range(6):
            near = ((points[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            centre = np.array([points[near == c].mean(axis=0) if (near == c).any() else centre[c] for c in range(len(centre))])
        apart = ((points[:, None] - centre[None]) ** 2).sum(axis=2)
        assert [got[i].cluster for i in at] == apart.argmin(axis=1).tolist()
        assert np.allclose([got[i].distance_to_cluster for i in at], np.sqrt(apart.min(axis=1)))


def test_centres_fall_back_to_parents(spark):
    rows = [(i, "x", "big", 40.0 + i / 10, 29.0, "exact") for i in range(4)] + [(4, "x", "small", 41.0, 30.0, "exact"), (5, "y", "one", 42.0, 31.0, "approx"), (6, "y", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, county string, district string, lat double, lon double, location_precision string")
    out = {r.id: r for r in L.location_features(df, df, {"a": (40.0, 29.0)}).collect()}
    county = np.mean([40.0, 40.1, 40.2, 40.3, 41.0])
    assert out[0].lat_centered_district == pytest.approx(-0.15) and out[4].lat_centered_district == pytest.approx(41.0 - county)
    assert out[5].lat_centered_district == pytest.approx(out[5].lat_centered_city) and out[6].has_lat_lon == 0 and out[6].distance_to_a_m is None and out[6].bearing_city_sin == 0
    assert out[0].distance_to_a_m == pytest.approx(0, abs=1e-6) and out[0].distance_to_nearest_anchor_m == out[0].distance_to_a_m
    strict = {r.id: r.has_lat_lon for r in L.location_features(df, df, {}, "exact").collect()}
    assert strict[5] == 0 and strict[0] == 1
