"""Edge cases that the driver tables lack."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions import geo, text
from parcela.operators import clean, encoders, layers, models, neighbours, reports, scores
from parcela.operators.state import aggregate, attach
from parcela.sources import sinks, tables
from parcela.streaming.incremental import ingest, upsert


def one(spark, column, value, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "value"), [
    ("6.500.000", 6500000.0), ("54.166,67", 54166.67), ("54166.67", 54166.67), ("6.500", 6500.0), ("1,5", 1.5), ("₺ 3.000 TL", 3000.0),
    ("1,234.5", 1234.5), ("-", None), ("", None), (None, None), ("12.34.5", 12345.0), ("120 m²", 120.0),
])
def test_number(spark, raw, value):
    assert one(spark, text.number, raw) == value


@pytest.mark.parametrize(("raw", "value"), [("11-15", 13.0), ("31 ve üzeri", 35.0), ("5", 5.0), ("0", 0.0), ("", None), ("yeni", None), ("6-9", 7.5), (None, None)])
def test_age(spark, raw, value):
    assert one(spark, text.age, raw) == value


@pytest.mark.parametrize(("raw", "value"), [("İzmit", "izmit"), ("IŞIK", "isik"), ("Çınarlı  Mah.", "cinarli mah."), ("Straße", "straße"), (None, None)])
def test_fold(spark, raw, value):
    assert one(spark, text.fold, raw) == value


def test_rooms_floor_and_stem(spark):
    assert one(spark, lambda c: text.rooms(c)[0], "3 + 1") == 3.0
    assert one(spark, lambda c: text.rooms(c)[0], "Stüdyo") is None
    assert one(spark, text.floor, "Zemin kat") == 0.0
    assert one(spark, text.floor, "Çatı katı") is None
    assert one(spark, text.site_stem, "Orka Life II Sitesi 3+1 120m2") == "orka life 2"
    assert one(spark, text.count_values, "A| |B|") == 2
    assert one(spark, text.clean, " None ") is None


def test_weighted_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.2, 0.8)], "a double, b double")
    assert [r[0] for r in df.select(text.weighted([(F.col("a"), 1.0), (F.col("b"), 3.0)])).collect()] == pytest.approx([1.0, 0.5, 0.65])


def test_null_keys_meet(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    rows = attach(df, aggregate(df, ["k"], n=F.count("*")), ["k"]).collect()
    assert {(r["k"], r["v"], r["n"]) for r in rows} == {(None, 1, 2), (None, 2, 2), ("a", 3, 1)}


def test_groups_without_spread_judge_nothing(spark):
    df = spark.createDataFrame([("a", 1.0)] * 20 + [("a", 9.0)], "g string, v double")
    assert not any(r["group_outlier"] for r in clean.group_iqr(df, "v", ["g"], 5).collect())
    assert all(r["z"] is None for r in clean.mad_z(df, F.col("v"), ["g"], "z").collect())


def test_unknown_is_not_in_range(spark):
    df = spark.createDataFrame([(None,), (5.0,), (50.0,)], "v double")
    kept, removed = clean.split(df, clean.in_ranges({"v": (1, 10, False)}), "range")
    assert kept.count() == 1 and removed.count() == 2


def test_encoding_never_sees_its_own_fold(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(40)]
    df = encoders.with_fold(spark.createDataFrame(rows, "id long, k string, y double"), "id", 4)
    changed = df.withColumn("y", F.when(F.col("fold") == 2, F.col("y") * 100).otherwise(F.col("y")))

    def of(d):
        a = encoders.mean_encoding(d, ["k"], "y", 5.0, "m")
        b = encoders.location_baseline(d, "y", [(1, ["k"], 3)], 4)
        return [(r["id"], r["m"]) for r in a.where("fold = 2").orderBy("id").collect()], [(r["id"], r["baseline"]) for r in b.where("fold = 2").orderBy("id").collect()]

    assert of(df) == of(changed)


def test_bad_json_gives_nulls_and_present_values_stand(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}', None), ("{bad", 7), (None, None), ('{"a": 2}', 5)], "raw string, a int")
    out = tables.json_values(df, "raw", {"a": "int", "b": "string"}).collect()
    assert [(r["a"], r["b"]) for r in out] == [(1, "x"), (7, None), (None, None), (5, None)]


def test_buckets_merge_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,), (None,)], "v double")
    got = {(r["v"], r["b"]) for r in reports.quantile_buckets(df, "v", 5, "b").collect()}
    assert (None, None) in got and len({b for v, b in got if v is not None}) >= 2
    assert len({b for v, b in got if v == 1.0}) == 1


def test_haversine_and_polyline(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    d = df.select(geo.haversine(*(F.col(c) for c in "abcd"))).first()[0]
    assert d == pytest.approx(geo.EARTH * math.pi / 180)
    assert df.select(geo.polyline_distance(F.col("a"), F.col("b"), [(0.0, -1.0), (0.0, 1.0)])).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_nearest_excludes_the_listing_itself(spark):
    df = spark.createDataFrame([(1, 40.0, 29.0, 1.0), (2, 40.0, 29.0, 2.0), (3, 40.001, 29.0, 3.0), (4, None, None, 4.0)], "id long, lat double, lon double, v double")
    rows = neighbours.nearest_listings(df, "id", "v", 2).collect()
    assert {(r["id"], r["neighbour"], r["rank"]) for r in rows} == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}


def test_calibration_stays_within_its_cap(spark):
    rows = [(i, float(100 + i), float(50 + i)) for i in range(60)]
    df = encoders.with_fold(spark.createDataFrame(rows, "id long, y double, p double"), "id", 3)
    for out in (models.calibrate_linear(df, "y", "p", 3), models.calibrate_bins(df, "y", "p", 3, 4, 5), models.calibrate_isotonic(df, "y", "p", 3)):
        assert out.count() == 60
        assert out.where(F.abs(F.ln(F.col("calibrated") / F.col("p"))) > 0.1 + 1e-9).isEmpty()


def test_pair_tests(spark):
    class Price:
        def transform(self, df):
            return df.withColumn("prediction", 2.0 * F.col("m2"))

    df = spark.createDataFrame([(1, 50.0), (2, 80.0)], "id long, m2 double")
    out = models.pair_tests(df, Price(), {"larger": {"m2": F.col("m2") + 5}}, "id").first()
    assert (out["variant"], out["n"], out["mean_change"], out["share_up"]) == ("larger", 2, 10.0, 1.0)


def test_upsert_and_ingest(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])
    a = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], schema)
    b = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], schema)
    assert {tuple(r) for r in upsert(a, b, ["id"], ["at"]).collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 1, "e")}
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    a.write.parquet(folder)
    ingest(spark, folder, schema, target, checkpoint, ["id"], ["at"])
    b.write.mode("append").parquet(folder)
    ingest(spark, folder, schema, target, checkpoint, ["id"], ["at"])
    assert {tuple(r) for r in spark.read.parquet(f"{target}/v1").collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 1, "e")}


def test_scan_names_what_is_missing(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", True).csv(str(tmp_path / "t.csv"))
    df, missing = tables.scan(spark, str(tmp_path / "t"), ["b", "c"])
    assert df.columns == ["b"] and missing == ["c"]
    assert tables.first_present(["Lat", "lon"], ["latitude", "lat"]) == "Lat"


def test_geojson_and_keyed_replacement(spark, tmp_path):
    points = spark.createDataFrame([("a", 2, 40.2, 29.2), ("a", 1, 40.1, 29.1)], "line string, seq int, lat double, lon double")
    assert sinks.geojson_lines(points, "line").first()["geojson"] == '{"type":"LineString","coordinates":[[29.1,40.1],[29.2,40.2]]}'
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    sinks.write_table(points, old)
    sinks.replace_keyed(points.withColumn("lat", F.lit(41.0)).where("seq = 1"), old, new, ["line", "seq"], ["seq"])
    assert {(r.seq, r.lat) for r in spark.read.parquet(new).collect()} == {(1, 41.0), (2, 40.2)}
    sinks.write_report(points, str(tmp_path / "report"), ["seq"])
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2


def test_scores_of_missing_attributes(spark):
    assert one(spark, scores.yes_no, " Var ") == 1.0 and one(spark, scores.yes_no, "Hayır") == 0.0 and one(spark, scores.yes_no, "belki") is None
    assert one(spark, scores.age_score, None, "double") == 0.5
    assert [one(spark, scores.yes_no, x) for x in ("Açık Otopark", "Otopark yok", "var, yeni", "hayır", "-", None)] == [1.0, 0.0, 1.0, 0.0, None, None]
    assert one(spark, text.site_stem, "Sitesi 3+1") == "missing" and one(spark, text.stem_id, "Orka  Life-2") == "orka_life_2"
    assert one(spark, scores.poi_category, "High_School") == "education"
    df = spark.createDataFrame([(None, 1.0, "x"), (True, 1.0, "x")], "e boolean, v double, c string")
    assert {tuple(r) for r in scores.scope_mask(df, F.col("e"), ["v"], ["c"]).select("v", "c").collect()} == {(0.0, "location_not_used"), (1.0, "x")}


def test_layers_keep_every_row(spark):
    rows = [(i, float(100 + i % 7 * 5), 110.0, float(i % 7), i // 2 % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y double, p double, x double, s int").withColumn("fold", (F.col("id") % 2).cast("int"))
    out, share = layers.residual_layer(df, "y", "p", F.col("s") == 1, ["x"], 2, [0.5, 1.0])
    assert out.count() == 120 and share > 0
    mixed, weight = layers.segment_layer(df.withColumn("expert", F.col("y")), "y", "p", F.col("s") == 1, "expert", [0.5, 1.0], 10)
    assert weight == 1.0 and mixed.where("s = 1 and layered <> y").isEmpty() and mixed.where("s = 0 and layered <> p").isEmpty()
    assert layers.segment_layer(df.withColumn("expert", F.col("y")), "y", "p", F.col("s") == 1, "expert", [1.0], 1000)[1] == 0.0
    assert layers.calibrate_quantiles(df, "y", "p", 2).count() == 120
