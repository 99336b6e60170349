"""Earlier operator forms on small tables worked out by hand."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parcela.operators import variants as V
from parcela.operators.reports import tail_bias
from parcela.operators.state import ranked


def test_room_pair_and_both_spellings(spark):
    df = spark.createDataFrame([(" 3 + 01 ",), ("Stüdyo",), (None,)], "r string")
    assert [r[0] for r in df.select(V.room_pair(F.col("r"))).collect()] == ["3+1", "stüdyo", None]
    assert [r[0] for r in df.select(V.both_spellings(F.col("r"))).collect()] == [" 3 + 01   3 + 01 ", "stüdyo studyo", ""]


def test_strict_flats_join_all_reasons(spark):
    rows = [(1, "Köy evi", "daire", "3+1", 100.0, 50.0), (2, "ev", "Müstakil", "5+1", 230.0, 50.0), (3, "ev", None, None, 40.0, 50.0), (4, "ev", "daire", "2 + 1", 100.0, None), (5, None, "daire", "2 + 1", 45.0, 50.0)]
    df = spark.createDataFrame(rows, "classified_id int, title string, kind string, room_count string, gross_m2 double, unit_price double")
    out = {r.classified_id: r.reason for r in V.strict_flats(df, "koy evi", "mustakil", (10.0, 100.0)).collect()}
    assert out == {1: "title_special_segment", 2: "real_estate_type_special_segment; room_count_not_standard; gross_m2_above_220", 3: "room_count_not_standard; gross_m2_below_45", 5: ""}


def test_ranks_stay_whole_where_one_group_holds_most_rows(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 37 % 11).alias("v"))
    out = ranked(df, ["g"], ["v", "id"]).toPandas()
    for _, part in out.groupby("g", dropna=False):
        part = part.sort_values(["v", "id"])
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and set(part["rank_of"]) == {len(part)}
    assert ranked(df.where("id < 0"), ["g"], ["v", "id"]).count() == 0


def test_rank_buckets_are_steps_of_the_ranks(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 23)) for i in range(23)] + [(99, None)], "id long, v double").where("v is not null")
    out = V.rank_buckets(df, [], ["v", "id"], 5, "b").toPandas().sort_values(["v", "id"])
    assert out["b"].tolist() == (pd.qcut(out["v"].rank(method="first"), 5, labels=False) + 1).tolist()


def test_residuals_fall_back_and_draw_to_the_county(spark):
    rows = [("c", "d", "s", "2+1", "new", 10.0), ("c", "d", "s", "2+1", "new", 20.0), ("c", "e", "s", "1+1", "old", 0.0)]
    columns = "county string, district string, m2_group string, room_count string, age_group string, y double"
    fit = spark.createDataFrame(rows, columns)
    df = spark.createDataFrame([("c", "d", "s", "2+1", "new", None), ("c", "d", "t", "9+1", "old", None), ("z", "d", "s", "2+1", "new", None)], columns)
    a, b, z = V.place_age_residuals(df, fit, "y", alpha=2.0, full=4).orderBy("county", "m2_group").collect()
    assert a.district_m2_age_residual == 0.5 * 15 + 0.5 * 10 and a.residual_level == 3 and a.residual_confidence == 0.5
    assert b.district_room_residual == b.county_age_residual == 1 / 3 * 0 + 2 / 3 * 10 and b.county_m2_residual == 10 and b.residual_level == 1 and b.residual_confidence == 0
    assert z.county_age_residual == z.district_age_residual == 0 and z.residual_level == 0


def test_coverage_of_features(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (3.0, None), (1.0, None), (None, None)], "a double, b double")
    a, b = V.feature_coverage(df, ["a", "b"]).orderBy("feature").collect()
    assert (a.non_null_rate, a.mean, a.low, a.high, a.mode) == (0.8, 2.0, 1.0, 3.0, 1.0) and abs(a["std"] - np.std([1, 1, 3, 3], ddof=1)) < 1e-12
    assert b.non_null_rate == 0 and b.mean is None and b.mode is None and b["std"] is None


def test_training_matrix_and_first_known(spark):
    df = spark.createDataFrame([(1, 5.0, float("inf"), None), (2, float("nan"), 1.0, "x"), (3, -1.0, 1.0, "x"), (4, float("inf"), 1.0, "x"), (5, None, 1.0, "x")], "id int, y double, n double, c string")
    assert [tuple(r) for r in V.training_matrix(df, "y", ["n"], ["c"], ["id"]).collect()] == [(1, 5.0, None, "missing")]
    rows = spark.createDataFrame([("k", 2, 7.0, None), ("k", 1, None, None), ("k", 3, 9.0, None)], "key string, o int, a double, b double")
    assert [tuple(r) for r in V.first_known(rows, ["key"], ["a", "b"], "o").collect()] == [("k", 7.0, None, 1)]


def test_tail_bias_takes_a_row_at_least(spark):
    df = spark.createDataFrame([("a", i, float(i), float(i + (10 if i == 1 else -5 if i == 4 else 0))) for i in range(1, 5)], "g string, id int, y double, p double")
    assert [tuple(r) for r in tail_bias(df, "y", "p", ["g"], "id").collect()] == [("a", 10.0, -5.0)]
