"""Site names, dictionary matches, merges and measured tables on small tables worked out by hand."""

from pyspark.sql import functions as F

from parcela.operators import sites as P

ALIASES = {"orka life": "orka", "orka life 2": "orka_2", "abc": "abc", "panoramakent": "pano"}


def test_site_names(spark):
    rows = [
        (1, "Orka Evleri", "x", None), (2, "YOK", "Satılık Orka Life 2 daire", None), (3, None, "güzel daire", "Mavi Göl Konutları yanı"), (4, "Yok", "satilik daire sitesi", None),
        (5, None, None, None), (6, "", "acil panoramakent", "panoramakent"), (7, None, "manzara deniz gunesi", None), (8, "var", "abc", ""),
    ]
    df = spark.createDataFrame(rows, "id int, s string, t string, a string")
    out = {r.id: (r.site_raw, r.site_source) for r in P.site_names(df, "s", "t", "a", list(ALIASES)).collect()}
    assert out[1] == ("Orka Evleri", "site_name") and out[2] == ("orka life 2", "title") and out[6] == ("panoramakent", "title")
    assert out[3][0].endswith("mavi gol konutlari") and out[3][0].startswith("guzel daire") is False and out[3][1] == "address"
    assert out[4] == out[5] == out[8] == ("", "missing") and out[7] == ("manzara deniz gunesi", "title")


def test_known_sites_do_not_absorb_phases(spark):
    rows = [("orka life", ""), ("orka life 2", ""), ("orka life 3", "orka life"), ("orka life ii", ""), ("orka life b blok", ""), ("abc", ""), ("abc d", ""), ("", "evi panoramakent 3 te"), ("", "panoramakent 3 ve panoramakent"), (None, None), ("", "panoramakentte")]
    df = spark.createDataFrame(rows, "s string, t string")
    out = [r[0] for r in df.select(P.known_site(F.col("s"), F.col("t"), ALIASES)).collect()]
    assert out == ["orka", "orka_2", None, None, "orka", "abc", None, None, "pano", None, None]


def test_merges_frequencies_and_differences(spark):
    df = spark.createDataFrame([("a", "a1", 10.0)] * 4 + [("a", "a2", 25.0)] * 4 + [("b", "b1", 1.0), ("b", "b2", 50.0), ("c", "c1", 1.0), ("missing", "x", 1.0), ("missing", "y", 99.0)], "site string, v string, p double")
    out = {r.site: (r.n_variants, r.total_count, r.median_gap, r.warning, r.severe) for r in P.merge_audit(df, "site", "v", "p", 15.0).collect()}
    assert out == {"a": (2, 8, 15.0, "possible_bad_merge", True), "b": (2, 2, 49.0, "possible_bad_merge", False)}
    assert {(r.site, r.site_frequency, r.site_frequency_bucket) for r in P.with_frequency(df, "site").collect()} == {("a", 8, 3), ("b", 2, 1), ("c", 1, 1), ("missing", 0, 0)}
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", "u")], "k int, f string, g string"), spark.createDataFrame([(1, "x", "n"), (3, None, None)], "k int, f string, g string")
    assert {(r.k, r.feature, r.is_equal) for r in P.feature_diff(a, b, ["k"], ["f", "g"]).collect()} == {(1, "f", True), (1, "g", False), (2, "f", False), (2, "g", False), (3, "f", True), (3, "g", True)}


def test_measured_tables_join_once_for_an_id(spark):
    df = spark.createDataFrame([("1", 5.0), (" 2", None), ("3", None), ("4", None), (None, None)], "id string, green double")
    measured = spark.createDataFrame([("1 ", 7.0, 1.0, None), ("2", 8.0, None, None), ("2", 9.0, None, None), ("3", None, None, "cloud"), (None, 1.0, 1.0, None)], "id string, green double, built double, missing_reason string")
    out = {r.id: tuple(r)[1:] for r in P.attach_measured(df, measured, "id", ["green", "built"]).select("id", "green", "built", "has_measures", "missing_reason").collect()}
    assert out == {"1": (5.0, 1.0, 1.0, ""), " 2": (8.0, None, 1.0, ""), "3": (None, None, 0.0, "cloud"), "4": (None, None, 0.0, "no_match_or_coords"), None: (None, None, 0.0, "no_match_or_coords")}
