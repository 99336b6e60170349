"""Queries over sites and their dictionary, measured tables, leading features and differences, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.functions import text as X
from parcela.operators import sites as P
from parcela.operators.state import aggregate
from parcela.plans.analytics import ORACLE_SQL as ANALYTICS
from parcela.plans.analytics import SALES, enc_detail_premium, rounded, sales
from parcela.plans.sql import LISTING, RAW
from parcela.sources import tables as S

KNOWN = {"hot plate": "hot_plate", "hot plate 2": "hot_plate_2", "red ring": "red_ring"}


def src_site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose titles and addresses name a site in several ways, or none."""
    k, title = F.col("partkey") % 5, F.col("title")
    df = S.listings(spark, sf_dir).withColumns({
        "site": F.when(F.col("suppkey") % 4 == 0, F.initcap("title")).when(F.col("suppkey") % 4 == 1, "Yok"), "address": F.when((k == 4) & (F.col("partkey") % 2 == 0), F.concat(title, F.lit(" Kent"))),
        "heading": F.when(k == 0, F.concat(title, F.lit(" Sitesi"))).when(k == 1, F.concat(title, F.lit(" LIFE"))).when(k == 2, F.concat(title, F.lit(" 2"))).when(k == 3, "Satılık daire sitesi"),
    })
    return P.site_names(df, "site", "heading", "address", list(KNOWN)).select("classified_id", "site_raw", "site_source")


def enc_known_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("suppkey") % 5, F.col("partkey") % 3
    text = F.when(k == 0, "near red ring 4").when(k == 1, "red ring").when(k == 2, "red ring 4 and red ring, etap")
    stem = F.concat(F.col("title"), F.when(n == 0, "").otherwise(F.concat(F.lit(" "), (n + 1).cast("string"))))
    df = sales(spark, sf_dir).withColumns({"stem": X.site_stem(stem), "text": text})
    return df.withColumn("site_id", P.known_site(F.col("stem"), F.col("text"), KNOWN)).select("classified_id", "stem", "site_id")


def enc_site_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir).withColumn("site", F.when(F.col("partkey") % 4 > 0, F.concat_ws("/", "title", "county")).otherwise("missing"))
    return aggregate(P.with_frequency(df, "site"), ["site", "site_frequency", "site_frequency_bucket"], n=F.count("*"))


def dq_site_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles merged by their last word within a county, and how far their medians lie apart."""
    df = sales(spark, sf_dir).withColumn("site", F.concat_ws("/", F.element_at(F.split("title", " "), -1), "county"))
    return rounded(P.merge_audit(df, "site", "title", "unit_price", 120.0), 4, "median_gap")


def join_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    measured = df.where("partkey % 3 > 0").select(
        F.concat(F.lit(" "), F.col("classified_id"), F.lit(" ")).alias("classified_id"), F.when(F.col("suppkey") % 2 == 0, F.col("discount")).alias("green"),
        F.when(F.col("suppkey") % 3 == 0, F.col("tax")).alias("built"), F.when(F.col("partkey") % 2 == 0, "cloud").alias("missing_reason"),
    )
    return P.attach_measured(df, measured, "classified_id", ["green", "built"]).select("classified_id", "green", "built", "has_measures", "missing_reason")


def topk_county_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two flags of each county with the largest premiums or discounts."""
    effects = enc_detail_premium(spark, sf_dir).withColumn("size", F.abs("effect"))
    return rounded(P.top_by_group(effects, "county", "flag", "size", 2), 6, "mean_value")


def dq_feature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings changed each feature between their first and their last row."""
    raw = S.raw_listings(spark, sf_dir)
    first = raw.withColumn("_n", F.row_number().over(Window.partitionBy("classified_id").orderBy(*(F.col(c).asc_nulls_last() for c in S.LISTING_ORDER)))).where("_n = 1")
    out = P.feature_diff(first, S.listings(spark, sf_dir), ["classified_id"], ["county", "room_count", "title", "near_market"])
    return aggregate(out, ["feature", "is_equal"], n=F.count("*"))


QUERIES = {f.__name__: f for f in (src_site_names, enc_known_site, enc_site_frequency, dq_site_merges, join_measured, topk_county_features, dq_feature_diff)}

FIRST = ", ".join(f"{c} ASC NULLS LAST" for c in S.LISTING_ORDER)
COMPARED = ("county", "room_count", "title", "near_market")

ORACLE_SQL = {
    "src_site_names": LISTING + """, a AS (SELECT *, partkey % 5 k, suppkey % 4 = 0 own, title IN ('hot plate', 'red ring') AS known FROM listing), b AS (SELECT *, CASE WHEN own THEN list_reduce(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || w[2:]), lambda x, y: x || ' ' || y) WHEN k = 2 AND title = 'hot plate' THEN 'hot plate 2' WHEN known AND (k < 3 OR k = 4 AND partkey % 2 = 0) THEN title
WHEN k = 0 THEN title || ' sitesi' WHEN k = 1 THEN title || ' life' WHEN k = 4 AND partkey % 2 = 0 THEN title || ' kent' ELSE '' END raw FROM a) SELECT classified_id, raw AS site_raw, CASE WHEN own THEN 'site_name' WHEN raw = '' THEN 'missing' WHEN k = 4 THEN 'address' ELSE 'title' END AS site_source FROM b""",
    "enc_known_site": SALES + """, a AS (SELECT *, title || CASE partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 2' ELSE ' 3' END AS stem FROM s)
SELECT classified_id, stem, CASE WHEN stem IN ('hot plate', 'hot plate 2', 'red ring') THEN replace(stem, ' ', '_') WHEN title = 'red ring' THEN NULL WHEN suppkey % 5 IN (1, 2) THEN 'red_ring' END AS site_id FROM a""",
    "enc_site_frequency": SALES + """, a AS (SELECT CASE WHEN partkey % 4 > 0 THEN title || '/' || county ELSE 'missing' END AS site, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT *, CASE WHEN site = 'missing' THEN 0 ELSE n END AS f FROM a)
SELECT site, f AS site_frequency, CASE WHEN f <= 0 THEN 0 WHEN f < 3 THEN 1 WHEN f < 8 THEN 2 WHEN f < 20 THEN 3 ELSE 4 END AS site_frequency_bucket, n FROM b""",
    "dq_site_merges": SALES + """, e AS (SELECT string_split(title, ' ')[-1] || '/' || county AS site, title, count(*) n, median(unit_price) m FROM s GROUP BY ALL), t AS (SELECT site, count(*) AS n_variants, CAST(sum(n) AS BIGINT) AS total_count, max(m) - min(m) g FROM e GROUP BY ALL HAVING count(*) > 1)
SELECT site, n_variants, total_count, round(g, 4) AS median_gap, CASE WHEN g >= 120 THEN 'possible_bad_merge' ELSE '' END AS warning, g >= 120 AND (total_count >= 8 OR n_variants >= 3) AS severe FROM t""",
    "join_measured": SALES + """, a AS (SELECT *, CASE WHEN partkey % 3 > 0 AND suppkey % 2 = 0 THEN discount END AS green, CASE WHEN partkey % 3 > 0 AND suppkey % 3 = 0 THEN tax END AS built FROM s)
SELECT classified_id, green, built, CASE WHEN coalesce(green, built) IS NOT NULL THEN 1e0 ELSE 0e0 END AS has_measures, CASE WHEN coalesce(green, built) IS NOT NULL THEN '' WHEN partkey % 3 > 0 AND partkey % 2 = 0 THEN 'cloud' ELSE 'no_match_or_coords' END AS missing_reason FROM a""",
    "topk_county_features": "SELECT county, flag, round(abs(effect), 6) AS mean_value, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY abs(effect) DESC, flag) AS place FROM (" + ANALYTICS["enc_detail_premium"] + ")) WHERE place <= 2",
    "dq_feature_diff": RAW + f""", k AS (SELECT *, row_number() OVER (PARTITION BY classified_id ORDER BY {FIRST}) AS a, count(*) OVER (PARTITION BY classified_id) AS n FROM raw), w AS (SELECT x.classified_id, """ + ", ".join(f"x.{c} = y.{c} AS {c}" for c in COMPARED) + """ FROM k x JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classified_id ORDER BY """ + ", ".join(f"{c} DESC NULLS LAST" for c in S.LISTING_ORDER) + """) AS z FROM raw) WHERE z = 1) y USING (classified_id) WHERE x.a = 1)
SELECT feature, is_equal, count(*) AS n FROM (UNPIVOT w ON """ + ", ".join(COMPARED) + " INTO NAME feature VALUE is_equal) GROUP BY ALL",
}
