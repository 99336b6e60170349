"""Queries over what lies around listings, with SQL twins that compare all places with all points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions.geo import utm35
from parcela.operators import encoders as E
from parcela.operators import geo_context as C
from parcela.operators import location as L
from parcela.operators.state import durable
from parcela.plans.analytics import FOLDS, haversine_sql, rounded
from parcela.plans.sql import LISTING, plain
from parcela.sources import tables as S

COUNTY = "NATION_3"

#: Tagged points, road vertices and coast points, from the suppliers, parts and nations.
POIS = """
SELECT CASE s.s_suppkey % 9 WHEN 0 THEN 'school' WHEN 1 THEN 'university' WHEN 2 THEN 'hospital' WHEN 3 THEN 'pharmacy' WHEN 4 THEN 'marketplace' END AS amenity,
       CASE WHEN s.s_suppkey % 9 = 5 THEN 'supermarket' END AS shop, CASE WHEN s.s_suppkey % 9 = 6 THEN 'park' END AS leisure,
       CASE WHEN s.s_suppkey % 9 = 7 THEN 'bus_stop' END AS highway, CASE WHEN s.s_suppkey % 9 >= 7 THEN 'transport' WHEN s.s_suppkey % 4 = 0 THEN 'daily' ELSE 'other' END AS category,
       CASE WHEN s.s_suppkey % 11 = 0 THEN 'kindergarten' END AS subcategory,
       40.55e0 + (s.s_suppkey * 37 % 450) / 1000e0 AS lat, 29.40e0 + (s.s_suppkey * 53 % 850) / 1000e0 AS lon FROM {supplier} s
"""
ROADS = """
SELECT CASE WHEN p.p_size <= 3 THEN 'highway' WHEN p.p_size <= 10 THEN 'primary' WHEN p.p_size <= 30 THEN 'major' WHEN p.p_size <= 40 THEN 'other' END AS road_class,
       CASE p.p_size WHEN 11 THEN 'motorway_link' WHEN 12 THEN 'trunk' WHEN 41 THEN 'secondary' END AS highway,
       40.55e0 + (p.p_partkey * 17 % 451) / 1000e0 AS lat, 29.40e0 + (p.p_partkey * 29 % 853) / 1000e0 AS lon FROM {part} p WHERE p.p_partkey % 3 = 0
"""
COAST = "SELECT 40.58e0 + n.n_nationkey * 0.004e0 AS lat, 29.40e0 + n.n_nationkey * 0.035e0 AS lon FROM {nation} n"


def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the columns that the features take."""
    df = E.with_fold(S.listings(spark, sf_dir, "sale"), "classified_id", FOLDS)
    return df.withColumns({
        "location_precision": F.when(F.col("lat").isNotNull(), F.when(F.col("partkey") % 3 == 0, "exact").otherwise("approx")), "near_sea_zero": F.col("in_parking"),
        "site_inside": F.when(F.col("near_market") == 1, "Evet"), "location_quality_score": F.when(F.col("lat").isNotNull(), 0.5 + F.col("discount")),
        "is_large_home": (F.col("gross_m2") > 200).cast("int"), "distance_to_geo_cluster_center_m": F.lit(250.0),
    })


def enc_geo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ["classified_id", "fold", "county", "room_count", "gross_m2", "view_sea", "near_sea_zero", "site_inside", "location_quality_score", "is_large_home", "distance_to_geo_cluster_center_m", "location_precision", "lat", "lon"]
    out = C.geo_context(around(spark, sf_dir).select(*used), *(S.view(spark, sf_dir, v) for v in (POIS, ROADS, COAST)), FOLDS, COUNTY)
    return rounded(out.select("classified_id", *C.FEATURES), 4, *C.FEATURES)


#: Made-up anchors within the listings' area.
ANCHORS = {"port": (40.61, 29.47), "square": (40.765, 29.94), "campus": (40.82, 29.92)}


def enc_location_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all sales by centres that the sales of the first four folds have; some districts have few of them."""
    df = around(spark, sf_dir).withColumn("district", F.when(F.col("partkey") % 500 == 0, F.concat(F.lit("d"), F.col("partkey"))).otherwise(F.col("district")))
    df = durable(df.select("classified_id", "fold", "county", "district", "lat", "lon", "location_precision"))
    out = L.location_features(df, df.where("fold < 4"), ANCHORS, "exact")
    columns = [c for c in out.columns if c not in df.columns and c != "has_lat_lon"]
    return out.select("classified_id", "has_lat_lon", *((F.round(F.col(c) + 1e-9, 4) + 0.0).alias(c) for c in columns))  # a step off exact halves, no negative zero


def geo_county_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = utm35(F.col("lat"), F.col("lon"))
    df = durable(around(spark, sf_dir).where("lat is not null").select("classified_id", "county", x.alias("x"), y.alias("y")))
    return rounded(L.group_clusters(df, ["county"], "x", "y", 4).select("classified_id", "cluster", "distance_to_cluster"), 3, "distance_to_cluster")


def utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """East and north of zone 35 in SQL."""
    p = f"radians({lat})"
    n = f"(6378137.0e0 / sqrt(1 - 0.00669437999014e0 * pow(sin({p}), 2)))"
    t = f"pow(tan({p}), 2)"
    c = f"(0.00669437999014e0 / (1 - 0.00669437999014e0) * pow(cos({p}), 2))"
    d = f"((radians({lon}) - radians(27.0e0)) * cos({p}))"
    e = 0.00669437999014
    arc = f"6378137.0e0 * ({1 - e / 4 - 3 * e**2 / 64!r}e0 * {p} - {3 * e / 8 + 3 * e**2 / 32!r}e0 * sin(2 * {p}) + {15 * e**2 / 256:.18f}e0 * sin(4 * {p}))"
    east = f"0.9996e0 * {n} * ({d} + (1 - {t} + {c}) * pow({d}, 3) / 6) + 500000.0e0"
    north = f"0.9996e0 * ({arc} + {n} * tan({p}) * (pow({d}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({d}, 4) / 24))"
    return east, north


EAST, NORTH = utm_sql("lat", "lon")
IN_LAYER = {
    "school": "amenity IN ('school', 'kindergarten', 'college') OR subcategory IN ('school', 'kindergarten', 'college')", "university": "amenity = 'university' OR subcategory = 'university'",
    "hospital": "amenity = 'hospital' OR subcategory = 'hospital'", "healthcare": "amenity IN ('hospital', 'clinic', 'doctors', 'pharmacy')", "pharmacy": "amenity = 'pharmacy'",
    "market": "shop IN ('supermarket', 'convenience') OR amenity = 'marketplace'", "park": "leisure = 'park'", "daily": "category = 'daily' OR shop IN ('supermarket', 'convenience') OR leisure = 'park'",
    "bus_stop": "highway = 'bus_stop' OR subcategory = 'bus_stop'", "transport": "category = 'transport'",
}
IN_ROAD = {
    "highway": "coalesce(road_class, 'major') = 'highway' OR highway IN ('motorway', 'motorway_link')", "primary": "coalesce(road_class, 'major') IN ('primary', 'highway') OR highway IN ('trunk', 'primary', 'motorway')",
    "major": "coalesce(road_class, 'major') IN ('major', 'primary', 'highway') OR highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary')",
}
LAYERS = " UNION ALL ".join(
    [f"SELECT '{n}' AS layer, {EAST} AS px, {NORTH} AS py FROM pois WHERE {w}" for n, w in IN_LAYER.items()]
    + [f"SELECT '{n}' AS layer, {EAST} AS px, {NORTH} AS py FROM roads WHERE {w}" for n, w in IN_ROAD.items()]
    + [f"SELECT 'sea' AS layer, {EAST} AS px, {NORTH} AS py FROM coast"]
)


def near_sql(name: str, scale: float) -> str:
    return f"exp(-distance_to_{name}_m / {scale}e0)"


PRODUCTS = {
    "bsk_distance_to_sea_x_view_sea": "log_sea * view_sea", "bsk_distance_to_sea_x_near_sea_zero": "log_sea * in_parking", "bsk_distance_to_sea_x_large_home": "log_sea * large",
    "bsk_distance_to_sea_x_site_inside": "log_sea * near_market", "bsk_distance_to_sea_x_quality": "log_sea * (0.5e0 + discount)",
    "bsk_school_access_x_family_home": "education * CASE WHEN room_count IN ('3+1', '4+1', '5+1') OR gross_m2 >= 120 THEN 1 ELSE 0 END", "bsk_road_access_x_large_home": near_sql("major_road", 1200.0) + " * large",
    "bsk_coastal_x_large_home": "coastal * large", "bsk_coastal_x_geo_cluster": "coastal / (1.0e0 + 250.0e0 / 500.0e0)", "bsk_coastal_x_room_4p1": "coastal * CASE WHEN room_count IN ('4+1', '5+1') THEN 1 ELSE 0 END",
}
FILLED = {c: f"coalesce(s.{c}, m.{c}, 1500.0e0)" for c in C.DISTANCES}
GEO_SQL = (
    LISTING + ", pois AS (" + plain(POIS) + "), roads AS (" + plain(ROADS) + "), coast AS (" + plain(COAST) + "), layers AS (" + LAYERS + ")"
    + f", sale AS (SELECT *, classified_id % {FOLDS} AS fold, CASE WHEN lat IS NOT NULL THEN {EAST} END AS x, CASE WHEN lat IS NOT NULL THEN {NORTH} END AS y FROM listing WHERE purpose = 'sale')"
    + ", places AS (SELECT DISTINCT x, y FROM sale WHERE x IS NOT NULL)"
    + ", apart AS (SELECT x, y, layer, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS d FROM places, layers)"
    + ", near AS (SELECT x, y, " + ", ".join(f"min(CASE WHEN layer = '{v}' THEN d END) AS {c}" for c, v in C.DISTANCES.items()) + ", "
    + ", ".join(f"sum(CASE WHEN layer = '{v}' AND d <= {r} THEN 1 ELSE 0 END) AS {c}" for c, (v, r) in C.COUNTS.items()) + " FROM apart GROUP BY x, y)"
    + ", met AS (SELECT sale.*, " + ", ".join(f"near.{c}" for c in C.DISTANCES) + ", " + ", ".join(f"coalesce(near.{c}, 0) AS {c}" for c in C.COUNTS)
    + ", ln(1 + distance_to_sea_m) AS log_sea, CASE WHEN distance_to_sea_m <= 1000 THEN 1e0 ELSE 0e0 END AS coastal, CASE WHEN gross_m2 > 200 OR gross_m2 >= 150 OR room_count IN ('4+1', '5+1') THEN 1e0 ELSE 0e0 END AS large"
    + f", 0.7e0 * {near_sql('nearest_school', 800.0)} + 0.3e0 * {near_sql('nearest_university', 3000.0)} AS education"
    + f", 0.6e0 * {near_sql('nearest_healthcare', 1500.0)} + 0.4e0 * {near_sql('nearest_hospital', 3000.0)} AS health"
    + f", 0.6e0 * {near_sql('nearest_market', 700.0)} + 0.4e0 * {near_sql('nearest_park', 1000.0)} AS daily"
    + " FROM sale LEFT JOIN near ON sale.x = near.x AND sale.y = near.y)"
    + f", s AS (SELECT *, 0.35e0 * daily + 0.25e0 * education + 0.2e0 * {near_sql('nearest_bus_stop', 500.0)} + 0.2e0 * least(1.0e0, daily_poi_count_500m / 10.0e0) AS walk FROM met)"
    + ", folds AS (SELECT DISTINCT fold AS f FROM s), m AS (SELECT f, " + ", ".join(f"median({c}) AS {c}" for c in C.DISTANCES) + " FROM s, folds WHERE fold <> f GROUP BY f)"
    + " SELECT classified_id, CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END AS geo_context_missing, CASE WHEN x IS NOT NULL AND partkey % 3 = 0 THEN 1e0 ELSE 0e0 END AS geo_context_has_exact_location"
    + ", CASE WHEN x IS NOT NULL THEN 1e0 ELSE 0e0 END AS geo_context_has_approx_location, round(coalesce(log_sea, ln(1 + m.distance_to_sea_m)), 4) AS log_distance_to_sea, "
    + ", ".join(f"CASE WHEN s.distance_to_sea_m <= {k} THEN 1e0 ELSE 0e0 END AS is_coastal_{k}m" for k in (250, 500, 1000, 2000))
    + ", CASE WHEN x IS NULL THEN -1e0 WHEN s.distance_to_sea_m <= 250 THEN 0e0 WHEN s.distance_to_sea_m <= 500 THEN 1e0 WHEN s.distance_to_sea_m <= 1000 THEN 2e0 WHEN s.distance_to_sea_m <= 3000 THEN 3e0 ELSE 4e0 END AS coast_distance_bucket_code, "
    + ", ".join(f"round({e}, 4) AS {c}" for c, e in FILLED.items()) + ", " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.COUNTS)
    + f", round(coalesce(walk, 0), 4) AS walkability_proxy_score, round(coalesce({near_sql('sea', 1200.0).replace('-distance', '-s.distance')}, 0), 4) AS coastal_access_score, round(coalesce(education, 0), 4) AS education_access_score"
    + ", round(coalesce(health, 0), 4) AS health_access_score, round(coalesce(daily, 0), 4) AS daily_life_access_score"
    + f", round(coalesce(0.25e0 * {near_sql('sea', 1200.0).replace('-distance', '-s.distance')} + 0.2e0 * walk + 0.15e0 * education + 0.15e0 * health + 0.15e0 * daily + 0.1e0 * coalesce({near_sql('major_road', 1200.0).replace('-distance', '-s.distance')}, 0), 0), 4) AS location_context_score, "
    + ", ".join(f"round(coalesce(CASE WHEN county = '{COUNTY}' THEN {e.replace('-distance', '-s.distance')} END, 0), 4) AS {c}" for c, e in PRODUCTS.items())
    + " FROM s LEFT JOIN m ON s.fold = m.f"
)

PLACES = ("city", "county", "district")


def centred_sql(place: str) -> str:
    a, b = f"{place}_lat", f"{place}_lon"
    angle = f"atan2(sin(radians(lon - {b})) * cos(radians(lat)), cos(radians({a})) * sin(radians(lat)) - sin(radians({a})) * cos(radians(lat)) * cos(radians(lon - {b})))"
    return (
        f"round(CASE WHEN has THEN lat - {a} ELSE 0e0 END + 1e-9, 4) + 0e0 AS lat_centered_{place}, round(CASE WHEN has THEN lon - {b} ELSE 0e0 END + 1e-9, 4) + 0e0 AS lon_centered_{place}, round(CASE WHEN has THEN {haversine_sql('lat', 'lon', a, b)} END + 1e-9, 4) AS distance_to_{place}_center_m, "
        f"round(CASE WHEN has AND {haversine_sql('lat', 'lon', a, b)} > 0.01 THEN sin({angle}) ELSE 0e0 END + 1e-9, 4) + 0e0 AS bearing_{place}_sin, round(CASE WHEN has AND {haversine_sql('lat', 'lon', a, b)} > 0.01 THEN cos({angle}) ELSE 0e0 END + 1e-9, 4) + 0e0 AS bearing_{place}_cos"
    )


ANCHOR_SQL = {n: f"CASE WHEN has THEN {haversine_sql('lat', 'lon', f'{a}e0', f'{b}e0')} END" for n, (a, b) in ANCHORS.items()}
LOCATION_SQL = LISTING + f""", s AS (SELECT classified_id, classified_id % {FOLDS} AS fold, county, CASE WHEN partkey % 500 = 0 THEN 'd' || partkey ELSE district END AS district, lat, lon, lat IS NOT NULL AND partkey % 3 = 0 AS has FROM listing WHERE purpose = 'sale'),
k AS (SELECT * FROM s WHERE has AND fold < 4), a AS (SELECT avg(lat) AS city_lat, avg(lon) AS city_lon FROM k), b AS (SELECT county, avg(lat) AS y, avg(lon) AS x FROM k GROUP BY county HAVING count(*) >= 3),
c AS (SELECT county, district, avg(lat) AS y, avg(lon) AS x FROM k GROUP BY county, district HAVING count(*) >= 3),
j AS (SELECT s.*, city_lat, city_lon, coalesce(b.y, city_lat) AS county_lat, coalesce(b.x, city_lon) AS county_lon, coalesce(c.y, b.y, city_lat) AS district_lat, coalesce(c.x, b.x, city_lon) AS district_lon
  FROM s LEFT JOIN b ON s.county = b.county LEFT JOIN c ON s.county = c.county AND s.district = c.district, a)
SELECT classified_id, CASE WHEN has THEN 1e0 ELSE 0e0 END AS has_lat_lon, {', '.join(map(centred_sql, PLACES))}, {', '.join(f'round({e} + 1e-9, 4) AS distance_to_{n}_m' for n, e in ANCHOR_SQL.items())}, round(least({', '.join(ANCHOR_SQL.values())}) + 1e-9, 4) AS distance_to_nearest_anchor_m FROM j"""

QUERIES = {"enc_geo_context": enc_geo_context, "enc_location_features": enc_location_features, "geo_county_clusters": geo_county_clusters}
ORACLE_SQL = {"enc_geo_context": GEO_SQL, "enc_location_features": LOCATION_SQL}
