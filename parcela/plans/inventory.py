"""Queries over listing scans, base clean, engineered features, cleaner reports and places, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions import geo as G
from parcela.functions import text as X
from parcela.operators import clean as C
from parcela.operators import inventory as I
from parcela.operators import listing_features as Y
from parcela.operators import reports as R
from parcela.operators import scores as Z
from parcela.operators.state import aggregate, attach, durable
from parcela.plans.analytics import FOLDS, PRED, SALES, haversine_sql, nudged, predicted, rounded, sales
from parcela.plans.cleaning import ANOMALY, both_purposes, scored, sized
from parcela.plans.sql import GROUPED, LISTING, ORDER, RAW
from parcela.sources import tables as S

HEATING = {"kombi": 0.8, "yerden": 1.0, "soba": 0.2}
HEATINGS = ("Kombi (Doğalgaz)", "Yerden Isıtma", "Soba", "bilinmiyor")
PARKING = ("Açık Otopark", "Yok", "Otopark yok", "belki")
EXACT = ("exact", "approx_map", "district", "", "none")
AMENITIES = {"attr_has_parking": ("parking", 0.6), "attr_has_elevator": ("elevator", 0.4)}


def picked(names: tuple[str, ...], number: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col(number), F.lit(len(names))) + 1).cast("int"))


def described(df: DataFrame) -> DataFrame:
    """Listings with texts for heating, parking, elevator and how exact the place is."""
    return df.withColumns({"heating": picked(HEATINGS, "suppkey"), "parking": picked(PARKING, "partkey"), "elevator": F.when(F.col("partkey") % 3 == 0, F.lit(" VAR ")).when(F.col("partkey") % 3 == 1, F.lit("Hayır")), "exactness": picked(EXACT, "partkey")})


def src_listing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir)
    return I.listing_scan(df, " asia" if df.where("city = 'ASIA'").limit(1).count() else "region_2", "Sale", ["saved_at", "classified_id"], limit=200).select("classified_id", "city", "purpose", "saved_at")


def flt_base_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose numbers arrive as localised texts, ages in part as ranges and purposes in any case."""
    turned = F.concat(F.translate(F.format_number("price", 2), ",.", ".,"), F.lit(" TL"))
    df = S.raw_listings(spark, sf_dir).withColumns({
        "price_text": turned, "purpose": F.when(F.col("partkey") % 2 == 0, F.upper("purpose")).otherwise(F.concat(F.lit(" "), F.col("purpose"))), "building_age_raw": F.concat((F.col("suppkey") % 45).cast("string"), F.lit(" ve üzeri")),
        "building_age": F.when(F.col("suppkey") % 3 > 0, F.col("building_age")), "unit_price": F.when(F.col("partkey") % 5 > 0, F.col("unit_price")), "title": F.concat(F.lit(" "), F.col("title")),
    })
    out = I.base_clean(df, "sale", S.LISTING_ORDER[:-1], ["title"], ["price_text"])
    return nudged(out.select("classified_id", "title", F.col("price_text").alias("price"), "building_age", "unit_price", "m2_group"), 4, "price", "unit_price")


def enc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir).withColumn("detail_view", F.concat_ws("|", F.split("title", " ")))
    out = Y.engineered(df, {"detail_view": "view_count"}, {"outside_score": ["near_market", "in_parking", "view_sea"]})
    names = ["m2_group", "net_gross_ratio", "floor_ratio", "remaining_floors", "is_ground_floor", "is_basement", "is_top_floor", "is_middle_floor", "rooms", "living_rooms", "total_room_score", "is_new_building", "is_old_building", "is_small_flat", "is_large_flat", "view_count", "outside_score", "detail_selected_count"]
    return rounded(out.select("classified_id", *names), 6, "net_gross_ratio", "floor_ratio")


def enc_attribute_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.attribute_features(described(sales(spark, sf_dir)), HEATING, AMENITIES)
    names = ["attr_is_new_building", "attr_is_mid_age_building", "attr_building_age_score", "attr_building_age_inverse", "attr_is_ground_or_below", "attr_is_top_floor", "attr_is_middle_floor", "attr_floor_quality_score", "attr_net_gross_ratio", "attr_net_gross_good", "attr_m2_per_room", "attr_compactness_score", "attr_has_parking",
             "attr_has_elevator", "attr_amenity_score", "attr_heating_quality_score", "attr_has_natural_gas_heating", "attr_has_premium_heating", "attr_has_poor_heating", "attr_heating_quality_bucket", "attr_total_quality_score", "attr_total_quality_bucket", "attr_large_home_x_quality"]
    return rounded(out.select("classified_id", *names), 6, "attr_building_age_inverse", "attr_net_gross_ratio", "attr_m2_per_room", "attr_amenity_score", "attr_total_quality_score", "attr_large_home_x_quality")


def enc_attribute_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Y.attribute_features(described(sales(spark, sf_dir)), HEATING, AMENITIES)
    df = attach(df, aggregate(df, ["county"], m=F.median("unit_price")), ["county"]).withColumn("residual", F.ln(F.col("unit_price") / F.col("m")))
    return rounded(Y.bucket_effects(df, "residual", ["attr_building_age_bucket", "attr_heating_quality_bucket"]), 6, "effect")


def enc_smoothed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.smoothed_median(sales(spark, sf_dir), ["county", "room_count"], "unit_price", 10.0, "base").select("classified_id", "base"), 5, "base")


def enc_rare_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir).withColumn("rare", (F.col("classified_id") == F.lit(11)).cast("int"))
    out = Y.without_rare_flags(df, ["near_market", "rare"], 20)
    return aggregate(out, ["county"], near_market=F.sum("near_market"), rare=F.sum("rare"))


def flt_v1_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"price": (1000.0, 100000.0), "gross_m2": (25.0, 500.0), "unit_price": (100.0, 5000.0)}
    out = I.staged_cleaner(S.raw_listings(spark, sf_dir).where("purpose = 'sale'"), "unit_price", limits, S.LISTING_ORDER)
    return I.reason_counts(out)


def flt_inventory_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir)
    sale, rent = (150.0, 1200.0), (1.0, 6.0)
    ok = F.when(F.col("purpose") == "sale", I.basic_mask("sale", sale, rent)).otherwise(I.basic_mask("rental", sale, rent))
    return aggregate(df.withColumn("usable", ok), ["purpose", "county", "usable"], n=F.count("*"))


#: What listings are flagged by.
FLAGGED_BY = ("county", "district", "room_count", "unit_price", "gross_m2", "net_m2", "building_age", "title")


def agg_outlier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.outlier_flags(durable(sized(spark, sf_dir).select(*FLAGGED_BY, "m2_group")))
    return nudged(I.outlier_groups(out, "unit_price", ["district", "room_count", "m2_group"]), 4, "median_target", "mean_target")


def agg_outlier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.outlier_summary(C.outlier_flags(durable(S.listings(spark, sf_dir, "sale").select(*FLAGGED_BY))), "unit_price")
    return nudged(out, 4, *(c for c in out.columns if c not in ("scope", "rows")))


def agg_anomaly_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.anomaly_groups(scored(*both_purposes(spark, sf_dir)), ["county", "district", "room_count", "m2_group", "anomaly_level"])
    return nudged(out, 4, "mean_anomaly_score", "median_anomaly_score", "mean_unit_price")


def agg_location_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.location_quality(described(S.listings(spark, sf_dir)), "exactness")
    return rounded(out, 4, "has_lat_lon_rate", "median_distance_to_county_centroid")


def agg_segment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each market segment; a listing can be in several."""
    df = predicted(spark, sf_dir)
    inside = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in Y.segments(df).items())))
    out = R.metrics(df.withColumn("segment", F.explode(inside)), "unit_price", "pred", ["segment"], 8)
    return rounded(out.select("segment", "rows", "mape", "mae", "bias"), 4, "mape", "mae", "bias")


def agg_site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir).withColumn("site", X.site_stem(F.concat(F.col("title"), F.lit(" Sitesi 2+1"))))
    return rounded(I.site_candidates(df, "site", "classified_id", "unit_price"), 4, "median_value")


def txt_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive numbers, room totals, identifiers, yes and no, heating and ages of parts read as listings."""
    df = S.table(spark, sf_dir, "part").withColumns({"partkey": F.col("p_partkey"), "suppkey": F.col("p_size").cast("long")})
    df, n = described(df), F.col("p_size")
    rooms = F.when(n % 3 == 0, F.concat(n, F.lit(" + 1"))).when(n % 3 == 1, n.cast("string"))
    heat = Z.heating_score(F.col("heating"), HEATING)
    return df.select("p_partkey", X.plain_number(F.concat(n, F.lit(".500,25 TL"))).alias("plain"), X.rooms_total(rooms).alias("rooms_total"), X.rooms_number(rooms).alias("rooms_number"), X.stem_id(F.col("p_name")).alias("stem_id"), Z.yes_no(F.col("parking")).alias("parking"), Z.yes_no(F.col("elevator")).alias("elevator"),
                     heat.alias("heat"), Z.heating_bucket(heat).alias("heat_bucket"), Z.age_bucket(n).alias("age_bucket"))


def geo_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = described(S.listings(spark, sf_dir)).where("lat is not null")
    east, north = G.utm35(F.col("lat"), F.col("lon"))
    exact = Z.precision(F.col("exactness"))
    coast = G.haversine(F.col("lat"), F.col("lon"), F.lit(40.7), F.lit(29.7))
    out = df.select("classified_id", east.alias("east"), north.alias("north"), exact.alias("precision"), Z.place_quality(exact, F.when(F.col("partkey") % 2 == 0, F.lit("ok")).otherwise(F.lit("removed")), F.lit(True)).alias("quality"), G.coast_inverse(F.when(F.col("suppkey") % 2 == 0, coast)).alias("coast_inverse"), Z.family_home(df).alias("family"))
    return rounded(out, 3, "east", "north").withColumn("coast_inverse", F.round("coast_inverse", 6))


def src_road_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("motorway", "trunk_link", "secondary", "footway", "primary", ""))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    ref = F.when(F.col("s_suppkey") % 5 == 0, "o-4").when(F.col("s_suppkey") % 7 == 0, "D100")
    return aggregate(df.withColumn("road_class", Z.road_class(kind, ref, F.when(F.col("s_suppkey") % 11 == 0, "e-5 yolu"))), ["road_class"], n=F.count("*"))


def win_district_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.name_codes(sales(spark, sf_dir), "district", "code")
    return aggregate(out, ["district", "code"], n=F.count("*"))


QUERIES = {f.__name__: f for f in (
    src_listing_scan, flt_base_clean, enc_features, enc_attribute_quality, enc_attribute_effects, enc_smoothed_median, enc_rare_binary, flt_v1_cleaner, flt_inventory_mask, agg_outlier_groups, agg_outlier_summary, agg_anomaly_groups,
    agg_location_quality, agg_segment_errors, agg_site_candidates, txt_scalars, geo_projection, src_road_class, win_district_code,
)}


def pick_sql(names: tuple[str, ...], number: str) -> str:
    return "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], CAST({number} % {len(names)} + 1 AS INTEGER))"


ROOM = "CAST(regexp_extract(room_count, '([0-9]+)', 1) AS DOUBLE)"
AGE_SCORE = "CASE WHEN building_age <= 4 THEN 1e0 WHEN building_age <= 10 THEN 0.8e0 WHEN building_age <= 20 THEN 0.55e0 WHEN building_age <= 30 THEN 0.3e0 ELSE 0.1e0 END"
FLOOR_SCORE = "CASE WHEN floor_num <= 0 THEN 0.2e0 WHEN floor_num >= total_floors THEN 0.45e0 WHEN floor_num / total_floors BETWEEN 0.25e0 AND 0.8e0 THEN 1e0 ELSE 0.7e0 END"
HEAT_SCORE = "list_extract([0.8e0, 1e0, 0.2e0, 0.5e0], CAST({n} % 4 + 1 AS INTEGER))"
PARK = "list_extract([1e0, 0e0, 0e0, NULL], CAST({n} % 4 + 1 AS INTEGER))"
LIFT = "CASE {n} % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 END"
HEAT_BUCKET = "CASE WHEN abs(h - 0.5e0) < 1e-9 THEN 'unknown' WHEN h >= 0.85e0 THEN 'premium' WHEN h >= 0.6e0 THEN 'good' WHEN h >= 0.4e0 THEN 'mid' ELSE 'poor' END"
AGE_BUCKET = "CASE WHEN {a} <= 4 THEN 'new' WHEN {a} <= 10 THEN 'young' WHEN {a} <= 25 THEN 'mid' ELSE 'old' END"
ATTRIBUTES = SALES + f""", a AS (SELECT *, {AGE_SCORE} sa, {FLOOR_SCORE} sf, {HEAT_SCORE.format(n="suppkey")} h, {PARK.format(n="partkey")} hp, {LIFT.format(n="partkey")} he, gross_m2 / ({ROOM} + 1) each, greatest(0.2e0, least(1.2e0, net_m2 / gross_m2)) ng FROM s),
b AS (SELECT *, CASE WHEN each < 22 THEN 0.4e0 WHEN each <= 35 THEN 1e0 WHEN each <= 50 THEN 0.8e0 ELSE 0.55e0 END sc, coalesce((coalesce(hp * 0.6e0, 0) + coalesce(he * 0.4e0, 0)) / nullif(CASE WHEN hp IS NULL THEN 0e0 ELSE 0.6e0 END + CASE WHEN he IS NULL THEN 0e0 ELSE 0.4e0 END, 0), 0.5e0) am FROM a),
t AS (SELECT *, greatest(0e0, least(1e0, (sa * 0.3e0 + sf * 0.2e0 + am * 0.2e0 + h * 0.15e0 + sc * 0.15e0) / (0.3e0 + 0.2e0 + 0.2e0 + 0.15e0 + 0.15e0))) tq FROM b)"""
FLAGGED = GROUPED + """, s AS (SELECT * FROM grouped WHERE purpose = 'sale'), a AS (SELECT county, district, room_count, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(*) n FROM s GROUP BY ALL),
b AS (SELECT county, district, quantile_cont(unit_price, 0.25) p1, quantile_cont(unit_price, 0.75) p3, count(*) k FROM s GROUP BY ALL), m AS (SELECT median(unit_price) m FROM s), mad AS (SELECT median(abs(unit_price - m)) mad FROM s, m),
l AS (SELECT s.*, NOT unit_price BETWEEN 100 AND 5000 OR NOT gross_m2 BETWEEN 25 AND 500 OR net_m2 > gross_m2 OR net_m2 / gross_m2 < 0.73 OR abs(0.6745 * (unit_price - m) / mad) > 3.5 OR n >= 8 AND q3 > q1 AND (unit_price < q1 - 1.5 * (q3 - q1) OR unit_price > q3 + 1.5 * (q3 - q1))
OR k >= 8 AND p3 > p1 AND (unit_price < p1 - 1.5 * (p3 - p1) OR unit_price > p3 + 1.5 * (p3 - p1)) AS gone FROM s JOIN a USING (county, district, room_count) JOIN b USING (county, district), m, mad),
o AS (SELECT *, NOT gone AND (gross_m2 >= 200 OR building_age >= 40 OR regexp_matches(lower(title), 'burnished|plated')) AS review FROM l)"""
EXACTNESS = "list_extract(['exact_map', 'approx_map', 'district_only', 'missing', 'missing'], CAST(partkey % 5 + 1 AS INTEGER))"
FIRST = ORDER.replace("DESC NULLS LAST", "ASC NULLS LAST")

ORACLE_SQL = {
    "src_listing_scan": LISTING + " SELECT classified_id, city, purpose, saved_at FROM listing WHERE city = CASE WHEN (SELECT count(*) FROM listing WHERE city = 'ASIA') > 0 THEN 'ASIA' ELSE 'REGION_2' END AND purpose = 'sale' ORDER BY saved_at DESC NULLS LAST, classified_id DESC LIMIT 200",
    "flt_base_clean": RAW + f""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classified_id ORDER BY {ORDER.removesuffix(", purpose DESC NULLS LAST")}) AS newest FROM raw) WHERE newest = 1)
SELECT classified_id, title, round(price, 2) AS price, CASE WHEN suppkey % 3 > 0 THEN building_age ELSE suppkey % 45 + 4e0 END AS building_age, round(unit_price + 1e-9, 4) AS unit_price, CASE WHEN gross_m2 <= 75 THEN '<=75' WHEN gross_m2 <= 100 THEN '76-100' WHEN gross_m2 <= 125 THEN '101-125' WHEN gross_m2 <= 150 THEN '126-150' WHEN gross_m2 <= 200 THEN '151-200' ELSE '200+' END AS m2_group FROM l WHERE purpose = 'sale'""",
    "enc_features": SALES + f""" SELECT classified_id, m2_group, round(greatest(0.2e0, least(1.2e0, net_m2 / gross_m2)), 6) AS net_gross_ratio, round(floor_num / total_floors, 6) AS floor_ratio, total_floors - floor_num AS remaining_floors, CAST(floor_num = 0 AS INTEGER) AS is_ground_floor, CAST(floor_num < 0 AS INTEGER) AS is_basement, CAST(floor_num >= total_floors AS INTEGER) AS is_top_floor,
CAST(floor_num > 0 AND floor_num < total_floors AS INTEGER) AS is_middle_floor, {ROOM} AS rooms, 1e0 AS living_rooms, {ROOM} + 1 AS total_room_score, CAST(building_age <= 3 AS INTEGER) AS is_new_building, CAST(building_age >= 20 AS INTEGER) AS is_old_building, CAST(gross_m2 <= 75 AS INTEGER) AS is_small_flat, CAST(gross_m2 >= 180 AS INTEGER) AS is_large_flat,
CAST(len(list_filter(string_split(title, ' '), lambda x: x <> '')) AS INTEGER) AS view_count, CAST(near_market + in_parking + view_sea AS INTEGER) AS outside_score, CAST(len(list_filter(string_split(title, ' '), lambda x: x <> '')) AS INTEGER) AS detail_selected_count FROM s""",
    "enc_attribute_quality": ATTRIBUTES + f""" SELECT classified_id, CAST(building_age <= 4 AS DOUBLE) AS attr_is_new_building, CAST(building_age >= 11 AND building_age <= 25 AS DOUBLE) AS attr_is_mid_age_building, sa AS attr_building_age_score, round(1 / (1 + building_age), 6) AS attr_building_age_inverse, CAST(floor_num <= 0 AS DOUBLE) AS attr_is_ground_or_below,
CAST(floor_num = total_floors AS DOUBLE) AS attr_is_top_floor, CAST(floor_num / total_floors BETWEEN 0.25e0 AND 0.8e0 AS DOUBLE) AS attr_is_middle_floor, sf AS attr_floor_quality_score, round(ng, 6) AS attr_net_gross_ratio, CAST(ng >= 0.8e0 AS DOUBLE) AS attr_net_gross_good, round(each, 6) AS attr_m2_per_room, sc AS attr_compactness_score, hp AS attr_has_parking, he AS attr_has_elevator,
round(am, 6) AS attr_amenity_score, h AS attr_heating_quality_score, CAST(suppkey % 4 < 2 AS DOUBLE) AS attr_has_natural_gas_heating, CAST(h >= 0.85e0 AS DOUBLE) AS attr_has_premium_heating, CAST(h <= 0.3e0 AS DOUBLE) AS attr_has_poor_heating, {HEAT_BUCKET} AS attr_heating_quality_bucket, round(tq, 6) AS attr_total_quality_score,
CASE WHEN tq <= 0.35e0 THEN 'low' WHEN tq <= 0.65e0 THEN 'mid' ELSE 'high' END AS attr_total_quality_bucket, round(CAST(gross_m2 >= 150 AS DOUBLE) * tq, 6) AS attr_large_home_x_quality FROM t""",
    "enc_attribute_effects": ATTRIBUTES + f""", m AS (SELECT county, median(unit_price) m FROM t GROUP BY ALL), r AS (SELECT county, ln(unit_price / m) y, {AGE_BUCKET.format(a="building_age")} AS attr_building_age_bucket, {HEAT_BUCKET} AS attr_heating_quality_bucket FROM t JOIN m USING (county)), g AS (SELECT median(y) g FROM r),
u AS (UNPIVOT r ON attr_building_age_bucket, attr_heating_quality_bucket INTO NAME feature VALUE bucket), e AS (SELECT county, feature, bucket, count(*) n, median(y) m FROM u GROUP BY ALL) SELECT county, feature, bucket, n, round(n / (n + 30e0) * m + (1 - n / (n + 30e0)) * g, 6) AS effect FROM e, g""",
    "enc_smoothed_median": SALES + ", k AS (SELECT county, room_count, median(unit_price) m, count(*) n FROM s GROUP BY ALL), g AS (SELECT median(unit_price) g FROM s) SELECT classified_id, round((m * n + g * 10e0) / (n + 10e0), 5) AS base FROM s JOIN k USING (county, room_count), g",
    "enc_rare_binary": SALES + " SELECT county, CAST(sum(near_market) AS BIGINT) AS near_market, CAST(0 AS BIGINT) AS rare FROM s GROUP BY ALL",
    "flt_v1_cleaner": RAW + f""", o AS (SELECT *, row_number() OVER (PARTITION BY classified_id ORDER BY {FIRST}) k FROM raw WHERE purpose = 'sale'), a AS (SELECT *, concat_ws('; ', CASE WHEN NOT price BETWEEN 1000 AND 100000 THEN 'invalid_price' END, CASE WHEN NOT gross_m2 BETWEEN 25 AND 500 THEN 'invalid_gross_m2' END, CASE WHEN NOT unit_price BETWEEN 100 AND 5000 THEN 'invalid_unit_price' END, CASE WHEN k > 1 THEN 'duplicate_classified_id' END) r0 FROM o),
q AS (SELECT quantile_cont(unit_price, 0.01) lo, quantile_cont(unit_price, 0.99) hi, count(*) n FROM a WHERE r0 = ''), b AS (SELECT a.*, CASE WHEN r0 = '' AND n >= 20 AND (unit_price < lo OR unit_price > hi) THEN 'global_quantile_outlier_0.01_0.99' ELSE r0 END r1 FROM a, q),
d AS (SELECT city, county, district, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(*) n FROM b WHERE r1 = '' GROUP BY ALL), c AS (SELECT b.*, CASE WHEN r1 = '' AND n >= 8 AND q3 > q1 AND (unit_price < q1 - 1.5 * (q3 - q1) OR unit_price > q3 + 1.5 * (q3 - q1)) THEN 'district_iqr_outlier' ELSE r1 END r2 FROM b LEFT JOIN d USING (city, county, district)),
e AS (SELECT city, county, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(*) n FROM c WHERE r2 = '' GROUP BY ALL), f AS (SELECT CASE WHEN r2 = '' AND n >= 20 AND q3 > q1 AND (unit_price < q1 - 1.75 * (q3 - q1) OR unit_price > q3 + 1.75 * (q3 - q1)) THEN 'county_iqr_outlier' WHEN r2 = '' THEN 'kept' ELSE r2 END r FROM c LEFT JOIN e USING (city, county))
SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(r, '; ')) AS reason FROM f) GROUP BY ALL""",
    "flt_inventory_mask": LISTING + " SELECT purpose, county, price > 0 AND gross_m2 > 20 AND gross_m2 < 600 AND CASE WHEN purpose = 'sale' THEN unit_price BETWEEN 150 AND 1200 ELSE monthly_rent / gross_m2 BETWEEN 1 AND 6 END AS usable, count(*) AS n FROM listing GROUP BY ALL",
    "agg_outlier_groups": FLAGGED + """, u AS (UNPIVOT (SELECT unit_price, gone, review, district, room_count, m2_group FROM o) ON district, room_count, m2_group INTO NAME group_column VALUE group_value)
SELECT group_column, group_value, count(*) AS n, round(median(unit_price) + 1e-9, 4) AS median_target, round(avg(unit_price) + 1e-9, 4) AS mean_target, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE review) AS review FROM u GROUP BY ALL""",
    "agg_outlier_summary": FLAGGED + ", u AS (SELECT 'all' AS scope, unit_price v FROM o UNION ALL SELECT 'cleaned', unit_price FROM o WHERE NOT gone) SELECT scope, count(*) AS rows, round(avg(v) + 1e-9, 4) AS mean, round(stddev_samp(v) + 1e-9, 4) AS std, round(min(v) + 1e-9, 4) AS low, round(max(v) + 1e-9, 4) AS high, " + ", ".join(f"round(quantile_cont(v, {q / 100}) + 1e-9, 4) AS p{q}" for q in (1, 5, 25, 50, 75, 95, 99)) + " FROM u GROUP BY ALL",
    "agg_anomaly_groups": ANOMALY + """, u AS (UNPIVOT (SELECT anomaly_score sc, unit_price, county, district, room_count, m2_group, anomaly_level FROM g) ON county, district, room_count, m2_group, anomaly_level INTO NAME group_column VALUE group_value)
SELECT group_column, group_value, count(*) AS n, round(avg(sc) + 1e-9, 4) AS mean_anomaly_score, round(median(sc) + 1e-9, 4) AS median_anomaly_score, count(*) FILTER (WHERE sc >= 25) AS high_risk_or_worse, count(*) FILTER (WHERE sc >= 45) AS exclude_candidate, round(avg(unit_price) + 1e-9, 4) AS mean_unit_price FROM u GROUP BY ALL""",
    "agg_location_quality": LISTING + f""", c AS (SELECT purpose, county, avg(lat) cy, avg(lon) cx FROM listing GROUP BY ALL), d AS (SELECT l.*, {EXACTNESS} p, {haversine_sql("lat", "lon", "cy", "cx")} d FROM listing l JOIN c USING (purpose, county))
SELECT purpose, city, county, district, count(*) AS rows, count(lat) AS has_lat_lon_count, round(count(lat) / count(*), 4) AS has_lat_lon_rate, count(*) FILTER (WHERE p = 'exact_map') AS exact_map_count, count(*) FILTER (WHERE p = 'approx_map') AS approx_map_count, count(*) FILTER (WHERE p = 'district_only') AS district_only_count, count(*) FILTER (WHERE p = 'missing') AS missing_count, round(median(d), 4) AS median_distance_to_county_centroid FROM d GROUP BY ALL""",
    "agg_segment_errors": PRED + f""", x AS (SELECT *, gross_m2 >= 151 OR {ROOM} >= 4 AS a, gross_m2 <= 85 OR {ROOM} <= 1 AS b, building_age >= 26 AS c FROM p), u AS (SELECT unnest(list_filter([CASE WHEN a THEN 'large_home' END, CASE WHEN b THEN 'compact' END, CASE WHEN c THEN 'old_building' END, CASE WHEN NOT a AND NOT b AND NOT c THEN 'mainstream' END], lambda v: v IS NOT NULL)) AS segment, unit_price, pred FROM x)
SELECT segment, count(*) AS rows, round(avg(abs(pred - unit_price) / unit_price), 4) AS mape, round(avg(abs(pred - unit_price)), 4) AS mae, round(avg(pred - unit_price), 4) AS bias FROM u GROUP BY ALL HAVING count(*) >= 8""",
    "agg_site_candidates": LISTING + r", f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^\w\s|+./''\-]', ' ', 'g'), '\s+', ' ', 'g')) AS site FROM listing) SELECT site, count(*) AS n, count(DISTINCT classified_id) AS n_ids, round(median(unit_price), 4) AS median_value, min(classified_id) AS example, count(DISTINCT county) AS n_counties FROM f GROUP BY ALL HAVING count(*) > 1",
    "txt_scalars": r"SELECT p_partkey, p_size * 1000 + 500.25e0 AS plain, CASE p_size % 3 WHEN 0 THEN p_size + 1e0 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS rooms_total, CASE WHEN p_size % 3 < 2 THEN CAST(p_size AS DOUBLE) END AS rooms_number, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS stem_id, " + PARK.format(n="p_partkey") + " AS parking, " + LIFT.format(n="p_partkey") + f" AS elevator, h AS heat, {HEAT_BUCKET} AS heat_bucket, {AGE_BUCKET.format(a='p_size')} AS age_bucket FROM (SELECT *, " + HEAT_SCORE.format(n="p_size") + " AS h FROM part)",
    "geo_projection": LISTING + f""", a AS (SELECT *, radians(lat) p, (radians(lon) - radians(27e0)) * cos(radians(lat)) d, 6378137e0 / sqrt(1 - 0.00669437999014e0 * pow(sin(radians(lat)), 2)) n, pow(tan(radians(lat)), 2) t, 0.00669437999014e0 / (1 - 0.00669437999014e0) * pow(cos(radians(lat)), 2) c, {EXACTNESS} x FROM listing WHERE lat IS NOT NULL),
b AS (SELECT *, 6378137e0 * ((1 - 0.00669437999014e0 / 4 - 3 * pow(0.00669437999014e0, 2) / 64) * p - (3 * 0.00669437999014e0 / 8 + 3 * pow(0.00669437999014e0, 2) / 32) * sin(2 * p) + (15 * pow(0.00669437999014e0, 2) / 256) * sin(4 * p)) arc FROM a)
SELECT classified_id, round(0.9996e0 * n * (d + (1 - t + c) * pow(d, 3) / 6) + 500000, 3) AS east, round(0.9996e0 * (arc + n * tan(p) * (pow(d, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * pow(d, 4) / 24)), 3) AS north, x AS precision, CASE WHEN partkey % 2 = 1 THEN 0.8e0 WHEN x = 'exact_map' THEN 1e0 WHEN x = 'approx_map' THEN 0.7e0 WHEN x = 'district_only' THEN 0.3e0 ELSE 0e0 END AS quality,
round(1 / (1 + CASE WHEN suppkey % 2 = 0 THEN {haversine_sql("lat", "lon", "40.7e0", "29.7e0")} ELSE 5000e0 END / 1000e0), 6) AS coast_inverse, room_count IN ('3+1', '4+1', '5+1') OR gross_m2 >= 120 AS family FROM b""",
    "src_road_class": """SELECT CASE WHEN s_suppkey % 6 = 0 OR s_suppkey % 5 = 0 THEN 'highway' WHEN s_suppkey % 6 IN (1, 4) OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'primary' WHEN s_suppkey % 6 = 2 THEN 'major' ELSE 'other' END AS road_class, count(*) AS n FROM supplier GROUP BY ALL""",
    "win_district_code": SALES + ", c AS (SELECT lower(district) f, CAST(row_number() OVER (ORDER BY lower(district)) AS INTEGER) code FROM (SELECT DISTINCT district FROM s)) SELECT district, code, count(*) AS n FROM s JOIN c ON lower(s.district) = c.f GROUP BY ALL",
}
