"""Queries over cleaning and data quality, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions import text as X
from parcela.operators import clean as C
from parcela.operators.baseline import in_sample_baseline
from parcela.operators.state import aggregate, attach, durable, learned
from parcela.plans.baselines import baseline_sql
from parcela.plans.sql import GROUPED, LISTING, plain
from parcela.sources import tables as S

SEGMENT = ["county", "room_count", "m2_group"]
#: Least rows of the baseline's levels where listings are cleaned: groups of twelve, and five more for broad ones.
CLEAN_LEAST = {"specific": 12, "medium": 12, "broad": 17}


def sized(spark: SparkSession, sf_dir: str, purpose: str | None = "sale") -> DataFrame:
    return S.listings(spark, sf_dir, purpose).withColumn("m2_group", X.size_group(F.col("gross_m2")))


def flt_group_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.group_iqr(durable(sized(spark, sf_dir).select("classified_id", *SEGMENT, "unit_price")), "unit_price", SEGMENT)
    return out.select("classified_id", "county", "room_count", "m2_group", "unit_price", "group_outlier", "global_outlier")


def flt_basic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = C.in_ranges({"gross_m2": (25, 180, False), "unit_price": (150, 1200, False), "monthly_rent": (10, 400, True)})
    kept, removed = C.split(S.listings(spark, sf_dir), keep, "range")
    both = kept.withColumn("reason", F.lit("kept")).unionByName(removed)
    return both.groupBy("purpose", "county", "reason").agg(F.count("*").alias("n"), F.round(F.avg("unit_price"), 4).alias("mean_unit_price"))


def flt_mad_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = durable(sized(spark, sf_dir).select("classified_id", "county", "district", "m2_group", "room_count", "unit_price"))
    out = C.location_outliers(in_sample_baseline(df, "unit_price", least=CLEAN_LEAST), "unit_price", "location_baseline_m2", ["county", "room_count"])
    return out.select("classified_id", F.round("baseline_ratio", 6).alias("baseline_ratio"), F.round("ratio_z", 5).alias("ratio_z"), "location_outlier")


def flt_hier_outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ["classified_id", "county", "district", "room_count", "unit_price", "gross_m2", "net_m2", "building_age", "title"]
    out = C.outlier_flags(durable(S.listings(spark, sf_dir, "sale").select(*used)))
    return out.select("classified_id", "outlier_level", "remove_reasons", "review_reasons", "is_removed", "needs_review")


def flt_staged_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.staged_reasons(S.listings(spark, sf_dir, "sale"), "unit_price", [("district_iqr", ["county", "district"], 8, 1.0), ("county_iqr", ["county"], 20, 1.25)])
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("unit_price"), 4).alias("mean_unit_price"))


#: What anomaly scores are made of.
SCORED = ("classified_id", "county", "district", "room_count", "m2_group", "unit_price", "price", "gross_m2", "net_m2", "floor_num", "total_floors", "building_age", "near_market", "in_parking", "view_sea")


def both_purposes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sales with what they are scored by, and rentals with their rent, from one pass over the listings."""
    both = durable(sized(spark, sf_dir, None).select(*SCORED, "purpose", "monthly_rent"))
    return both.where("purpose = 'sale'").drop("purpose", "monthly_rent"), both.where("purpose = 'rental'")


def scored(df: DataFrame, rentals: DataFrame) -> DataFrame:
    """Sales with anomaly scores: the location baseline of all sales, the district's rents for the years of return, the flags as details."""
    keys = ["county", "district"]
    based = in_sample_baseline(df, "unit_price", least=CLEAN_LEAST)
    rents = learned(aggregate(rentals, keys, rent_m2=F.median(X.ratio(F.col("monthly_rent"), F.col("gross_m2")))))
    details = F.col("near_market") + F.col("in_parking") + F.col("view_sea")
    return C.anomaly_scores((attach(based, rents, keys).withColumn("details", details)), "location_baseline_m2", "location_baseline_count", "rent_m2", "details")


def dq_anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(*both_purposes(spark, sf_dir))
    return out.select("classified_id", "anomaly_score", "anomaly_reasons", "anomaly_level")


def dq_suspicious_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir)
    conditions = {
        "floor_over_top": F.col("floor_num") > F.col("total_floors"), "net_over_gross": F.col("net_m2") > 0.9 * F.col("gross_m2"),
        "no_coordinates": F.col("lat").isNull(), "cheap": F.col("unit_price") < 200,
    }
    return C.suspicious(df, conditions, ["classified_id", "purpose", "county"])


def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir)
    return C.duplicates(df, ["county", "district", "room_count", "gross_m2", "building_age"], "classified_id")


def dq_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.missingness(S.listings(spark, sf_dir), ["lat", "lon", "monthly_rent", "building_age"], "purpose")
    return out.withColumn("share", F.round("share", 6))


def dq_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.cardinality(S.listings(spark, sf_dir), ["county", "district", "room_count", "kind", "title"])
    return out.withColumn("top_share", F.round("top_share", 6))


def win_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.listings(spark, sf_dir).select("classified_id", "purpose", "saved_at", F.round("price", 2).alias("price"))


def set_union_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir, "sale")
    kept, first = C.split(df, C.in_ranges({"gross_m2": (30, 200, False)}), "gross")
    _, second = C.split(kept, C.in_ranges({"building_age": (0, 40, False)}), "age")
    return first.unionByName(second, allowMissingColumns=True).select("classified_id", "reason")


def src_json_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.json_values(S.table(spark, sf_dir, "events"), "props", {"k": "bigint", "absent": "string"})
    return out.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.count("absent").alias("n_absent"), F.round(F.sum("value"), 3).alias("total"))


def src_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.json_keys(S.table(spark, sf_dir, "events"), "props")


def src_latest_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.latest(S.view(spark, sf_dir, S.TREND), ["county", "district"], "property_date", "1997-12-31")
    return out.select("county", "district", "property_date", F.round("unit_price_for_sale", 4).alias("unit_price_for_sale"), "count_for_sale")


def txt_to_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.format_number("o_totalprice", 2)
    turned = F.translate(whole, ",.", ".,")
    df = S.table(spark, sf_dir, "orders").select("o_orderkey", X.number(F.concat(turned, F.lit(" TL"))).alias("turned"), X.number(F.concat(F.lit("₺"), whole)).alias("plain"), X.number(F.concat(F.lit("-"), (F.col("o_orderkey") + 1).cast("string"))).alias("negative"))
    return df.select("o_orderkey", F.round("turned", 2).alias("turned"), F.round("plain", 2).alias("plain"), "negative")


def txt_room_age_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + 5)).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size"), F.lit(" ve üzeri"))).otherwise(F.col("p_size").cast("string"))
    room, living = X.rooms(F.concat(F.col("p_size") % 5, F.lit(" + "), F.col("p_size") % 2))
    return df.select("p_partkey", X.age(text).alias("age"), room.alias("rooms"), living.alias("living"), X.size_group(F.col("p_size") * 6).alias("size_group"))


def txt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents by folded form; the folded words are counted."""
    docs = S.table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.split(X.fold(F.col("text")), " ")).alias("word")).where(F.length("word") > 0)
    return words.groupBy("lang", F.length("word").alias("letters")).agg(F.count("*").alias("n"))


def txt_keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"metal": ["steel", "brass", "copper", "nickel", "tin"], "finish": ["polished", "burnished", "brushed", "plated", "anodized"], "size": ["small", "medium", "large"]}
    df = S.table(spark, sf_dir, "part")
    folded = X.fold(F.concat_ws(" ", "p_name", "p_type"))
    out = df.withColumns(X.flags(folded, groups))
    return out.groupBy("p_brand", *groups).agg(F.count("*").alias("n"))


def txt_site_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "part").withColumn("stem", X.site_stem(F.concat(F.col("p_name"), F.lit(" II Sitesi"))))
    counted = df.groupBy("stem").agg(F.count("*").alias("n"))
    return counted.withColumn("bucket", X.frequency_bucket(F.col("n")))


QUERIES = {f.__name__: f for f in (
    flt_group_iqr, flt_basic_range, flt_mad_location, flt_hier_outlier_flags, flt_staged_reasons, dq_anomaly_score, dq_suspicious_long, dq_duplicates, dq_missingness,
    dq_cardinality, win_keep_last, set_union_removed, src_json_expand, src_json_keys, src_latest_trend, txt_to_num, txt_room_age_parse, txt_fold, txt_keyword_flags, txt_site_stem,
)}

SIZE = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= 75 THEN '<=75' WHEN {c} <= 100 THEN '76-100' WHEN {c} <= 125 THEN '101-125' WHEN {c} <= 150 THEN '126-150' WHEN {c} <= 200 THEN '151-200' ELSE '200+' END"

RULES = [
    ("baseline_ratio_very_low", "r < 0.6", 18), ("baseline_ratio_low", "r >= 0.6 AND r < 0.72", 8), ("baseline_ratio_high", "r > 1.55 AND r <= 1.9", 8), ("baseline_ratio_very_high", "r > 1.9", 18), ("low_baseline_support", "base_n < 5", 8), ("net_gross_too_low", "net_m2 / gross_m2 < 0.5", 12),
    ("net_gross_too_high", "net_m2 / gross_m2 > 1.03", 18), ("price_unit_mismatch", "abs(price / gross_m2 - unit_price) / unit_price > 0.03", 25), ("large_room_tiny_m2", "room >= 4 AND gross_m2 < 95", 12), ("small_room_huge_m2", "room <= 1 AND gross_m2 > 135", 10),
    ("very_large_property", "gross_m2 > 230", 7), ("very_small_property", "gross_m2 < 45", 7), ("floor_above_total", "total_floors > 0 AND floor_num > total_floors", 20), ("total_floors_extreme", "total_floors > 45", 8), ("building_age_extreme", "building_age > 80", 8),
    ("amortization_too_low", "unit_price / rent_m2 / 12 < 8", 10), ("amortization_too_high", "unit_price / rent_m2 / 12 > 45", 10), ("low_detail", "near_market + in_parking + view_sea <= 3", 5), ("group_mad_extreme", "abs(z) > 3.5", 15),
]
ANOMALY = GROUPED + ", src AS (SELECT * FROM grouped WHERE purpose = 'sale')" + baseline_sql("src", least=CLEAN_LEAST) + """, rent AS (SELECT county, district, median(monthly_rent / gross_m2) rent_m2 FROM grouped WHERE purpose = 'rental' GROUP BY ALL),
s AS (SELECT l.*, base_count AS base_n, rent_m2, unit_price / greatest(1e0, base_m) r, CAST(regexp_extract(room_count, '([0-9]+)', 1) AS DOUBLE) room FROM mb l LEFT JOIN rent USING (county, district)),
m AS (SELECT county, room_count, m2_group, median(ln(r)) m, count(*) n FROM s GROUP BY ALL), d AS (SELECT s.*, m, n, abs(ln(r) - m) d FROM s JOIN m USING (county, room_count, m2_group)), k AS (SELECT county, room_count, m2_group, median(d) mad FROM d GROUP BY ALL),
z AS (SELECT d.*, CASE WHEN n >= 12 AND mad > 1e-9 THEN 0.6745 * (ln(r) - m) / mad END z FROM d JOIN k USING (county, room_count, m2_group)),
f AS (SELECT *, concat_ws('|', """ + ", ".join(f"CASE WHEN {c} THEN 'anom_{n}' END" for n, c, _ in RULES) + ") AS anomaly_reasons, least(100e0, " + " + ".join(f"CASE WHEN {c} THEN {w}e0 ELSE 0e0 END" for _, c, w in RULES) + """) AS anomaly_score FROM z),
g AS (SELECT *, CASE WHEN anomaly_score <= 9.9 THEN 'normal' WHEN anomaly_score <= 24.9 THEN 'review' WHEN anomaly_score <= 44.9 THEN 'high_risk' ELSE 'exclude_candidate' END AS anomaly_level FROM f)"""

ORACLE_SQL = {
    "flt_group_iqr": GROUPED + """, b AS (SELECT county, room_count, m2_group, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(unit_price) n FROM grouped WHERE purpose = 'sale' GROUP BY ALL),
f AS (SELECT g.*, coalesce(b.n >= 18 AND q3 > q1 AND (unit_price < q1 - 2.75 * (q3 - q1) OR unit_price > q3 + 2.75 * (q3 - q1)), false) AS group_outlier FROM grouped g JOIN b USING (county, room_count, m2_group) WHERE purpose = 'sale'),
w AS (SELECT quantile_cont(unit_price, 0.25) a, quantile_cont(unit_price, 0.75) z FROM f WHERE NOT group_outlier)
SELECT classified_id, county, room_count, m2_group, unit_price, group_outlier, NOT group_outlier AND z > a AND (unit_price < a - 4 * (z - a) OR unit_price > z + 4 * (z - a)) AS global_outlier FROM f, w""",
    "flt_basic_range": LISTING + """ SELECT purpose, county, CASE WHEN gross_m2 BETWEEN 25 AND 180 AND unit_price BETWEEN 150 AND 1200 AND coalesce(monthly_rent BETWEEN 10 AND 400, true) THEN 'kept' ELSE 'range' END AS reason,
count(*) AS n, round(avg(unit_price), 4) AS mean_unit_price FROM listing GROUP BY ALL""",
    "flt_mad_location": GROUPED + ", src AS (SELECT * FROM grouped WHERE purpose = 'sale')" + baseline_sql("src", least=CLEAN_LEAST) + """, s AS (SELECT mb.*, unit_price / greatest(1e0, base_m) r FROM mb),
m AS (SELECT county, room_count, median(ln(r)) m, count(*) n FROM s GROUP BY ALL), d AS (SELECT s.*, m.m, m.n, abs(ln(r) - m.m) d FROM s JOIN m USING (county, room_count)),
k AS (SELECT county, room_count, median(d) mad FROM d GROUP BY ALL), z AS (SELECT d.*, CASE WHEN n >= 12 AND mad > 1e-9 THEN 0.6745 * (ln(r) - m) / mad END z FROM d JOIN k USING (county, room_count))
SELECT classified_id, round(r, 6) AS baseline_ratio, round(z, 5) AS ratio_z, NOT r BETWEEN 0.5 AND 1.9 OR coalesce(abs(z) > 3.5, false) AS location_outlier FROM z""",
    "flt_hier_outlier_flags": LISTING + """, s AS (SELECT * FROM listing WHERE purpose = 'sale'), a AS (SELECT county, district, room_count, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(*) n FROM s GROUP BY ALL),
b AS (SELECT county, district, quantile_cont(unit_price, 0.25) p1, quantile_cont(unit_price, 0.75) p3, count(*) k FROM s GROUP BY ALL), m AS (SELECT median(unit_price) m FROM s), mad AS (SELECT median(abs(unit_price - m)) mad FROM s, m),
l AS (SELECT s.*, 0.6745 * (unit_price - m) / mad z, CASE WHEN n >= 8 AND q3 > q1 AND (unit_price < q1 - 1.5 * (q3 - q1) OR unit_price > q3 + 1.5 * (q3 - q1)) THEN 'district_room'
WHEN k >= 8 AND p3 > p1 AND (unit_price < p1 - 1.5 * (p3 - p1) OR unit_price > p3 + 1.5 * (p3 - p1)) THEN 'district' END AS outlier_level FROM s JOIN a USING (county, district, room_count) JOIN b USING (county, district), m, mad),
r AS (SELECT *, concat_ws('|', CASE WHEN NOT unit_price BETWEEN 100 AND 5000 THEN 'unit_price_limit' END, CASE WHEN NOT gross_m2 BETWEEN 25 AND 500 THEN 'gross_limit' END, CASE WHEN net_m2 > gross_m2 THEN 'net_over_gross' END,
CASE WHEN net_m2 / gross_m2 < 0.73 THEN 'net_gross_low' END, CASE WHEN abs(z) > 3.5 THEN 'mad' END, CASE WHEN outlier_level IS NOT NULL THEN 'group_iqr' END) AS remove_reasons,
concat_ws('|', CASE WHEN gross_m2 >= 200 THEN 'large' END, CASE WHEN building_age >= 40 THEN 'old' END, CASE WHEN regexp_matches(lower(title), 'burnished|plated') THEN 'special_title' END) AS review_reasons FROM l)
SELECT classified_id, outlier_level, remove_reasons, review_reasons, remove_reasons <> '' AS is_removed, remove_reasons = '' AND review_reasons <> '' AS needs_review FROM r""",
    "flt_staged_reasons": LISTING + """, s AS (SELECT *, concat_ws('; ', CASE WHEN NOT gross_m2 BETWEEN 25 AND 500 THEN 'invalid_gross' END, CASE WHEN NOT unit_price BETWEEN 100 AND 5000 THEN 'invalid_unit_price' END) r0 FROM listing WHERE purpose = 'sale'),
a AS (SELECT county, district, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(*) n FROM s WHERE r0 = '' GROUP BY ALL),
t AS (SELECT s.*, CASE WHEN r0 = '' AND n >= 8 AND q3 > q1 AND (unit_price < q1 - (q3 - q1) OR unit_price > q3 + (q3 - q1)) THEN 'district_iqr' ELSE r0 END r1 FROM s LEFT JOIN a USING (county, district)),
b AS (SELECT county, quantile_cont(unit_price, 0.25) q1, quantile_cont(unit_price, 0.75) q3, count(*) n FROM t WHERE r1 = '' GROUP BY ALL),
u AS (SELECT t.*, CASE WHEN r1 = '' AND n >= 20 AND q3 > q1 AND (unit_price < q1 - 1.25 * (q3 - q1) OR unit_price > q3 + 1.25 * (q3 - q1)) THEN 'county_iqr' ELSE r1 END AS reason FROM t LEFT JOIN b USING (county))
SELECT reason, count(*) AS n, round(avg(unit_price), 4) AS mean_unit_price FROM u GROUP BY ALL""",
    "dq_anomaly_score": ANOMALY + " SELECT classified_id, anomaly_score, anomaly_reasons, anomaly_level FROM g",
    "dq_suspicious_long": LISTING + """ SELECT classified_id, purpose, county, reason FROM (SELECT classified_id, purpose, county, unnest([CASE WHEN floor_num > total_floors THEN 'floor_over_top' END, CASE WHEN net_m2 > 0.9e0 * gross_m2 THEN 'net_over_gross' END,
CASE WHEN lat IS NULL THEN 'no_coordinates' END, CASE WHEN unit_price < 200 THEN 'cheap' END]) AS reason FROM listing) WHERE reason IS NOT NULL""",
    "dq_duplicates": LISTING + """ SELECT county, district, room_count, gross_m2, building_age, count(*) AS n, array_to_string(list_sort(list(classified_id))[1:3], ',') AS examples FROM listing GROUP BY ALL HAVING count(*) > 1""",
    "dq_missingness": LISTING + """, u AS (SELECT purpose, lat, lon, monthly_rent, building_age FROM listing UNION ALL SELECT 'both', lat, lon, monthly_rent, building_age FROM listing),
c AS (SELECT purpose, count(*) n, count(*) - count(lat) lat, count(*) - count(lon) lon, count(*) - count(monthly_rent) monthly_rent, count(*) - count(building_age) building_age FROM u GROUP BY ALL)
SELECT purpose, n, "column", n_missing, round(n_missing / n, 6) AS share FROM (UNPIVOT c ON lat, lon, monthly_rent, building_age INTO NAME "column" VALUE n_missing)""",
    "dq_cardinality": LISTING + """, u AS (SELECT "column", "value" FROM (UNPIVOT (SELECT county, district, room_count, kind, title FROM listing) ON county, district, room_count, kind, title INTO NAME "column" VALUE "value")), c AS (SELECT "column", "value", count(*) n FROM u GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY "column") total, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value" DESC) k FROM c)
SELECT "column", count(*) AS n_values, max(CASE WHEN k = 1 THEN "value" END) AS top_value, round(max(n) / max(total), 6) AS top_share, count(*) FILTER (WHERE n <= greatest(2, 0.005 * total)) AS n_rare FROM t GROUP BY ALL""",
    "win_keep_last": LISTING + " SELECT classified_id, purpose, saved_at, round(price, 2) AS price FROM listing",
    "set_union_removed": LISTING + " SELECT classified_id, CASE WHEN gross_m2 BETWEEN 30 AND 200 THEN 'age' ELSE 'gross' END AS reason FROM listing WHERE purpose = 'sale' AND NOT (gross_m2 BETWEEN 30 AND 200 AND building_age BETWEEN 0 AND 40)",
    "src_json_expand": "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(json_extract(props, '$.absent')) AS n_absent, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "src_json_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
    "src_latest_trend": "WITH t AS (" + plain(S.TREND) + """) SELECT county, district, property_date, round(unit_price_for_sale, 4) AS unit_price_for_sale, count_for_sale
FROM (SELECT *, row_number() OVER (PARTITION BY county, district ORDER BY property_date DESC) k FROM t WHERE NOT projection_like AND property_date <= DATE '1997-12-31') WHERE k = 1""",
    "txt_to_num": "SELECT o_orderkey, round(o_totalprice, 2) AS turned, round(o_totalprice, 2) AS plain, CAST(-o_orderkey - 1 AS DOUBLE) AS negative FROM orders",
    "txt_room_age_parse": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size + 2.5e0 WHEN 1 THEN p_size + 4e0 ELSE CAST(p_size AS DOUBLE) END AS age, CAST(p_size % 5 AS DOUBLE) AS rooms, CAST(p_size % 2 AS DOUBLE) AS living, " + SIZE.replace("{c}", "p_size * 6") + " AS size_group FROM part",
    "txt_fold": r"""WITH f AS (SELECT lang, translate(lower(text), 'çğıöşüâîûéèêëáàäãåíìïóòôõúùñ', 'cgiosuaiueeeeaaaaaiiioooouun') t FROM documents),
w AS (SELECT lang, unnest(string_split_regex(regexp_replace(t, '[^\p{L}\p{N}_\s|+./''\-]', ' ', 'g'), '\s+')) word FROM f) SELECT lang, CAST(length(word) AS INTEGER) AS letters, count(*) AS n FROM w WHERE length(word) > 0 GROUP BY ALL""",
    "txt_keyword_flags": """SELECT p_brand, CAST(regexp_matches(t, 'steel|brass|copper|nickel|tin') AS INTEGER) AS metal, CAST(regexp_matches(t, 'polished|burnished|brushed|plated|anodized') AS INTEGER) AS finish, CAST(regexp_matches(t, 'small|medium|large') AS INTEGER) AS size, count(*) AS n
FROM (SELECT p_brand, lower(concat_ws(' ', p_name, p_type)) t FROM part) GROUP BY ALL""",
    "txt_site_stem": r"""WITH s AS (SELECT trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s|+./''\-]', ' ', 'g'), '\s+', ' ', 'g')) || ' 2' AS stem, count(*) AS n FROM part GROUP BY ALL)
SELECT stem, n, CASE WHEN n <= 0 THEN 0 WHEN n < 3 THEN 1 WHEN n < 8 THEN 2 WHEN n < 20 THEN 3 ELSE 4 END AS bucket FROM s""",
}

