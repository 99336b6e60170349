"""Queries over joins, aggregates, encoders, maps, models and reports, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.functions import geo as G
from parcela.functions import text as X
from parcela.operators import encoders as E
from parcela.operators import market as M
from parcela.operators import models as L
from parcela.operators import neighbours as N
from parcela.operators import reports as R
from parcela.operators import scores as Z
from parcela.operators.state import aggregate, attach, durable
from parcela.plans.sql import GROUPED, LISTING, plain
from parcela.sources import tables as S
from parcela.streaming.incremental import to_do, upsert

FOLDS = 5
COAST = [(40.60, 29.45), (40.70, 29.70), (40.75, 29.95), (40.72, 30.20)]
CENTRE = (40.765, 29.94)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.listings(spark, sf_dir, "sale").withColumn("m2_group", X.size_group(F.col("gross_m2")))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def nudged(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded after a step of 1e-9 up, where exact halves occur, which engines round unlike."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


def predicted(spark: SparkSession, sf_dir: str, *used: str) -> DataFrame:
    """Sales with `pred`: the mean of the other folds by county and rooms. The sales are written once, as what follows reads
    them several times, with the columns that are named (all, if none are); the means are written beside them."""
    df = E.with_fold(sales(spark, sf_dir), "classified_id", FOLDS)
    if used:
        df = df.select(*dict.fromkeys(["classified_id", "fold", "county", "room_count", "unit_price", *used]))
    return E.mean_encoding(durable(df), ["county", "room_count"], "unit_price", 20.0, "pred", written=True)


def agg_rent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.spread_stats(S.listings(spark, sf_dir, "rental"), "monthly_rent", ["county", "district"], "rent")
    return nudged(out, 5, "rent_median", "rent_mean", "rent_iqr", "rent_cv")


def join_rental_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ["classified_id", "county", "district", "m2_group", "room_count", "price", "gross_m2", "monthly_rent", "purpose"]
    both = durable(S.listings(spark, sf_dir).withColumn("m2_group", X.size_group(F.col("gross_m2"))).select(*used))
    out = M.rent_features(both.where("purpose = 'sale'"), both.where("purpose = 'rental'"))
    return rounded(out.select("classified_id", "rent", "rent_level", "rent_count", "rent_confidence", "amortization_years"), 6, "rent", "rent_confidence", "amortization_years")


def join_trend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = S.latest(S.view(spark, sf_dir, S.TREND), ["county", "district"], "property_date")
    out = M.trend_features(sales(spark, sf_dir), trend)
    return nudged(out.select("classified_id", "trend_sale", "trend_rent", "trend_source"), 4, "trend_sale", "trend_rent")


def join_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.demographic_features(sales(spark, sf_dir), S.view(spark, sf_dir, S.DEMOGRAPHICS))
    return rounded(out.select("classified_id", "demo_matched", "demo_population", "income_per_head", "low_share", "share_of_county"), 5, "income_per_head", "low_share", "share_of_county")


def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a nullable key, attached to the rows of that key, null included."""
    df = S.listings(spark, sf_dir).withColumn("half", F.when(F.col("building_age") < 20, F.col("room_count")))
    state = aggregate(df, ["county", "half"], n=F.count("*"))
    return aggregate(attach(df, state, ["county", "half"]), ["county", "half"], n=F.max("n"), n_rows=F.count("*"))


def join_outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.listings(spark, sf_dir, "sale").where("gross_m2 > 210"), S.listings(spark, sf_dir, "rental").where("gross_m2 > 215")
    return rounded(M.union_counts(a, b, ["county", "district", "room_count"], "unit_price"), 5, "median_sale", "median_rental", "rental_share")


def agg_price_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.price_rollup(sales(spark, sf_dir), ["city", "county", "district"], "unit_price")
    return nudged(out, 4, "mean", "std", "low", "high", "p10", "p25", "p50", "p75", "p90")


def agg_group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.stacked_metrics(predicted(spark, sf_dir), "unit_price", "pred", ["county", "district", "room_count", "m2_group"], 8)
    return rounded(out, 4, "mape", "median_ape", "mae", "mean_actual", "mean_predicted")


def agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.metrics(predicted(spark, sf_dir), "unit_price", "pred", ["county"])
    return rounded(out, 4, "r2", "log_r2", "mape", "median_ape", "mae", "median_ae", "variance_ratio", "bias")


def agg_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.readiness(sales(spark, sf_dir), ["county", "m2_group"], F.col("lat").isNotNull()), 6, "coverage")


def win_decile_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.decile_bias(predicted(spark, sf_dir), "unit_price", "pred"), 4, "mean_actual", "mean_predicted", "bias", "mape")


def win_tail_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.tail_bias(predicted(spark, sf_dir), "unit_price", "pred", ["county"], "classified_id"), 4, "low_bias", "high_bias")


def win_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.weighted_median(sales(spark, sf_dir), ["county", "district"], "unit_price", "gross_m2", "classified_id"), 6, "weighted_median")


def win_share_in_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(S.listings(spark, sf_dir), ["county", "district"], n=F.count("*"))
    over = Window.partitionBy("county")
    return out.withColumns({"share": F.round(F.col("n") / F.sum("n").over(over), 6), "place": F.row_number().over(over.orderBy(F.desc("n"), "district"))})


def agg_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicted(spark, sf_dir).withColumn("residual", F.col("unit_price") - F.col("pred"))
    return rounded(R.correlations(df, ["gross_m2", "building_age", "floor_num"], "residual"), 5, "pearson", "spearman")


def agg_flag_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicted(spark, sf_dir)
    out = R.flag_lift(df, ["near_market", "in_parking", "view_sea"], F.col("unit_price") > 1.2 * F.col("pred"))
    return rounded(out, 6, "share_all", "share_scope", "lift")


def topk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.top_errors(predicted(spark, sf_dir), "unit_price", "pred", "classified_id")
    return rounded(out.select("classified_id", "county", "abs_error"), 4, "abs_error")


def enc_target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = durable(E.with_fold(sales(spark, sf_dir), "classified_id", FOLDS).select("classified_id", "fold", "county", "district", "unit_price"))
    out = E.mean_encoding(df, ["county", "district"], "unit_price", 20.0, "mean_enc")
    return rounded(out.select("classified_id", "fold", "mean_enc", "mean_enc_count"), 5, "mean_enc")


def enc_location_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = durable(E.with_fold(sales(spark, sf_dir), "classified_id", FOLDS).select("classified_id", "fold", "county", "district", "m2_group", "room_count", "unit_price"))
    levels = [(4, ["county", "district", "m2_group", "room_count"], 8), (3, ["county", "district", "m2_group"], 12), (2, ["county", "district"], 12), (1, ["county"], 20)]
    out = E.location_baseline(df, "unit_price", levels, FOLDS)
    return nudged(out.select("classified_id", "fold", "baseline", "baseline_level", "baseline_count"), 5, "baseline")


def enc_detail_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = durable(sales(spark, sf_dir).select("county", "unit_price", "near_market", "in_parking", "view_sea"))
    df = durable(attach(df, aggregate(df, ["county"], m=F.median("unit_price")), ["county"]).withColumn("residual", F.ln(F.col("unit_price") / F.col("m"))))
    return rounded(E.flag_premiums(df, ["near_market", "in_parking", "view_sea"], "residual"), 6, "effect")


def enc_site_foldsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites named by their stem, encoded by other folds' means; sites of under three listings elsewhere get none."""
    df = E.with_fold(sales(spark, sf_dir).withColumn("site", X.site_stem(F.col("title"))), "classified_id", FOLDS)
    out = E.mean_encoding(df, ["site"], "unit_price", 20.0, "site_enc")
    out = out.withColumn("site_enc", F.when(F.col("site_enc_count") >= 3, F.col("site_enc")))
    return rounded(out.select("classified_id", "site", "site_enc", "site_enc_count"), 5, "site_enc")


def enc_rare_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.group_rare(S.listings(spark, sf_dir), "title", 40)
    return aggregate(out, ["title"], n=F.count("*"))


def enc_useless(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    return E.useless(df, ["purpose", "monthly_rent", "county", "price"])


def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir).where("lat is not null")
    sin, cos = G.bearing(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon"))
    out = df.select("classified_id", G.haversine(F.col("lat"), F.col("lon"), F.lit(CENTRE[0]), F.lit(CENTRE[1])).alias("distance"), sin.alias("bearing_sin"), cos.alias("bearing_cos"), G.inside(F.col("lat"), F.col("lon"), (40.6, 40.9, 29.5, 30.0)).alias("inside"))
    return rounded(out, 4, "distance", "bearing_sin", "bearing_cos")


def geo_access_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.view(spark, sf_dir, S.POINTS).select("category", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = N.nearest_known(customers(spark, sf_dir), "c_custkey", points, "category")
    out = near.withColumn("access", G.access(F.col("nearest"), 1500.0))
    return rounded(out, 4, "nearest", "access")


def geo_coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customers(spark, sf_dir).where("lat is not null")
    return rounded(df.select("c_custkey", G.polyline_distance(F.col("lat"), F.col("lon"), COAST).alias("coast")), 3, "coast")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "customer")
    known = F.col("c_custkey") % 10 < 8
    return df.select("c_custkey", "c_acctbal", F.when(known, 40.55 + (F.col("c_custkey") % 450) / 1000.0).alias("lat"), F.when(known, 29.40 + (F.col("c_custkey") * 7 % 850) / 1000.0).alias("lon"))


def join_radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.view(spark, sf_dir, S.POINTS).select("category", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return rounded(N.within(customers(spark, sf_dir), "c_custkey", points, 5000.0, "category"), 4, "nearest")


def join_knn_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.nearest_listings(customers(spark, sf_dir), "c_custkey", "c_acctbal", 5)
    return rounded(out.withColumnRenamed("value", "balance"), 4, "distance", "balance")


def join_knn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.neighbour_stats(N.nearest_listings(customers(spark, sf_dir), "c_custkey", "c_acctbal", 10), "c_custkey", [5, 10])
    return rounded(out, 4, "median_5", "median_10", "weighted_mean")


def compared(df: DataFrame) -> DataFrame:
    """What listings are compared by; map clusters are squares of a tenth of a degree."""
    cluster = F.concat_ws("/", F.floor(F.col("lat") * 10), F.floor(F.col("lon") * 10))
    return df.select("classified_id", "county", "district", "room_count", "m2_group", "gross_m2", Z.age_bucket(F.col("building_age")).alias("age_group"), F.when(F.col("lat").isNotNull(), cluster).alias("cluster"), F.col("title").alias("site"))


def join_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.similar_listings(compared(sales(spark, sf_dir)), "classified_id", ["county", "district", "room_count", "m2_group"], 3)
    return out.select("classified_id", "neighbour", "rank", F.round("score", 6).alias("score"))


def ens_blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = E.mean_encoding(predicted(spark, sf_dir), ["m2_group"], "unit_price", 20.0, "pred_size")
    return rounded(L.blend_grid(df, "unit_price", "pred", "pred_size", [0.1, 0.25, 0.5, 0.75, 1.0]), 6, "mape", "mae")


def ens_group_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.group_residual(predicted(spark, sf_dir), "unit_price", "pred", ["m2_group"], 80.0, "corrected")
    return rounded(df.select("classified_id", "corrected"), 5, "corrected")


def cal_linear_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.calibrate_linear(predicted(spark, sf_dir), "unit_price", "pred", FOLDS).select("classified_id", "calibrated"), 4, "calibrated")


def cal_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.calibrate_bins(predicted(spark, sf_dir), "unit_price", "pred", FOLDS).select("classified_id", "calibrated"), 4, "calibrated")


def cal_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.calibrate_isotonic(predicted(spark, sf_dir), "unit_price", "pred", FOLDS).select("classified_id", "calibrated")


def mdl_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of ridge and boosted trees out of fold, and of their blend by inverse error."""
    numeric = ["gross_m2", "building_age", "near_market", "in_parking", "view_sea"]
    used = ["classified_id", "fold", "unit_price", "county"]
    df = durable(E.with_fold(sales(spark, sf_dir), "classified_id", 2).select(*used, "m2_group", *numeric))
    df = E.location_baseline(df, "unit_price", [(1, ["county", "m2_group"], 20)], 2).select(*used, "baseline", *numeric)
    out = L.out_of_fold(df, "unit_price", "baseline", numeric, ["county"], ["ridge", "boosted"], 2)
    out = durable(out.select("county", "unit_price", "pred_ridge", "pred_boosted"))  # predicted once, for the weights and for the errors
    weights = L.ensemble_weights(out, "unit_price", ["pred_ridge", "pred_boosted"])
    return R.metrics(out.withColumn("pred_ensemble", L.blend(weights)), "unit_price", "pred_ensemble", ["county"])


def set_antijoin_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = S.table(spark, sf_dir, "customer").select("c_custkey")
    done = S.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return to_do(wanted, done, ["c_custkey"])


def set_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    current, changes = events.where("event_type <> 'purchase'"), events.where("event_type = 'purchase'")
    return upsert(current, changes, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (
    agg_rent_stats, join_rental_fallback, join_trend_fallback, join_demographics, join_null_safe, join_outer_counts, agg_price_rollup, agg_group_errors, agg_metrics, agg_readiness,
    win_decile_bias, win_tail_bias, win_weighted_median, win_share_in_county, agg_correlations, agg_flag_lift, topk_errors, enc_target_stats, enc_location_baseline, enc_detail_premium,
    enc_site_foldsafe, enc_rare_group, enc_useless, geo_haversine, geo_access_scores, geo_coast, join_radius_count, join_knn_geo, join_knn_stats, join_similarity_topk,
    ens_blend_grid, ens_group_residual, cal_linear_log, cal_bin, cal_isotonic, mdl_out_of_fold, set_antijoin_todo, set_upsert,
)}


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000e0 * asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


SALES = GROUPED + ", s AS (SELECT *, CAST(classified_id % 5 AS INTEGER) AS fold FROM grouped WHERE purpose = 'sale')"


def mean_sql(source: str, keys: str, name: str, out: str) -> str:
    """A leave-fold-out mean drawn to the overall one, as further subqueries ending in `out`."""
    on, also = (" AND ".join(f"x.{k} = {t}.{k}" for k in keys.split(", ")) for t in ("kf", "k"))
    return f""", kf_{out} AS (SELECT {keys}, fold, sum(unit_price) s, count(*) n FROM {source} GROUP BY ALL), k_{out} AS (SELECT {keys}, sum(s) s, sum(n) n FROM kf_{out} GROUP BY ALL), f_{out} AS (SELECT fold, sum(s) s, sum(n) n FROM kf_{out} GROUP BY ALL), a_{out} AS (SELECT sum(s) s, sum(n) n FROM f_{out}),
{out} AS (SELECT x.*, (k.s - kf.s + 20 * (a.s - f.s) / (a.n - f.n)) / (k.n - kf.n + 20) AS {name}, CAST(k.n - kf.n AS BIGINT) AS {name}_count FROM {source} x JOIN kf_{out} kf ON {on} AND x.fold = kf.fold JOIN k_{out} k ON {also} JOIN f_{out} f ON f.fold = x.fold, a_{out} a)"""


PRED = SALES + mean_sql("s", "county, room_count", "pred", "p")
METRICS = "1 - sum(pow(unit_price - pred, 2)) / (var_pop(unit_price) * count(*)), 4) AS r2, round(1 - sum(pow(ln(1 + unit_price) - ln(1 + greatest(pred, 0)), 2)) / (var_pop(ln(1 + unit_price)) * count(*)), 4) AS log_r2, round(avg(abs(pred - unit_price) / unit_price), 4) AS mape, round(median(abs(pred - unit_price) / unit_price), 4) AS median_ape, round(avg(abs(pred - unit_price)), 4) AS mae, round(median(abs(pred - unit_price)), 4) AS median_ae, round(var_pop(pred) / var_pop(unit_price), 4) AS variance_ratio, round(avg(pred - unit_price), 4) AS bias"
PEOPLE = "c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 10 < 8 THEN 40.55e0 + (c_custkey % 450) / 1000e0 END AS lat, CASE WHEN c_custkey % 10 < 8 THEN 29.40e0 + (c_custkey * 7 % 850) / 1000e0 END AS lon FROM customer)"
POINTS = "WITH points AS (" + plain(S.POINTS) + "), " + PEOPLE
KNN = "WITH " + PEOPLE + ", n AS (SELECT a.c_custkey, b.c_custkey AS neighbour, b.c_acctbal AS balance, " + haversine_sql("a.lat", "a.lon", "b.lat", "b.lon") + """ AS distance FROM c a JOIN c b ON a.lat IS NOT NULL AND b.lat IS NOT NULL AND a.c_custkey <> b.c_custkey),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY round(distance, 6), neighbour) AS INTEGER) AS rank FROM n)"""
LEVELS = [(4, "county, district, m2_group, room_count", 8), (3, "county, district, m2_group", 12), (2, "county, district", 12), (1, "county", 20)]
BASELINE = SALES + ", learn AS (SELECT s.* REPLACE (CAST(v AS INTEGER) AS fold) FROM s, range(5) t(v) WHERE v <> s.fold)" + "".join(
    f", b{c} AS (SELECT fold, {keys}, median(unit_price) m{c}, count(*) n{c} FROM learn GROUP BY ALL HAVING count(*) >= {least})" for c, keys, least in LEVELS
) + ", b0 AS (SELECT fold, median(unit_price) m0, count(*) n0 FROM learn GROUP BY ALL) SELECT classified_id, fold, round(greatest(1, coalesce(m4, m3, m2, m1, m0)) + 1e-9, 5) AS baseline, CASE WHEN m4 IS NOT NULL THEN 4 WHEN m3 IS NOT NULL THEN 3 WHEN m2 IS NOT NULL THEN 2 WHEN m1 IS NOT NULL THEN 1 ELSE 0 END AS baseline_level, coalesce(n4, n3, n2, n1, n0) AS baseline_count FROM s" + "".join(
    f" LEFT JOIN b{c} USING (fold, {keys})" for c, keys, _ in LEVELS
) + " LEFT JOIN b0 USING (fold)"
COMPARED = """, sc AS (SELECT *, CASE WHEN building_age <= 4 THEN 'new' WHEN building_age <= 10 THEN 'young' WHEN building_age <= 25 THEN 'mid' ELSE 'old' END AS ag, CASE WHEN lat IS NOT NULL THEN floor(lat * 10) || '/' || floor(lon * 10) END AS cl FROM s)"""
SIMILARITY = "0.25e0 * exp(-abs(a.gross_m2 - b.gross_m2) / 40e0) + 0.2e0 * 1e0 + 0.15e0 * CASE WHEN a.ag = b.ag THEN 1e0 ELSE 0.5e0 END + 0.15e0 * 1e0 + 0.1e0 * CASE WHEN coalesce(a.cl = b.cl, false) THEN 1e0 ELSE 0e0 END + 0.1e0 * CASE WHEN a.title = b.title THEN 1e0 ELSE 0.5e0 END + 0.05e0 * CASE WHEN (a.gross_m2 >= 150) = (b.gross_m2 >= 150) THEN 1e0 ELSE 0.3e0 END"
CAP = "exp(ln(pred) + greatest(-0.1e0, least(0.1e0, ({x}) - ln(pred))))"

ORACLE_SQL = {
    "agg_rent_stats": LISTING + """ SELECT county, district, round(median(monthly_rent) + 1e-9, 5) AS rent_median, round(avg(monthly_rent) + 1e-9, 5) AS rent_mean, count(monthly_rent) AS rent_count, round(CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(monthly_rent, 0.75) - quantile_cont(monthly_rent, 0.25) END + 1e-9, 5) AS rent_iqr,
round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(monthly_rent) / avg(monthly_rent) END + 1e-9, 5) AS rent_cv FROM listing WHERE purpose = 'rental' GROUP BY ALL""",
    "join_rental_fallback": GROUPED + """, r AS (SELECT *, monthly_rent / gross_m2 x FROM grouped WHERE purpose = 'rental'), a AS (SELECT county, district, room_count, median(x) ma, count(*) na FROM r GROUP BY ALL), e AS (SELECT county, district, m2_group, median(x) me, count(*) ne FROM r GROUP BY ALL), b AS (SELECT county, district, median(x) mb, count(*) nb FROM r GROUP BY ALL), c AS (SELECT county, median(x) mc, count(*) nc FROM r GROUP BY ALL), d AS (SELECT median(x) md FROM r),
j AS (SELECT l.*, coalesce(ma, me, mb, mc, md) rent, CASE WHEN na > 0 THEN 'district_room' WHEN ne > 0 THEN 'district_m2_group' WHEN nb > 0 THEN 'district' WHEN nc > 0 THEN 'county' ELSE 'global' END rent_level, greatest(coalesce(na, 0), coalesce(ne, 0), coalesce(nb, 0), coalesce(nc, 0)) rent_count FROM grouped l LEFT JOIN a USING (county, district, room_count) LEFT JOIN e USING (county, district, m2_group) LEFT JOIN b USING (county, district) LEFT JOIN c USING (county), d WHERE purpose = 'sale')
SELECT classified_id, round(rent, 6) AS rent, rent_level, rent_count, round(least(rent_count, 30) / 30, 6) AS rent_confidence, round(price / (12 * rent * gross_m2), 6) AS amortization_years FROM j""",
    "join_trend_fallback": LISTING + ", trend AS (" + plain(S.TREND) + """), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county, district ORDER BY property_date DESC) k FROM trend WHERE NOT projection_like) WHERE k = 1), w AS (SELECT county, median(unit_price_for_sale) cs, median(unit_price_for_rent) cr FROM t GROUP BY ALL)
SELECT classified_id, round(coalesce(unit_price_for_sale, cs) + 1e-9, 4) AS trend_sale, round(coalesce(unit_price_for_rent, cr) + 1e-9, 4) AS trend_rent, CASE WHEN unit_price_for_sale IS NOT NULL THEN 'district' WHEN cs IS NOT NULL THEN 'county' ELSE 'none' END AS trend_source FROM listing l LEFT JOIN t USING (county, district) LEFT JOIN w USING (county) WHERE purpose = 'sale'""",
    "join_demographics": LISTING + ", people AS (" + plain(S.DEMOGRAPHICS) + """), w AS (SELECT county, sum(population) p, sum(income) i, sum(households_low) h FROM people GROUP BY ALL)
SELECT classified_id, CAST(population IS NOT NULL AS INTEGER) AS demo_matched, CAST(coalesce(population, p) AS BIGINT) AS demo_population, round(coalesce(income, i) / coalesce(population, p), 5) AS income_per_head, round(coalesce(households_low, h) / coalesce(population, p), 5) AS low_share, round(population / p, 5) AS share_of_county
FROM listing l LEFT JOIN people USING (county, district) LEFT JOIN w USING (county) WHERE purpose = 'sale'""",
    "join_null_safe": LISTING + " SELECT county, CASE WHEN building_age < 20 THEN room_count END AS half, count(*) AS n, count(*) AS n_rows FROM listing GROUP BY ALL",
    "join_outer_counts": LISTING + """, a AS (SELECT county, district, room_count, count(*) n_sale, median(unit_price) median_sale FROM listing WHERE purpose = 'sale' AND gross_m2 > 210 GROUP BY ALL), b AS (SELECT county, district, room_count, count(*) n_rental, median(unit_price) median_rental FROM listing WHERE purpose = 'rental' AND gross_m2 > 215 GROUP BY ALL)
SELECT county, district, room_count, coalesce(n_sale, 0) AS n_sale, round(median_sale, 5) AS median_sale, coalesce(n_rental, 0) AS n_rental, round(median_rental, 5) AS median_rental, round(coalesce(n_rental, 0) / (coalesce(n_sale, 0) + coalesce(n_rental, 0)), 5) AS rental_share FROM a FULL JOIN b USING (county, district, room_count)""",
    "agg_price_rollup": LISTING + """ SELECT city, county, district, CAST(3 - bit_count(grouping_id(city, county, district)) AS INTEGER) AS depth, count(*) AS n, round(avg(unit_price) + 1e-9, 4) AS mean, round(stddev_samp(unit_price) + 1e-9, 4) AS std, round(min(unit_price) + 1e-9, 4) AS low, round(max(unit_price) + 1e-9, 4) AS high,
round(quantile_cont(unit_price, 0.1) + 1e-9, 4) AS p10, round(quantile_cont(unit_price, 0.25) + 1e-9, 4) AS p25, round(quantile_cont(unit_price, 0.5) + 1e-9, 4) AS p50, round(quantile_cont(unit_price, 0.75) + 1e-9, 4) AS p75, round(quantile_cont(unit_price, 0.9) + 1e-9, 4) AS p90 FROM listing WHERE purpose = 'sale' GROUP BY ROLLUP (city, county, district) HAVING grouping_id(city, county, district) < 7""",
    "agg_group_errors": PRED + """, u AS (UNPIVOT (SELECT unit_price, pred, county, district, room_count, m2_group FROM p) ON county, district, room_count, m2_group INTO NAME dimension VALUE "value")
SELECT dimension, "value", count(*) AS n, round(avg(abs(pred - unit_price) / unit_price), 4) AS mape, round(median(abs(pred - unit_price) / unit_price), 4) AS median_ape, round(avg(abs(pred - unit_price)), 4) AS mae, round(avg(unit_price), 4) AS mean_actual, round(avg(pred), 4) AS mean_predicted FROM u GROUP BY ALL HAVING count(*) >= 8""",
    "agg_metrics": PRED + " SELECT county, count(*) AS rows, round(" + METRICS + " FROM p GROUP BY ALL",
    "agg_readiness": GROUPED + """, r AS (SELECT county, m2_group, count(*) n, count(DISTINCT district) n_districts, avg(CASE WHEN lat IS NOT NULL THEN 1e0 ELSE 0e0 END) coverage FROM grouped WHERE purpose = 'sale' GROUP BY ALL)
SELECT county, m2_group, n, n_districts, round(coverage, 6) AS coverage, CASE WHEN n >= 300 AND coverage >= 0.65 THEN 'GOOD' WHEN n >= 80 THEN 'OK' ELSE 'WEAK' END AS level, concat_ws('|', CASE WHEN n < 300 THEN 'few_rows' END, CASE WHEN coverage < 0.65 THEN 'low_coverage' END, CASE WHEN n_districts < 3 THEN 'few_districts' END) AS reasons FROM r""",
    "win_decile_bias": PRED + """, e AS (SELECT unnest(quantile_cont(unit_price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) e FROM p), l AS (SELECT list(DISTINCT e) l FROM e)
SELECT CAST(len(list_filter(l, lambda x: unit_price > x)) AS INTEGER) AS decile, count(*) AS n, round(avg(unit_price), 4) AS mean_actual, round(avg(pred), 4) AS mean_predicted, round(avg(pred - unit_price), 4) AS bias, round(avg(abs(pred - unit_price) / unit_price), 4) AS mape FROM p, l GROUP BY ALL""",
    "win_tail_bias": PRED + """, r AS (SELECT county, pred - unit_price e, row_number() OVER (PARTITION BY county ORDER BY unit_price, classified_id) k, count(*) OVER (PARTITION BY county) n FROM p)
SELECT county, round(avg(e) FILTER (WHERE k <= greatest(1, floor(n * 0.1e0))), 4) AS low_bias, round(avg(e) FILTER (WHERE k > n - greatest(1, floor(n * 0.1e0))), 4) AS high_bias FROM r GROUP BY ALL""",
    "win_weighted_median": LISTING + """, g AS (SELECT county, district, unit_price, sum(gross_m2) w FROM listing WHERE purpose = 'sale' GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY county, district ORDER BY unit_price) c, sum(w) OVER (PARTITION BY county, district) t FROM g)
SELECT county, district, round(min(unit_price), 6) AS weighted_median FROM c WHERE c >= 0.5 * t GROUP BY ALL""",
    "win_share_in_county": LISTING + ", g AS (SELECT county, district, count(*) n FROM listing GROUP BY ALL) SELECT county, district, n, round(n / sum(n) OVER (PARTITION BY county), 6) AS share, CAST(row_number() OVER (PARTITION BY county ORDER BY n DESC, district) AS INTEGER) AS place FROM g",
    "agg_correlations": PRED + """, u AS (UNPIVOT (SELECT unit_price - pred AS y, gross_m2, building_age, floor_num FROM p) ON gross_m2, building_age, floor_num INTO NAME "column" VALUE x), r AS (SELECT "column", x, y, rank() OVER (PARTITION BY "column" ORDER BY x) + (count(*) OVER (PARTITION BY "column", x) - 1) / 2 rx, rank() OVER (PARTITION BY "column" ORDER BY y) + (count(*) OVER (PARTITION BY "column", y) - 1) / 2 ry FROM u)
SELECT "column", round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r GROUP BY ALL""",
    "agg_flag_lift": PRED + """, u AS (UNPIVOT (SELECT unit_price > 1.2e0 * pred AS s, near_market, in_parking, view_sea FROM p) ON near_market, in_parking, view_sea INTO NAME flag VALUE v)
SELECT flag, CAST(sum(v) AS BIGINT) AS n_all, CAST(sum(v) FILTER (WHERE s) AS BIGINT) AS n_scope, round(avg(v), 6) AS share_all, round(avg(v) FILTER (WHERE s), 6) AS share_scope, round(avg(v) FILTER (WHERE s) / avg(v), 6) AS lift FROM u GROUP BY ALL""",
    "topk_errors": PRED + " SELECT classified_id, county, round(abs(pred - unit_price), 4) AS abs_error FROM p ORDER BY abs(pred - unit_price) DESC, classified_id LIMIT 50",
    "enc_target_stats": SALES + mean_sql("s", "county, district", "mean_enc", "p") + " SELECT classified_id, fold, round(mean_enc, 5) AS mean_enc, mean_enc_count FROM p",
    "enc_location_baseline": BASELINE,
    "enc_detail_premium": SALES + """, m AS (SELECT county, median(unit_price) m FROM s GROUP BY ALL), u AS (UNPIVOT (SELECT county, ln(unit_price / m) y, near_market, in_parking, view_sea FROM s JOIN m USING (county)) ON near_market, in_parking, view_sea INTO NAME flag VALUE v),
a AS (SELECT county, flag, count(*) FILTER (WHERE v = 1) n1, count(*) FILTER (WHERE v = 0) n0, median(y) FILTER (WHERE v = 1) - median(y) FILTER (WHERE v = 0) g FROM u GROUP BY ALL), b AS (SELECT flag, count(*) FILTER (WHERE v = 1) n1, count(*) FILTER (WHERE v = 0) n0, median(y) FILTER (WHERE v = 1) - median(y) FILTER (WHERE v = 0) g FROM u GROUP BY ALL),
j AS (SELECT a.county, a.flag, a.n1, CASE WHEN a.n1 >= 3 AND a.n0 >= 3 THEN a.g END o, CASE WHEN b.n1 >= 3 AND b.n0 >= 3 THEN b.g END w FROM a JOIN b USING (flag))
SELECT county, flag, n1 AS n_with, round(coalesce(CASE WHEN o IS NULL THEN w ELSE n1 / (n1 + 50e0) * o + (1 - n1 / (n1 + 50e0)) * coalesce(w, 0) END, 0), 6) AS effect FROM j""",
    "enc_site_foldsafe": GROUPED + r", s AS (SELECT *, CAST(classified_id % 5 AS INTEGER) AS fold, trim(regexp_replace(regexp_replace(lower(title), '[^\w\s|+./''\-]', ' ', 'g'), '\s+', ' ', 'g')) AS site FROM grouped WHERE purpose = 'sale')" + mean_sql("s", "site", "site_enc", "p") + " SELECT classified_id, site, round(CASE WHEN site_enc_count >= 3 THEN site_enc END, 5) AS site_enc, site_enc_count FROM p",
    "enc_rare_group": LISTING + ", c AS (SELECT title, count(*) n FROM listing GROUP BY ALL) SELECT CASE WHEN n < 40 THEN 'other' ELSE title END AS title, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL",
    "enc_useless": LISTING + """, c AS (SELECT count(purpose) a, count(DISTINCT purpose) da, count(monthly_rent) b, count(DISTINCT county) dc, count(DISTINCT price) dp FROM listing WHERE purpose = 'sale'),
r AS (SELECT 'purpose' AS "column", CASE WHEN a = 0 THEN 'all_null' WHEN da = 1 THEN 'constant' END AS reason FROM c UNION ALL SELECT 'monthly_rent', CASE WHEN b = 0 THEN 'all_null' END FROM c UNION ALL SELECT 'county', CASE WHEN dc = 1 THEN 'constant' END FROM c UNION ALL SELECT 'price', CASE WHEN dp = 1 THEN 'constant' END FROM c) SELECT * FROM r WHERE reason IS NOT NULL""",
    "geo_haversine": LISTING + ", a AS (SELECT *, atan2(sin(radians(lon - 29.94e0)) * cos(radians(lat)), cos(radians(40.765e0)) * sin(radians(lat)) - sin(radians(40.765e0)) * cos(radians(lat)) * cos(radians(lon - 29.94e0))) b FROM listing WHERE lat IS NOT NULL) SELECT classified_id, round(" + haversine_sql("lat", "lon", "40.765e0", "29.94e0") + ", 4) AS distance, round(sin(b), 4) + 0e0 AS bearing_sin, round(cos(b), 4) + 0e0 AS bearing_cos, lat BETWEEN 40.6e0 AND 40.9e0 AND lon BETWEEN 29.5e0 AND 30.0e0 AS inside FROM a",
    "geo_access_scores": POINTS + ", d AS (SELECT c_custkey, category, min(" + haversine_sql("c.lat", "c.lon", "q.lat", "q.lon") + ") m FROM c, points q WHERE c.lat IS NOT NULL GROUP BY ALL) SELECT c_custkey, category, round(m, 4) AS nearest, round(exp(-m / 1500e0), 4) AS access FROM d",
    "geo_coast": "WITH " + PEOPLE + ", v(y, x) AS (VALUES (40.60e0, 29.45e0), (40.70e0, 29.70e0), (40.75e0, 29.95e0), (40.72e0, 30.20e0), ((40.60e0 + 40.70e0) / 2, (29.45e0 + 29.70e0) / 2), ((40.70e0 + 40.75e0) / 2, (29.70e0 + 29.95e0) / 2), ((40.75e0 + 40.72e0) / 2, (29.95e0 + 30.20e0) / 2)) SELECT c_custkey, round(min(" + haversine_sql("lat", "lon", "y", "x") + "), 3) AS coast FROM c, v WHERE lat IS NOT NULL GROUP BY ALL",
    "join_radius_count": POINTS + ", d AS (SELECT c_custkey, category, " + haversine_sql("c.lat", "c.lon", "q.lat", "q.lon") + " m FROM c, points q WHERE c.lat IS NOT NULL) SELECT c_custkey, category, count(*) AS n, round(min(m), 4) AS nearest FROM d WHERE m <= 5000 GROUP BY ALL",
    "join_knn_geo": KNN + " SELECT c_custkey, neighbour, round(distance, 4) AS distance, rank, round(balance, 4) AS balance FROM k WHERE rank <= 5",
    "join_knn_stats": KNN + " SELECT c_custkey, count(*) AS n, round(median(balance) FILTER (WHERE rank <= 5), 4) AS median_5, round(median(balance), 4) AS median_10, round(sum(exp(-distance / 1000e0) * balance) / sum(exp(-distance / 1000e0)), 4) AS weighted_mean FROM k WHERE rank <= 10 GROUP BY ALL",
    "join_similarity_topk": SALES + COMPARED + ", j AS (SELECT a.classified_id, b.classified_id AS neighbour, round(" + SIMILARITY + """, 9) AS score
FROM sc a JOIN sc b USING (county, district, room_count, m2_group) WHERE a.classified_id <> b.classified_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY classified_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM j) SELECT classified_id, neighbour, rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
    "ens_blend_grid": PRED + mean_sql("p", "m2_group", "pred_size", "q") + ", g AS (SELECT w.w, unit_price y, (1 - w.w) * pred + w.w * pred_size x FROM q, (VALUES (0.1e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) w(w)) SELECT w AS weight, round(avg(abs(x - y) / y), 6) AS mape, round(avg(abs(x - y)), 6) AS mae FROM g GROUP BY ALL",
    "ens_group_residual": PRED + ", f AS (SELECT m2_group, fold, sum(ln(unit_price / pred)) s, count(*) n FROM p GROUP BY ALL), t AS (SELECT m2_group, sum(s) ts, sum(n) tn FROM f GROUP BY ALL) SELECT classified_id, round(pred * exp((ts - s) / (tn - n + 80)), 5) AS corrected FROM p JOIN f USING (m2_group, fold) JOIN t USING (m2_group)",
    "cal_linear_log": PRED + ", r AS (SELECT v AS fold, regr_slope(ln(unit_price), ln(pred)) b, regr_intercept(ln(unit_price), ln(pred)) a FROM p, range(5) t(v) WHERE v <> fold GROUP BY v) SELECT classified_id, round(" + CAP.format(x="a + b * ln(pred)") + ", 4) AS calibrated FROM p JOIN r USING (fold)",
    "cal_bin": PRED + """, l AS (SELECT p.* REPLACE (CAST(v AS INTEGER) AS fold) FROM p, range(5) t(v) WHERE v <> p.fold), e AS (SELECT fold, quantile_cont(ln(pred), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) e FROM l GROUP BY ALL),
b AS (SELECT fold, len(list_filter(e, lambda x: ln(pred) > x)) bin, greatest(-0.1e0, least(0.1e0, 0.5e0 * (median(ln(unit_price)) - median(ln(pred))))) shift FROM l JOIN e USING (fold) GROUP BY ALL HAVING count(*) >= 30), q AS (SELECT p.*, len(list_filter(e, lambda x: ln(pred) > x)) bin FROM p JOIN e USING (fold))
SELECT classified_id, round(""" + CAP.format(x="ln(pred) + coalesce(shift, 0)") + ", 4) AS calibrated FROM q LEFT JOIN b USING (fold, bin)",
    "set_antijoin_todo": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "set_upsert": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k = 1",
}
