"""Queries over attribute scores, comparables, layers and further reports, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions import text as X
from parcela.operators import layers as Y
from parcela.operators import models as L
from parcela.operators import neighbours as N
from parcela.operators import reports as R
from parcela.operators import scores as Z
from parcela.operators.encoders import mean_encoding, with_fold
from parcela.operators.state import aggregate, attach, durable
from parcela.plans.analytics import CAP, COMPARED, FOLDS, PRED, SALES, SIMILARITY, compared, customers, mean_sql, nudged, predicted, rounded, sales
from parcela.plans.cleaning import ANOMALY, both_purposes, scored
from parcela.plans.sql import GROUPED, LISTING
from parcela.sources import tables as S
from parcela.sources.sinks import samples


def enc_attribute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Z.attribute_scores(sales(spark, sf_dir))
    return rounded(out.select("classified_id", "score_age", "score_floor", "score_compact", "score_equipment", "score_total", "score_bucket"), 6, "score_compact", "score_equipment", "score_total")


def enc_large_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Z.large_home(sales(spark, sf_dir))
    return rounded(out.select("classified_id", "is_large", "m2_over", "log_m2", "room_density", "large_new", "large_view"), 6, "log_m2", "room_density")


def enc_premium_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.listings(spark, sf_dir)
    flags = X.flags(X.fold(F.concat_ws(" ", "title", "kind")), {"metal": ["steel", "brass"], "finish": ["polished", "burnished"], "size": ["large"]})
    score = Z.premium_score({"metal": 2.0, "finish": 3.0, "size": 1.5}, F.col("title").startswith("spring"))
    out = df.withColumns(flags).withColumn("premium_score", score).withColumn("premium_level", Z.premium_level(F.col("premium_score")))
    return aggregate(out, ["premium_level", "premium_score"], n=F.count("*"))


def enc_scope_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates are used in counties where enough listings have them."""
    df = sales(spark, sf_dir)
    covered = aggregate(df, ["county"], coverage=F.avg(F.col("lat").isNotNull().cast("double")))
    out = Z.scope_mask(attach(df, covered, ["county"]), F.col("coverage") >= 0.8, ["lat", "lon"], ["district"])
    return out.select("classified_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "district")


def enc_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    near = N.similar_listings(compared(df), "classified_id", ["county", "district", "room_count", "m2_group"], 3)
    out = Y.comparable_features(df, near, "classified_id", "unit_price", ["county"])
    return nudged(out.select("classified_id", "comp_value", "comp_mean", "comp_count", "comp_missing", "comp_confidence"), 5, "comp_value", "comp_mean", "comp_confidence")


def agg_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.metrics(predicted(spark, sf_dir), "unit_price", "pred", ["county", "district", "m2_group"], 10)
    return rounded(out.select("county", "district", "m2_group", "rows", "mape", "mae", "bias"), 4, "mape", "mae", "bias")


def agg_focus_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One county's districts: spread of unit prices, and medians of large homes."""
    df = sales(spark, sf_dir).where("county = 'NATION_7'")
    q = F.percentile("unit_price", F.array(F.lit(0.1), F.lit(0.9)))
    out = aggregate(df, ["district"], n=F.count("*"), _q=q, median=F.median("unit_price"), n_large=F.count_if(F.col("gross_m2") >= 150), large_median=F.median(F.when(F.col("gross_m2") >= 150, F.col("unit_price"))))
    return nudged(out.select("district", "n", "median", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p90"), "n_large", "large_median"), 4, "median", "p10", "p90", "large_median")


def agg_anomaly_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with and without listings of high anomaly scores."""
    df, rentals = both_purposes(spark, sf_dir)
    listed = scored(mean_encoding(with_fold(df, "classified_id", FOLDS), ["county", "room_count"], "unit_price", 20.0, "pred", written=True), rentals)
    s = F.col("anomaly_score")
    slices = F.array_compact(F.array(F.lit("all"), F.when(s < 25, F.lit("below_25")), F.when(s < 45, F.lit("below_45")), F.when(s >= 25, F.lit("from_25")), F.when(s >= 45, F.lit("from_45"))))
    out = R.metrics(listed.withColumn("slice", F.explode(slices)), "unit_price", "pred", ["slice"], 5)
    return rounded(out.select("slice", "rows", "mape", "mae"), 4, "mape", "mae")


def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of listings that have each attribute, by county and attribute, with the mode of rooms."""
    df = S.listings(spark, sf_dir)
    long = df.select("county", "room_count", F.col("lat").isNotNull().cast("int").alias("lat"), F.col("monthly_rent").isNotNull().cast("int").alias("monthly_rent"), "in_parking").unpivot(["county", "room_count"], ["lat", "monthly_rent", "in_parking"], "feature", "has")
    counted = aggregate(long, ["county", "feature", "room_count"], _n=F.count("*"), _h=F.sum("has"))
    out = aggregate(counted, ["county", "feature"], n=F.sum("_n"), n_has=F.sum("_h"), usual_rooms=F.max_by("room_count", F.struct("_n", "room_count")))
    return out.withColumn("share", F.round(X.ratio(F.col("n_has"), F.col("n")), 6))


def topk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(S.listings(spark, sf_dir), "unit_price", "classified_id", 25).select("classified_id", "end", "county")


def src_poi_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("School", "clinic", "Bakery", "bus_stop", "bench"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return aggregate(S.table(spark, sf_dir, "supplier").withColumn("category", Z.poi_category(kind)), ["category"], n=F.count("*"))


def src_line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector read as a line, thinned to about ten vertices."""
    out = Z.sampled_vertices(S.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return out.select("vec_id", "vertex_i", F.round(F.col("vertex").cast("double"), 6).alias("vertex"))


def cal_quantile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.calibrate_quantiles(predicted(spark, sf_dir, "unit_price"), "unit_price", "pred", FOLDS).select("classified_id", "calibrated"), 4, "calibrated")


def mdl_segment_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mean_encoding(predicted(spark, sf_dir), ["m2_group"], "unit_price", 20.0, "expert")
    out, _ = Y.segment_layer(df, "unit_price", "pred", F.col("gross_m2") >= 151, "expert", [0.15, 0.25, 0.35, 0.5, 0.65, 0.8, 1.0])
    return rounded(R.metrics(out, "unit_price", "layered").select("rows", "mape", "mae"), 5, "mape", "mae")


def mdl_residual_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, share = Y.residual_layer(predicted(spark, sf_dir, "gross_m2", "building_age", "in_parking", "view_sea"), "unit_price", "pred", F.col("gross_m2") >= 150, ["gross_m2", "building_age", "in_parking", "view_sea"], 2, [0.25, 0.5, 1.0])
    return R.metrics(out, "unit_price", "layered", spread=True).withColumn("share", F.lit(share))


def mdl_pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a ridge model's predictions move for older and for larger homes."""
    df = durable(sales(spark, sf_dir).select("classified_id", "gross_m2", "building_age", "in_parking", F.ln("unit_price").alias("_z")))  # read by every stage that is fitted
    model = Pipeline(stages=[*L.preparation(["gross_m2", "building_age", "in_parking"], []), L.regressors()["ridge"]]).fit(df)
    variants = {"older": {"building_age": F.col("building_age") + 10}, "larger": {"gross_m2": F.col("gross_m2") + 30}, "parking": {"in_parking": F.lit(1)}}
    return L.pair_tests(df, model, variants, "classified_id")


def geo_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.location_clusters(customers(spark, sf_dir), 12)
    return aggregate(out, ["cluster"], n=F.count("*"), lat=F.avg("lat"), lon=F.avg("lon"))


QUERIES = {f.__name__: f for f in (
    enc_attribute_scores, enc_large_home, enc_premium_signals, enc_scope_mask, enc_comparable, agg_heatmap, agg_focus_districts, agg_anomaly_slices, agg_coverage, topk_samples,
    src_poi_categories, src_line_samples, cal_quantile_map, mdl_segment_layer, mdl_residual_layer, mdl_pair_tests, geo_clusters,
)}

ROOMS = "CAST(regexp_extract(room_count, '([0-9]+)', 1) AS DOUBLE)"
SIMILAR = COMPARED + ", j AS (SELECT a.classified_id, b.classified_id AS neighbour, b.unit_price v, round(" + SIMILARITY + """, 9) AS score
FROM sc a JOIN sc b USING (county, district, room_count, m2_group) WHERE a.classified_id <> b.classified_id), k AS (SELECT *, row_number() OVER (PARTITION BY classified_id ORDER BY score DESC, neighbour) AS rank FROM j)"""
GRID = "[" + ", ".join(repr(0.05 + 0.9 * i / 19) for i in range(20)) + "]"

ORACLE_SQL = {
    "agg_anomaly_slices": ANOMALY + ", t AS (SELECT *, CAST(classified_id % 5 AS INTEGER) AS fold FROM g)" + mean_sql("t", "county, room_count", "pred", "p") + """, u AS (SELECT unnest(list_filter(['all', CASE WHEN anomaly_score < 25 THEN 'below_25' END, CASE WHEN anomaly_score < 45 THEN 'below_45' END, CASE WHEN anomaly_score >= 25 THEN 'from_25' END, CASE WHEN anomaly_score >= 45 THEN 'from_45' END], lambda x: x IS NOT NULL)) AS slice, unit_price, pred FROM p)
SELECT slice, count(*) AS rows, round(avg(abs(pred - unit_price) / unit_price), 4) AS mape, round(avg(abs(pred - unit_price)), 4) AS mae FROM u GROUP BY ALL HAVING count(*) >= 5""",
    "enc_attribute_scores": SALES + ", a AS (SELECT classified_id, CASE WHEN building_age <= 4 THEN 1e0 WHEN building_age <= 10 THEN 0.8e0 WHEN building_age <= 20 THEN 0.55e0 WHEN building_age <= 30 THEN 0.3e0 ELSE 0.1e0 END AS score_age, CASE WHEN floor_num <= 0 THEN 0.2e0 WHEN floor_num >= total_floors THEN 0.45e0 WHEN floor_num / total_floors BETWEEN 0.25e0 AND 0.8e0 THEN 1e0 ELSE 0.7e0 END AS score_floor, CASE WHEN gross_m2 / (" + ROOMS + " + 1) < 22 THEN 0.4e0 WHEN gross_m2 / (" + ROOMS + " + 1) <= 35 THEN 1e0 WHEN gross_m2 / (" + ROOMS + """ + 1) <= 50 THEN 0.8e0 ELSE 0.55e0 END AS c, (in_parking + near_market + view_sea) / 3e0 AS e FROM s), t AS (SELECT *, greatest(0, least(1, score_age * 0.35e0 + score_floor * 0.2e0 + c * 0.2e0 + e * 0.25e0)) t FROM a)
SELECT classified_id, score_age, score_floor, round(c, 6) AS score_compact, round(e, 6) AS score_equipment, round(t, 6) AS score_total, CASE WHEN t <= 0.35 THEN 'low' WHEN t <= 0.65 THEN 'mid' ELSE 'high' END AS score_bucket FROM t""",
    "enc_large_home": SALES + ", a AS (SELECT *, " + ROOMS + " room FROM s), b AS (SELECT *, CAST(gross_m2 >= 150 OR room >= 5 AS INTEGER) is_large FROM a) SELECT classified_id, is_large, greatest(0e0, gross_m2 - 150) AS m2_over, round(ln(gross_m2), 6) AS log_m2, round(100 * room / gross_m2, 6) AS room_density, is_large * CAST(building_age <= 5 AS INTEGER) AS large_new, is_large * view_sea AS large_view FROM b",
    "enc_premium_signals": LISTING + """, a AS (SELECT least(10e0, 2e0 * CAST(regexp_matches(lower(concat_ws(' ', title, kind)), 'steel|brass') AS INTEGER) + 3e0 * CAST(regexp_matches(lower(concat_ws(' ', title, kind)), 'polished|burnished') AS INTEGER) + 1.5e0 * CAST(regexp_matches(lower(concat_ws(' ', title, kind)), 'large') AS INTEGER) + CASE WHEN title LIKE 'spring%' THEN 3e0 ELSE 0e0 END) AS premium_score FROM listing)
SELECT CASE WHEN premium_score >= 7 THEN 'premium' WHEN premium_score >= 4 THEN 'upper' WHEN premium_score >= 2 THEN 'mid' ELSE 'standard' END AS premium_level, premium_score, count(*) AS n FROM a GROUP BY ALL""",
    "enc_scope_mask": SALES + ", c AS (SELECT county, avg(CASE WHEN lat IS NOT NULL THEN 1e0 ELSE 0e0 END) coverage FROM s GROUP BY ALL) SELECT classified_id, CASE WHEN coverage >= 0.8 THEN round(lat, 6) ELSE 0e0 END AS lat, CASE WHEN coverage >= 0.8 THEN round(lon, 6) ELSE 0e0 END AS lon, CASE WHEN coverage >= 0.8 THEN district ELSE 'location_not_used' END AS district FROM s JOIN c USING (county)",
    "enc_comparable": SALES + SIMILAR + """, t AS (SELECT classified_id, median(v) m, count(*) n, sum(score * v) / sum(score) w FROM k WHERE rank <= 3 GROUP BY ALL), c AS (SELECT county, median(unit_price) cm FROM s GROUP BY ALL)
SELECT classified_id, round(coalesce(m, cm) + 1e-9, 5) AS comp_value, round(w + 1e-9, 5) AS comp_mean, coalesce(n, 0) AS comp_count, CAST(m IS NULL AS INTEGER) AS comp_missing, round(least(1, coalesce(n, 0) / 3) + 1e-9, 5) AS comp_confidence FROM s LEFT JOIN t USING (classified_id) JOIN c USING (county)""",
    "agg_heatmap": PRED + " SELECT county, district, m2_group, count(*) AS rows, round(avg(abs(pred - unit_price) / unit_price), 4) AS mape, round(avg(abs(pred - unit_price)), 4) AS mae, round(avg(pred - unit_price), 4) AS bias FROM p GROUP BY ALL HAVING count(*) >= 10",
    "agg_focus_districts": GROUPED + """ SELECT district, count(*) AS n, round(median(unit_price) + 1e-9, 4) AS median, round(quantile_cont(unit_price, 0.1) + 1e-9, 4) AS p10, round(quantile_cont(unit_price, 0.9) + 1e-9, 4) AS p90, count(*) FILTER (WHERE gross_m2 >= 150) AS n_large, round(median(unit_price) FILTER (WHERE gross_m2 >= 150) + 1e-9, 4) AS large_median
FROM grouped WHERE purpose = 'sale' AND county = 'NATION_7' GROUP BY ALL""",
    "agg_coverage": LISTING + """, u AS (UNPIVOT (SELECT county, room_count, CAST(lat IS NOT NULL AS INTEGER) AS lat, CAST(monthly_rent IS NOT NULL AS INTEGER) AS monthly_rent, in_parking FROM listing) ON lat, monthly_rent, in_parking INTO NAME feature VALUE has), c AS (SELECT county, feature, room_count, count(*) k, sum(has) h FROM u GROUP BY ALL)
SELECT county, feature, CAST(sum(k) AS BIGINT) AS n, CAST(sum(h) AS BIGINT) AS n_has, arg_max(room_count, (k, room_count)) AS usual_rooms, round(sum(h) / sum(k), 6) AS share FROM c GROUP BY ALL""",
    "topk_samples": LISTING + " SELECT * FROM (SELECT classified_id, 'high' AS \"end\", county FROM listing ORDER BY unit_price DESC, classified_id LIMIT 25) UNION ALL SELECT * FROM (SELECT classified_id, 'low' AS \"end\", county FROM listing ORDER BY unit_price, classified_id LIMIT 25)",
    "src_poi_categories": "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'education' WHEN 1 THEN 'health' WHEN 2 THEN 'daily' WHEN 3 THEN 'transport' ELSE 'other' END AS category, count(*) AS n FROM supplier GROUP BY ALL",
    "src_line_samples": "WITH r AS (SELECT vec_id, embedding e, unnest(range(len(embedding))) i FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS vertex_i, round(CAST(e[i + 1] AS DOUBLE), 6) AS vertex FROM r WHERE i % greatest(1, len(e) // 10) = 0 OR i = len(e) - 1",
    "cal_quantile_map": PRED + f""", l AS (SELECT p.* REPLACE (CAST(v AS INTEGER) AS fold) FROM p, range(5) t(v) WHERE v <> p.fold), q AS (SELECT fold, quantile_cont(ln(pred), {GRID}) x, quantile_cont(ln(unit_price), {GRID}) y FROM l GROUP BY ALL), a AS (SELECT p.*, q.x, q.y, greatest(1, least(19, len(list_filter(q.x, lambda e: e <= ln(pred))))) i FROM p JOIN q USING (fold)),
b AS (SELECT *, greatest(0, least(1, coalesce((ln(pred) - x[i]) / nullif(x[i + 1] - x[i], 0), 0))) g FROM a) SELECT classified_id, round(""" + CAP.format(x="ln(pred) + 0.5e0 * (y[i] + g * (y[i + 1] - y[i]) - ln(pred))") + ", 4) AS calibrated FROM b",
}
