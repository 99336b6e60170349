"""Queries over location baselines and target statistics, with SQL twins, and the SQL of the baseline for others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions import text as X
from parcela.operators import baseline as B
from parcela.operators import encoders as E
from parcela.operators import market as M
from parcela.operators.state import durable
from parcela.plans.sql import GROUPED, plain
from parcela.sources import tables as S

FOLDS = 5
PLACED = ["classified_id", "fold", "county", "district", "m2_group", "room_count", "unit_price"]


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with fold and trend; some districts are unknown."""
    df = S.listings(spark, sf_dir, "sale").withColumn("m2_group", X.size_group(F.col("gross_m2"))).withColumn("district", F.when(F.col("partkey") % 13 > 0, F.col("district")))
    return E.with_fold(df, "classified_id", FOLDS)


def enc_market_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = S.latest(S.view(spark, sf_dir, S.TREND), ["county", "district"], "property_date")
    df = durable(M.trend_features(based(spark, sf_dir), trend).withColumn("trend", F.col("trend_sale") / 100).select(*PLACED, "trend"))
    out = B.market_baseline(df, "unit_price", FOLDS, "trend")
    value = ("location_baseline_m2", "location_baseline_log", "location_baseline_vs_trend")
    return out.select("classified_id", "location_baseline_count", "location_baseline_level_code", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in value))


def enc_target_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.target_groups(durable(based(spark, sf_dir).select(*PLACED)), "unit_price", FOLDS)
    return out.select("classified_id", *(F.round(F.col(f"{g}_{x}") + 1e-9, 5).alias(f"{g}_{x}") for g in B.TARGETS for x in ("median", "mean")))


def baseline_sql(source: str, folds: int = 0, least: dict[str, int] = B.LEAST) -> str:
    """Subqueries that end in `mb`: the source (with named keys, and fold where there are folds) with m, n and code of the baseline before any trend."""
    clean = ", ".join(f"coalesce(nullif(trim({c}), ''), 'missing') AS k_{c}" for c in B.KEYS)
    fold, per, other = ("f.v AS held, ", ", held", f", range({folds}) f(v) WHERE f.v <> fold AND") if folds else ("", "", " WHERE")
    out = f", mk AS (SELECT *, {clean} FROM {source})"
    for code, (keys, size) in B.LEVELS.items():
        names = ", ".join(f"k_{c}" for c in keys)
        out += f", mb{code} AS (SELECT {fold}{names}, median(unit_price) AS m, count(*) AS n FROM mk{other} unit_price > 0 GROUP BY {names}{per} HAVING count(*) >= {least[size]})"
    out += f", mb0 AS (SELECT {fold}median(unit_price) AS m FROM mk{other} unit_price > 0{' GROUP BY held' if folds else ''})"
    joins = " ".join(f"LEFT JOIN mb{c} ON " + " AND ".join([f"mk.k_{k} = mb{c}.k_{k}" for k in keys] + ([f"mk.fold = mb{c}.held"] if folds else [])) for c, (keys, _) in B.LEVELS.items())
    each = list(B.LEVELS)
    code = "CASE " + " ".join(f"WHEN mb{c}.m IS NOT NULL THEN {c}e0" for c in each) + " ELSE 0e0 END"
    return out + (
        f", mb AS (SELECT mk.*, coalesce({', '.join(f'mb{c}.m' for c in each)}, mb0.m, 1e0) AS base_m, CAST(coalesce({', '.join(f'mb{c}.n' for c in each)}, 0) AS DOUBLE) AS base_count, {code} AS base_code"
        f" FROM mk {joins} LEFT JOIN mb0 ON {'mk.fold = mb0.held' if folds else 'true'})"
    )


TRENDED = GROUPED + ", trend AS (" + plain(S.TREND) + """), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county, district ORDER BY property_date DESC) k FROM trend WHERE NOT projection_like) WHERE k = 1),
w AS (SELECT county, median(unit_price_for_sale) cs FROM t GROUP BY county), gd AS (SELECT * REPLACE (CASE WHEN partkey % 13 > 0 THEN district END AS district) FROM grouped WHERE purpose = 'sale'),
src AS (SELECT g.*, CAST(classified_id % 5 AS INTEGER) AS fold, coalesce(t.unit_price_for_sale, w.cs) / 100 AS trend FROM gd g LEFT JOIN t ON t.county = g.county AND t.district = g.district LEFT JOIN w ON w.county = g.county)"""


def targets_sql() -> str:
    out = TRENDED + f", mk AS (SELECT *, {', '.join(f"coalesce(nullif(trim({c}), ''), 'missing') AS k_{c}" for c in B.KEYS)} FROM src), a AS (SELECT f.v AS held, median(unit_price) AS m, avg(unit_price) AS s FROM mk, range(5) f(v) WHERE f.v <> fold GROUP BY held)"
    for name, keys in B.TARGETS.items():
        names = ", ".join(f"k_{c}" for c in keys)
        out += f", {name} AS (SELECT f.v AS held, {names}, median(unit_price) AS m, avg(unit_price) AS s, count(*) AS n FROM mk, range(5) f(v) WHERE f.v <> fold GROUP BY held, {names})"
    joins = " ".join(f"LEFT JOIN {g} ON mk.fold = {g}.held AND " + " AND ".join(f"mk.k_{k} = {g}.k_{k}" for k in keys) for g, keys in B.TARGETS.items())
    columns = ", ".join(f"round(coalesce({g}.m, a.m) + 1e-9, 5) AS {g}_median, round(coalesce(({g}.s * {g}.n + a.s * 20) / ({g}.n + 20), a.s) + 1e-9, 5) AS {g}_mean" for g in B.TARGETS)
    return out + f" SELECT classified_id, {columns} FROM mk {joins} JOIN a ON mk.fold = a.held"


QUERIES = {"enc_market_baseline": enc_market_baseline, "enc_target_groups": enc_target_groups}
ORACLE_SQL = {
    "enc_market_baseline": TRENDED + baseline_sql("src", FOLDS) + """, v AS (SELECT *, greatest(1e0, CASE WHEN trend > 0 THEN exp((1 - CASE WHEN base_count < 12 THEN 0.65e0 ELSE 0.25e0 END) * ln(base_m) + CASE WHEN base_count < 12 THEN 0.65e0 ELSE 0.25e0 END * ln(trend)) ELSE base_m END) AS b FROM mb)
SELECT classified_id, base_count AS location_baseline_count, base_code AS location_baseline_level_code, round(b + 1e-9, 5) AS location_baseline_m2, round(ln(b) + 1e-9, 5) AS location_baseline_log, round(coalesce(b / trend, 1e0) + 1e-9, 5) AS location_baseline_vs_trend FROM v""",
    "enc_target_groups": targets_sql(),
}
