"""Queries over the site dictionary and over names found in texts; their SQL twins compare every text with every alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.operators import json_columns as J
from parcela.operators import site_dictionary as D
from parcela.plans.analytics import PRED, predicted, rounded, sales
from parcela.plans.sql import GROUPED, LISTING, plain
from parcela.sources import tables as S

#: Names of parts as aliases of sites; some have a second phase.
ALIASES = """
SELECT p.p_name AS alias, replace(p.p_name, ' ', '_') AS canonical_id, CASE p.p_size % 4 WHEN 0 THEN 'premium' WHEN 1 THEN 'mid' WHEN 2 THEN 'mass' ELSE 'unknown' END AS tier, p.p_partkey AS place
FROM {part} p WHERE p.p_name LIKE 'small%' OR p.p_name LIKE '%bolt'
UNION ALL SELECT concat(p.p_name, ' 2') AS alias, concat(replace(p.p_name, ' ', '_'), '_2') AS canonical_id, 'mid' AS tier, p.p_partkey + 1000000 AS place FROM {part} p WHERE p.p_name LIKE 'small%' AND p.p_size % 5 = 0
"""


def sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with a stem, what it was read from, and a text that names sites in several ways."""
    k, n, t = F.col("suppkey") % 5, F.col("partkey") % 4, F.col("title")
    text = F.when(k == 0, F.concat(F.lit("near "), t, F.lit(" 4"))).when(k == 1, t).when(k == 2, F.concat(t, F.lit(" 4 and "), t, F.lit(", etap"))).when(k == 3, F.concat(F.lit("big "), t, F.lit("s")))
    stem = F.when(n == 0, t).when(n == 1, F.concat(t, F.lit(" 2"))).when(n == 2, F.concat_ws(" ", F.lit("old"), t, F.col("county"))).otherwise("missing")
    return sales(spark, sf_dir).withColumns({"stem": F.lower(stem), "text": text, "raw": F.when(n < 3, F.initcap(stem)).otherwise(""), "source": F.when(n < 3, "title").otherwise("missing")})


def enc_site_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.site_ids(sited(spark, sf_dir), "raw", "source", "stem", "text", S.view(spark, sf_dir, ALIASES), 4)
    return out.select("classified_id", "site_project_id", "site_project_match_source", "site_project_listing_count", "has_site_project_id", "site_project_freq_bucket", "site_quality_tier", "site_tier_code")


def dq_site_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = S.view(spark, sf_dir, ALIASES)
    encoded = D.site_ids(sited(spark, sf_dir), "raw", "source", "stem", "text", aliases, 4)
    return rounded(D.review_rows(encoded, "raw", "stem", "unit_price", aliases, 4), 4, "mean_price", "median_price")


def agg_site_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("partkey") % 6, F.initcap("title")
    heading = F.when(k == 0, F.concat(t, F.lit(" Sitesi"))).when(k == 1, F.concat(F.lit("Yeni daire "), t, F.lit(" RESIDENCE, 3+1"))).when(k == 2, F.concat(F.lit("in \""), t, F.lit("\" and 'Kat'"))).when(k == 3, "Merkez Sitesi").otherwise(F.col("title"))
    address = F.when(k == 4, F.concat(t, F.lit(" PROJE | "), t, F.lit("  SITESINDE")))
    df = predicted(spark, sf_dir, "partkey", "suppkey", "title", "gross_m2").withColumns({"heading": heading, "address": address, "site": F.when(F.col("suppkey") % 3 == 0, t).when(F.col("suppkey") % 3 == 1, "Yok"), "residual": F.col("pred") - F.col("unit_price"), "decile": F.floor(F.col("gross_m2") / 30)})
    found = D.mentions(df, "classified_id", "site", ["heading", "address"])
    out = D.mentioned_sites(found, df, "classified_id", "decile", "residual", "unit_price", "pred", "heading")
    return rounded(out, 5, "mean_residual", "mean_actual", "mean_pred", "mean_confidence")


def documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with a JSON text of details: keys differ by row, some clash with columns, some texts are broken."""
    d = S.listings(spark, sf_dir, "sale")
    n = F.col("partkey") % 5
    number = F.when(n == 0, F.concat(F.lit("\""), (F.col("gross_m2")).cast("int"), F.lit("\""))).when(n == 1, "\"much\"").when(n == 2, "true").otherwise((F.col("suppkey") % 7).cast("string"))
    pairs = [
        F.concat(F.lit("\"view_hill\": "), number), F.when(n < 3, F.concat(F.lit("\"near_school\": "), (F.col("suppkey") % 2).cast("string"))), F.concat(F.lit("\"other\": "), F.lit("1")),
        F.when(n > 2, F.concat(F.lit("\"detail_muhit\": \""), F.col("title"), F.lit("|Okul\""))), F.when(n == 4, F.lit("\"in_parking\": 5")), F.concat(F.lit("\"title\": \"json\"")), F.lit("\"gross_m2\": \"\""),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    broken = F.when(F.col("suppkey") % 11 == 0, F.substring(text, 1, 20)).when(F.col("suppkey") % 11 == 1, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return d.withColumns({"raw": broken, "in_parking": F.when(F.col("partkey") % 3 > 0, F.col("in_parking").cast("string")).otherwise(""), "title": F.when(F.col("partkey") % 2 > 0, F.col("title")).otherwise(" ")})


def src_json_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expand_export(documented(spark, sf_dir), "raw").select("classified_id", "view_hill", "near_school", "detail_muhit", "in_parking", "title", "gross_m2")


SITED = GROUPED + """, al0 AS (""" + plain(ALIASES) + """), al AS (SELECT alias, arg_min(canonical_id, place) AS canonical_id, arg_min(tier, place) AS tier, min(place) AS place FROM al0 GROUP BY alias),
st AS (SELECT *, CASE partkey % 4 WHEN 0 THEN lower(title) WHEN 1 THEN lower(title) || ' 2' WHEN 2 THEN 'old ' || lower(title) || ' ' || lower(county) ELSE 'missing' END AS stem,
  CASE suppkey % 5 WHEN 0 THEN 'near ' || title || ' 4' WHEN 1 THEN title WHEN 2 THEN title || ' 4 and ' || title || ', etap' WHEN 3 THEN 'big ' || title || 's' END AS text FROM grouped WHERE purpose = 'sale'),
dt AS (SELECT DISTINCT stem, coalesce(text, '') AS text FROM st),
mt AS (
  SELECT stem, text, canonical_id, tier, CASE WHEN stem = alias THEN 1 ELSE 0 END AS same, length(alias) AS size, place FROM dt, al
  WHERE stem = alias OR length(alias) >= 4 AND CASE WHEN starts_with(stem || ' ', alias || ' ') THEN NOT regexp_matches(substr(stem, length(alias) + 1), '^(\\s+(\\d+|ii))+$')
    ELSE regexp_matches(text, '(^|\\W)' || alias || '($|\\W)') AND NOT (regexp_matches(text, '(^|\\W)' || alias || '\\s+\\d+\\b') AND NOT regexp_matches(text, '(^|\\W)' || alias || '($|\\S|\\s+($|[^\\s\\d]))')) END),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem, text ORDER BY same DESC, size DESC, place) AS k FROM mt) WHERE k = 1),
en AS (
  SELECT st.*, b.canonical_id, b.tier, CASE WHEN partkey % 4 < 3 THEN 'title' WHEN b.canonical_id IS NOT NULL THEN 'dict' ELSE 'missing' END AS match_source,
         coalesce(b.canonical_id, CASE WHEN st.stem = 'missing' THEN 'missing' ELSE regexp_replace(st.stem, '[^a-z0-9]+', '_', 'g') END) AS proposed
  FROM st LEFT JOIN bt b ON st.stem = b.stem AND coalesce(st.text, '') = b.text),
c1 AS (SELECT proposed, count(*) AS seen FROM en WHERE proposed <> 'missing' GROUP BY proposed),
e2 AS (SELECT en.*, coalesce(seen, 0) AS seen, CASE WHEN canonical_id IS NULL AND en.proposed <> 'missing' AND coalesce(seen, 0) < 4 THEN 'other' ELSE en.proposed END AS site_project_id FROM en LEFT JOIN c1 ON c1.proposed = en.proposed),
c2 AS (SELECT site_project_id, count(*) AS n FROM e2 WHERE site_project_id <> 'missing' GROUP BY site_project_id)"""

MENTIONED = PRED + r""", dm AS (
  SELECT *, initcaps AS t FROM (SELECT *, upper(substr(split_part(title, ' ', 1), 1, 1)) || substr(split_part(title, ' ', 1), 2) || ' ' || upper(substr(split_part(title, ' ', 2), 1, 1)) || substr(split_part(title, ' ', 2), 2) AS initcaps FROM p)),
dx AS (
  SELECT classified_id, unit_price, pred, pred - unit_price AS residual, floor(gross_m2 / 30) AS decile,
    CASE partkey % 6 WHEN 0 THEN t || ' Sitesi' WHEN 1 THEN 'Yeni daire ' || t || ' RESIDENCE, 3+1' WHEN 2 THEN 'in "' || t || '" and ''Kat''' WHEN 3 THEN 'Merkez Sitesi' ELSE title END AS heading,
    CASE WHEN partkey % 6 = 4 THEN t || ' PROJE | ' || t || '  SITESINDE' ELSE '' END AS address, CASE suppkey % 3 WHEN 0 THEN t WHEN 1 THEN 'Yok' END AS site FROM dm),
fx AS (
  SELECT classified_id, 0 AS place, site AS name, 'site_name' AS source, 0.95e0 AS confidence FROM dx WHERE lower(coalesce(site, '')) NOT IN ('', 'yok')
  UNION ALL SELECT classified_id, 1, unnest(list_transform(range(1, len(a1) + 1), lambda i: a1[i] || ' ' || a2[i])), 'heading', 0.85e0 FROM (SELECT classified_id, regexp_extract_all(heading, '{plus}', 1) AS a1, regexp_extract_all(heading, '{plus}', 2) AS a2 FROM dx)
  UNION ALL SELECT classified_id, 2, unnest(regexp_extract_all(heading, '{inside}', 1)) || ' Sitesi', 'heading', 0.8e0 FROM dx
  UNION ALL SELECT classified_id, 3, unnest(regexp_extract_all(heading, '{quoted}', 1)), 'heading', 0.55e0 FROM dx
  UNION ALL SELECT classified_id, 4, unnest(list_transform(range(1, len(a1) + 1), lambda i: a1[i] || ' ' || a2[i])), 'address', 0.85e0 FROM (SELECT classified_id, regexp_extract_all(address, '{plus}', 1) AS a1, regexp_extract_all(address, '{plus}', 2) AS a2 FROM dx)
  UNION ALL SELECT classified_id, 5, unnest(regexp_extract_all(address, '{inside}', 1)) || ' Sitesi', 'address', 0.8e0 FROM dx
  UNION ALL SELECT classified_id, 6, unnest(regexp_extract_all(address, '{quoted}', 1)), 'address', 0.55e0 FROM dx),
cx AS (SELECT classified_id, place, source, confidence, regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '^[ \-|/.,;:]+|[ \-|/.,;:]+$', '', 'g') AS candidate_name FROM fx),
nx AS (SELECT *, lower(candidate_name) AS candidate_norm FROM cx WHERE length(candidate_name) >= 3),
tx AS (SELECT *, row_number() OVER (PARTITION BY classified_id, candidate_norm ORDER BY confidence DESC, place) AS k FROM nx
  WHERE len(list_filter(string_split(candidate_norm, ' '), lambda w: w NOT IN ('yeni', 'daire', 'merkez', 'kat', 'yok') AND NOT regexp_matches(w, '^\d+$') AND NOT regexp_matches(w, '^\d+\+\d+$'))) > 0),
jx AS (SELECT tx.candidate_norm, tx.candidate_name, tx.source, tx.confidence, dx.*, m.top FROM tx JOIN dx ON tx.classified_id = dx.classified_id, (SELECT max(decile) AS top FROM dx) m WHERE k = 1),
ox AS (SELECT candidate_norm, string_agg(substr(heading, 1, 80), ' || ' ORDER BY classified_id) AS example_titles FROM (SELECT *, row_number() OVER (PARTITION BY candidate_norm ORDER BY classified_id) AS n FROM jx) WHERE n <= 3 GROUP BY candidate_norm)
SELECT j.candidate_norm, arg_min(candidate_name, classified_id) AS candidate_name_example, count(DISTINCT classified_id) AS n_listings, CAST(sum(CASE WHEN decile = top AND residual < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_top_expensive_underpred,
  round(avg(residual), 5) AS mean_residual, round(avg(unit_price), 5) AS mean_actual, round(avg(pred), 5) AS mean_pred, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, round(avg(confidence), 5) AS mean_confidence, min(example_titles) AS example_titles
FROM jx j JOIN ox ON ox.candidate_norm = j.candidate_norm GROUP BY j.candidate_norm""".replace("{plus}", D.FAMILIES[0][2].replace("(?iu)", "(?i)").replace("'", "''")).replace("{inside}", D.FAMILIES[1][2].replace("(?iu)", "(?i)").replace("'", "''")).replace("{quoted}", D.FAMILIES[2][2].replace("'", "''"))

QUERIES = {f.__name__: f for f in (enc_site_dictionary, dq_site_review, agg_site_extracted, src_json_prefixes)}
ORACLE_SQL = {
    "enc_site_dictionary": SITED.replace("\\\\", "\\") + """ SELECT classified_id, e2.site_project_id, match_source AS site_project_match_source, coalesce(n, 0) AS site_project_listing_count, CASE WHEN e2.site_project_id <> 'missing' THEN 1 ELSE 0 END AS has_site_project_id,
CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN n < 3 THEN 1 WHEN n < 8 THEN 2 WHEN n < 20 THEN 3 ELSE 4 END AS site_project_freq_bucket, coalesce(tier, 'unknown') AS site_quality_tier,
CASE tier WHEN 'premium' THEN 3 WHEN 'mid' THEN 2 WHEN 'mass' THEN 1 ELSE 0 END AS site_tier_code FROM e2 LEFT JOIN c2 ON c2.site_project_id = e2.site_project_id""",
    "dq_site_review": SITED.replace("\\\\", "\\") + """, lo AS (SELECT *, upper(substr(stem, 1, 1)) AS u FROM e2 WHERE canonical_id IS NULL AND proposed <> 'missing'),
kn AS (SELECT DISTINCT canonical_id AS known FROM al), rv AS (
  SELECT stem, proposed AS proposed_canonical_id, CASE WHEN seen < 4 THEN 'freq_lt_min_separate_other' ELSE 'low_freq_kept_separate_review' END AS reason, seen AS frequency FROM lo WHERE seen < 4
  UNION ALL SELECT stem, known, 'near_dict_not_merged_conservative', seen FROM lo, kn WHERE known <> proposed AND (contains(proposed, known) OR contains(known, proposed))),
pr AS (SELECT site_project_id, round(avg(unit_price), 4) AS mean_price, round(median(unit_price), 4) AS median_price FROM e2 GROUP BY site_project_id)
SELECT array_to_string(list_transform(string_split(stem, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS raw_name, proposed_canonical_id, reason, frequency, count(*) AS n, min(mean_price) AS mean_price, min(median_price) AS median_price
FROM rv LEFT JOIN pr ON pr.site_project_id = rv.proposed_canonical_id GROUP BY stem, proposed_canonical_id, reason, frequency""",
    "agg_site_extracted": MENTIONED,
    "src_json_prefixes": LISTING + """, j AS (SELECT *, partkey % 5 AS k, suppkey % 11 > 1 AS good FROM listing WHERE purpose = 'sale')
SELECT classified_id, CASE WHEN good THEN CASE WHEN k = 0 THEN floor(gross_m2) WHEN k = 1 THEN NULL WHEN k = 2 THEN 1e0 ELSE CAST(suppkey % 7 AS DOUBLE) END END AS view_hill,
  CASE WHEN good AND k < 3 THEN CAST(suppkey % 2 AS DOUBLE) END AS near_school, CASE WHEN good AND k > 2 THEN CASE WHEN true THEN title END || '|Okul' END AS detail_muhit,
  CASE WHEN partkey % 3 > 0 THEN CAST(in_parking AS DOUBLE) WHEN good AND k = 4 THEN 5e0 END AS in_parking, CASE WHEN partkey % 2 > 0 THEN title WHEN good THEN 'json' ELSE ' ' END AS title, CAST(gross_m2 AS DOUBLE) AS gross_m2 FROM j""",
}
