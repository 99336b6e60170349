"""Sources: table readers, and the listing entities as views of the driver tables.

The view texts are plain SQL over named tables, so that the same text binds the entities in other engines.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LISTING_COLUMNS = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS classified_id,
       CASE WHEN l.l_returnflag = 'R' THEN 'rental' ELSE 'sale' END AS purpose,
       r.r_name AS city, n.n_name AS county, c.c_mktsegment AS district,
       concat(CAST(p.p_size % 5 + 1 AS STRING), '+1') AS room_count,
       l.l_extendedprice AS price,
       CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice / 200 END AS monthly_rent,
       l.l_quantity * 4 + 20 AS gross_m2,
       (l.l_quantity * 4 + 20) * (0.72e0 + 2 * l.l_discount) AS net_m2,
       l.l_extendedprice / (l.l_quantity * 4 + 20) AS unit_price,
       CAST(l.l_suppkey % 45 AS DOUBLE) AS building_age,
       CAST(l.l_partkey % 14 AS DOUBLE) AS floor_num,
       CAST(l.l_partkey % 12 + 1 AS DOUBLE) AS total_floors,
       CASE WHEN c.c_custkey % 10 < 8 THEN 40.55e0 + (c.c_custkey % 450) / 1000e0 END AS lat,
       CASE WHEN c.c_custkey % 10 < 8 THEN 29.40e0 + (c.c_custkey * 7 % 850) / 1000e0 END AS lon,
       CAST(l.l_tax >= 0.04 AS INT) AS near_market,
       CAST(l.l_suppkey % 3 = 0 AS INT) AS in_parking,
       CAST(l.l_partkey % 7 = 0 AS INT) AS view_sea,
       p.p_name AS title, p.p_type AS kind, l.l_shipdate AS saved_at, l.l_quantity AS q, l.l_tax AS tax, l.l_discount AS discount,
       l.l_partkey AS partkey, l.l_suppkey AS suppkey
"""
RAW_LISTINGS = LISTING_COLUMNS + """FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""
#: The same rows with the orders' places joined first, so that the many lines are dealt out twice at most.
PLACED_LISTINGS = LISTING_COLUMNS.rstrip() + """, l.l_orderkey AS _order, l.l_linenumber AS _line
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN ({orders} o JOIN ({customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey) ON o.o_custkey = c.c_custkey) ON l.l_orderkey = o.o_orderkey
"""

#: Total order of the rows of one id; the last one stands.
LISTING_ORDER = ("saved_at", "price", "q", "tax", "discount", "partkey", "suppkey", "purpose")

TREND = """
SELECT n.n_name AS county, c.c_mktsegment AS district, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS property_date,
       avg(o.o_totalprice) AS unit_price_for_sale, avg(o.o_totalprice) / 200 AS unit_price_for_rent, count(*) AS count_for_sale,
       date_trunc('month', o.o_orderdate) >= TIMESTAMP '1998-06-01 00:00:00' AS projection_like
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE n.n_nationkey % 5 <> 4 OR c.c_mktsegment <> 'BUILDING'
GROUP BY n.n_name, c.c_mktsegment, date_trunc('month', o.o_orderdate)
"""

DEMOGRAPHICS = """
SELECT r.r_name AS city, n.n_name AS county, c.c_mktsegment AS district, count(*) AS population, sum(c.c_acctbal) AS income,
       sum(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END) AS households_low, sum(CASE WHEN c.c_acctbal > 5000 THEN 1 ELSE 0 END) AS households_high
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
WHERE n.n_nationkey % 5 <> 3 OR c.c_mktsegment <> 'MACHINERY'
GROUP BY r.r_name, n.n_name, c.c_mktsegment
"""

POINTS = """
SELECT s.s_suppkey AS poi_id, CASE s.s_suppkey % 5 WHEN 0 THEN 'education' WHEN 1 THEN 'health' WHEN 2 THEN 'daily' WHEN 3 THEN 'transport' ELSE 'other' END AS category,
       40.55e0 + (s.s_suppkey * 37 % 450) / 1000e0 AS lat, 29.40e0 + (s.s_suppkey * 53 % 850) / 1000e0 AS lon FROM {supplier} s
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view text over the tables that it names."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLACED_LISTINGS).drop("_order", "_line")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by a total order; null keys are one key."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def listings(spark: SparkSession, sf_dir: str, purpose: str | None = None) -> DataFrame:
    """One row per listing, of one purpose or of both.

    Lines are dealt out by order when they meet the orders, so the last line of each order and number is found where it
    lies. Numbers beyond one digit would let lines of several orders share an id; then rows are dealt out by id."""
    odd = table(spark, sf_dir, "lineitem").where("l_linenumber is null or l_linenumber not between 0 and 9")
    keys = ["_order", "_line"] if odd.isEmpty() else ["classified_id"]
    out = keep_last(view(spark, sf_dir, PLACED_LISTINGS), keys, LISTING_ORDER).drop("_order", "_line")
    return out if purpose is None else out.where(F.col("purpose") == purpose)


def scan(spark: SparkSession, stem: str, wanted: Iterable[str] = (), where: Column | None = None) -> tuple[DataFrame, list[str]]:
    """The table at stem.parquet, or at stem.csv (with a header) where that is missing; the wanted columns that it has, and those that it lacks."""
    try:
        df = spark.read.parquet(f"{stem}.parquet")
    except AnalysisException:
        df = spark.read.option("header", True).csv(f"{stem}.csv")
    if where is not None:
        df = df.where(where)
    wanted = list(wanted) or df.columns
    return df.select(*(c for c in wanted if c in df.columns)), [c for c in wanted if c not in df.columns]


def first_present(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def with_columns_present(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with a null column for each name that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def latest(df: DataFrame, keys: Sequence[str], at: str, until: str | None = None) -> DataFrame:
    """The newest row of each key that is not a projection, up to a date."""
    known = df.where(~F.coalesce("projection_like", F.lit(False)))
    if until is not None:
        known = known.where(F.col(at) <= F.lit(until).cast("date"))
    return keep_last(known, keys, [at])


def json_values(df: DataFrame, column: str, types: dict[str, str]) -> DataFrame:
    """df with the values of a JSON object's keys; a value that df has already stands before the JSON's. Bad JSON gives nulls."""
    parsed = F.try_parse_json(F.col(column))
    found = {c: F.try_variant_get(parsed, f"$.{c}", t) for c, t in types.items()}
    return df.withColumns({c: F.coalesce(df[c].cast(types[c]), v) if c in df.columns else v for c, v in found.items()})


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """How many rows hold each key of a JSON object."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
