"""Sinks: tables, reports, keyed tables that are replaced whole, and lines as GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.streaming.incremental import upsert


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A small report as one CSV file with a header; reports are aggregates of a size that a page holds."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def replace_keyed(df: DataFrame, old: str, new: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """The old table with df's rows upserted, written at a new path; the old one stays until readers have moved."""
    upsert(df.sparkSession.read.parquet(old), df, keys, order).write.mode("overwrite").parquet(new)


def geojson_lines(points: DataFrame, by: str) -> DataFrame:
    """(by, geojson): the points (seq, lat, lon) of each line as a LineString. A line's points are bounded by its sampling."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    return points.groupBy(by).agg(line.alias("_c")).select(by, F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("_c").alias("coordinates"))).alias("geojson"))


def samples(df: DataFrame, value: str, id_: str, n: int) -> DataFrame:
    """The n highest and the n lowest rows by a value."""
    high = df.orderBy(F.col(value).desc_nulls_last(), id_).limit(n).withColumn("end", F.lit("high"))
    return high.unionByName(df.orderBy(F.col(value).asc_nulls_last(), id_).limit(n).withColumn("end", F.lit("low")))
