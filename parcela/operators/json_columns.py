"""Columns found in a JSON object: those of named keys and of keys with given prefixes, typed and merged into what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of the keys that hold numbers, exact keys, and what else an export may hold.
PREFIXES = ("front_", "view_", "transport_", "near_", "out_", "in_", "subtype_")
EXACT = (
    "building_age_raw", "building_age_group", "detail_cephe", "detail_manzara", "detail_konut_tipi", "detail_ic_ozellikler", "detail_dis_ozellikler", "detail_muhit", "detail_ulasim",
    "detail_engelli_yasli_uygun", "detail_selected_count", "detail_quality_score",
)
NUMERIC = ("detail_selected_count", "detail_quality_score")
EXPORT_NUMERIC = (
    "price", "monthly_rent", "unit_price_gross", "unit_price_net", "rent_per_m2_gross", "rent_per_m2_net", "gross_m2", "net_m2", "building_age", "floor_num", "total_floors",
    "bathroom_count", "dues", "deposit", "detail_selected_count", "detail_quality_score",
)
EXPORT_TEXT = ("room_count", "district", "county", "city", "floor", "floor_segment", "title")


def parsed(c: Column) -> Column:
    """The keys and values of a JSON object as text; null for anything else."""
    text = F.when(F.ltrim(c).startswith("{"), c)
    return F.from_json(text, "map<string,string>")


def found_keys(df: DataFrame, column: str, exact: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """The wanted keys that any row holds, sorted. They become columns, so there are as many as a table may be wide."""
    wanted = F.col("key").isin(*exact)
    for p in prefixes:
        wanted = wanted | F.col("key").startswith(p)
    held = df.select(F.explode(F.map_keys(parsed(F.col(column)))).alias("key")).where(wanted).distinct()
    return sorted(r["key"] for r in held.collect())


def number(c: Column) -> Column:
    """A text or number as a number; true is 1, false 0; what is none, and no finite one's name, is null."""
    text = F.lower(F.trim(c.cast("string")))
    value = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def expand_json(df: DataFrame, column: str, exact: Sequence[str] = EXACT, prefixes: Sequence[str] = PREFIXES, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """df with a column for every wanted key of its JSON. Prefixed and `numeric` keys are numbers, others text.

    A value that df has stands before the JSON's: a number that can be read as one, or a text that is not blank. Bad JSON,
    and JSON that is no object, holds nothing. A column of the key's name in another case is that key's."""
    if column not in df.columns:
        return df
    values, have = F.col("_json"), {c.lower(): c for c in df.columns}
    new: dict[str, Column] = {}
    for key in found_keys(df, column, exact, prefixes):
        name = have.get(key.lower(), key)
        text = F.nullif(F.element_at(values, F.lit(key)), F.lit(""))
        if key.startswith(tuple(prefixes)) or key in numeric:
            new[name] = F.coalesce(number(F.col(f"`{name}`")), number(text)) if key.lower() in have else number(text)
        elif key.lower() in have:
            own = F.col(f"`{name}`").cast("string")
            new[name] = F.when(F.trim(F.coalesce(own, F.lit(""))) == "", F.coalesce(text, own)).otherwise(own)
        else:
            new[name] = text
        have.setdefault(key.lower(), name)
    return df.withColumn("_json", parsed(F.col(column))).withColumns(new).drop("_json")


def expand_export(df: DataFrame, column: str) -> DataFrame:
    """The same with the keys of an export, whose prices, sizes and counts are numbers too."""
    return expand_json(df, column, (*EXACT, *EXPORT_NUMERIC, *EXPORT_TEXT), PREFIXES, EXPORT_NUMERIC)
