"""Cleaning: range, quartile and deviation filters, outlier flags with reasons, anomaly scores, data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.text import fold, ratio, reasons, rooms_number
from parcela.operators.state import aggregate, attach, learned

MAD_FACTOR = 0.6745


def holds(c: Column) -> Column:
    """A condition in which null counts as false."""
    return F.coalesce(c, F.lit(False))


def in_ranges(ranges: Mapping[str, tuple[float, float, bool]]) -> Column:
    """Whether every column lies in its range, ends included; a null passes only where the range says so."""
    out = F.lit(True)
    for name, (low, high, null_passes) in ranges.items():
        out &= F.coalesce(F.col(name).between(low, high), F.lit(null_passes))
    return out


def split(df: DataFrame, keep: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """The rows to keep, and the others with a reason."""
    return df.where(holds(keep)), df.where(~holds(keep)).withColumn("reason", F.lit(reason))


def with_bounds(df: DataFrame, value: str, by: Sequence[str], factor: float, least_rows: int, name: str, active: Column | None = None) -> DataFrame:
    """df with whether a value lies outside its group's quartiles by `factor` spreads; groups too small or without spread judge nothing.

    Quartiles are those of the active rows, and only these are judged. They are aggregated and joined back,
    so that a group of any size is pre-aggregated where its rows lie."""
    known = df if active is None else df.where(active)
    state = aggregate(known, by, _q=F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.75))), _n=F.count(value))
    spread = F.col("_q")[1] - F.col("_q")[0]
    outside = (F.col("_n") >= least_rows) & (spread > 0) & ((F.col(value) < F.col("_q")[0] - factor * spread) | (F.col(value) > F.col("_q")[1] + factor * spread))
    if active is not None:
        outside &= active
    return attach(df, state, by).withColumn(name, holds(outside)).drop("_q", "_n")


def group_iqr(df: DataFrame, value: str, by: Sequence[str], least_rows: int = 18, factor: float = 2.75, global_factor: float = 4.0) -> DataFrame:
    """df with `group_outlier` (outside its group's bounds, in groups large enough) and `global_outlier`, judged on the rows left."""
    out = with_bounds(df, value, by, factor, least_rows, "group_outlier")
    return with_bounds(out, value, [], global_factor, 1, "global_outlier", ~F.col("group_outlier"))


def mad_z(df: DataFrame, value: Column, by: Sequence[str], name: str, least_rows: int = 1) -> DataFrame:
    """df with the robust z of a value within its group: the distance from the median over the median distance."""
    out = df.withColumn("_x", value)
    out = attach(out, learned(aggregate(out, by, _m=F.median("_x"), _n=F.count("_x"))), by).withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
    out = attach(out, learned(aggregate(out, by, _mad=F.median("_d"))), by)
    z = F.when((F.col("_n") >= least_rows) & (F.col("_mad") > 1e-9), MAD_FACTOR * (F.col("_x") - F.col("_m")) / F.col("_mad"))
    return out.withColumn(name, z).drop("_x", "_m", "_d", "_mad", "_n")


def location_outliers(df: DataFrame, value: str, baseline: str, by: Sequence[str], low: float = 0.5, high: float = 1.9, most_z: float = 3.5, least_rows: int = 12) -> DataFrame:
    """df with `location_outlier`: a ratio to the baseline out of bounds, or far from its group's in logarithms."""
    share = ratio(F.col(value), F.col(baseline))
    out = mad_z(df.withColumn("baseline_ratio", share), F.when(share > 0, F.ln(share)), by, "ratio_z", least_rows)
    return out.withColumn("location_outlier", ~holds(F.col("baseline_ratio").between(low, high)) | holds(F.abs("ratio_z") > most_z))


def hierarchical_flags(df: DataFrame, value: str, levels: Sequence[tuple[str, Sequence[str]]], least_rows: int = 8, factor: float = 1.5) -> DataFrame:
    """df with the name of the first level, narrow to wide, within whose groups the value is an outlier (null: none)."""
    for name, by in levels:
        df = with_bounds(df, value, by, factor, least_rows, f"_{name}")
    level = F.coalesce(*(F.when(F.col(f"_{n}"), F.lit(n)) for n, _ in levels))
    return df.withColumn("outlier_level", level).drop(*(f"_{n}" for n, _ in levels))


def outlier_flags(df: DataFrame) -> DataFrame:
    """df with `remove_reasons`, `review_reasons`, `is_removed` and `needs_review` for sale listings."""
    out = hierarchical_flags(df, "unit_price", [("district_room", ["county", "district", "room_count"]), ("district", ["county", "district"])])
    out = mad_z(out, F.col("unit_price"), [], "_z")
    remove = {
        "unit_price_limit": ~F.col("unit_price").between(100, 5000), "gross_limit": ~F.col("gross_m2").between(25, 500),
        "net_over_gross": F.col("net_m2") > F.col("gross_m2"), "net_gross_low": ratio(F.col("net_m2"), F.col("gross_m2")) < 0.73,
        "mad": F.abs("_z") > 3.5, "group_iqr": F.col("outlier_level").isNotNull(),
    }
    review = {"large": F.col("gross_m2") >= 200, "old": F.col("building_age") >= 40, "special_title": fold(F.col("title")).rlike("burnished|plated")}
    out = out.withColumns({"remove_reasons": reasons(remove), "review_reasons": reasons(review)}).drop("_z")
    return out.withColumns({"is_removed": F.col("remove_reasons") != "", "needs_review": (F.col("remove_reasons") == "") & (F.col("review_reasons") != "")})


def staged_reasons(df: DataFrame, value: str, stages: Sequence[tuple[str, Sequence[str], int, float]]) -> DataFrame:
    """df with `reason`: validity first, then each stage (name, group, least rows, factor) over rows still without one."""
    first = reasons({"invalid_gross": ~F.col("gross_m2").between(25, 500), "invalid_unit_price": ~F.col(value).between(100, 5000)}, "; ")
    df = df.withColumn("reason", first)
    for name, by, least, factor in stages:
        df = with_bounds(df, value, by, factor, least, "_bad", F.col("reason") == "")
        df = df.withColumn("reason", F.when(F.col("_bad"), F.lit(name)).otherwise(F.col("reason"))).drop("_bad")
    return df


def anomaly_rules(baseline: str, count: str | None = None, rent: str | None = None, details: str | None = None) -> dict[str, tuple[Column, float]]:
    """What makes a sale listing suspicious, and how much each counts. Columns that are not given have no rule.

    `_z` is the group's robust z of the log ratio to the baseline."""
    price, gross, net = F.col("unit_price"), F.col("gross_m2"), F.col("net_m2")
    share, room = ratio(price, F.col(baseline)), rooms_number(F.col("room_count"))
    rules = {
        "anom_baseline_ratio_very_low": (share < 0.6, 18.0), "anom_baseline_ratio_low": ((share >= 0.6) & (share < 0.72), 8.0),
        "anom_baseline_ratio_high": ((share > 1.55) & (share <= 1.9), 8.0), "anom_baseline_ratio_very_high": (share > 1.9, 18.0),
        **({"anom_low_baseline_support": (F.col(count) < 5, 8.0)} if count else {}),
        "anom_net_gross_too_low": (ratio(net, gross) < 0.5, 12.0), "anom_net_gross_too_high": (ratio(net, gross) > 1.03, 18.0),
        "anom_price_unit_mismatch": (ratio(F.abs(ratio(F.col("price"), gross) - price), price) > 0.03, 25.0),
        "anom_large_room_tiny_m2": ((room >= 4) & (gross < 95), 12.0), "anom_small_room_huge_m2": ((room <= 1) & (gross > 135), 10.0),
        "anom_very_large_property": (gross > 230, 7.0), "anom_very_small_property": (gross < 45, 7.0),
        "anom_floor_above_total": ((F.col("total_floors") > 0) & (F.col("floor_num") > F.col("total_floors")), 20.0),
        "anom_total_floors_extreme": (F.col("total_floors") > 45, 8.0), "anom_building_age_extreme": (F.col("building_age") > 80, 8.0),
    }
    if rent:
        years = ratio(price, F.col(rent)) / 12
        rules |= {"anom_amortization_too_low": (years < 8, 10.0), "anom_amortization_too_high": (years > 45, 10.0)}
    if details:
        rules["anom_low_detail"] = (F.col(details) <= 3, 5.0)
    return rules | {"anom_group_mad_extreme": (F.abs("_z") > 3.5, 15.0)}


def anomaly_scores(df: DataFrame, baseline: str, count: str | None = None, rent: str | None = None, details: str | None = None) -> DataFrame:
    """df with `anomaly_score` (0 to 100), `anomaly_reasons` and `anomaly_level`."""
    share = ratio(F.col("unit_price"), F.col(baseline))
    df = mad_z(df, F.when(share > 0, F.ln(share)), ["county", "room_count", "m2_group"], "_z", 12)
    rules = anomaly_rules(baseline, count, rent, details)
    total = sum((F.when(holds(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in rules.values()), F.lit(0.0))
    df = df.withColumns({"anomaly_score": F.least(F.lit(100.0), total), "anomaly_reasons": reasons({n: c for n, (c, _) in rules.items()})}).drop("_z")
    s = F.col("anomaly_score")
    return df.withColumn("anomaly_level", F.when(s <= 9.9, "normal").when(s <= 24.9, "review").when(s <= 44.9, "high_risk").otherwise("exclude_candidate"))


def suspicious(df: DataFrame, conditions: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """One row for each condition that a listing meets."""
    return df.select(*columns, F.explode(F.array_compact(F.array(*(F.when(holds(c), F.lit(n)) for n, c in conditions.items())))).alias("reason"))


def duplicates(df: DataFrame, keys: Sequence[str], id_: str, examples: int = 3) -> DataFrame:
    """Keys of several rows, with their number and their smallest ids. Only each key's smallest ids are gathered."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    many = attach(df.select(*keys, id_), counted, keys).where("n > 1")
    ranked = many.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(id_))).where(F.col("_r") <= examples)  # a top-k, cut short before the shuffle
    return ranked.groupBy(*keys, "n").agg(F.array_join(F.sort_array(F.collect_list(id_)).cast("array<string>"), ",").alias("examples"))


def missingness(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(by, column, n, n_missing, share) for each column and value of `by`, and for all rows (`both`)."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    every = counted.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).withColumn(by, F.lit("both"))
    long = counted.unionByName(every).unpivot([by, "n"], list(columns), "column", "n_missing")
    return long.withColumn("share", ratio(F.col("n_missing"), F.col("n")))


def cardinality(df: DataFrame, columns: Sequence[str], rare_share: float = 0.005, rare_rows: int = 2) -> DataFrame:
    """For each column: values, the most frequent one, its share, and values that are rare."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value").where("value is not null")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    total = Window.partitionBy("column")
    counted = counted.withColumn("_all", F.sum("n").over(total))
    rare = F.col("n") <= F.greatest(F.lit(rare_rows), rare_share * F.col("_all"))
    first = F.max_by("value", F.struct(F.col("n"), F.col("value")))
    return counted.groupBy("column").agg(F.count("*").alias("n_values"), first.alias("top_value"), ratio(F.max("n"), F.max("_all")).alias("top_share"), F.count_if(rare).alias("n_rare"))
