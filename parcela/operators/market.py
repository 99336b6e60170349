"""Market features: rent and sale statistics by key, joins with fallbacks, trends, demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import ratio
from parcela.operators.state import aggregate, attach


def spread_stats(df: DataFrame, value: str, keys: Sequence[str], prefix: str) -> DataFrame:
    """Median, mean, number, quartile spread and coefficient of variation of a value by key (0 for single values)."""
    x = F.col(value)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    n = F.count(x)
    return aggregate(df, keys, **{
        f"{prefix}_median": F.median(x), f"{prefix}_mean": F.avg(x), f"{prefix}_count": n,
        f"{prefix}_iqr": F.when(n < 2, F.lit(0.0)).otherwise(q[1] - q[0]),
        f"{prefix}_cv": F.when((n < 2) | (F.avg(x) == 0), F.lit(0.0)).otherwise(ratio(F.stddev_samp(x), F.avg(x))),
    })


def fallback(df: DataFrame, state_of: DataFrame, value: str, levels: Sequence[tuple[str, Sequence[str], int]], name: str, most: bool = False) -> DataFrame:
    """df with the median of `value` at the first level that has enough rows, the level's name, and the number of rows.

    Levels are (name, keys, least rows), narrow to wide; a level without keys is the whole table. With `most` the
    number is the largest of all levels that have keys."""
    marks: list[tuple[str, Column, Column]] = []
    for level, keys, least in levels:
        state = aggregate(state_of, keys, **{f"_m_{level}": F.median(value), f"_n_{level}": F.count(value)})
        df = attach(df, state, keys)
        marks.append((level, F.coalesce(F.col(f"_n_{level}") >= least, F.lit(False)), F.col(f"_m_{level}")))
    out = df.withColumns({
        name: F.coalesce(*(F.when(ok, m) for _, ok, m in marks)),
        f"{name}_level": F.coalesce(*(F.when(ok, F.lit(level)) for level, ok, _ in marks), F.lit("none")),
        f"{name}_count": F.greatest(*(F.coalesce(f"_n_{level}", F.lit(0)) for level, keys, _ in levels if keys)) if most else F.coalesce(*(F.when(ok, F.col(f"_n_{level}")) for level, ok, _ in marks), F.lit(0)),
    })
    return out.drop(*(f"_{x}_{level}" for level, _, _ in levels for x in "mn"))


def rent_features(sales: DataFrame, rentals: DataFrame) -> DataFrame:
    """Estimated rent a square metre from the narrowest level that has any, its level, the largest number of rentals at
    any level below the whole table, a confidence from it (full at 30), and years to earn the price back."""
    per_m2 = rentals.withColumn("rent_m2", ratio(F.col("monthly_rent"), F.col("gross_m2")))
    levels = [("district_room", ["county", "district", "room_count"], 1), ("district_m2_group", ["county", "district", "m2_group"], 1), ("district", ["county", "district"], 1), ("county", ["county"], 1), ("global", [], 1)]
    out = fallback(sales, per_m2, "rent_m2", levels, "rent", most=True)
    years = ratio(F.col("price"), 12 * F.col("rent") * F.col("gross_m2"))
    return out.withColumns({"rent_confidence": F.least(F.col("rent_count"), F.lit(30)) / 30.0, "amortization_years": years})


def trend_features(sales: DataFrame, trend: DataFrame) -> DataFrame:
    """The latest trend of the district, else the county's median of the latest trends; and which it was."""
    own = trend.select("county", "district", F.col("unit_price_for_sale").alias("_t"), F.col("unit_price_for_rent").alias("_r"))
    wide = aggregate(trend, ["county"], _ct=F.median("unit_price_for_sale"), _cr=F.median("unit_price_for_rent"))
    out = attach(attach(sales, own, ["county", "district"]), wide, ["county"])
    source = F.when(F.col("_t").isNotNull(), "district").when(F.col("_ct").isNotNull(), "county").otherwise("none")
    return out.withColumns({"trend_sale": F.coalesce("_t", "_ct"), "trend_rent": F.coalesce("_r", "_cr"), "trend_source": source}).drop("_t", "_r", "_ct", "_cr")


def demographic_features(sales: DataFrame, people: DataFrame) -> DataFrame:
    """District figures, the county's sums where the district has none, and the district's share of the county."""
    county = aggregate(people, ["county"], county_population=F.sum("population"), county_income=F.sum("income"), county_low=F.sum("households_low"))
    out = attach(attach(sales, people.drop("city"), ["county", "district"]), county, ["county"])
    return out.withColumns({
        "demo_matched": F.col("population").isNotNull().cast("int"),
        "demo_population": F.coalesce("population", "county_population"),
        "income_per_head": ratio(F.coalesce("income", "county_income"), F.coalesce("population", "county_population")),
        "low_share": ratio(F.coalesce("households_low", "county_low"), F.coalesce("population", "county_population")),
        "share_of_county": ratio(F.col("population"), F.col("county_population")),
    })


def union_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two sides' counts and medians by key."""
    left = aggregate(a, keys, n_sale=F.count("*"), median_sale=F.median(value))
    right = aggregate(b, keys, n_rental=F.count("*"), median_rental=F.median(value))
    out = left.join(right, list(keys), "full")
    return out.withColumns({"n_sale": F.coalesce("n_sale", F.lit(0)), "n_rental": F.coalesce("n_rental", F.lit(0))}).withColumn("rental_share", ratio(F.col("n_rental"), F.col("n_sale") + F.col("n_rental")))
