"""Features of a listing from its own columns: floors, rooms, ages, sizes, details, attribute quality, segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import count_values, ratio, rooms, rooms_total, size_group, weighted
from parcela.operators import scores as Z
from parcela.operators.clean import holds
from parcela.operators.state import aggregate, attach


def flag(c: Column) -> Column:
    """1 where a condition holds, 0 where it does not or is unknown."""
    return holds(c).cast("int")


def known_flag(c: Column) -> Column:
    """1.0 or 0.0; null where the condition is unknown."""
    return c.cast("double")


def engineered(df: DataFrame, details: Mapping[str, str] = {}, groups: Mapping[str, Sequence[str]] = {}) -> DataFrame:  # noqa: B006
    """df with what is derived from its floors, rooms, ages, sizes and details.

    `details` names the count for each marked list, `groups` the columns of 0 and 1 that each score adds up."""
    floor, top, age, gross = (F.col(c) for c in ("floor_num", "total_floors", "building_age", "gross_m2"))
    room, living = rooms(F.col("room_count"))
    counts = {name: count_values(F.col(c)) for c, name in details.items()}
    sums = {name: sum((F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce(F.col(c), F.lit(0)))) for c in members), F.lit(0)) for name, members in groups.items()}
    return df.withColumns({
        "m2_group": F.coalesce(size_group(gross), F.lit("missing")), "net_gross_ratio": F.greatest(F.lit(0.2), F.least(F.lit(1.2), ratio(F.col("net_m2"), gross))),
        "floor_ratio": ratio(floor, top), "remaining_floors": top - floor, "is_ground_floor": flag(floor == 0), "is_basement": flag(floor < 0),
        "is_top_floor": flag(floor >= top), "is_middle_floor": flag((floor > 0) & (floor < top)), "rooms": room, "living_rooms": living, "total_room_score": room + living,
        "is_new_building": flag(age <= 3), "is_old_building": flag(age >= 20), "is_small_flat": flag(gross <= 75), "is_large_flat": flag(gross >= 180),
        **counts, **sums, "detail_selected_count": sum(counts.values(), F.lit(0)),
    })


def attribute_features(df: DataFrame, heating: Mapping[str, float], amenities: Mapping[str, tuple[str, float]]) -> DataFrame:
    """df with the quality of its attributes as attr_ columns: age, floor, size, amenities, heating and all together.

    `amenities` gives for each attr_ column the text column of yes and no and its weight."""
    floor, top, age, gross = (F.col(c) for c in ("floor_num", "total_floors", "building_age", "gross_m2"))
    share, net = ratio(floor, top), F.greatest(F.lit(0.2), F.least(F.lit(1.2), ratio(F.col("net_m2"), gross)))
    each = ratio(gross, rooms_total(F.col("room_count")))
    heat = Z.heating_score(F.col("heating"), heating)
    out = df.withColumns({
        "attr_is_new_building": known_flag(age <= 4), "attr_is_young_building": known_flag((age >= 5) & (age <= 10)), "attr_is_mid_age_building": known_flag((age >= 11) & (age <= 25)), "attr_is_old_building": known_flag(age >= 26),
        "attr_building_age_score": Z.age_score(age), "attr_building_age_inverse": 1.0 / (1.0 + F.greatest(age, F.lit(0.0))),
        "attr_floor_ratio": share, "attr_is_ground_or_below": known_flag(floor <= 0), "attr_is_top_floor": flag(floor == top).cast("double"), "attr_is_middle_floor": known_flag(share.between(0.25, 0.8)), "attr_floor_quality_score": Z.floor_score(floor, top),
        "attr_net_gross_ratio": F.when(F.col("net_m2").isNotNull() & gross.isNotNull(), net), "attr_net_gross_good": known_flag(net >= 0.8), "attr_net_gross_bad": known_flag(net < 0.7),
        "attr_m2_per_room": each, "attr_compactness_score": Z.compactness(gross, rooms_total(F.col("room_count"))),
        **{name: Z.yes_no(F.col(c)) for name, (c, _) in amenities.items()},
        "attr_heating_quality_score": heat, "attr_has_natural_gas_heating": flag(Z.simple(F.col("heating")).rlike("dogalgaz|kombi|merkezi|yerden")).cast("double"),
        "attr_has_premium_heating": flag(heat >= 0.85).cast("double"), "attr_has_poor_heating": flag(heat <= 0.3).cast("double"), "attr_building_age_bucket": Z.age_bucket(age), "attr_heating_quality_bucket": Z.heating_bucket(heat),
    })
    out = out.withColumn("attr_amenity_score", weighted([(F.col(name), w) for name, (_, w) in amenities.items()]))
    parts = {"attr_building_age_score": 0.3, "attr_floor_quality_score": 0.2, "attr_amenity_score": 0.2, "attr_heating_quality_score": 0.15, "attr_compactness_score": 0.15}
    out = out.withColumn("attr_total_quality_score", weighted([(F.col(c), w) for c, w in parts.items()]))
    q = F.col("attr_total_quality_score")
    return out.withColumns({"attr_large_home_x_quality": known_flag(gross >= 150) * q, "attr_compact_home_x_quality": known_flag(gross <= 85) * q, "attr_total_quality_bucket": Z.total_bucket(q)})


def segments(df: DataFrame) -> dict[str, Column]:
    """The market segments of a listing; what is in none of the others is mainstream."""
    gross, room = F.col("gross_m2"), rooms(F.col("room_count"))[0]
    large, compact, old = holds((gross >= 151) | (room >= 4)), holds((gross <= 85) | (room <= 1)), holds(F.col("building_age") >= 26)
    return {"large_home": large, "compact": compact, "old_building": old, "mainstream": ~large & ~compact & ~old}


def bucket_effects(df: DataFrame, residual: str, buckets: Sequence[str], alpha: float = 30.0) -> DataFrame:
    """(county, feature, bucket, n, effect): the median residual of each county's bucket, drawn to that of all rows by alpha rows."""
    long = df.select("county", F.col(residual).alias("_y"), *(F.col(c).cast("string").alias(c) for c in buckets)).unpivot(["county", "_y"], list(buckets), "feature", "bucket")
    state = aggregate(long, ["county", "feature", "bucket"], n=F.count("_y"), _m=F.median("_y"))
    out = attach(state, aggregate(df, [], _g=F.median(residual)), [])
    w = F.col("n") / (F.col("n") + F.lit(alpha))
    return out.select("county", "feature", "bucket", "n", (w * F.col("_m") + (1 - w) * F.col("_g")).alias("effect"))


def smoothed_median(df: DataFrame, keys: Sequence[str], target: str, smoothing: float, name: str) -> DataFrame:
    """df with the median target of its key, drawn to that of all rows by `smoothing` rows."""
    out = attach(attach(df, aggregate(df, keys, _m=F.median(target), _n=F.count(target)), keys), aggregate(df, [], _g=F.median(target)), [])
    return out.withColumn(name, (F.col("_m") * F.col("_n") + F.col("_g") * smoothing) / (F.col("_n") + F.lit(smoothing))).drop("_m", "_n", "_g")


def without_rare_flags(df: DataFrame, flags: Sequence[str], least: int = 20) -> DataFrame:
    """df with columns of 0 and 1 that hold fewer than `least` ones set to 0; the columns stay."""
    ones = df.agg(*(F.sum(c).alias(f"_n_{c}") for c in flags))
    return df.join(F.broadcast(ones)).withColumns({c: F.when(F.col(f"_n_{c}") >= least, F.col(c)).otherwise(F.lit(0)) for c in flags}).drop(*(f"_n_{c}" for c in flags))  # one row
