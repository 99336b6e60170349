"""Scores of a listing's attributes, size regimes, premium signals, and the mask of location columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import ratio, rooms, weighted

# Words of assent and denial, and how good a heating is, in the order in which names are looked for.
YES, NO = ("var", "evet", "true", "1", "yes", "mevcut", "bulunuyor"), ("yok", "hayir", "false", "0", "no", "degil")
UNKNOWN = ("", "missing", "nan", "none", "null", "belirtilmemis")


def simple(c: Column) -> Column:
    """Lower case, plain letters, single spaces; null is empty."""
    return F.coalesce(F.regexp_replace(F.translate(F.lower(F.trim(c.cast("string"))), "ığüşöç", "igusoc"), r"\s+", " "), F.lit(""))


def yes_no(c: Column) -> Column:
    """1 or 0 for words of assent or denial; null for others. Any car park is one unless it is denied."""
    text = simple(c)
    holds = lambda words: text.rlike("|".join(words))
    return (
        F.when(text.isin(*UNKNOWN, "-"), F.lit(None).cast("double"))
        .when(text.rlike("otopark|parking"), F.when(holds(NO), 0.0).otherwise(1.0))
        .when(text.rlike("^(" + "|".join(YES) + ")"), 1.0).when(text.isin(*NO), 0.0)
        .when(text.contains("var") & ~text.contains("yok"), 1.0).when(text.rlike("yok|hayir"), 0.0)
    )


def heating_score(c: Column, scores: Mapping[str, float]) -> Column:
    """The score of a heating by its name, else of the first listed name that it holds; a half where none is known."""
    text = simple(c)
    out = F.when(text.isin(*UNKNOWN), 0.5)
    for name, score in scores.items():
        out = out.when(text == name, float(score))
    for name, score in scores.items():
        out = out.when(text.contains(name), float(score))
    return out.otherwise(0.5)


def age_score(c: Column) -> Column:
    return F.when(c.isNull(), 0.5).when(c <= 4, 1.0).when(c <= 10, 0.8).when(c <= 20, 0.55).when(c <= 30, 0.3).otherwise(0.1)


def floor_score(floor: Column, top: Column) -> Column:
    """Middle floors best, the top floor less, the ground least; unknown floors a half."""
    share = ratio(floor, top)
    return F.when(floor.isNull(), 0.5).when(floor <= 0, 0.2).when(F.coalesce(floor >= top, F.lit(False)), 0.45).when(F.coalesce(share.between(0.25, 0.8), F.lit(False)), 1.0).otherwise(0.7)


def compactness(gross: Column, n_rooms: Column) -> Column:
    """Square metres a room as a score; unknown ones a half."""
    each = ratio(gross, n_rooms)
    return F.when(each.isNull(), 0.5).when(each < 22, 0.4).when(each <= 35, 1.0).when(each <= 50, 0.8).otherwise(0.55)


def total_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "mid").when(score <= 0.35, "low").when(score <= 0.65, "mid").otherwise("high")


def heating_bucket(score: Column) -> Column:
    return F.when(score.isNull() | (F.abs(score - 0.5) < 1e-9), "unknown").when(score >= 0.85, "premium").when(score >= 0.6, "good").when(score >= 0.4, "mid").otherwise("poor")


def age_bucket(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age <= 4, "new").when(age <= 10, "young").when(age <= 25, "mid").otherwise("old")


def family_home(df: DataFrame) -> Column:
    """Three to five rooms beside the living room, or 120 square metres."""
    return F.coalesce(F.replace("room_count", F.lit(" "), F.lit("")).isin("3+1", "4+1", "5+1"), F.lit(False)) | (F.coalesce("gross_m2", F.lit(0.0)) >= 120)


def precision(c: Column) -> Column:
    """Names of how exact a place is, in one spelling."""
    s = F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return (
        F.when(s.isin("exact_map", "exact", "map_exact"), "exact_map").when(s.isin("approx_map", "approx", "approximate", "map_approx"), "approx_map")
        .when(s.isin("district_only", "district", "neighborhood_only"), "district_only").when(s.isin("", "nan", "none", "null", "missing"), "missing").otherwise(s)
    )


def place_quality(exactness: Column, status: Column, known: Column) -> Column:
    """How far a listing's coordinates can be trusted, 0 to 1."""
    s = F.coalesce(F.lower(F.trim(status)), F.lit(""))
    exact = exactness == "exact_map"
    return F.when(s.isin("listing_removed", "removed") & known, 0.8).when(exact & s.isin("ok", "success", "done", ""), 1.0).when(exact, 0.95).when(exactness == "approx_map", 0.7).when(exactness == "district_only", 0.3).otherwise(0.0)


def road_class(highway: Column, ref: Column, name: Column) -> Column:
    """Motorways and trunk roads by their tags or by what they are called."""
    r, n = F.upper(F.coalesce(ref, F.lit(""))), F.upper(F.coalesce(name, F.lit("")))
    kind = F.coalesce(highway, F.lit(""))
    return (
        F.when(kind.isin("motorway", "motorway_link") | n.contains("TEM") | r.rlike("O-?4"), "highway")
        .when(kind.isin("trunk", "trunk_link", "primary", "primary_link") | r.rlike("D-?100") | n.rlike("E-?5"), "primary")
        .when(kind.isin("secondary", "secondary_link", "tertiary", "tertiary_link"), "major").otherwise("other")
    )


def attribute_scores(df: DataFrame) -> DataFrame:
    """Age, floor, compactness and equipment scores, their weighted total and its bucket."""
    room, living = rooms(F.col("room_count"))
    parts = {"score_age": age_score(F.col("building_age")), "score_floor": floor_score(F.col("floor_num"), F.col("total_floors")), "score_compact": compactness(F.col("gross_m2"), room + living), "score_equipment": (F.col("in_parking") + F.col("near_market") + F.col("view_sea")) / 3.0}
    out = df.withColumns(parts)
    total = weighted([(F.col("score_age"), 0.35), (F.col("score_floor"), 0.2), (F.col("score_compact"), 0.2), (F.col("score_equipment"), 0.25)])
    out = out.withColumn("score_total", total)
    return out.withColumn("score_bucket", total_bucket(F.col("score_total")))


def large_home(df: DataFrame, at: float = 150.0) -> DataFrame:
    """Size over a threshold, its logarithm, rooms by size, and what large homes share with age and view."""
    g, room = F.col("gross_m2"), rooms(F.col("room_count"))[0]
    is_large = F.coalesce((g >= at) | (room >= 5), F.lit(False)).cast("int")
    return df.withColumns({
        "is_large": is_large, "m2_over": F.greatest(F.lit(0.0), F.coalesce(g - at, F.lit(0.0))), "log_m2": F.ln(F.greatest(F.lit(1.0), g)), "room_density": ratio(100 * room, g),
        "large_new": is_large * F.coalesce((F.col("building_age") <= 5).cast("int"), F.lit(0)), "large_view": is_large * F.col("view_sea"),
    })


def premium_score(flags: Mapping[str, float], known: Column) -> Column:
    """0 to 10 from weighted flags and whether the site is known."""
    total = sum((F.col(f) * F.lit(w) for f, w in flags.items()), F.lit(0.0)) + F.when(known, 3.0).otherwise(0.0)
    return F.least(F.lit(10.0), total)


def premium_level(score: Column) -> Column:
    return F.when(score >= 7, "premium").when(score >= 4, "upper").when(score >= 2, "mid").otherwise("standard")


def scope_mask(df: DataFrame, enabled: Column, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Location columns outside the enabled scope: numbers 0, categories `location_not_used`."""
    on = F.coalesce(enabled, F.lit(False))
    return df.withColumns({**{c: F.when(on, F.col(c)).otherwise(F.lit(0.0)) for c in numeric}, **{c: F.when(on, F.col(c)).otherwise(F.lit("location_not_used")) for c in categorical}})


def poi_category(kind: Column) -> Column:
    """Amenity, shop or transport tags in five categories."""
    k = F.lower(kind)
    return F.when(k.rlike("school|university|kindergarten"), "education").when(k.rlike("hospital|clinic|pharmacy"), "health").when(k.rlike("market|bakery|supermarket"), "daily").when(k.rlike("bus|rail|station"), "transport").otherwise("other")


def sampled_vertices(df: DataFrame, id_: str, line: str, most: int) -> DataFrame:
    """Every n-th vertex of a line so that about `most` remain, and always its last: (id, vertex_i, vertex)."""
    long = df.select(id_, F.size(line).alias("_n"), F.posexplode(line).alias("vertex_i", "vertex"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(most)))
    return long.where((F.col("vertex_i") % step == 0) | (F.col("vertex_i") == F.col("_n") - 1)).drop("_n")
