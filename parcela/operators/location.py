"""Where a listing lies: centres of places with wider places as parents, directions, anchors, and clusters of many groups at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.geo import bearing, haversine
from parcela.operators.scores import precision
from parcela.operators.state import aggregate, attach, durable

#: Rows with coordinates that a centre of its own needs.
LEAST_CENTRE = 3
#: Metres within which a listing lies at a centre, in no direction from it.
SAME_PLACE = 0.01
PRECISIONS = {"any": None, "approx": ("exact_map", "approx_map"), "exact": ("exact_map",)}


def gated(df: DataFrame, least_precision: str = "any") -> Column:
    """Whether a listing's coordinates count: known, and as exact as asked for."""
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    asked = PRECISIONS[least_precision]
    return known if asked is None else known & precision(F.col("location_precision")).isin(*asked)


def centres(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """(by, name_lat, name_lon): mean coordinates of groups with enough rows."""
    out = aggregate(df.where("lat is not null and lon is not null"), by, **{f"{name}_lat": F.avg("lat"), f"{name}_lon": F.avg("lon"), "_n": F.count("*")})
    return out.where(F.col("_n") >= LEAST_CENTRE).drop("_n")


def location_features(df: DataFrame, learn: DataFrame, anchors: Mapping[str, tuple[float, float]], least_precision: str = "any") -> DataFrame:
    """df with coordinates relative to the centres of all, of its county and of its district, distances and directions to them,
    and distances to named anchors. Centres are learned from `learn`; a district with too few rows takes its county's, a county that
    of all. Listings whose coordinates do not count get 0 for differences and directions, and null distances."""
    known = durable(learn.where(gated(learn, least_precision)).select("county", "district", "lat", "lon"))
    out = attach(df, aggregate(known, [], city_lat=F.avg("lat"), city_lon=F.avg("lon")), [])
    out = attach(attach(out, centres(known, ["county"], "county"), ["county"]), centres(known, ["county", "district"], "district"), ["county", "district"])
    for side in ("lat", "lon"):
        out = out.withColumn(f"county_{side}", F.coalesce(f"county_{side}", f"city_{side}")).withColumn(f"district_{side}", F.coalesce(f"district_{side}", f"county_{side}"))
    has = gated(out, least_precision)
    columns: dict[str, Column] = {"has_lat_lon": has.cast("double")}
    for place in ("city", "county", "district"):
        sin, cos = bearing(F.col(f"{place}_lat"), F.col(f"{place}_lon"), F.col("lat"), F.col("lon"))
        far = haversine(F.col("lat"), F.col("lon"), F.col(f"{place}_lat"), F.col(f"{place}_lon"))
        apart = has & (far > SAME_PLACE)
        columns |= {
            f"lat_centered_{place}": F.when(has, F.col("lat") - F.col(f"{place}_lat")).otherwise(0.0), f"lon_centered_{place}": F.when(has, F.col("lon") - F.col(f"{place}_lon")).otherwise(0.0),
            f"distance_to_{place}_center_m": F.when(has, far),
            f"bearing_{place}_sin": F.when(apart, sin).otherwise(0.0), f"bearing_{place}_cos": F.when(apart, cos).otherwise(0.0),
        }
    each = {f"distance_to_{name}_m": F.when(has, haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b))) for name, (a, b) in anchors.items()}
    nearest = F.least(*each.values()) if len(each) > 1 else next(iter(each.values()), F.lit(None).cast("double"))
    return out.withColumns({**columns, **each, "distance_to_nearest_anchor_m": nearest}).drop(*(f"{p}_{s}" for p in ("city", "county", "district") for s in ("lat", "lon")))


def squared(x: str, y: str, c: Column) -> Column:
    return F.pow(F.col(x) - c["x"], 2) + F.pow(F.col(y) - c["y"], 2)


def group_clusters(df: DataFrame, by: Sequence[str], x: str, y: str, k: int, rounds: int = 10) -> DataFrame:
    """df's rows with coordinates, their cluster (from 0) and its centre, by k-means within every group at once.

    Rows of one place are one point that weighs as many. Starts are the k places of lowest hash, so they do not hang on the layout;
    each round is one sum by group and centre. A centre that loses all points stays where it is; of equally near ones the
    first counts. Groups with fewer places than k have as many clusters as places."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = durable(aggregate(known, [*by, x, y], _n=F.count("*")))
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(x, y), x, y))
    first = points.withColumn("_i", order).where(F.col("_i") <= k)  # a top-k, cut short before the shuffle
    centre = durable(first.select(*by, (F.col("_i") - 1).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")))

    def nearest(rows: DataFrame) -> DataFrame:
        held = aggregate(centre, by, _c=F.sort_array(F.collect_list(F.struct("i", "x", "y"))))  # k a group
        near = F.array_min(F.transform("_c", lambda c: F.struct(squared(x, y, c).alias("d"), c["i"].alias("i"), c["x"].alias("x"), c["y"].alias("y"))))
        return attach(rows, held, by).withColumn("_near", near).drop("_c")

    for _ in range(rounds):
        met = nearest(points).select(*by, F.col("_near.i").alias("i"), "_n", x, y)
        moved = aggregate(met, [*by, "i"], _w=F.sum("_n"), _x=F.sum(F.col("_n") * F.col(x)), _y=F.sum(F.col("_n") * F.col(y)))
        new = attach(centre, moved, [*by, "i"])
        centre = durable(new.select(*by, "i", F.coalesce(F.col("_x") / F.col("_w"), F.col("x")).alias("x"), F.coalesce(F.col("_y") / F.col("_w"), F.col("y")).alias("y")))
    out = nearest(known)
    return out.withColumns({"cluster": F.col("_near.i"), "cluster_x": F.col("_near.x"), "cluster_y": F.col("_near.y"), "distance_to_cluster": F.sqrt("_near.d")}).drop("_near")
