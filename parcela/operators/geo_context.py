"""What lies around a listing: distances to layers of points, numbers of points within radii, and scores of both.

All layers, nested road classes and radii are met in one grid over metres east and north. Listings of one place are
one location. A location posts itself once for every radius, points stand in the cell of that width and the eight
around. For the nearest point of each layer a location looks at the nine cells around it; the layers whose nearest
point may lie further off look again in cells four times as wide, all layers in the same pass, until none is left; a
layer's points are met by those alone that still look for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.geo import access, utm35
from parcela.operators.scores import family_home, precision
from parcela.operators.state import aggregate, attach, counted_medians, durable, learned

# Tags of each layer of points, classes and tags of the nested road layers.
SCHOOLS = ("school", "kindergarten", "college")
HEALTHCARE = ("hospital", "clinic", "doctors", "pharmacy")
SHOPS = ("supermarket", "convenience")
ROADS = {
    "highway": (("highway",), ("motorway", "motorway_link")),
    "primary": (("primary", "highway"), ("trunk", "primary", "motorway")),
    "major": (("major", "primary", "highway"), ("motorway", "trunk", "primary", "secondary", "tertiary")),
}
# The layers whose nearest point is wanted, by column, and the numbers of points within metres.
DISTANCES = {
    "distance_to_sea_m": "sea", "distance_to_major_road_m": "major", "distance_to_primary_road_m": "primary", "distance_to_highway_m": "highway",
    "distance_to_nearest_bus_stop_m": "bus_stop", "distance_to_nearest_school_m": "school", "distance_to_nearest_university_m": "university",
    "distance_to_nearest_hospital_m": "hospital", "distance_to_nearest_healthcare_m": "healthcare", "distance_to_nearest_market_m": "market",
    "distance_to_nearest_park_m": "park",
}
COUNTS = {
    "bus_stop_count_500m": ("bus_stop", 500), "transport_count_1000m": ("transport", 1000), "school_count_500m": ("school", 500), "school_count_1000m": ("school", 1000),
    "university_count_3000m": ("university", 3000), "pharmacy_count_1000m": ("pharmacy", 1000), "healthcare_count_2000m": ("healthcare", 2000),
    "market_count_500m": ("market", 500), "market_count_1000m": ("market", 1000), "park_count_1000m": ("park", 1000),
    "daily_poi_count_500m": ("daily", 500), "daily_poi_count_1000m": ("daily", 1000),
}
#: What stands for the median of a distance that no learned row has.
UNKNOWN_DISTANCE = 1500.0
#: Width in metres of the first cells that are searched.
FIRST_CELL = 500.0


def poi_layers(points: DataFrame) -> DataFrame:
    """(px, py, layers) of points with tags; a point is in each layer that one of its tags names."""
    tag = lambda name, *values: F.coalesce(F.col(name).isin(*values), F.lit(False))
    layers = {
        "school": tag("amenity", *SCHOOLS) | tag("subcategory", *SCHOOLS), "university": tag("amenity", "university") | tag("subcategory", "university"),
        "hospital": tag("amenity", "hospital") | tag("subcategory", "hospital"), "healthcare": tag("amenity", *HEALTHCARE), "pharmacy": tag("amenity", "pharmacy"),
        "market": tag("shop", *SHOPS) | tag("amenity", "marketplace"), "park": tag("leisure", "park"), "daily": tag("category", "daily") | tag("shop", *SHOPS) | tag("leisure", "park"),
        "bus_stop": tag("highway", "bus_stop") | tag("subcategory", "bus_stop"), "transport": tag("category", "transport"),
    }
    return placed(points, layers)


def road_layers(vertices: DataFrame) -> DataFrame:
    """(px, py, layers) of road vertices; the classes are nested, a motorway is in all three."""
    return placed(vertices, {name: F.coalesce(F.coalesce("road_class", F.lit("major")).isin(*classes), F.lit(False)) | F.coalesce(F.col("highway").isin(*tags), F.lit(False)) for name, (classes, tags) in ROADS.items()})


def placed(points: DataFrame, layers: Mapping[str, Column]) -> DataFrame:
    x, y = utm35(F.col("lat"), F.col("lon"))
    held = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in layers.items())))
    return points.where("lat is not null and lon is not null").select(x.alias("px"), y.alias("py"), held.alias("layers")).where(F.size("layers") > 0)


def cells_around(x: Column, y: Column, width: Column) -> Column:
    """The nine cells around a place."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return F.transform(steps, lambda s: F.struct((F.floor(x / width) + s.i).alias("cx"), (F.floor(y / width) + s.j).alias("cy")))


def distance(x: str, y: str) -> Column:
    return F.sqrt(F.pow(F.col(x) - F.col("px"), 2) + F.pow(F.col(y) - F.col("py"), 2))


def counted(places: DataFrame, points: DataFrame, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """(x, y, name, n): how many points of its layer each named count has within its radius; places without any have no row."""
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(layer).alias("layer"), F.lit(float(r)).alias("width")) for n, (layer, r) in wanted.items()))
    single = aggregate(points.select("px", "py", F.explode("layers").alias("layer")), ["px", "py", "layer"], m=F.count("*"))
    posts = single.withColumn("w", F.explode(F.filter(names, lambda w: w.layer == F.col("layer")))).select("px", "py", "m", "w.name", "w.width")
    posts = posts.withColumn("c", F.explode(cells_around(F.col("px"), F.col("py"), F.col("width")))).select("px", "py", "m", "name", "width", "c.*")
    radii = F.array(*(F.lit(float(r)) for r in sorted({r for _, r in wanted.values()})))
    asking = places.withColumn("width", F.explode(radii)).withColumns({"cx": F.floor(F.col("x") / F.col("width")), "cy": F.floor(F.col("y") / F.col("width"))})
    met = asking.join(posts, ["width", "cx", "cy"]).where(distance("x", "y") <= F.col("width"))
    return aggregate(met, ["x", "y", "name"], n=F.sum("m"))


def nearest_of_layers(places: DataFrame, points: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(x, y, layer, nearest) for every place and each of the layers that has a point at all."""
    points = durable(points.select("px", "py", F.explode(F.array_intersect("layers", F.array(*map(F.lit, layers)))).alias("layer")).distinct())
    there = [r[0] for r in points.select("layer").distinct().collect()]  # names of layers, a few
    if not there:
        return places.select("x", "y", F.lit(None).cast("string").alias("layer"), F.lit(None).cast("double").alias("nearest")).where("false")
    ends = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    own = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = 0.0 if own[0] is None else max(max(ends[1], own[1]) - min(ends[0], own[0]), max(ends[3], own[3]) - min(ends[2], own[2]))
    left, width, done = places.select("x", "y", F.explode(F.array(*map(F.lit, sorted(there)))).alias("layer")), FIRST_CELL, None
    while True:
        last = width > span  # the nine cells hold everything
        around = left.withColumn("c", F.explode(cells_around(F.col("x"), F.col("y"), F.lit(width)))).select("x", "y", "layer", "c.*")
        standing = points.withColumns({"cx": F.floor(F.col("px") / width), "cy": F.floor(F.col("py") / width)})
        found = aggregate(around.join(standing, ["layer", "cx", "cy"]), ["x", "y", "layer"], nearest=F.min(distance("x", "y")))
        found = durable(found if last else found.where(F.col("nearest") <= width))  # what lies beyond may be outside the nine cells
        done = found if done is None else done.unionAll(found)
        if last:
            return done
        left = durable(left.join(found, ["x", "y", "layer"], "left_anti"))
        if left.isEmpty():
            return done
        width *= 4


def surroundings(listings: DataFrame, pois: DataFrame, roads: DataFrame, coast: DataFrame) -> DataFrame:
    """listings with x, y, every distance and every count; distances of listings without a place, and to layers without a point, are null."""
    df = located(listings)
    out = attach(df, learned(context_of_places(df, pois, roads, coast)), ["x", "y"])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in COUNTS})


def located(listings: DataFrame) -> DataFrame:
    """listings with x and y, null where latitude or longitude is."""
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    x, y = utm35(F.col("lat"), F.col("lon"))
    return listings.withColumns({"x": F.when(known, x), "y": F.when(known, y)})


def context_of_places(df: DataFrame, pois: DataFrame, roads: DataFrame, coast: DataFrame) -> DataFrame:
    """(x, y), distances and counts of every place that df has; counts of none are null."""
    places = durable(df.where("x is not null").select("x", "y").distinct())
    points = poi_layers(pois).unionAll(road_layers(roads)).unionAll(placed(coast, {"sea": F.lit(True)}))
    near, count = nearest_of_layers(places, points, sorted(set(DISTANCES.values()))), counted(places, points, COUNTS)
    near = aggregate(near, ["x", "y"], **{c: F.min(F.when(F.col("layer") == layer, F.col("nearest"))) for c, layer in DISTANCES.items()})
    count = aggregate(count, ["x", "y"], **{c: F.max(F.when(F.col("name") == c, F.col("n"))) for c in COUNTS})
    return attach(attach(places, near, ["x", "y"]), count, ["x", "y"])


def geo_context(listings: DataFrame, pois: DataFrame, roads: DataFrame, coast: DataFrame, folds: int, county: str) -> DataFrame:
    """listings (with `fold`) and 48 features of what lies around them.

    Distances that a listing lacks are the medians of the other folds' listings; scores and products of what is
    unknown are 0. Products are taken for the named county alone."""
    rows = durable(located(listings))
    context = learned(context_of_places(rows, pois, roads, coast))
    df = attach(rows, context, ["x", "y"]).withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in COUNTS})
    # named with a mark, so that a later column never meets an earlier one of its name
    known = F.col("x").isNotNull()
    exact = precision(F.col("location_precision"))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sea, d = F.col("distance_to_sea_m"), F.col
    near = lambda name, scale: access(d(f"distance_to_{name}_m"), scale)
    bucket = F.when(~known, -1.0).when(sea <= 250, 0.0).when(sea <= 500, 1.0).when(sea <= 1000, 2.0).when(sea <= 3000, 3.0).otherwise(4.0)
    education = 0.7 * near("nearest_school", 800.0) + 0.3 * near("nearest_university", 3000.0)
    health = 0.6 * near("nearest_healthcare", 1500.0) + 0.4 * near("nearest_hospital", 3000.0)
    daily = 0.6 * near("nearest_market", 700.0) + 0.4 * near("nearest_park", 1000.0)
    df = df.withColumns({
        "geo_context_missing": flag(~known), "geo_context_has_exact_location": flag(known & (exact == "exact_map")), "geo_context_has_approx_location": flag(known & exact.isin("exact_map", "approx_map")),
        "log_distance_to_sea": F.log1p(sea), "coast_distance_bucket_code": bucket, **{f"is_coastal_{m}m": flag(sea <= m) for m in (250, 500, 1000, 2000)},
        "coastal_access_score": near("sea", 1200.0), "education_access_score": education, "health_access_score": health, "daily_life_access_score": daily,
    })
    walk = 0.35 * d("daily_life_access_score") + 0.25 * d("education_access_score") + 0.2 * near("nearest_bus_stop", 500.0) + 0.2 * F.least(F.lit(1.0), d("daily_poi_count_500m") / 10.0)
    df = df.withColumn("walkability_proxy_score", walk)
    parts = {"coastal_access_score": 0.25, "walkability_proxy_score": 0.2, "education_access_score": 0.15, "health_access_score": 0.15, "daily_life_access_score": 0.15}
    whole = sum((d(c) * w for c, w in parts.items()), 0.1 * zero(near("major_road", 1200.0)))
    number = lambda name: zero(d(name).cast("double"))
    rooms = F.coalesce(F.replace("room_count", F.lit(" "), F.lit("")), F.lit("missing"))
    large = flag((number("is_large_home") > 0.5) | rooms.isin("4+1", "5+1") | (number("gross_m2") >= 150))
    site = flag(F.lower(d("site_inside").cast("string")).isin("evet", "var", "1", "true", "yes"))
    here = lambda c: zero(F.when(d("county") == county, c))
    log_sea, coastal = d("log_distance_to_sea"), d("is_coastal_1000m")
    df = df.withColumns({
        "location_context_score": whole,
        "bsk_distance_to_sea_x_view_sea": here(log_sea * number("view_sea")), "bsk_distance_to_sea_x_near_sea_zero": here(log_sea * number("near_sea_zero")),
        "bsk_distance_to_sea_x_large_home": here(log_sea * large), "bsk_distance_to_sea_x_site_inside": here(log_sea * site),
        "bsk_distance_to_sea_x_quality": here(log_sea * number("location_quality_score")), "bsk_school_access_x_family_home": here(d("education_access_score") * flag(family_home(df))),
        "bsk_road_access_x_large_home": here(near("major_road", 1200.0) * large), "bsk_coastal_x_large_home": here(coastal * large),
        "bsk_coastal_x_geo_cluster": here(coastal / (1.0 + number("distance_to_geo_cluster_center_m") / 500.0)), "bsk_coastal_x_room_4p1": here(coastal * flag(rooms.isin("4+1", "5+1"))),
    })
    # listings of one place have the same distances: places are counted, not listings
    folded = ("all", *(f"f{i}" for i in range(folds)))
    counts = aggregate(rows.where("x is not null"), ["x", "y"], all=F.count("*"), **{f"f{i}": F.count_if(F.col("fold") == i) for i in range(folds)})
    long = attach(counts, context, ["x", "y"]).select(*folded, *DISTANCES).unpivot(list(folded), list(DISTANCES), "name", "value").where("value is not null")
    counts = aggregate(long, ["name", "value"], **{c: F.sum(c) for c in folded})
    medians = aggregate(counted_medians(counts, ["name"], "value", folds), ["fold"], **{f"_m_{c}": F.max(F.when(F.col("name") == c, F.col("median"))) for c in DISTANCES})
    df = attach(df, learned(medians), ["fold"])
    instead = {c: F.coalesce(F.col(f"_m_{c}"), F.lit(UNKNOWN_DISTANCE)) for c in DISTANCES}
    scores = [c for c in df.columns if c.endswith("_score") and c in {*parts, "location_context_score"}]
    return df.withColumns({
        "log_distance_to_sea": F.coalesce("log_distance_to_sea", F.log1p(instead["distance_to_sea_m"])),
        **{c: zero(d(c)) for c in scores}, **{c: F.coalesce(F.col(c), m) for c, m in instead.items()},
    }).drop("x", "y", *(f"_m_{c}" for c in DISTANCES))


FEATURES = (
    "geo_context_missing", "geo_context_has_exact_location", "geo_context_has_approx_location", "log_distance_to_sea", "is_coastal_250m", "is_coastal_500m", "is_coastal_1000m",
    "is_coastal_2000m", "coast_distance_bucket_code", *DISTANCES, *COUNTS, "walkability_proxy_score", "coastal_access_score", "education_access_score", "health_access_score",
    "daily_life_access_score", "location_context_score", "bsk_distance_to_sea_x_view_sea", "bsk_distance_to_sea_x_near_sea_zero", "bsk_distance_to_sea_x_large_home",
    "bsk_distance_to_sea_x_site_inside", "bsk_distance_to_sea_x_quality", "bsk_school_access_x_family_home", "bsk_road_access_x_large_home", "bsk_coastal_x_large_home",
    "bsk_coastal_x_geo_cluster", "bsk_coastal_x_room_4p1",
)
