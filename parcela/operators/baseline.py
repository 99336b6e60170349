"""What listings of a place usually cost: medians and means of nested and crossing groups, learned from other folds.

Numbers and sums are taken once, by the narrowest group and fold; every level is a sum of these. Each level's values are
ordered where its groups lie, those of all rows over range partitions, so that no value is copied for a level or a fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.functions.text import ratio
from parcela.operators.state import aggregate, attach, durable, fold_medians, group_fold_medians, learned

KEYS = ("county", "district", "m2_group", "room_count")
# The levels from narrow to wide with their codes and least rows, and the weights of the trend.
LEVELS = {
    7: (("county", "district", "m2_group", "room_count"), "specific"), 6: (("county", "district", "m2_group"), "medium"), 5: (("county", "district", "room_count"), "medium"),
    4: (("county", "district"), "specific"), 3: (("county", "m2_group", "room_count"), "medium"), 2: (("county", "m2_group"), "broad"), 1: (("county",), "broad"),
}
LEAST = {"specific": 8, "medium": 12, "broad": 20}
TREND_FEW, TREND_ENOUGH = 0.65, 0.25
# The groups of target statistics.
TARGETS = {
    "district_target": ("county", "district"), "county_target": ("county",), "district_m2_group_target": ("county", "district", "m2_group"),
    "district_room_count_target": ("county", "district", "room_count"), "county_room_count_target": ("county", "room_count"),
}


def named(df: DataFrame) -> DataFrame:
    """df with `_county` and so on: the keys, `missing` where they are null or empty."""
    clean = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("missing"))
    return df.withColumns({f"_{c}": clean(c) for c in KEYS})


def at_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Each row once for every level, with the keys that the level does not use empty."""
    each = F.array(*(F.struct(F.lit(name).alias("_level"), *(F.col(f"_{c}").alias(f"_{c}") if c in keys else F.lit("").alias(f"_{c}") for c in KEYS)) for name, keys in levels.items()))
    return df.withColumn("_at", F.explode(each)).select("_at.*", *keep)


def group_states(df: DataFrame, target: str, levels: Mapping[str, Sequence[str]], folds: int) -> DataFrame:
    """(_level, keys, fold, median, mean, n): statistics of the positive targets of all other folds; level '' is all rows."""
    by = ["_level", *(f"_{c}" for c in KEYS)]
    rows = named(df).where(F.col(target) > 0)
    own = [F.col("fold") == i for i in range(folds)]
    narrow = aggregate(rows, [f"_{c}" for c in KEYS], _s=F.sum(target), _n=F.count(target), **{f"_s{i}": F.sum(F.when(c, F.col(target)).otherwise(0.0)) for i, c in enumerate(own)}, **{f"_n{i}": F.count_if(c) for i, c in enumerate(own)})
    parts = ["_s", "_n", *(f"_{x}{i}" for x in "sn" for i in range(folds))]
    sums = aggregate(at_levels(narrow, {**levels, "": ()}, parts), by, **{c: F.sum(c) for c in parts})
    means = F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), ratio(F.col("_s") - F.col(f"_s{i}"), F.col("_n") - F.col(f"_n{i}")).alias("mean")) for i in range(folds)))).alias("x")
    medians = None
    for name, keys in {**levels, "": ()}.items():
        own_keys = [f"_{c}" for c in keys]
        broad = min((k for k in levels.values() if len(k) > 1 and set(k) <= set(keys)), key=len, default=keys)
        found = group_fold_medians(rows, own_keys, target, folds, [f"_{c}" for c in broad]) if keys else fold_medians(rows, [], target, folds)
        found = found.select(F.lit(name).alias("_level"), *(F.col(f"_{c}") if c in keys else F.lit("").alias(f"_{c}") for c in KEYS), "fold", "median", "n")
        medians = found if medians is None else medians.unionAll(found)
    return attach(medians, sums.select(*by, means).select(*by, "x.*"), [*by, "fold"])


def places(df: DataFrame) -> DataFrame:
    """The distinct combinations of keys and fold, far fewer than the rows."""
    return named(df).select(*(f"_{c}" for c in KEYS), "fold").distinct()


def market_baseline(df: DataFrame, target: str, folds: int, trend: str | None = None, least: Mapping[str, int] = LEAST, learn: DataFrame | None = None) -> DataFrame:
    """df (with `fold`) and five columns: the median of other folds at the narrowest level with enough rows, drawn to a
    trend price in logarithms (`location_baseline_m2`, 1 at least), its logarithm, the number of rows behind it (0 for the
    median of all), the level's code (7 to 1, 0 for all), and its ratio to the trend (1 without a trend).

    A trend weighs more where fewer rows than a medium level needs stand behind the median. The medians are learned
    from `learn`, or from df itself."""
    state = durable(group_states(df if learn is None else learn, target, {str(k): keys for k, (keys, _) in LEVELS.items()}, folds))  # some thousand rows
    return with_baseline(df, state, trend, least)


def with_baseline(df: DataFrame, state: DataFrame, trend: str | None = None, least: Mapping[str, int] = LEAST) -> DataFrame:
    """df (with `fold`) and its baseline from statistics of the levels that were learned before."""
    need = F.element_at(F.create_map(*(x for k, (_, size) in LEVELS.items() for x in (F.lit(str(k)), F.lit(least[size])))), F.col("_level"))
    by = [f"_{c}" for c in KEYS]
    asked = at_levels(places(df).select("*", F.struct(*by, "fold").alias("_of")), {str(k): keys for k, (keys, _) in LEVELS.items()}, ["fold", "_of"])
    found = asked.join(state.where((F.col("_level") != "") & (F.col("n") >= need)), ["_level", *by, "fold"])
    best = aggregate(found, ["_of"], _b=F.max_by(F.struct("median", "n", F.col("_level").cast("double").alias("code")), F.col("_level").cast("int")))
    whole = state.where("_level = ''").select("fold", F.col("median").alias("_all"))
    out = attach(attach(named(df), learned(best.select("_of.*", "_b")), [*by, "fold"]), F.broadcast(whole), ["fold"])
    base, count = F.coalesce("_b.median", "_all", F.lit(1.0)), F.coalesce(F.col("_b.n").cast("double"), F.lit(0.0))
    t = F.lit(None).cast("double") if trend is None else F.when(F.col(trend) > 0, F.col(trend))
    w = F.when(count < least["medium"], TREND_FEW).otherwise(TREND_ENOUGH)
    value = F.greatest(F.lit(1.0), F.when(t.isNotNull(), F.exp((1 - w) * F.ln(base) + w * F.ln(t))).otherwise(base))
    out = out.withColumns({"location_baseline_m2": value, "location_baseline_count": count, "location_baseline_level_code": F.coalesce("_b.code", F.lit(0.0))})
    out = out.withColumns({"location_baseline_log": F.ln("location_baseline_m2"), "location_baseline_vs_trend": F.coalesce(F.col("location_baseline_m2") / t, F.lit(1.0))})
    return out.drop("_b", "_all", *by)


def in_sample_baseline(df: DataFrame, target: str, trend: str | None = None, least: Mapping[str, int] = LEAST) -> DataFrame:
    """The same from all rows: they stand in a fold of their own, and what they get is learned by one that has no rows."""
    learn = df.drop("fold").withColumn("fold", F.lit(-1))
    out = market_baseline(df.withColumnRenamed("fold", "_fold").withColumn("fold", F.lit(0)), target, 1, trend, least, learn).drop("fold")
    return out.withColumnRenamed("_fold", "fold")


def target_groups(df: DataFrame, target: str, folds: int, smoothing: float = 20.0) -> DataFrame:
    """df (with `fold`), and for each of five groups the median of other folds and their mean, drawn to the mean of all by
    `smoothing` rows; the median and the mean of all where the group has none."""
    state = durable(group_states(df, target, TARGETS, folds))
    by = [f"_{c}" for c in KEYS]
    asked = at_levels(places(df).select("*", F.struct(*by, "fold").alias("_of")), TARGETS, ["fold", "_of"])
    whole = state.where("_level = ''").select("fold", F.col("median").alias("_am"), F.col("mean").alias("_aa"))
    found = attach(asked.join(state, ["_level", *by, "fold"], "left"), whole, ["fold"])
    smooth = F.coalesce((F.col("mean") * F.col("n") + F.col("_aa") * smoothing) / (F.col("n") + smoothing), F.col("_aa"))
    columns = {f"{name}_{what}": F.max(F.when(F.col("_level") == name, value)) for name in TARGETS for what, value in (("median", F.coalesce("median", "_am")), ("mean", smooth))}
    wide = aggregate(found, ["_of"], **columns).select("_of.*", *columns)
    return attach(named(df), wide, [*by, "fold"]).drop(*by)
