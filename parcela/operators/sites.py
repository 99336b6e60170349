"""Housing sites: their names in listings, a dictionary of known sites, variants of one site, measured tables by id."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.text import GENERIC_SUFFIXES, STOP_WORDS, fold, frequency_bucket
from parcela.operators.state import aggregate, attach

# Words that end a site's name, those that do so as brands, and texts that name no site.
ENDINGS = ("sitesi", "site", "sit", "rezidans", "residence", "projesi", "proje", "konutlari", "evleri", "life", "park", "kent", "vadi", "city")
BRANDS = ("life", "park", "kent", "vadi", "city", "perla", "korupark", "gunesi")
NO_SITE = ("belirtilmemis", "yok", "nan", "none", "missing", "var", "")
LEAST_ALIAS = 4


def whole(word: str) -> str:
    return rf"(?<!\w){re.escape(word)}(?!\w)"


def longest_first(aliases: Sequence[str]) -> list[str]:
    """Aliases of four letters or more, longest first; equal lengths keep their order."""
    return sorted((a for a in aliases if len(a) >= LEAST_ALIAS), key=len, reverse=True)


def site_names(df: DataFrame, site: str, title: str, address: str, aliases: Sequence[str]) -> DataFrame:
    """df with `site_raw` and `site_source`: the site column where it names one, else the longest alias within title and
    address, else words before a usual ending, else words that end in a brand; empty and `missing` where there is none.

    Aliases are folded names, a dictionary's worth; each is one condition of the expression."""
    own, heading, place = fold(F.col(site)), F.coalesce(fold(F.col(title)), F.lit("")), F.coalesce(fold(F.col(address)), F.lit(""))
    blob = F.trim(F.concat_ws(" | ", F.when(heading != "", heading), F.when(place != "", place)))
    word = r"[a-z0-9][a-z0-9'./-]{1,}"
    broad = rf"\b({word}(?:\s+{word}){{0,5}})\s+({'|'.join(ENDINGS)})\b"
    ending = rf"\b([a-z0-9]{{3,}}(?:\s+[a-z0-9]{{2,}}){{0,3}}\s+(?:{'|'.join(BRANDS)}))\b"
    head = F.regexp_extract(blob, broad, 1)
    telling = F.filter(F.split(head, r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    named = (F.size(telling) > 0) & ~((F.size(telling) == 1) & telling[0].isin(*GENERIC_SUFFIXES))
    alias = F.coalesce(*(F.when(blob.rlike(whole(a)), F.lit(a)) for a in longest_first(aliases)), F.lit(None).cast("string"))
    brand = F.regexp_extract(blob, ending, 1)

    def found(raw: Column, part: Column) -> Column:
        return F.struct(raw.alias("raw"), F.when(heading.contains(part), "title").otherwise("address").alias("source"))

    out = (
        F.when(own.isNotNull() & ~own.isin(*NO_SITE), F.struct(F.trim(F.col(site).cast("string")).alias("raw"), F.lit("site_name").alias("source")))
        .when(alias.isNotNull(), found(alias, alias)).when((head != "") & named, found(F.concat_ws(" ", head, F.regexp_extract(blob, broad, 2)), head))
        .when(brand != "", found(brand, brand)).otherwise(F.struct(F.lit("").alias("raw"), F.lit("missing").alias("source")))
    )
    return df.withColumn("_s", out).withColumns({"site_raw": F.col("_s.raw"), "site_source": F.col("_s.source")}).drop("_s")


def known_site(stem: Column, text: Column, known: Mapping[str, str]) -> Column:
    """The id of the longest alias that a stem begins with or a text holds; an alias without a phase number does not take
    a stem or a text in which a number follows it. An alias equal to the stem stands before all. Null where none fits."""
    stem, text = F.coalesce(stem, F.lit("")), F.coalesce(text, F.lit(""))
    exact = [F.when(stem == a, F.lit(i)) for a, i in known.items()]

    def fits(a: str) -> Column:
        rest = F.substring(stem, len(a) + 1, 1_000_000)
        begins = (stem == a) | stem.startswith(a + " ")
        numbered, alone = text.rlike(rf"(?<!\w){re.escape(a)}\s+\d+\b"), text.rlike(rf"(?<!\w){re.escape(a)}(?!\s+\d)")
        within = text.rlike(whole(a)) & ~(numbered & ~alone)
        return F.when(begins, ~rest.rlike(r"^(\s+(\d+|ii))+$")).otherwise(within)

    return F.coalesce(*exact, *(F.when(fits(a), F.lit(known[a])) for a in longest_first(list(known))), F.lit(None).cast("string"))


def with_frequency(df: DataFrame, site: str) -> DataFrame:
    """df with the number of its site's rows, 0 for `missing`, and that number's bucket."""
    out = attach(df, aggregate(df.where(F.col(site) != "missing"), [site], _n=F.count("*")), [site])
    return out.withColumn("site_frequency", F.coalesce("_n", F.lit(0))).withColumn("site_frequency_bucket", frequency_bucket(F.col("site_frequency"))).drop("_n")


def merge_audit(df: DataFrame, site: str, variant: str, value: str, gap: float) -> DataFrame:
    """Sites that several variants are merged into: variants, rows, and the widest gap between the variants' medians;
    a gap of `gap` or more is a possible bad merge, a severe one with eight rows or three variants."""
    each = aggregate(df.where(F.col(site) != "missing"), [site, variant], _n=F.count("*"), _m=F.median(value))
    out = aggregate(each, [site], n_variants=F.count("*"), total_count=F.sum("_n"), median_gap=F.max("_m") - F.min("_m")).where("n_variants > 1")
    warning = F.coalesce(F.col("median_gap") >= gap, F.lit(False))
    return out.withColumns({"warning": F.when(warning, "possible_bad_merge").otherwise(""), "severe": warning & ((F.col("total_count") >= 8) | (F.col("n_variants") >= 3))})


def attach_measured(df: DataFrame, measured: DataFrame, id_: str, indices: Sequence[str], order: str | None = None) -> DataFrame:
    """df with the indices of a measured table; of several rows of a trimmed id the last one by `order` counts, whole
    (without an order that of the largest values, so that the result does not hang on the layout). Values that df has stand before them.

    `has_measures` is 1 where any index is known, whatever the table says; else `missing_reason` is the table's, or
    `no_match_or_coords`."""
    key = F.trim(F.col(id_).cast("string"))
    right = measured.select(key.alias("_id"), *(F.col(c).cast("double").alias(f"_{c}") for c in indices), F.col("missing_reason").alias("_why"), *([F.col(order).alias("_at")] if order else []))
    whole = [*(f"_{c}" for c in indices), "_why"]
    right = aggregate(right, ["_id"], _row=F.max_by(F.struct(*whole), F.struct(*(["_at"] if order else []), *whole))).select("_id", "_row.*")
    out = df.withColumn("_id", key).join(right, "_id", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) if c in df.columns else F.col(f"_{c}") for c in indices})
    has = F.coalesce(*indices).isNotNull()
    return out.withColumns({"has_measures": has.cast("double"), "missing_reason": F.when(has, "").otherwise(F.coalesce("_why", F.lit("no_match_or_coords")))}).drop("_id", "_why", *(f"_{c}" for c in indices))


def top_by_group(df: DataFrame, by: str, name: str, value: str, most: int) -> DataFrame:
    """The `most` names of each group with the largest mean value; ties by name."""
    mean = aggregate(df, [by, name], mean_value=F.avg(value))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("mean_value", 9)), name))
    return mean.withColumn("place", place).where(F.col("place") <= most)


def feature_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value_a, value_b, is_equal) of rows with equal keys on two sides; null equals null, an absent row is all null."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(list(keys), list(columns), "feature", name)

    both = long(a, "value_a").join(long(b, "value_b"), [*keys, "feature"], "full")
    return both.withColumn("is_equal", F.col("value_a").eqNullSafe(F.col("value_b")))
