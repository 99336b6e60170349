"""A dictionary of sites as a table of aliases, met by hash of word runs; and names found in texts.

Each distinct pair of stem and text is looked up once. Its runs of words are joined to the aliases, so a dictionary may
have any number of them; the phase rule is checked on the few pairs that met. Names that no alias covers stand for
themselves, and go to review where they are rare or near a dictionary name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.functions.text import fold, frequency_bucket, stem_id
from parcela.operators.sites import LEAST_ALIAS
from parcela.operators.state import aggregate, attach, durable

# Codes of the tiers; rows of a name below which it is reviewed.
TIERS = {"unknown": 0, "mass": 1, "mid": 2, "premium": 3}
LEAST_SEEN = 3
# Words that name no site, and the three families of patterns with their confidences.
NAMELESS = (
    "basiskele", "kocaeli", "izmit", "satilik", "kiralik", "daire", "konut", "arsa", "fiyat", "firsat", "acil", "guzel", "luks", "yeni", "merkez", "mahalle", "mah", "sk", "sokak",
    "cadde", "bulvar", "kat", "arakat", "belirtilmemis", "yok", "var", "nan", "none",
)
NO_NAME = ("", "belirtilmemis", "yok", "nan", "none")
NAME_WORD = r"[A-ZÇĞİÖŞÜ0-9][A-Za-zÇĞİÖŞÜçğıöşü0-9'’.\-]{1,}"
SITE_WORD = r"S[İI]TES[İI]|S[İI]TE|S[İI]T|REZ[İI]DANS|RESIDENCE|PROJES[İI]|PROJE"
FAMILIES = (
    ("name_plus_site_token", 0.85, rf"(?iu)({NAME_WORD}(?:\s+{NAME_WORD}){{0,4}})\s+({SITE_WORD})\b"),
    ("sitesinde", 0.8, rf"(?iu)({NAME_WORD}(?:\s+{NAME_WORD}){{0,3}})\s+S[İI]TES[İI](?:['’]?N[DEDA]{{2}})?\b"),
    ("quoted", 0.55, r"[\"“”']([^\"“”']{3,40})[\"“”']"),
)
STRUCTURED = ("structured_site_name", 0.95)
#: Letters by which contained names are met.
GRAM = 4


def runs(text: Column, most: Column) -> Column:
    """All runs of up to `most` words of a text, as they stand in it."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"\w+|\W+"), F.lit(0)), lambda p: p != "")
    starts = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"^\w"), i)), lambda i: i.isNotNull())
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(parts, i + 1, 2 * k - 1), "")))))


def dictionary_match(df: DataFrame, stem: str, text: str, aliases: DataFrame) -> DataFrame:
    """df with `canonical_id` and `tier` of the dictionary (alias, canonical_id, tier, place), null where nothing fits.

    An alias that is the stem stands before all. Else the longest alias counts, the first by place of equal ones, that the
    stem begins with, or that stands whole in the text: not if only numbers follow it in the stem, nor if a number follows
    it wherever it stands in the text. `place` is the alias' order; aliases are folded and begin and end in a letter or digit."""
    rows = df.select(F.coalesce(stem, F.lit("")).alias("_stem"), F.coalesce(text, F.lit("")).alias("_text")).distinct()
    known = aliases.where(F.col("alias") != "").groupBy("alias").agg(F.min_by(F.struct("canonical_id", "tier", "place"), F.struct("place")).alias("_e")).select("alias", "_e.*")
    longest = known.agg(F.max(F.size(F.regexp_extract_all("alias", F.lit(r"\w+"), F.lit(0))))).first()[0] or 1  # words of the longest alias
    words = F.split("_stem", " ")
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), lambda k: F.array_join(F.slice(words, 1, k), " "))
    asked = F.array_distinct(F.concat(heads, runs(F.col("_text"), F.lit(longest)), F.array("_stem")))
    met = rows.select("_stem", "_text", F.explode(asked).alias("alias")).join(known, "alias")
    exact, begins = F.col("alias") == F.col("_stem"), F.concat("_stem", F.lit(" ")).startswith(F.concat("alias", F.lit(" ")))
    rest = F.substr("_stem", F.length("alias") + 1)
    phase = rest.rlike(r"^(\s+(\d+|ii))+$")
    # the alias as a pattern: what is not a letter, digit or blank is escaped
    name = F.regexp_replace("alias", r"([^\w\s])", r"\\$1")
    has = lambda *p: F.regexp_like("_text", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p)))
    whole, numbered, alone = has(r"(?<!\w)", name, r"(?!\w)"), has(r"(?<!\w)", name, r"\s+\d+\b"), has(r"(?<!\w)", name, r"(?!\s+\d)")
    fits = exact | ((F.length("alias") >= LEAST_ALIAS) & F.when(begins, ~phase).otherwise(whole & ~(numbered & ~alone)))
    best = met.where(fits).groupBy("_stem", "_text").agg(F.max_by(F.struct("canonical_id", "tier"), F.struct(exact, F.length("alias"), -F.col("place"))).alias("_e"))
    out = df.withColumns({"_stem": F.coalesce(stem, F.lit("")), "_text": F.coalesce(text, F.lit(""))})
    return attach(out, best, ["_stem", "_text"]).withColumns({"canonical_id": F.col("_e.canonical_id"), "tier": F.col("_e.tier")}).drop("_stem", "_text", "_e")


def site_ids(df: DataFrame, raw: str, source: str, stem: str, text: str, aliases: DataFrame, least: int = 1) -> DataFrame:
    """df with what a site encoder learns: `site_project_id` (the dictionary's, else the stem's; `other` below `least` rows,
    `missing` without a stem), `site_project_match_source`, rows of the id, their bucket, tier and its code."""
    out = dictionary_match(df, stem, text, aliases)
    own = F.col("canonical_id").isNotNull()
    own_stem = F.when(F.coalesce(F.col(stem), F.lit("")).isin("", "missing"), F.lit("missing")).otherwise(stem_id(F.col(stem)))
    out = durable(out.withColumns({
        "_proposed": F.coalesce("canonical_id", own_stem), "_in_dictionary": own,
        "site_project_match_source": F.when(own & (F.coalesce(source, F.lit("missing")) == "missing"), "dict").otherwise(F.coalesce(source, F.lit("missing"))),
    }))
    counted = aggregate(out.where("_proposed <> 'missing'"), ["_proposed"], _seen=F.count("*"))
    out = attach(out, counted, ["_proposed"])
    rare = ~F.col("_in_dictionary") & (F.col("_proposed") != "missing") & (F.coalesce("_seen", F.lit(0)) < least)
    out = durable(out.withColumn("site_project_id", F.when(rare, F.lit("other")).otherwise(F.col("_proposed"))))
    final = aggregate(out.where("site_project_id <> 'missing'"), ["site_project_id"], site_project_listing_count=F.count("*"))
    out = attach(out, final, ["site_project_id"])
    tier = F.coalesce("tier", F.lit("unknown"))
    codes = F.create_map(*(x for k, v in TIERS.items() for x in (F.lit(k), F.lit(v))))
    return out.withColumns({
        "site_project_listing_count": F.coalesce("site_project_listing_count", F.lit(0)), "has_site_project_id": (F.col("site_project_id") != "missing").cast("int"),
        "site_project_freq_bucket": frequency_bucket(F.coalesce("site_project_listing_count", F.lit(0))), "site_quality_tier": tier, "site_tier_code": F.coalesce(F.element_at(codes, tier), F.lit(0)),
    })


def near_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, canonical_id) where one of two different identifiers holds the other.

    The held one's first GRAM letters stand in the other: names meet by these letters, and are compared where they met."""
    def posts(df: DataFrame, c: str) -> DataFrame:
        grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.substr(F.col(c), i, k)))))
        return df.select(c, F.explode(grams).alias("gram")).where(F.length("gram") > 0)

    a, b = names.where(F.length("name") > 0), known.where(F.length("canonical_id") > 0)
    inner = posts(a, "name").join(b.withColumn("gram", F.substring("canonical_id", 1, GRAM)), "gram").where(F.contains(F.col("name"), F.col("canonical_id")))
    outer = posts(b, "canonical_id").join(a.withColumn("gram", F.substring("name", 1, GRAM)), "gram").where(F.contains(F.col("canonical_id"), F.col("name")))
    return inner.select("name", "canonical_id").unionAll(outer.select("name", "canonical_id")).where("name <> canonical_id").distinct()


def review_rows(encoded: DataFrame, raw: str, stem: str, value: str, aliases: DataFrame, least: int = 1) -> DataFrame:
    """(raw_name, proposed_canonical_id, reason, frequency, mean_price, median_price, n): names for a person to look at.

    Names outside the dictionary seen in fewer than `least` rows, names kept apart but seen in fewer than three, and names
    near a dictionary name. Prices are those of the proposed id's rows."""
    name = F.coalesce(F.nullif(F.col(raw), F.lit("")), F.col(stem))
    loose = encoded.where(~F.col("_in_dictionary") & (F.col("_proposed") != "missing"))
    seen = F.coalesce("_seen", F.lit(0))
    reason = F.when(seen < least, "freq_lt_min_separate_other").when(seen < LEAST_SEEN, "low_freq_kept_separate_review")
    few = loose.select(name.alias("raw_name"), F.col("_proposed").alias("proposed_canonical_id"), reason.alias("reason"), seen.alias("frequency")).where("reason is not null")
    known = aliases.select("canonical_id").distinct()
    near = near_names(loose.select(F.col("_proposed").alias("name")).distinct(), known)
    close = loose.join(near, F.col("_proposed") == F.col("name")).select(name.alias("raw_name"), near["canonical_id"].alias("proposed_canonical_id"), F.lit("near_dict_not_merged_conservative").alias("reason"), seen.alias("frequency"))
    rows = aggregate(few.unionAll(close), ["raw_name", "proposed_canonical_id", "reason", "frequency"], n=F.count("*"))
    prices = aggregate(encoded, ["site_project_id"], mean_price=F.avg(value), median_price=F.median(value))
    return attach(rows, prices.withColumnRenamed("site_project_id", "proposed_canonical_id"), ["proposed_canonical_id"])


def mentions(df: DataFrame, id_: str, site: str, texts: Sequence[str]) -> DataFrame:
    """(id, candidate_name, candidate_norm, source_field, pattern, confidence): every name that a listing may mention, the
    surest mention of each folded name; of equal ones that which is found first."""
    def told(source: str, pattern: str, confidence: float) -> Callable[[Column], Column]:
        return lambda n: F.struct(n.alias("name"), F.lit(source).alias("source"), F.lit(pattern).alias("pattern"), F.lit(confidence).alias("confidence"))

    found = [F.when(~F.coalesce(fold(F.col(site)), F.lit("")).isin(*NO_NAME), F.array(told("site_name", *STRUCTURED)(F.col(site)))).otherwise(F.array())]
    for t in texts:
        for name, confidence, pattern in FAMILIES:
            first = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(1))
            names = first
            if name == "name_plus_site_token":
                names = F.zip_with(first, F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
            elif name == "sitesinde":
                names = F.transform(first, lambda a: F.concat(a, F.lit(" Sitesi")))
            found.append(F.transform(names, told(t, name, confidence)))
    long = df.select(id_, F.posexplode(F.concat(*found)).alias("place", "m")).select(id_, "place", "m.*")
    clean = F.regexp_replace(F.trim(F.regexp_replace("name", r"\s+", " ")), r"^[ \-|/.,;:]+|[ \-|/.,;:]+$", "")
    long = long.withColumn("candidate_name", clean).where(F.length("candidate_name") >= 3).withColumn("candidate_norm", fold(F.col("candidate_name")))
    words = F.filter(F.split("candidate_norm", r"\s+"), lambda w: w != "")
    telling = F.exists(words, lambda w: ~w.isin(*NAMELESS) & ~w.rlike(r"^\d+$") & ~w.rlike(r"^\d+\+\d+$"))
    best = long.where(telling).groupBy(id_, "candidate_norm").agg(F.max_by(F.struct("candidate_name", F.col("source").alias("source_field"), "pattern", "confidence"), F.struct("confidence", -F.col("place"))).alias("m"))
    return best.select(id_, "candidate_norm", "m.*")


def mentioned_sites(found: DataFrame, df: DataFrame, id_: str, decile: str, residual: str, actual: str, predicted: str, title: str, examples: int = 3) -> DataFrame:
    """A row for each folded name: a spelling, distinct listings, listings of the dearest tenth that are predicted too low,
    means, sources, mean confidence and the titles of its first listings, cut at 80 letters.

    Confidences are short decimals, so their mean often lies on an exact half; they are added as decimals, so that it does
    not fall beside it by the order in which rows are added."""
    facts = df.select(F.col(id_).alias("_id"), F.col(decile).alias("_d"), F.col(residual).alias("_r"), F.col(actual).alias("_y"), F.col(predicted).alias("_p"), F.col(title).alias("_t"))
    top = facts.agg(F.max("_d").alias("_top"))
    rows = attach(found.join(facts, F.col(id_) == F.col("_id")), top, [])
    low = ((F.col("_d") == F.col("_top")) & (F.col("_r") < 0)).cast("int")
    out = aggregate(
        rows, ["candidate_norm"], candidate_name_example=F.min_by("candidate_name", "_id"), n_listings=F.count_distinct("_id"), n_top_expensive_underpred=F.coalesce(F.sum(low), F.lit(0)),
        mean_residual=F.avg("_r"), mean_actual=F.avg("_y"), mean_pred=F.avg("_p"), sources=F.array_join(F.sort_array(F.collect_set("source_field")), ","), mean_confidence=F.sum(F.col("confidence").cast("decimal(28,18)")).cast("double") / F.count("confidence"),
    )
    place = F.row_number().over(Window.partitionBy("candidate_norm").orderBy("_id"))  # the first three of each name, cut before they are gathered
    first = rows.select("candidate_norm", "_id", F.substring("_t", 1, 80).alias("_t")).distinct().withColumn("_n", place).where(F.col("_n") <= examples)
    titles = aggregate(first, ["candidate_norm"], example_titles=F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.coalesce("_t", F.lit("")).alias("t")))), lambda x: x.t), " || "))
    return attach(out, titles, ["candidate_norm"])
