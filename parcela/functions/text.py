"""Text and number columns: normalised keys, localised numbers, rooms, ages, site names, keyword flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks of the Latin and Turkish alphabets, and their plain letters.
MARKED, PLAIN = "çğıöşüâîûéèêëáàäãåíìïóòôõúùñ", "cgiosuaiueeeeaaaaaiiioooouun"
NULL_WORDS = ("", "nan", "none", "null", "-", "belirtilmemiş", "belirtilmemis")
# Generic words at the end of site names, and words that are no part of one.
GENERIC_SUFFIXES = ("sitesi", "site", "sit", "konutlari", "evleri", "rezidans", "residence", "projesi", "proje", "blok")
STOP_WORDS = (
    "basiskele", "kocaeli", "izmit", "satilik", "kiralik", "daire", "konut", "arsa", "firsat", "acil", "guzel", "luks", "yeni", "merkez", "mahalle", "mah", "kat", "arakat",
    "belirtilmemis", "yok", "var", "nan", "none", "missing", "other",
)


def clean(c: Column) -> Column:
    """Trimmed text with plain spaces; words that stand for nothing become null."""
    text = F.trim(F.replace(c.cast("string"), F.lit(" "), F.lit(" ")))
    return F.when(~F.lower(text).isin(*NULL_WORDS), text)


def fold(c: Column) -> Column:
    """Lower case without marks; other characters than words, spaces and |+./'- become spaces."""
    plain = F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s|+./'\-]", " "), r"\s+", " "))


def key(c: Column) -> Column:
    """A name as a join key: lower case, plain letters, without words for quarter."""
    lower = F.translate(F.lower(F.trim(F.replace(c, F.lit(" "), F.lit(" ")))), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"\s+(mahallesi|mah\.|mh\.|mah|mh)$", ""), r"\s+", " "))


def location_key(c: Column) -> Column:
    """A place name as letters and digits alone."""
    lower = F.translate(F.lower(c), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"\b(mahallesi|mahalle|mah\.?|mh\.?)\b", " "), r"[^0-9a-z]+", " "))


def number(c: Column) -> Column:
    """A localised number. With both marks the last is the decimal one; a lone comma is; dots alone group
    thousands if several, or if one stands before exactly three digits and after one to three."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"tl|₺|m²|m2", ""), r"[^0-9.,\-]", "")
    dots, commas = F.length(kept) - F.length(F.translate(kept, ".", "")), F.length(kept) - F.length(F.translate(kept, ",", ""))
    last_dot = F.length(kept) - F.locate(".", F.reverse(kept))
    last_comma = F.length(kept) - F.locate(",", F.reverse(kept))
    without_dots, without_commas = F.translate(kept, ".", ""), F.translate(kept, ",", "")
    text = (
        F.when((dots > 0) & (commas > 0) & (last_comma > last_dot), F.replace(without_dots, F.lit(","), F.lit(".")))
        .when((dots > 0) & (commas > 0), without_commas)
        .when(commas > 0, F.replace(kept, F.lit(","), F.lit(".")))
        .when(dots > 1, without_dots)
        .when(kept.rlike(r"^-?[0-9]{1,3}\.[0-9]{3}$"), without_dots)
        .otherwise(kept)
    )
    return text.try_cast("double")


def rooms(c: Column) -> tuple[Column, Column]:
    """Rooms and living rooms of '3+1'; null if there is no such pair."""
    pair = r"([0-9]+)\s*\+\s*([0-9]+)"
    return F.regexp_extract(c, pair, 1).try_cast("double"), F.regexp_extract(c, pair, 2).try_cast("double")


def age(c: Column) -> Column:
    """Years of a building: the middle of 'a-b', n + 4 of 'n and over', or n."""
    a, b = F.regexp_extract(c, r"([0-9]+)\s*-\s*([0-9]+)", 1).try_cast("double"), F.regexp_extract(c, r"([0-9]+)\s*-\s*([0-9]+)", 2).try_cast("double")
    n = F.regexp_extract(c, r"([0-9]+)", 1).try_cast("double")
    return F.when(a.isNotNull(), F.bround((a + b) / 2, 1)).when(F.lower(c).rlike("üzeri|üstü|uzeri|ustu|\\+"), n + 4).otherwise(n)


def floor(c: Column) -> Column:
    """Number of a floor given in words or digits; roofs are null."""
    text = fold(c)
    return F.when(text.rlike("bodrum"), F.lit(-1.0)).when(text.rlike("zemin|giris|bahce"), F.lit(0.0)).when(text.rlike("cati"), F.lit(None)).otherwise(F.regexp_extract(text, r"(-?[0-9]+)", 1).try_cast("double"))


def size_group(c: Column) -> Column:
    """Square metres in groups closed on the right."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for low, high in ((None, 75), (75, 100), (100, 125), (125, 150), (150, 200)):
        out = out.when(c <= high, F.lit(f"<={high}" if low is None else f"{low + 1}-{high}"))
    return out.otherwise(F.lit("200+"))


def count_values(c: Column, mark: str = "|") -> Column:
    """Values of a marked list that are not empty."""
    return F.coalesce(F.size(F.filter(F.split(c, f"[{mark}]"), lambda x: F.length(F.trim(x)) > 0)), F.lit(0))


def flags(c: Column, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """1 for each group of which the folded text holds a pattern."""
    return {name: F.coalesce(c.rlike("|".join(patterns)), F.lit(False)).cast("int") for name, patterns in groups.items()}


def strip_suffixes(c: Column) -> Column:
    """A folded name without generic words at its end."""
    return F.trim(F.regexp_replace(c, r"((^|\s+)(" + "|".join((*GENERIC_SUFFIXES, "etap")) + r"))+$", ""))


def site_stem(c: Column) -> Column:
    """A site's name as up to six words: rooms and sizes go first, then generic words at the end, then stop words; ii becomes 2.

    What leaves no word is `missing`."""
    bare = F.regexp_replace(F.regexp_replace(fold(c), r"\b[0-9]+\+[0-9]+\b", " "), r"\b[0-9]+\s*m2\b", " ")
    words = F.filter(F.split(strip_suffixes(F.trim(F.regexp_replace(bare, r"\s+", " "))), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    stem = F.array_join(F.slice(F.transform(words, lambda w: F.when(w.isin("ii", "ii."), F.lit("2")).otherwise(w)), 1, 6), " ")
    return F.when(F.coalesce(stem, F.lit("")) == "", F.lit("missing")).otherwise(stem)


def stem_id(c: Column) -> Column:
    """A stem as an identifier of letters, digits and underscores; `missing` if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("missing")).otherwise(name)


def plain_number(c: Column) -> Column:
    """A number in which every dot groups thousands and the comma is the decimal mark."""
    bare = F.regexp_replace(c.cast("string"), "TL|₺|m²|m2", "")
    return F.regexp_replace(F.translate(bare, ",.", "."), r"[^0-9.\-]", "").try_cast("double")


def rooms_number(c: Column) -> Column:
    """Rooms beside the living room; a lone number stands for itself."""
    return F.regexp_extract(F.replace(c, F.lit(" "), F.lit("")), r"([0-9]+)", 1).try_cast("double")


def rooms_total(c: Column) -> Column:
    """Rooms and living rooms together; a lone number stands for itself."""
    room, living = rooms(c)
    return F.coalesce(room + living, F.regexp_extract(c, r"([0-9]+)", 1).try_cast("double"))


def frequency_bucket(c: Column) -> Column:
    return F.when(c <= 0, 0).when(c < 3, 1).when(c < 8, 2).when(c < 20, 3).otherwise(4)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def weighted(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null within 0 and 1; a half if all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    mean = F.try_divide(total, weight)
    return F.when(mean.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def reasons(conditions: Mapping[str, Column], mark: str = "|") -> Column:
    """The names of the conditions that hold, joined; a null condition does not hold."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()))), mark)
