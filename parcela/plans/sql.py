"""Common beginnings of the SQL twins: the entity views as named subqueries."""

from __future__ import annotations

import re

from parcela.sources import tables as S


def plain(text: str) -> str:
    """A view text over the tables' own names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


RAW = "WITH raw AS (" + plain(S.RAW_LISTINGS) + ")"
ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in S.LISTING_ORDER)
LISTING = RAW + f", listing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classified_id ORDER BY {ORDER}) AS newest FROM raw) WHERE newest = 1)"
GROUPED = LISTING + """, grouped AS (SELECT *, CASE WHEN gross_m2 <= 75 THEN '<=75' WHEN gross_m2 <= 100 THEN '76-100' WHEN gross_m2 <= 125 THEN '101-125' WHEN gross_m2 <= 150 THEN '126-150'
WHEN gross_m2 <= 200 THEN '151-200' ELSE '200+' END AS m2_group FROM listing)"""
