"""Licence scans: passages against licence templates by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, words of letters and digits alone, line ends as any other
space. A passage is any run of words. With a least coefficient t, a template of m bigrams can only match a
passage of n bigrams if n lies between m t / (2 - t) and m (2 - t) / t, and only if they share m t / (2 - t). So a
template is compared only where so many of its bigrams stand within so many places, and only with passages of no
more places that begin and end with one of them (others are no better). Of passages that overlap the best counts.

Defined results: null and empty texts hold no licence; ties go to the passage that comes first, then to the first
template by name; texts of any length are scanned whole; repeated rows are scanned alike; a null doc_id stays
null; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import map_rows, table

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")
# The usual notices of well-known licences.
TEMPLATES = {
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT/notice": "Released under the MIT License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


def normalised(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """Finds the templates in a text."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least, self.low = least, least / (2 - least)
        self.names = sorted(templates)
        self.templates = [bigrams(normalised(templates[name])) for name in self.names]
        self.of: dict[tuple[str, str], list[int]] = {}
        for k, wanted in enumerate(self.templates):
            for pair in wanted:
                self.of.setdefault(pair, []).append(k)

    def passages(self, k: int, places: list[int], pairs: list[tuple[str, str]]) -> list[tuple[float, int, int, int]]:
        """(coefficient, first bigram, template, bigram after the last) of the best passage from each place on, if it is good enough."""
        wanted, out = self.templates[k], []
        m = len(wanted)
        fewest, most = max(1, math.ceil(m * self.low - 1e-9)), math.floor(m / self.low + 1e-9)
        for i, start in enumerate(places):
            if i + fewest > len(places) or places[i + fewest - 1] - start >= most:
                continue
            seen: set[tuple[str, str]] = set()
            shared, at, best = 0, start, (0.0, 0)
            for place in places[i:]:
                if place - start >= most:
                    break
                for pair in pairs[at : place + 1]:
                    if pair not in seen:
                        seen.add(pair)
                        shared += pair in wanted
                at = place + 1
                if (dice := 2 * shared / (len(seen) + m)) > best[0]:
                    best = dice, at
            if best[0] >= self.least:
                out.append((best[0], start, k, best[1]))
        return out

    def __call__(self, text: str | None) -> list[tuple[str, float]]:
        """(template, coefficient) of the passages that reach the least one and don't overlap, in order."""
        words = normalised(text or "")
        pairs = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(pairs):
            for k in self.of.get(pair, ()):
                places.setdefault(k, []).append(i)
        found = [p for k in sorted(places) for p in self.passages(k, places[k], pairs)]
        taken: list[tuple[int, int, float, int]] = []  # by place; none overlaps another
        for dice, start, k, end in sorted(found, key=lambda p: (-p[0], p[1], p[2])):
            i = bisect_left(taken, (start,))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end, dice, k))
        return [(self.names[k], dice) for _, _, dice, k in taken]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license and template of the best passage (null: none), its dice, and n_passages of every document."""
    scanner = Scanner(templates or TEMPLATES, least)

    def compute(texts: list[str | None]) -> tuple:
        out = []
        for text in texts:
            found = scanner(text)
            name, dice = max(found, key=lambda f: f[1], default=(None, None))
            out.append((name and name.split("/")[0], name, dice, len(found)))
        return (None, *zip(*out, strict=True)) if out else (None, [], [], [], [])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(narrow, ["text"], compute, {"license": "string", "template": "string", "dice": "double", "n_passages": "long"}, ["doc_id"])


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licence notices that they hold."""
    return scan(table(spark, sf_dir, "documents"))
