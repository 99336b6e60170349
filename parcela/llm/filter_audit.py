"""Filter interaction audit: what each of five filters removes alone, in any order, and beside the others.

Identical texts are found after a counting-Bloom prepass. A text has one block of the sketch and two cells in
it. Every task counts the cells of its own documents; the partial sketches are merged by block, and a bitmap of
512 bytes a block tells which cells were touched more than once. The merged sketch has CELLS cells a document,
MOST_BLOCKS blocks at most (64 MB), and goes to the tasks that read the texts: a text with a cell that no other
touched is unique for certain, and only the texts of possible repeats are shuffled, to find the smallest doc_id
of each whole text exactly. Beyond about 130 million documents the sketch is not made larger; then it
clears fewer texts and more are shuffled, with the same result.

The five flags of a document are one mask. Masks are counted by part, with the labels; everything reported is a
sum of those counts, at most 32 a part, for each of the 120 orders.

Defined results: null texts count as empty; all empty texts are identical; repeated rows of one doc_id are not
smaller than each other, so none of them fails for the other; a null doc_id is neither smaller nor larger than
any, so its row never fails E, and has no labels; several labels of one doc_id count once, as set if one of them
is; texts of any length are read whole; other columns are not read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import durable, table

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cells of the sketch for each document, cells of a block, and most blocks.
CELLS, BLOCK, MOST_BLOCKS = 8, 4096, 1 << 17
#: Documents that a task counts at a time, and blocks that one task merges.
CHUNK, MERGED = 1 << 20, 2048


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, the mask of filters A to D, a hash and the SHA-256 digest of every text."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    )
    mask = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        mask.alias("mask"), F.xxhash64(text).alias("hash"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def cells(blocks: int) -> tuple[Column, Column, Column]:
    """The block of a hash and its two cells there."""
    cell = lambda shift: F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit(BLOCK - 1).cast("long")).cast("int")
    return F.pmod("hash", F.lit(blocks).cast("long")).cast("int"), cell(40), cell(52)


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): for each block a bitmap of the cells that more than one of the hashes touched."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def partial(parts: list[np.ndarray]) -> pa.RecordBatch:
            cell, times = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.flatnonzero(np.diff(cell // BLOCK)) + 1
            rows = [(int(c[0]) // BLOCK, (c % BLOCK).astype("<u2").tobytes(), np.packbits(n > 1).tobytes()) for c, n in zip(np.split(cell, edges), np.split(times, edges), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "cells", "again"])

        parts, held = [], 0
        for batch in batches:
            block, one, two = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            parts += [block * BLOCK + one, (block * BLOCK + two)[one != two]]
            held += len(block)
            if held >= CHUNK:
                yield partial(parts)
                parts, held = [], 0
        if held:
            yield partial(parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.frombuffer(cell, "<u2")
                counts = seen.setdefault(block, np.zeros(BLOCK, np.uint8))
                counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(np.frombuffer(again, np.uint8), count=len(at)), 2)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([np.packbits(c > 1, bitorder="little").tobytes() for c in seen.values()], pa.binary())], names=["block", "bits"])

    partials = hashes.select(*cells(blocks)).mapInArrow(counted, "block int, cells binary, again binary")
    return durable(partials.repartition(-(-blocks // MERGED), "block").mapInArrow(merged, "block int, bits binary"))


def possible(rows: DataFrame, merged: DataFrame, blocks: int) -> DataFrame:
    """rows (with a hash) and whether the sketch leaves it open that another row has the same hash; `repeat` is the column."""
    block, *both = cells(blocks)
    byte = lambda c: F.conv(F.hex(F.substr("_bits", F.shiftright(c, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = lambda c: F.call_function("shiftright", byte(c), c.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    held = F.broadcast(merged.withColumnsRenamed({"block": "_block", "bits": "_bits"}))  # MOST_BLOCKS bitmaps of 512 bytes at most
    return rows.join(held, block == F.col("_block")).withColumn("repeat", bit(both[0]) & bit(both[1])).drop("_block", "_bits")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail the mask's filters, bit i being letter i."""
    flags = durable(flagged(docs))
    blocks = min(MOST_BLOCKS, max(1, -(-flags.count() * CELLS // BLOCK)))
    merged = sketch(flags, blocks)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    first = possible(texts, merged, blocks).where("repeat").groupBy("text").agg(F.min("doc_id").alias("_first"))
    first = first.select("_first", F.unhex(F.sha2("text", 256)).alias("_digest"))
    of_id = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*(F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    known = possible(flags.where(F.col("doc_id").isNotNull()), merged, blocks).drop("hash")
    # the first of a text is found by its own doc_id, so that no key holds all copies of a text
    joined = known.join(first, (F.col("doc_id") == F.col("_first")) & (F.col("digest") == F.col("_digest")), "left").join(of_id, F.col("doc_id") == F.col("_id"), "left")
    fails_e = F.col("repeat") & F.col("_first").isNull()
    rows = joined.select("part", (F.col("mask") + F.when(fails_e, 16).otherwise(0)).alias("mask"), F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = rows.unionAll(flags.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0), F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every part, order of the filters and step."""
    held = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 a part at most
    steps = [(order, step, sum(1 << LETTERS.index(x) for x in order[: step - 1]), 1 << LETTERS.index(order[step - 1])) for order in map("".join, permutations(LETTERS)) for step in range(1, 6)]
    every = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(e).alias("earlier"), F.lit(b).alias("bit")) for o, s, e, b in steps))
    rows = held.select("part", "masks", F.explode(every).alias("at")).select("part", "masks", "at.*")

    def total(what: str, where: str) -> Column:
        return F.expr(f"aggregate(masks, 0L, (s, m) -> s + if({where}, {what}, 0L))")

    removed = "m.mask & bit <> 0 and m.mask & earlier = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("m.n", "m.mask & (earlier | bit) = 0").alias("kept"), total("m.n", removed).alias("removed"),
        total("m.n", "m.mask & bit <> 0 and m.mask & earlier <> 0").alias("redundant"), total("m.n", "m.mask = bit").alias("unique_fails"),
        total("m.good", removed).alias("good_lost"), total("m.toxic", removed).alias("toxic_lost"),
        total("m.n * (120 div bit_count(m.mask))", "m.mask & bit <> 0").alias("shapley"),  # a filter comes first of k failing ones in a k-th of the orders
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under all 120 orders of the five filters, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END AS a,
         CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
         CASE WHEN w.doc_id > firsts.first_id THEN 1 ELSE 0 END AS e
  FROM w JOIN firsts ON w.text = firsts.text LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, a, b, c, d, e),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x),
failing AS (
  SELECT m.part, o.filter_order, n, good, toxic, a + b + c + d + e AS fails,
         CASE WHEN a = 1 THEN strpos(filter_order, 'A') ELSE 9 END AS pa, CASE WHEN b = 1 THEN strpos(filter_order, 'B') ELSE 9 END AS pb,
         CASE WHEN c = 1 THEN strpos(filter_order, 'C') ELSE 9 END AS pc, CASE WHEN d = 1 THEN strpos(filter_order, 'D') ELSE 9 END AS pd,
         CASE WHEN e = 1 THEN strpos(filter_order, 'E') ELSE 9 END AS pe
  FROM m, orders o),
placed AS (SELECT *, least(pa, pb, pc, pd, pe) AS met FROM failing),
steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
counted AS (
  SELECT part, filter_order, step,
         sum(CASE WHEN met > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN met = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN met < step AND step IN (pa, pb, pc, pd, pe) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN met = step AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN met = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN met = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed, steps GROUP BY part, filter_order, step),
shares AS (SELECT part, substr(filter_order, step, 1) AS letter, sum(removed) AS shapley FROM counted GROUP BY part, substr(filter_order, step, 1))
SELECT c.part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM counted c JOIN shares s ON c.part = s.part AND substr(filter_order, step, 1) = s.letter
"""
