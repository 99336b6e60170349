"""Best-fit packing of tokenised documents into sequences: large items are matched, small ones fill gaps.

Lengths are whole numbers up to the capacity, so a packing is settled for the histogram of lengths: a table
with at most `capacity` rows, however many documents there are. Lengths above a third of the capacity go
at most two to a sequence, each of the longest with the longest that still fits; the others then go, the
longest first, into the smallest gap that holds them. The result is a list of layouts with a number of
sequences each. Every piece reads its sequence and offset from its rank among the pieces of its length.

Defined results: a null text is an empty one (one piece, the end id alone); repeated rows are pieces of
their own; ties of length go by doc_id and piece; a null doc_id stays null; an empty table gives an empty result;
other columns are not read, whatever their names; no text is cut short.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import durable, map_rows, table, with_ranks

CAPACITY = 2048
END_ID = 0
#: A piece's place is looked up by its length, shifted by so many bits, and its rank.
RANK_BITS = 44
PIECE = {"piece": "int", "start": "long", "length": "int", "ids_crc32": "long"}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer at path (JSON), by tiktoken over the same vocabulary, several times as fast with the same ids.

    The strings of added tokens get these tokens' ids wherever they stand in a text, as that file's tokenizer does."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    coded = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: coded.encode(text, allowed_special="all")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full pieces, but for a first one that may be shorter."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def tokenize(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """One row per piece of every text."""

    def pieces(texts: list[str | None]) -> tuple:
        encode = encoder(tokenizer)
        out = []
        for i, text in enumerate(texts):
            ids = np.array([*(encode(text) if text else ()), END_ID], dtype="<u4")
            for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                out.append((i, k, start, length, zlib.crc32(ids[start : start + length])))
        return tuple(zip(*out, strict=True)) if out else ([], [], [], [], [])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["text"], pieces, PIECE, ["doc_id"])


def layouts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths side by side in a sequence, number of such sequences)."""
    left = dict(counts)
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by gap

    def put(layout: tuple[int, ...], n: int) -> None:
        if n:
            open_[capacity - sum(layout)].append((layout, n))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for x in large:
        for y in large:
            if not left[x]:
                break
            if y <= x and x + y <= capacity and left[y]:
                n = left[x] // 2 if x == y else min(left[x], left[y])
                put((x, y), n)
                left[x] -= n
                left[y] -= n
        put((x,), left[x])
        left[x] = 0
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        gap, n = x, left[x]
        while n:
            while gap < capacity and not open_[gap]:
                gap += 1
            layout, m = open_[gap].pop() if gap < capacity else ((), n)
            each = min(gap // x, n)  # best fit goes on filling the sequence that it has just made tighter
            full = min(m, n // each)
            put(layout + (x,) * each, full)
            if gap < capacity and m > full:
                open_[gap].append((layout, m - full))
            n -= full * each
    return sorted(x for group in open_ for x in group)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By length: (pieces up to here, sequence of the first piece less its rank, offset), in order of rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for layout, n in plan:
        offset = 0
        for x in layout:
            mine = out.setdefault(x, [])
            before = mine[-1][0] if mine else 0
            mine.append((before + n, sequence - before, offset))
            offset += x
        sequence += n
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = tokenize(docs, capacity, tokenizer or default_tokenizer())
    rows = durable(pieces.groupBy(*names).agg(F.count("*").alias("copies")))
    per_length = rows.groupBy("length").agg(F.sum("copies").alias("n"), F.count("*").alias("key_rows")).collect()
    by_length = places(layouts({r.length: r.n for r in per_length}, capacity))
    keys = spark.createDataFrame([(r.length, r.key_rows) for r in per_length], "length int, key_rows long")
    ranked = with_ranks(rows.join(F.broadcast(keys), "length"), ["length"], "key_rows", names[:3] + names[4:], "copies", "rank")
    each = ranked.select(*names, F.explode(F.sequence("rank", F.col("rank") + F.col("copies") - 1)).alias("rank"))
    parts = np.array([(x << RANK_BITS | upto, shift, offset) for x in sorted(by_length) for upto, shift, offset in by_length[x]], dtype=np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast(parts)  # its size follows from the capacity, not from the documents

    def placed(lengths: list[int], ranks: list[int]) -> tuple:
        rank = np.array(ranks, dtype=np.int64)
        at = shared.value[np.searchsorted(shared.value[:, 0], np.array(lengths, dtype=np.int64) << RANK_BITS | rank, side="right")]
        return None, at[:, 1] + rank, at[:, 2]

    found = map_rows(each.withColumn("length", F.col("length").cast("long")), ["length", "rank"], placed, {"sequence_id": "long", "offset": "long"})
    return found.select(*names, "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
