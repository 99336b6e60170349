"""Labelled documents: the split, and bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import map_rows


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from: crc32 of its id as text leaves 1 by 3. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(_id, _y, text) for a bounded table of (_id, _y): one text for each, the smallest where an id has several."""
    found = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id", "_y").agg(F.min("text").alias("text"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], seed: int = 3) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to most[y] texts labelled y, of lowest seeded hash, and the number of training labels of each y.

    The ids are picked from the narrow labels; only the picked texts are read. Labels that are null or
    not in `most` are left out. The bounds in `most` are the operators' documented parameters.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(*most)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in most.items():
        part = usable.where(F.col("_y") == y).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    order = sorted((r["_id"], r["_y"], r["text"] or "") for r in texts_of(docs, picked).collect())
    return [(text, y) for _, y, text in order], counts


def scored(docs: DataFrame, scores: Callable[[list[str | None]], Iterable[float]], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted from a function that scores a list of texts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = map_rows(narrow, ["text"], lambda texts: (None, list(scores(texts))), {"score": "double"}, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
