"""SimHash near-duplicates from an inverted index on the byte positions of fingerprints.

A fingerprint has one bit for each of 64 bits of the shingles' hashes, set if it is set in over half of them.
Texts of one fingerprint are one node. Fingerprints that differ in at most two bits share six of eight positional
bytes at least. The index posts each fingerprint under 14 sets of four positions with the bytes found there: the
sets whose positions have the exclusive or 0. Any six positions hold three of these sets whole (and any three
positions lie in one set alone). So the lists in which a pair meets are tallied, pairs with fewer than three are
dropped (chance agreement in one list mostly), and the bits of the others are compared. No link is lost.

A list of over MOST_LISTED fingerprints is not paired out. Its fingerprints are linked through their neighbours
at one flipped bit: two fingerprints within two bits share one, and only those do. The pipeline's near copies,
at a similarity of five-word shingles, are sought by `parcela.llm.near`.

Defined results: null and empty texts have fingerprint 0; repeated rows are documents of one node; texts
shorter than a shingle are one shingle; texts of any length are read whole; a null doc_id is the component's
only if no other one is in it; of several texts of one group that with the smallest (doc_id, hash of the text)
stays, null doc_ids last; other columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import near
from parcela.llm.common import durable, free_name, map_rows, table
from parcela.llm.components import components

SEED = 42
SHINGLE = 3
MOST_BITS = 2
MOST_LISTED = 64
#: Four positions of eight, 14 times; six positions that agree hold LEAST_LISTS of these sets.
POSITIONS = [p for p in combinations(range(8), 4) if reduce(xor, p) == 0]
LEAST_LISTS = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the lower-cased (A-Z) text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last))  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of the hashes, as a signed number."""
    rows = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(rows), 255):  # so that a count fits a byte
        counts += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print of every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(narrow, ["text"], lambda texts: (None, [fingerprint(shingle_hashes(t, SHINGLE)) for t in texts]), {"print": "long"}, ["doc_id"])


def posted(nodes: DataFrame) -> DataFrame:
    """(key, node, print): each fingerprint under every set of positions, a key being the set's number and the bytes there."""
    def key(k: int, positions: tuple[int, ...]) -> Column:
        parts = [F.shiftleft(F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255).cast("long")), 8 * i) for i, p in enumerate(positions)]
        return reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(k << 32).cast("long"))

    return nodes.select("node", "print", F.explode(F.array(*(key(k, p) for k, p in enumerate(POSITIONS)))).alias("key"))


def meeting(nodes: DataFrame) -> DataFrame:
    """(key, node, print, n): the fingerprints of lists with more than one, and the lists' sizes."""
    posts = posted(nodes)
    return durable(posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))


def tallied(listed: DataFrame) -> DataFrame:
    """Pairs (a, b) that meet in at least LEAST_LISTS lists and differ in few enough bits; for lists of bounded size."""
    lists = listed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "print"))).alias("list"))
    inner = "transform(slice(list, i + 2, size(list)), y -> named_struct('a', x.node, 'b', y.node, 'bits', bit_count(x.print ^ y.print)))"
    pairs = lists.select(F.explode(F.expr(f"flatten(transform(slice(list, 1, size(list) - 1), (x, i) -> {inner}))")).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("lists"), F.first("bits").alias("bits")).where((F.col("lists") >= LEAST_LISTS) & (F.col("bits") <= MOST_BITS)).select("a", "b")


def neighbour_links(nodes: DataFrame) -> DataFrame:
    """Edges that join all fingerprints within two bits: each with the first that shares a value within one bit."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    near_ = F.concat(F.array("print"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("print").bitwiseXOR(one(i))))
    around = nodes.select("node", F.explode(near_).alias("near"))
    firsts = around.groupBy("near").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return around.join(firsts, "near").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes (node, print) that are close, as many as join the nodes that are.

    A pair that meets in a crowded list lies in it with both its nodes, so it is found among the neighbours."""
    met = meeting(nodes)
    crowded = met.where(F.col("n") > MOST_LISTED).select("node").distinct()
    return tallied(met.where(F.col("n") <= MOST_LISTED)).unionAll(neighbour_links(nodes.join(crowded, "node")))


def grouped(prints: DataFrame) -> DataFrame:
    """(print, component_id) for each fingerprint of durable (doc_id, print): the smallest doc_id of its component."""
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so that no task posts much more than its share
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("id")).repartition(spread, "print")
    nodes = durable(distinct.withColumn("node", F.monotonically_increasing_id()))
    roots = durable(components(links(nodes)))
    joined = nodes.join(roots, "node").select("node", "root", "id")
    least = joined.groupBy("root").agg(F.min("id").alias("least"))
    of_node = joined.join(least, "root").select("node", "least")
    return nodes.join(of_node, "node", "left").select("print", F.coalesce("least", "id").alias("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the smallest doc_id that they are linked to."""
    prints = durable(fingerprints(table(spark, sf_dir, "documents")))
    found = prints.join(grouped(prints).withColumnRenamed("print", "_p"), F.col("print") == F.col("_p"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest (doc_id, hash of the text)."""
    member = durable(near.grouped(docs, similarity, shingle))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = member.groupBy("component_id").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("first")).select("first.*")
    times = member.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    stay = durable(first.alias("f").join(times.alias("t"), F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.text_hash") == F.col("t.text_hash"))).select("f.doc_id", "f.text_hash", "n"))
    names = {"doc_id": free_name(docs, "_id"), "text_hash": free_name(docs, "_hash"), "n": free_name(docs, "_times")}
    right = stay.withColumnsRenamed(names)
    kept = docs.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64("text") == F.col(names["text_hash"])))
    if stay.where("n > 1").isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(names["n"]) == 1)
    return once.unionAll(kept.where(F.col(names["n"]) > 1).dropDuplicates([names["doc_id"], names["text_hash"]])).select(*docs.columns)
