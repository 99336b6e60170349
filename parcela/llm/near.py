"""Near copies by word shingles: a sampled SimHash in a byte-position index, verified on the shingles themselves.

A plain SimHash blurs: at a Jaccard similarity of 0.8 every sixth bit of two texts differs, so that no key of
several bytes is likely to agree. Here each of PLACES bytes is the SimHash (the majority of each bit) of just
VOTERS of a text's shingles, those that stand lowest in an order of the byte's own. Two texts of similarity 0.8
agree in 0.55 of the bytes, texts that share nothing in one of 256.

The index posts each text under KEYS combinations of KEY_BYTES positions with the bytes found there. Texts under
one key are candidates: the positional bytes that they share are tallied, pairs with LEAST_SHARED or more go on
(0.9996 of all pairs at 0.8, more above), unless parities rule them out: a text has one bit for each of 512 parts
of the shingles, set if it has an odd number of the part, and two texts differ in at least as many shingles as
bits. What is left is settled by the shingles themselves. So no pair below the similarity is linked, and a pair
at 0.8 is found with 0.98, one at 0.85 with 0.999 (tests measure it).

Pairs are looked at in rounds, so that a large group of copies costs a row for each of its texts and not a pair:
first each text of a key is held against that text of the key whose keys most texts share (of copies of one
text, this one); joined texts are one root, and only keys with more than one root are looked at again, under
more keys; last, all pairs of different roots that remain under a key are tallied, however many there are.
Crowded keys are split over tasks.

Texts of equal sets are one node, known by a hash of 64 bits; null and empty texts have the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import durable, map_rows, tasks_for
from parcela.llm.components import components

PLACES, VOTERS = 64, 3
KEY_BYTES = 4
#: Keys of the first round, of the second, and of the last.
KEYS = (8, 24, 48)
LEAST_SHARED = 22
#: Shingles that are put in order at a time, and texts of a key that one task tallies with all others of it.
CHUNK, BLOCK = 4096, 1000
#: Narrow rows that the sets of a pair of texts stand for.
TEXT_ROWS = 10
#: Pairs of two roots that are verified before all others of these roots, those of most shared bytes.
FIRST_TRIED = 4
#: Tables of texts to be read again up to this size are broadcast, larger ones are joined by shuffling.
MOST_BROADCAST = 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)
ORDERS = np.array([(xxhash.xxh64_intdigest(f"turn {p}"), xxhash.xxh64_intdigest(f"times {p}") | 1) for p in range(PLACES)], dtype=np.uint64)


def key_places() -> np.ndarray:
    """The positions of each key: one of each quarter, in turns by which two keys share one position at most."""
    quarter = PLACES // KEY_BYTES
    return np.array([[q * quarter + (k % quarter + q * (k // quarter)) % quarter for q in range(KEY_BYTES)] for k in range(KEYS[-1])])


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    from parcela.llm.simhash import shingle_hashes

    return np.unique(shingle_hashes(text, shingle))


def sampled_print(shingles: np.ndarray) -> np.ndarray:
    """PLACES bytes, in words of 64 bits: at each place the majority bits of the VOTERS lowest shingles of that place's order."""
    if not len(shingles):
        return np.zeros(PLACES // 8, dtype=np.int64)
    low = np.zeros((PLACES, 0), dtype=np.uint64)
    for i in range(0, len(shingles), CHUNK):
        turned = (shingles[None, i : i + CHUNK] ^ ORDERS[:, :1]) * ORDERS[:, 1:]
        low = np.concatenate([low, turned], axis=1)
        if low.shape[1] > VOTERS:
            low = np.partition(low, VOTERS - 1, axis=1)[:, :VOTERS]
    votes = np.unpackbits((low * MIX >> np.uint64(56)).astype(np.uint8)[:, :, None], axis=2).sum(axis=1)
    return np.packbits(2 * votes > low.shape[1], axis=1)[:, 0].view("<i8")


def parities(shingles: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of the shingles falls into each part."""
    counts = np.bincount((shingles % np.uint64(512)).astype(np.int64), minlength=512)
    return np.packbits(counts % 2 == 1).view("<i8")


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, n, print, parity) of every document; n is the number of its shingles."""

    def compute(texts: list[str | None]) -> tuple:
        sets = [shingle_set(t, shingle) for t in texts]
        nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        return None, nodes, [len(s) for s in sets], [sampled_print(s) for s in sets], [parities(s) for s in sets]

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(narrow, ["text"], compute, {"node": "long", "n": "long", "print": "array<long>", "parity": "array<long>"}, ["doc_id", "text_hash"])


def posted(nodes: DataFrame, keys: int) -> DataFrame:
    """(key, node, root): each of (node, root, print) under the first so many keys, a key being its number and its bytes in one long."""
    places = key_places()[:keys]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.ascontiguousarray(batch.column("print").flatten().to_numpy()).view(np.uint8).reshape(-1, PLACES)
            values = np.ascontiguousarray(prints[:, places]).view("<u4")[:, :, 0].astype(np.int64)
            key = (np.arange(len(places)) << 32) + values
            node, root = (np.repeat(batch.column(c).to_numpy(), len(places)) for c in ("node", "root"))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node), pa.array(root)], names=["key", "node", "root"])

    return nodes.select("node", "root", "print").mapInArrow(rows, "key long, node long, root long")


def meeting(nodes: DataFrame, keys: int) -> DataFrame:
    """(key, node, root, n): the nodes under keys that hold more than one root, with the number of nodes there."""
    posts = posted(nodes, keys)
    apart = posts.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("n")).where("_a <> _b")
    return durable(posts.join(apart.drop("_a", "_b"), "key"))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two prints share: those whose difference is zero."""
    def differing(x: Column) -> Column:
        for k in (4, 2, 1):  # gathers each byte's bits in its lowest one
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(PLACES) - sum(differing(a[k].bitwiseXOR(b[k])) for k in range(PLACES // 8))


def may_be_near(a: str, b: str, t: float) -> Column:
    """The count filter (enough shared bytes), and what similarity t allows: sizes, and parities that differ."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(n_a, n_b) >= F.greatest(n_a, n_b) * F.lit(t) - F.lit(1e-9)
    apart = sum(F.bit_count(F.col(f"{a}.parity")[k].bitwiseXOR(F.col(f"{b}.parity")[k])) for k in range(8))
    odd = apart <= (n_a + n_b) * F.lit((1 - t) / (1 + t)) + F.lit(1e-9)
    return sizes & odd & (shared_bytes(F.col(f"{a}.print"), F.col(f"{b}.print")) >= LEAST_SHARED)


def against_one(met: DataFrame, nodes: DataFrame, t: float) -> DataFrame:
    """Candidates (a, b): the nodes of each key with the one whose keys hold most nodes, where roots differ."""
    known = met.groupBy("node").agg(F.sum("n").alias("_known"))
    first = met.join(known, "node").groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("_known", "node")).alias("one"))
    pairs = met.join(first, "key").where(F.col("root") != F.col("one.root")).select(F.col("one.node").alias("a"), F.col("node").alias("b")).distinct()
    x, y = nodes.alias("x"), nodes.alias("y")
    found = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return found.where(may_be_near("x", "y", t)).select("a", "b")


def all_apart(met: DataFrame, nodes: DataFrame, t: float) -> DataFrame:
    """Candidates (a, b, shared, root_a, root_b): all pairs of different roots under a key that the count filter lets pass.

    A key's nodes are dealt into parts of about BLOCK, each of which meets all nodes of the key."""
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    whole = met.select("key", "node", "root", parts.alias("parts")).join(nodes.select("node", "n", "print", "parity"), "node")
    x = whole.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")).alias("x")
    y = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    other = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & other & may_be_near("x", "y", t))
    shared = shared_bytes(F.col("x.print"), F.col("y.print"))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), shared.alias("shared"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, t: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets have similarity t or more. Only the texts of these pairs are read again."""
    near = durable(pairs.select("a", "b").distinct())
    tasks = tasks_for(TEXT_ROWS * near.count())
    near = near.coalesce(tasks)
    read = durable(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node"))
    read = F.broadcast(read) if read.count() <= MOST_BROADCAST else read
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(read, "text_hash").dropDuplicates(["node"])
    sets = durable(map_rows(texts.select("node", "text"), ["text"], lambda texts: (None, [shingle_set(x, shingle).tobytes() for x in texts]), {"shingles": "binary"}, ["node"]))
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")

    def compute(first: list[bytes], second: list[bytes]) -> tuple:
        which = []
        for i, (p, q) in enumerate(zip(first, second, strict=True)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            if shared >= t * (len(p) + len(q) - shared) - 1e-9:
                which.append(i)
        return (which,)

    return durable(map_rows(near.join(a, "a").join(b, "b"), ["_a", "_b"], compute, {}, ["a", "b"]).coalesce(tasks))


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the root of each: the smallest node that edges join it to."""
    roots = components(edges)
    roots = durable(roots.coalesce(tasks_for(roots.count()))).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return nodes.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_node", "_root")


def linked(nodes: DataFrame, docs: DataFrame, t: float, shingle: int) -> DataFrame:
    """nodes (node, n, print, parity, text_hash) with the root of each."""
    now, edges = nodes.withColumn("root", F.col("node")), None

    def join(pairs: DataFrame) -> None:
        nonlocal now, edges
        found = verified(pairs, nodes, docs, t, shingle)
        edges = found if edges is None else edges.unionAll(found)
        now = rooted(nodes, edges)

    for keys in KEYS[:-1]:
        join(against_one(meeting(now, keys), nodes, t))
    apart = durable(all_apart(meeting(now, KEYS[-1]), nodes, t))
    best = Window.partitionBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).orderBy(F.desc("shared"), "a", "b")
    join(apart.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= FIRST_TRIED))
    roots = now.select("node", "root")
    for side in "ab":  # what is joined by now need not be verified
        apart = apart.drop(f"root_{side}").join(roots.withColumnsRenamed({"node": side, "root": f"root_{side}"}), side)
    join(apart.where("root_a <> root_b"))
    return now


def grouped(docs: DataFrame, t: float, shingle: int) -> DataFrame:
    """(doc_id, text_hash, component_id) of every document; documents joined by links have one component_id."""
    found = durable(sketches(docs, shingle))
    nodes = durable(found.groupBy("node").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.first("parity").alias("parity"), F.min("text_hash").alias("text_hash")))
    roots = linked(nodes, docs, t, shingle).select(F.col("node").alias("_node"), F.col("root").alias("component_id"))
    return found.select("doc_id", "text_hash", "node").join(roots, F.col("node") == F.col("_node")).select("doc_id", "text_hash", "component_id")
