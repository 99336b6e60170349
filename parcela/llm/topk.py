"""Exact top-k inner products by pivot-table elimination.

Components become whole numbers, floor(SCALE * x). Every vector carries its distances to the same pivots.
By the triangle inequality the largest difference of two vectors' distances to a pivot bounds their
distance from below, and with their norms their inner product from above. A query evaluates candidates
in order of that bound and stops once the bound falls below its k-th best score; so results are exact.

The stated queries meet all rows in blocks: QUERY_ROWS queries and CANDIDATE_ROWS candidates to a task.
Pivots are picked far apart from a bounded sample of SAMPLE rows. The sample's scores also give each
query a first threshold, so that later blocks stop early and return little.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do
scores between vectors of different lengths; ties go to the smaller vec_id; of repeated ids each row is
a candidate of the others; components may be as large as leaves inner products within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.llm.common import durable, table

K = 10
SCALE = 1024
PIVOTS, SAMPLE = 32, 1024
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
#: Candidates that a query evaluates between two looks at its bound.
STEP = 256
EXACT = float(1 << 53)


def pack(rows: DataFrame, most: int) -> DataFrame:
    """(size, ids, uids, vectors) with up to `most` rows of one length of vector in each row, as binary."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(size: int) -> pd.DataFrame:
            held = waiting.pop(size)
            ids = np.array([h[0] for h in held], dtype=np.int64).tobytes()
            uids = np.array([h[1] for h in held], dtype=np.int64).tobytes()
            return pd.DataFrame({"size": [size], "ids": [ids], "uids": [uids], "vectors": [np.array([h[2] for h in held], dtype=np.int64).tobytes()]})

        for batch in batches:
            for vec_id, uid, vector in zip(batch["vec_id"], batch["uid"], batch["vector"], strict=True):
                held = waiting.setdefault(len(vector), [])
                held.append((vec_id, uid, vector))
                if len(held) >= most:
                    yield block(len(vector))
        for size in list(waiting):
            yield block(size)

    return rows.mapInPandas(blocks, "size int, ids binary, uids binary, vectors binary")


def unpack(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(row["ids"]) // 8
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(n, row["size"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floats where every partial sum is a whole number that they hold."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def pick_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Each next pivot is the sampled vector farthest from those picked."""
    x = sample.astype(float)
    away = np.linalg.norm(x - x.mean(axis=0), axis=1)
    picked = []
    for _ in range(min(most, len(x))):
        picked.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(x - x[picked[-1]], axis=1)) if len(picked) > 1 else np.linalg.norm(x - x[picked[0]], axis=1)
    return x[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x.astype(float) ** 2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x.astype(float) @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def bounds(q: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """An upper bound on the inner product of each query and candidate, rounding allowed for."""
    dq, dx = to_pivots(q, pivots), to_pivots(x, pivots)
    lower = np.zeros((len(q), len(x)))
    for p in range(len(pivots)):
        np.maximum(lower, np.abs(dq[:, p, None] - dx[None, :, p]), out=lower)
    norms = (q.astype(float) ** 2).sum(1)[:, None] + (x.astype(float) ** 2).sum(1)[None, :]
    return (norms - lower**2) / 2 + 1e-6 * norms + 1


def best_of(q, q_uid, floor, x, ids, uids, pivots, k) -> Iterator[tuple[int, int, int]]:
    """(query row, candidate row, score) of each query's k best candidates that reach its floor, by elimination."""
    bound = bounds(q, x, pivots)
    for i in range(len(q)):
        able = np.flatnonzero(bound[i] >= floor[i])
        able = able[np.argsort(-bound[i, able], kind="stable")]
        at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(able), STEP):
            if len(score) >= k and bound[i, able[a]] < score[k - 1]:
                break
            step = able[a : a + STEP]
            step = step[uids[step] != q_uid[i]]
            at, score = np.concatenate([at, step]), np.concatenate([score, products(q[i : i + 1], x[step])[0]])
            order = np.lexsort((ids[at], -score))[:k]
            at, score = at[order], score[order]
        for j, s in zip(at.tolist(), score.tolist(), strict=True):
            if s >= floor[i]:
                yield i, j, s


def top_k(vectors: DataFrame, query: str, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) that the SQL condition `query` picks."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(finite)
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    rows = durable(rows.select("vec_id", "uid", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("vector")))
    sample = rows.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SAMPLE).collect()
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {len(r["vector"]) for r in sample}:
        x = np.array([r["vector"] for r in sample if len(r["vector"]) == size], dtype=np.int64).reshape(-1, size)
        seeds[size] = x, np.array([r["uid"] for r in sample if len(r["vector"]) == size]), pick_pivots(x, PIVOTS)
    seed = spark.sparkContext.broadcast(seeds)  # SAMPLE vectors at most
    asked = rows.where(query)
    n_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    queries = durable(pack(asked.repartition(n_blocks, "uid"), QUERY_ROWS).withColumn("q", F.monotonically_increasing_id()))
    numbers = queries.select("q", F.col("size").alias("q_size"))
    candidates = durable(pack(rows, CANDIDATE_ROWS).withColumn("c", F.monotonically_increasing_id()))
    pairs = candidates.select("c", F.col("size").alias("c_size")).join(F.broadcast(numbers) if n_blocks <= 10_000 else numbers, F.col("c_size") == F.col("q_size")).select("c", "q")
    left = pairs.join(candidates, "c")
    right = pairs.select(F.col("c").alias("c2"), F.col("q").alias("q2")).join(queries.select(F.col("q").alias("q2"), *(F.col(n).alias(n) for n in ("size", "ids", "uids", "vectors"))), "q2")

    def search(_: tuple, cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, c), (_, b) in zip(cs.iterrows(), qs.iterrows(), strict=True):
            ids, uids, x = unpack(c)
            q_ids, q_uids, q = unpack(b)
            known, known_uids, pivots = seed.value.get(c["size"], (x[:1], uids[:1], x[:1].astype(float)))
            first = products(q, known)
            first[q_uids[:, None] == known_uids[None, :]] = np.iinfo(np.int64).min
            floor = np.partition(first, -k, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
            out += [(q_uids[i], q_ids[i], ids[j], s) for i, j, s in best_of(q, q_uids, floor.astype(float), x, ids, uids, pivots, k)]
        return pd.DataFrame(out, columns=["query_uid", "query_id", "vec_id", "score"])

    found = left.groupBy("c", "q").cogroup(right.groupBy("c2", "q2")).applyInPandas(search, "query_uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


OP3_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
