"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space; bytes.split() cuts the same runs out of UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one rank bucket; a key with more rows is ranked in several buckets, by several tasks.
BUCKET_ROWS = 4000
#: Narrow rows (links, pairs) that one task takes.
TASK_ROWS = 20_000
#: Bytes of input that a Python worker turns into objects at a time, about.
SLICE_BYTES = 1 << 20
#: Arrow's name of each type that the operators' own columns have.
ARROW = {
    "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir. Only a session on one machine may have none set (as in
    tests); it gets a temporary one. On a cluster that would be a disk which executors don't share: an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parcela-checkpoint-"))
    return df.checkpoint()


def tasks_for(rows: int) -> int:
    """Tasks for a table of narrow rows: few for a small one, so that it is not spread over hundreds of files."""
    return -(-rows // TASK_ROWS) or 1


def slices(batches: Iterator[pa.RecordBatch], inputs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in turn, few enough at a time that their inputs hold about SLICE_BYTES, so that a worker's memory does not hang on the length of texts."""
    for batch in batches:
        size = sum(batch.column(c).nbytes for c in inputs)
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(size, 1)))
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def map_rows(df: DataFrame, inputs: Sequence[str], compute: Callable, fields: Mapping[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all, if None) and the `fields` (name and type) that compute makes of the `inputs`.

    compute takes a list of values for each input and returns, for some rows, which rows they are (indexes, a
    row as often as it is wanted; None: all rows as they stand) and a list of values for each field. Kept
    columns pass as Arrow arrays, never through pandas: a null among longs leaves the others whole.
    """
    kept = list(df.columns if keep is None else keep)
    schema = T.StructType([*(df.schema[c] for c in kept), *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items())).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, inputs):
            which, *made = compute(*(batch.column(c).to_pylist() for c in inputs))
            columns = [batch.column(c) if which is None else batch.column(c).take(pa.array(which, pa.int64())) for c in kept]
            columns += [pa.array(values, ARROW[t]) for values, t in zip(made, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *fields])

    return df.mapInArrow(rows, schema)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def n_words(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_ranks(rows: DataFrame, keys: Sequence[str], key_rows: str, order: Sequence[str], copies: str, rank: str) -> DataFrame:
    """Adds to each row its rank from 0 among the rows of its key, a row of c copies taking c ranks (rank is the first).

    key_rows names the column with the key's number of rows. A key is dealt into buckets of about
    BUCKET_ROWS rows by a hash of `order`; the bucket totals, far fewer than the rows, give each bucket
    its first rank, and only inside a bucket are rows sorted. So no task sees a whole hot key. `rows`
    is read twice and should be durable. The rank follows from the values alone, not from their layout.
    """
    by = [*keys, "_bucket"]
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("rank"), *order), F.ceil(F.col(key_rows) / F.lit(BUCKET_ROWS))))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by).agg(F.sum(copies).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_start")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(starts, same)
        .withColumn(rank, F.col("_start") + F.coalesce(F.sum(copies).over(earlier), F.lit(0)))
        .drop("_bucket", "_start", *(f"_k{i}" for i in range(len(by))))
    )
