"""Incremental work: what is not done yet, upserts by key, and a file stream that upserts what arrives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_do(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not done; a null key is never done."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; of rows equal in `order` a change stands before a current row."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def ingest(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Takes in the files that have arrived since the last call and writes the upserted table's next version.

    Versions are folders named by batch; a batch that is run again writes its own version anew, so a lost
    executor or driver leaves no half-applied batch."""

    def apply(batch: DataFrame, number: int) -> None:
        before = batch.select(*batch.columns).limit(0) if number == 0 else spark.read.schema(schema).parquet(f"{target}/v{number - 1}")
        upsert(before, batch, keys, order).write.mode("overwrite").parquet(f"{target}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
