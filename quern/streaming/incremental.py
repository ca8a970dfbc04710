"""Chunks that are new or changed, in batches and as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids


def changed(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose (chunk_id, content_hash) is not among those known; content_hash is added."""
    rows = chunks.withColumn("content_hash", ids.content_hash(F.col("text")))
    return rows.join(known.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def follow(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None):
    """Starts a stream over Parquet chunk files: what each batch changes is handed on and appended to the store of known hashes.

    The store is written under the number of its batch, so a batch that is run again after a failure replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        known = session.createDataFrame([], "chunk_id string, content_hash string")
        path = session._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            # the batch itself may have been written before
            known = session.read.parquet(store).where(F.col("batch") != number)
        new = changed(df, known).dropDuplicates(["chunk_id", "content_hash"])
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")
        if handle:
            handle(session.read.parquet(f"{store}/batch={number}"), number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
