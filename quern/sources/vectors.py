"""Vectors: Parquet, lines of JSON, and matrices of NumPy with a file of metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sinks.store import numbered

SCHEMA = "row_id long, id string, doc string, text string, embedding array<float>"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, doc, text, embedding): lines that are no such object are left out; row_id is the place among the others, by file and line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    rows = lines.withColumn("m", F.from_json("value", "doc string, text string, embedding array<float>")).where("m.embedding IS NOT NULL").drop("value")
    return numbered(rows, "row_id", "file", "block", "line").select("row_id", "m.doc", "m.text", "m.embedding")


def read_npy(spark: SparkSession, matrix: str, meta: str) -> DataFrame:
    """Rows of a .npy matrix, each with the line of its number in a .jsonl of {id, doc, text}.

    Broken lines keep their number, so no later row moves.  A .npy is one file and is read by one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for df in frames:
            for content in df["content"]:
                rows = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000].astype(np.float32)
                    yield pd.DataFrame({"row_id": range(at, at + len(part)), "embedding": list(part)})

    vectors = spark.read.format("binaryFile").load(matrix).select("content").mapInPandas(run, "row_id long, embedding array<float>")
    lines = spark.read.text(meta, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("row_id", "line"))
    said = F.from_json("line", "id string, doc string, text string")
    return vectors.join(lines.select(F.col("row_id").cast("long").alias("row_id"), said.alias("m")), "row_id").select("row_id", "m.id", "m.doc", "m.text", "embedding").where("doc IS NOT NULL")
