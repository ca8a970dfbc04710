"""Tables between stages, written once to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset, a folder of our own, but only if driver and executors are
    one process; on a cluster each executor would write to its own disk, so that is refused."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "quern") -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read from a table: later jobs start there, and so does recovery from a lost executor."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds `name`, the place of each row from 0 in an order that leaves no ties.

    Rows are sorted by range and written; then only a count for each partition is needed, so no task sees all rows.
    """
    rows = stored(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, told = 0, []
    for k, n in counts:
        told.append((k, before))
        before += n
    told = df.sparkSession.createDataFrame(told, "__part long, __before long")
    # a row for each partition
    rows = rows.join(F.broadcast(told), part == told["__part"])
    return rows.withColumn(name, F.col("__before") + F.expr("__id & 8589934591")).drop("__id", "__part", "__before")
