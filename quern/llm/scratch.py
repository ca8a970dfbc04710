"""Intermediate tables in the folder that the cluster shares, and connected components on them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
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


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written for one run of an operator.  A written table is read by later jobs in place of
    its lineage, so a lost executor costs no more than the job at hand."""

    _roots: list[tuple[str, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        self.n = 0
        self._roots.append((spark.sparkContext.applicationId, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes kept tables, once nothing reads them any more."""
        for df in tables:
            _delete(self.spark, df._scratch_path)

    @classmethod
    def made(cls) -> int:
        return len(cls._roots)

    @classmethod
    def clear(cls, spark: SparkSession, since: int = 0) -> None:
        """Removes the tables of runs that began after the first `since`.  Results of operators read them: call it once those are written."""
        for app, root in cls._roots[since:]:
            if app == spark.sparkContext.applicationId:
                _delete(spark, root)
        del cls._roots[since:]


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, component) for the ends of undirected `edges` (a, b); component is the smallest node reachable.

    Alternating large and small stars: every round is two aggregations and two equi-joins, the number
    of edges never grows, and the rounds are logarithmic in the longest path.  Each round is written to
    the shared folder.
    """
    e = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = e.select("u").distinct().join(least, "u").where("m < u").select("u", F.col("m").alias("v"))
        large = large.unionByName(own).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        said = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old, e = e, new
        scratch.drop(old)
        if said == seen:
            break
        seen = said
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
