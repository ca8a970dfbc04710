"""Whether data are there and agree, before questions are asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def present(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Which paths exist, in whatever store they name."""
    out = {}
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        out[x] = bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))
    return out


def vectors(rows: DataFrame, meta: DataFrame, dimension: int, key: str = "row_id") -> DataFrame:
    """One row: n_rows, n_meta, dim_min, dim_max, agree (a row of metadata for each vector) and fits (all have the dimension)."""
    sizes = rows.agg(F.count("*").alias("n_rows"), F.min(F.size("embedding")).alias("dim_min"), F.max(F.size("embedding")).alias("dim_max"))
    both = rows.select(key, F.lit(1).alias("v")).join(meta.select(key, F.lit(1).alias("m")), key, "full_outer")
    said = both.agg(F.count("m").alias("n_meta"), F.coalesce(F.bool_and(F.expr("v IS NOT NULL AND m IS NOT NULL")), F.lit(True)).alias("agree"))
    fits = F.coalesce((F.col("dim_min") == dimension) & (F.col("dim_max") == dimension), F.lit(True))
    return sizes.join(said, how="inner").select("n_rows", "n_meta", "dim_min", "dim_max", "agree", fits.alias("fits"))
