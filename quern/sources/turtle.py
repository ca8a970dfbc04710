"""Turtle in: the statements that our own writer makes, and indented lines that go on with the subject above."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import strip

_UNSPLIT = (".gz", ".deflate", ".zst", ".lz4", ".snappy")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ord, s, p, o, kind) of all files under path; ord.line is a line's split of the file and its place within that.

    Lines are read one by one and pass on their subject in the order they lie in, so no task holds a file.  A split that begins with
    indented lines gets the last subject before it from a table of a row for each split.
    """
    files = spark.read.text(path)
    line = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    lines = _parsed(files.select(F.col("_metadata.file_path").alias("file"), line.alias("line"), F.col("value").alias("raw"))).select("file", "line", "own", "p", "said")
    rows = lines.mapInArrow(_carried, "file string, line struct<split: bigint, n: bigint>, s string, p string, said string")
    if not all(x.endswith(_UNSPLIT) for x in files.inputFiles()):
        ends = lines.groupBy("file", F.col("line.split").alias("split")).agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line.n"))).alias("own"))
        before = F.last("own", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
        ends = ends.select(F.col("file").alias("of"), "split", before.alias("before"), F.lit(True).alias("known"))
        rows = rows.join(F.broadcast(ends), (F.col("file") == F.col("of")) & (F.col("line.split") == F.col("split")), "left")
        lost = F.raise_error(F.lit("a file was split in another way when its subjects were read"))
        rows = rows.withColumn("s", F.when(F.col("s").isNotNull(), F.col("s")).when(F.col("known"), F.col("before")).otherwise(lost))
    return _triples(rows.where("s IS NOT NULL"))


def statements(lines: DataFrame) -> DataFrame:
    """Triples of (file, line, raw), whatever order the rows are in."""
    subject = F.last("own", ignorenulls=True).over(W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return _triples(_parsed(lines).withColumn("s", subject).where("s IS NOT NULL"))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, line, own, p, said) with the subject of the lines above, within a split, where a line has none."""
    at = held = None
    for b in batches:
        file, split = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).field("split").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1).tolist(), b.num_rows]
        subjects = [pa.array([], pa.string())]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                here = b.column(0)[lo].as_py(), int(split[lo])
                held = held if here == at else None
                own = pc.fill_null_forward(pa.concat_arrays([pa.array([held], pa.string()), b.column(2).slice(lo, hi - lo)]))
                at, held = here, own[-1].as_py()
                subjects.append(own.slice(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.concat_arrays(subjects), b.column(3), b.column(4)], names=["file", "line", "s", "p", "said"])


def _parsed(lines: DataFrame) -> DataFrame:
    """Adds own (the subject, if the line has one), p and said to the lines that state anything."""
    rows = lines.where("trim(raw) <> '' AND NOT startswith(raw, '@prefix')")
    body = strip(F.regexp_replace(strip(F.col("raw")), r"[. ;]+$", ""))
    more = F.substring("raw", 1, 1).isin(" ", "\t")
    rows = rows.withColumns({"body": body, "more": more})
    parts = F.when(F.col("more"), F.split("body", r"(?U)\s+", 2)).otherwise(F.split("body", r"(?U)\s+", 3))
    rows = rows.withColumn("parts", parts).where(F.size("parts") == F.when(F.col("more"), 2).otherwise(3))
    return rows.withColumns({"own": F.when(~F.col("more"), F.col("parts")[0]), "p": F.element_at("parts", -2), "said": F.element_at("parts", -1)})


def _triples(rows: DataFrame) -> DataFrame:
    date, lit = F.col("said").rlike(r'^".*"\^\^xsd:date$'), F.col("said").startswith('"')
    kind = F.when(date, "date").when(lit, "lit").when(F.col("said").isin("true", "false"), "bool").otherwise("iri")
    inner = F.regexp_extract("said", r'(?s)^"(.*)"[^"]*$', 1)
    plain = F.replace(F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit('"')), F.lit("\x01"), F.lit("\\")), F.lit("\x02"), F.lit(""))
    return rows.select(F.struct("file", "line").alias("ord"), "s", "p", F.when(kind.isin("lit", "date"), plain).otherwise(F.col("said")).alias("o"), kind.alias("kind"))
