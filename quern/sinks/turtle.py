"""Turtle out: prefixes, a blank line, one statement a line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import patterns as P
from quern.functions import text as T


def term(o: Column, kind: Column) -> Column:
    quoted = F.concat(F.lit('"'), T.escape(o), F.lit('"'))
    return F.when(kind == "lit", quoted).when(kind == "date", F.concat(F.lit('"'), o, F.lit('"^^xsd:date'))).otherwise(o)


def lines(triples: DataFrame) -> DataFrame:
    """(ord, value): statements in the order of the graph."""
    return triples.select("ord", F.concat_ws(" ", "s", "p", term(F.col("o"), F.col("kind")), F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str, mode: str = "errorifexists", one_file: bool = False, compression: str | None = None) -> None:
    """Text files in the order of their names; one file only where the graph is known to be small.  A file beside them, first by its name, has the prefixes."""
    out = lines(triples).orderBy("ord").select("value")
    (out.coalesce(1) if one_file else out).write.mode(mode).text(path, compression=compression)
    spark = triples.sparkSession
    head = [f"@prefix {k}: <{v}> ." for k, v in P.PREFIXES.items()] + [""]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(path, compression=compression)


def write_continued(triples: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """The other form: a subject once, its further statements on indented lines.  A subject with more statements than a file holds goes
    on in the next file, where it is named again, so none is gathered in a row."""
    said = F.concat_ws(" ", "p", term(F.col("o"), F.col("kind"))).alias("said")
    dealt = triples.select("s", "ord", said).repartitionByRange("s", "ord").sortWithinPartitions("s", "ord")
    dealt.select("s", "said").mapInArrow(_blocks, "value string").write.mode(mode).text(path, compression=compression)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of (s, said), sorted by s; a line is complete once the next one is known."""
    subject = line = None
    for b in batches:
        if not b.num_rows:
            continue
        s, said = b.columns
        first = pc.fill_null(pc.not_equal(s, pa.concat_arrays([pa.array([subject], s.type), s.slice(0, len(s) - 1)])), True)
        here = pc.if_else(first, pc.binary_join_element_wise(s, said, " "), pc.binary_join_element_wise("   ", said, " "))
        above = pa.concat_arrays([pa.array([line], here.type), here.slice(0, len(s) - 1)])
        ended = pc.binary_join_element_wise(above, pc.if_else(first, ".", ";"), " ")
        yield pa.RecordBatch.from_arrays([ended.slice(1) if line is None else ended], names=["value"])
        subject, line = s[-1].as_py(), here[-1].as_py()
    if line is not None:
        yield pa.RecordBatch.from_arrays([pa.array([f"{line} ."])], names=["value"])
