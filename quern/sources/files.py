"""Local documents: text files and zipped office documents, found in all folders below one."""

from __future__ import annotations

import contextlib
import io
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip

PARAGRAPH = "{http://www.hancom.co.kr/hwpml/2011/paragraph}"
SECTION = re.compile(r"section\d+\.xml$", re.IGNORECASE)


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return df.withColumn("file_name", name).withColumn("title", F.regexp_replace("file_name", r"\.[^.]+$", ""))


def read_txt(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, title, paragraphs): lines that are not empty; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    lines = F.transform(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\r\n|\r|\n"), strip)
    return _named(files.select("path", F.filter(lines, lambda x: x != "").alias("paragraphs"))).select("path", "file_name", "title", "paragraphs")


def _section(stream: IO[bytes]) -> list[tuple[int, str]]:
    """(place, text) of the paragraphs of a section, read as a stream.

    A paragraph within another, as in a table, is one of its own, and its text is also the outer one's: whatever a text element
    holds goes to all paragraphs that are open there.  Elements are let go once they are read.
    """
    open_: list[tuple[int, list[str]]] = []
    out: list[tuple[int, str]] = []
    begun = 0
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        if element.tag == PARAGRAPH + "p":
            if event == "start":
                open_.append((begun, []))
                begun += 1
            else:
                place, parts = open_.pop()
                out.append((place, "".join(parts)))
                if not open_:
                    element.clear()
        elif event == "end" and element.tag == PARAGRAPH + "t":
            for _, parts in open_:
                parts.append(element.text or "")
    return out


def section_paragraphs(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(section, place, text) of a zipped document: white space collapsed, empty ones left out; sections that are no XML have none."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            if SECTION.search(entry.filename):
                with archive.open(entry) as stream, contextlib.suppress(ElementTree.ParseError):
                    for place, text in _section(stream):
                        if said := " ".join(text.split()):
                            yield entry.filename, place, said


def hwpx_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, section, place, text) of *.hwpx: a row for each paragraph."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.hwpx").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *x) for path, content in zip(b.column(0).to_pylist(), b.column(1)) for x in section_paragraphs(content.as_py())]
            kinds = {"path": pa.string(), "section": pa.string(), "place": pa.int32(), "text": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    return files.select("path", "content").mapInArrow(run, "path string, section string, place int, text string")


def read_hwpx(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, title, paragraphs) of *.hwpx: sections in the order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.hwpx").load(folder).select("path")
    rows = F.array_sort(F.collect_list(F.struct("section", "place", "text")))
    said = hwpx_paragraphs(spark, folder).groupBy("path").agg(F.transform(rows, lambda x: x["text"]).alias("paragraphs"))
    out = files.join(said, "path", "left").withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<string>")))
    return _named(out).select("path", "file_name", "title", "paragraphs")


def read_pdf(spark: SparkSession, folder: str, pages: int = 60) -> DataFrame:
    """(path, text) of *.pdf; needs the optional pymupdf on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for df in frames:
            texts = []
            for content in df["content"]:
                text = ""
                if content[:4] == b"%PDF":
                    with fitz.open(stream=content, filetype="pdf") as document:
                        text = "\n".join(document[i].get_text() for i in range(min(pages, len(document))))
                texts.append(re.sub(r"[ \t]+", " ", text))
            yield pd.DataFrame({"path": df["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
