"""python -m quern build | classify | ingest | statutes | manuals | embed | stream | ask: the pipelines from a shell."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import hooks
from quern.functions.config import Settings
from quern.operators import chunking, classify, corpus
from quern.plans.build import Graph, with_overlay
from quern.plans.hybrid import HybridSession
from quern.sinks import tables, turtle
from quern.sinks.store import numbered
from quern.sources import chunks, files, payloads, vectors
from quern.streaming import incremental


def _named(said: str):
    """The function of a module:function."""
    module, name = said.split(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in {"build": ["chunks", "out"], "classify": ["chunks", "out"], "ingest": ["folder", "out"], "statutes": ["folder", "out"], "manuals": ["answers", "texts", "out"], "embed": ["chunks", "embedder", "out"], "stream": ["folder", "store", "checkpoint"], "ask": ["chunks", "vectors", "question"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name == "build":
            p.add_argument("--judge", help="module:function, list of organisations' labels -> those kept; KG_ORG_LLM_GATE=0 leaves it out")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    if a.command in ("build", "classify"):
        asked = getattr(a, "judge", None) if Settings.read().judge_organisations else None
        g = Graph(chunks.read(spark, a.chunks), judge=_named(asked) if asked else None)
        typed = classify.typed_edges(g.documents)
        if a.command == "classify":
            typed.orderBy("s", "p", "o").select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.text(f"{a.out}/kg_relations")
            return
        turtle.write(with_overlay(g.triples, typed), f"{a.out}/kg")
        tables.write_stats(g.stats(), f"{a.out}/kg_stats")
        tables.write_stats(classify.stats(g.documents), f"{a.out}/edge_stats")
        tables.write_chunk_nodes(g.chunk_nodes, f"{a.out}/chunk_nodes")
        tables.write_chunk_files(g.annotated(), f"{a.out}/by_document")
    elif a.command == "ingest":
        found = files.read_txt(spark, a.folder).unionByName(files.read_hwpx(spark, a.folder)).withColumn("doc_ord", F.xxhash64("path"))
        tables.write_chunks(corpus.assign_chunk_ids(chunking.local_chunks(found)), a.out, "hwpx_")
    elif a.command == "statutes":
        answers = payloads.read(spark, a.folder).select(F.xxhash64("file_name").alias("doc_ord"), F.regexp_replace("file_name", r"\.json$", "").alias("name"), "payload")
        tables.write_chunks(corpus.assign_chunk_ids(chunking.statute_chunks(answers)), a.out, "law_")
    elif a.command == "manuals":  # Parquet of search answers (query, page, payload) and of attachments' texts (sid, pos, text)
        answers = spark.read.parquet(a.answers)
        found = payloads.manuals(payloads.paged(payloads.hits(answers, "admrul"), answers))
        texts = payloads.readable(spark.read.parquet(a.texts)).join(found.select("sid", "name"), "sid")
        pieces = texts.select(F.xxhash64("sid").alias("doc_ord"), F.col("name").alias("doc_title"), F.posexplode(chunking.chunk_outline(F.col("text"))).alias("seq", "text"))
        tables.write_chunks(corpus.assign_chunk_ids(pieces), a.out, "manual_")
    elif a.command == "embed":  # embedder: module:function, list of texts -> list of vectors
        rows = hooks.embed(chunks.for_embedding(chunks.read(spark, a.chunks)), _named(a.embedder), max_chars=Settings.read().max_chars)
        tables.write_vectors(numbered(rows, "row_id", "doc", "text", "id"), a.out)
    elif a.command == "stream":
        schema = spark.read.parquet(a.folder).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        incremental.follow(spark, a.folder, schema, a.store, a.checkpoint).awaitTermination()
    else:
        g = Graph(chunks.read(spark, a.chunks))
        rows = vectors.read_parquet(spark, a.vectors)
        first = rows.orderBy("row_id").select("embedding").first()[0]
        for event in HybridSession(g.triples, rows, Settings.read()).events(a.question, first):
            print(event, end="")


if __name__ == "__main__":
    main()
