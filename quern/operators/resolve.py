"""Titles, aliases and containment: no pair of a text and a key is ever tested without need.

Keys of few characters in all, as titles and aliases are, are sent to the texts: an automaton of all keys reads each
text once where it lies, so texts are not shuffled.  The characters are counted first.  More keys go in several rounds, and
beyond ROUNDS of them containment becomes an equi-join on grams: each key waits under the rarest of its grams, and only
texts with that gram are confirmed by `contains`.  Rows are the same either way, which tests compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions import patterns as P
from quern.functions.text import norm, strip

#: Characters of the keys that one automaton holds, and automata that texts are read by at most.
AUTOMATON, ROUNDS = 1_000_000, 8


def grams(c: Column, size: int) -> Column:
    """The substrings of `size` characters, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(.{%d}))" % size), F.lit(1))


def containing(texts: DataFrame, text: str, keys: DataFrame, key: str, size: int, keep: list[str] | None = None) -> DataFrame:
    """Rows of texts (the columns `keep`, all by default) and keys where texts.text contains keys.key; keys shorter than `size` take no part."""
    keep = keep if keep is not None else texts.columns
    right = keys.where(F.length(key) >= size)
    chars = right.select(key).distinct().agg(F.sum(F.length(key))).first()[0]
    if not chars:
        return texts.select(*keep).join(right, F.lit(False))
    rounds = -(-chars // AUTOMATON)
    if rounds > ROUNDS:
        return _by_rarest_gram(texts, text, right, key, size).select(*keep, *right.columns)
    found = None
    for r in range(rounds):
        part = right.select(key).distinct().where(F.pmod(F.xxhash64(key), F.lit(rounds)) == r)
        hits = _scan(texts, text, [x[0] for x in part.collect()], keep)
        found = hits if found is None else found.unionByName(hits)
    return found.join(right.withColumnRenamed(key, "__key"), "__key").withColumnRenamed("__key", key).select(*keep, *right.columns)


def _scan(texts: DataFrame, text: str, keys: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` and __key, a row for each key that a text contains."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k in shared.value:
            automaton.add_word(k, k)
        if shared.value:
            automaton.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, t in enumerate(b.column(len(keep))):
                found = sorted({k for _, k in automaton.iter(t.as_py())}) if t.is_valid and shared.value else []
                rows += [i] * len(found)
                hits += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), pa.array(hits, pa.string())], names=[*keep, "__key"])

    inner = texts.select(*keep, F.col(text).alias("__text"))
    return inner.mapInArrow(run, StructType([*inner.select(*keep).schema]).add("__key", "string"))


def _by_rarest_gram(texts: DataFrame, text: str, keys: DataFrame, key: str, size: int) -> DataFrame:
    """The same by an equi-join: of a key's grams the one that fewest keys have is its anchor.

    Grams travel with a hash of their text, not with the text; only texts with an anchor are joined again.
    """
    own = keys.select(F.col(key).alias("__key")).distinct().withColumn("__gram", F.explode(F.array_distinct(grams(F.col("__key"), size))))
    often = own.groupBy("__gram").agg(F.count("*").alias("__often"))
    anchors = own.join(often, "__gram").groupBy("__key").agg(F.min_by("__gram", F.struct("__often", "__gram")).alias("__gram"))
    found = texts.select(F.xxhash64(text).alias("__hash"), F.explode(F.array_distinct(grams(F.col(text), size))).alias("__gram"))
    found = found.join(anchors.select("__gram").distinct(), "__gram", "left_semi").distinct()
    pairs = found.join(anchors, "__gram").drop("__gram")
    out = texts.withColumn("__hash", F.xxhash64(text)).join(pairs, "__hash").where(F.contains(F.col(text), F.col("__key"))).drop("__hash")
    return out.join(keys.withColumnRenamed(key, "__key"), "__key").withColumnRenamed("__key", key)


def registry(documents: DataFrame) -> DataFrame:
    """(title_norm, value, doc_ord): of each normalised title the first document."""
    return documents.groupBy("title_norm").agg(F.min_by("doc_iri", "doc_ord").alias("value"), F.min("doc_ord").alias("doc_ord"))


def resolve(wanted: DataFrame, titles: DataFrame, aliases: DataFrame | None = None, min_len: int = 4) -> DataFrame:
    """Adds `value` to the different strings in wanted.nt (normalised citations): of the title that equals it, or the alias, or the
    first title that contains it or that it contains if it has min_len characters.  Empty titles match nothing."""
    names = titles.where("title_norm <> ''").select(F.col("title_norm").alias("t"), F.col("value").alias("v"), "doc_ord")
    found = wanted.select("nt").distinct().join(names.select(F.col("t").alias("nt"), F.col("v").alias("exact")), "nt", "left")
    if aliases is not None:
        found = found.join(aliases.select(F.col("alias_norm").alias("nt"), F.col("iri").alias("alias")), "nt", "left")
    else:
        found = found.withColumn("alias", F.lit(None).cast("string"))
    rest = found.where(F.col("exact").isNull() & F.col("alias").isNull() & (F.length("nt") >= min_len)).select("nt")
    inside = containing(names, "t", rest, "nt", min_len).select("nt", "v", "doc_ord")
    around = containing(rest, "nt", names, "t", 1).select("nt", "v", "doc_ord")
    fuzzy = inside.unionByName(around).groupBy("nt").agg(F.min_by("v", "doc_ord").alias("fuzzy"))
    return found.join(fuzzy, "nt", "left").select("nt", F.coalesce("exact", "alias", "fuzzy").alias("value"))


def aliases(documents: DataFrame, titles: DataFrame) -> DataFrame:
    """(alias_norm, iri, surface): short forms that a document introduces for the full title of another; the first wins."""
    full = F.regexp_extract_all("text", F.lit(P.ALIAS), F.lit(1))
    short = F.regexp_extract_all("text", F.lit(P.ALIAS), F.lit(2))
    said = documents.select("doc_ord", F.posexplode(F.arrays_zip(full.alias("full"), short.alias("short"))).alias("pos", "m")).select(
        "doc_ord", "pos", strip(F.col("m.full")).alias("full"), strip(F.col("m.short")).alias("surface")
    )
    said = said.withColumns({"nt": norm(F.col("full")), "alias_norm": norm(F.col("surface"))})
    said = said.where((F.length("alias_norm") >= 3) & ~F.col("alias_norm").isin(*P.GENERIC_ALIASES))
    said = said.join(titles.select(F.col("title_norm").alias("alias_norm")), "alias_norm", "left_anti")
    known = said.join(resolve(said, titles), "nt").where("value IS NOT NULL")
    first = F.struct("doc_ord", "pos")
    return known.groupBy("alias_norm").agg(F.min_by("value", first).alias("iri"), F.min_by("surface", first).alias("surface"), F.min(first).alias("at"))
