"""From chunk texts to facts: articles, terms, citations, organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import patterns as P
from quern.functions import text as T
from quern.operators.resolve import containing, resolve


def articles(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_iri, article_iri, label, chunk_id, ...): of each legal document the first article of each label, also where documents of one
    title and one source have one id."""
    found = chunks.where("unit = '조' AND article_label <> ''").join(documents.where(F.col("family") == P.LEGAL).select("doc_ord", "doc_iri"), "doc_ord")
    nth = F.row_number().over(W.partitionBy("doc_ord", "article_label").orderBy("seq"))
    title = F.coalesce("article_title", F.lit(""))
    return found.withColumn("nth", nth).where("nth = 1").select(
        "doc_ord", "seq", "doc_iri", F.concat("doc_iri", F.lit("_"), T.norm(F.col("article_label"))).alias("article_iri"),
        F.when(title != "", F.concat_ws(" ", "article_label", title)).otherwise(F.col("article_label")).alias("label"), "article_label", "chunk_id",
    )


def citations(chunks: DataFrame) -> DataFrame:
    """(doc_ord, seq, pos, chunk_id, target, nt): every bracketed title."""
    found = chunks.select("doc_ord", "seq", "chunk_id", F.posexplode(F.regexp_extract_all("text", F.lit(P.CITATION), F.lit(1))).alias("pos", "target"))
    return found.withColumn("target", T.strip(F.col("target"))).withColumn("nt", T.norm(F.col("target")))


def resolved_citations(chunks: DataFrame, documents: DataFrame, titles: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Citations with `value`, the document each means, and `external` where that is a statute outside the corpus; others and those of
    the document itself are left out."""
    cited = citations(chunks)
    cited = cited.join(resolve(cited, titles, aliases), "nt", "left")
    external = F.col("value").isNull() & F.col("target").rlike(P.STATUTE_SUFFIX)
    cited = cited.withColumn("external", external).withColumn("value", F.when(external, ids.external(F.col("target"))).otherwise(F.col("value")))
    cited = cited.join(documents.select("doc_ord", "doc_iri"), "doc_ord")
    return cited.where("value IS NOT NULL AND value <> doc_iri")


def external_laws(resolved: DataFrame) -> DataFrame:
    """(iri, label): unresolved statutes, named as they are first."""
    return resolved.where("external").groupBy(F.col("value").alias("iri")).agg(
        F.min_by("target", F.struct("doc_ord", "seq", "pos")).alias("label"), F.min(F.struct("doc_ord", "seq", "pos")).alias("at")
    )


def plain_references(documents: DataFrame, titles: DataFrame, min_len: int = 8, limit: int | None = None, suffix: bool = True) -> DataFrame:
    """(doc_iri, value): titles of min_len characters that stand in a document's normalised text, brackets or none.

    limit: characters of the text that are searched; the whole text by default.
    """
    texts = documents.select("doc_iri", T.norm(F.col("text")).alias("nt"))
    if limit:
        texts = texts.withColumn("nt", F.substring("nt", 1, limit))
    keys = titles.where(F.length("title_norm") >= min_len)
    if suffix:
        keys = keys.where(F.col("title_norm").rlike("(?:" + "|".join(P.TITLE_SUFFIXES) + r")\z"))
    found = containing(texts, "nt", keys.select("title_norm", "value"), "title_norm", min_len, keep=["doc_iri"])
    return found.where("value <> doc_iri").select("doc_iri", "value").distinct()


def terms(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(term_iri, term, definition, doc_iri, chunk_id, ...): numbered definitions in legal documents that have an article for them."""
    gate = documents.where((F.col("family") == P.LEGAL) & F.col("text").rlike(P.DEFINITION_ARTICLE)).select("doc_ord", "doc_iri")
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(P.DEFINITION), F.lit(1)).alias("term"), F.regexp_extract_all("text", F.lit(P.DEFINITION), F.lit(2)).alias("body")
    )
    found = chunks.join(gate, "doc_ord").select("doc_ord", "seq", "doc_iri", "chunk_id", F.posexplode(pairs).alias("pos", "m"))
    found = found.withColumn("term", T.strip(F.col("m.term"))).where((F.col("term") != "") & (F.length("term") <= 30))
    return found.withColumns({"term_iri": ids.term(F.col("term")), "definition": T.definition_sentence(F.col("m.body"))}).drop("m")


def first_terms(found: DataFrame) -> DataFrame:
    """(term_iri, term, definition): as each term is first defined."""
    at = F.struct("doc_ord", "seq", "pos")
    return found.groupBy("term_iri").agg(F.min_by("term", at).alias("term"), F.min_by("definition", at).alias("definition"), F.min(at).alias("at"))


def organisations(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(canon, label, doc_iri, chunk_id, established, ...): every mention that is a name and no piece of a sentence."""
    hits = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(P.ORGANISATION), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(P.ORGANISATION), F.lit(2)).alias("after")
    )
    found = chunks.select("doc_ord", "seq", "chunk_id", F.posexplode(hits).alias("pos", "m"))
    found = found.withColumn("label", T.collapse(F.regexp_replace("m.name", P.ORGANISATION_LEAD, ""))).where(~F.col("label").rlike(P.ORGANISATION_REJECT))
    found = found.withColumn("canon", T.norm(F.col("label"))).where(F.length("canon") >= 5)
    found = found.withColumn("established", F.col("m.after").rlike(P.ESTABLISHED) & ~F.col("m.after").rlike(P.ABOLISHED)).drop("m")
    return found.join(documents.select("doc_ord", "doc_iri"), "doc_ord")


def whole_organisations(mentions: DataFrame, judge=None) -> DataFrame:
    """(canon, label): names that are no part of a longer one, and that `judge` (list of labels -> those kept), if any, lets pass."""
    at = F.struct("doc_ord", "seq", "pos")
    names = mentions.groupBy("canon").agg(F.min_by("label", at).alias("label"))
    longer = names.select(F.col("canon").alias("whole"))
    parts = containing(longer, "whole", names.select("canon"), "canon", 5).where("whole <> canon").select("canon").distinct()
    names = names.join(parts, "canon", "left_anti")
    return names if judge is None else judged(names, judge)


def judged(names: DataFrame, judge) -> DataFrame:
    """The names (canon, label) that `judge` (list of labels -> those kept) lets pass in batches of 40."""

    def gate(frames):
        for df in frames:
            for i in range(0, len(df), 40):
                batch = df.iloc[i : i + 40]
                try:
                    kept = set(judge(batch["label"].tolist()))
                except Exception:  # a failed call lets its batch pass
                    kept = set(batch["label"])
                yield batch[batch["label"].isin(kept)]

    return names.mapInPandas(gate, names.schema)
