"""The graph of a corpus as one table of triples, with its side tables and counters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import text as T
from quern.operators import corpus, extract
from quern.operators.resolve import aliases, registry
from quern.sinks.store import stored


def _rows(df: DataFrame, stage: int, order: Column, *said: tuple) -> DataFrame:
    """A triple for each (subject, predicate, object, kind) in said; objects that are null are left out.  order: struct of doc, part, seq, pos, name."""
    items = [F.struct(F.lit(i).alias("i"), s.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), o.alias("o"), F.lit(k).alias("kind")) for i, (s, p, o, k) in enumerate(said)]
    out = df.select(order.alias("at"), F.explode(F.array(*items)).alias("t")).where("t.o IS NOT NULL")
    return out.select(F.lit(stage).alias("stage"), "at", F.col("t.i").alias("i"), "t.s", "t.p", "t.o", "t.kind")


def _at(doc=0, part=0, seq=0, pos=0, name="") -> Column:
    c = lambda x, t: (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) and x else F.lit(x)).cast(t)
    return F.struct(c(doc, "long").alias("doc"), c(part, "int").alias("part"), c(seq, "int").alias("seq"), c(pos, "int").alias("pos"), c(name, "string").alias("name"))


@dataclass
class Graph:
    """Everything that is built from chunks; each table is made when first asked for, and written where several read it."""

    chunks: DataFrame
    judge: object = None  # of organisation names: list of labels -> those kept

    def __post_init__(self):
        self.chunks = stored(self.chunks)

    @cached_property
    def documents(self) -> DataFrame:
        return stored(corpus.documents(self.chunks))

    @cached_property
    def titles(self) -> DataFrame:
        return stored(registry(self.documents))

    @cached_property
    def aliases(self) -> DataFrame:
        return stored(aliases(self.documents, self.titles))

    @cached_property
    def articles(self) -> DataFrame:
        return extract.articles(self.chunks, self.documents)

    @cached_property
    def terms(self) -> DataFrame:
        return stored(extract.terms(self.chunks, self.documents))

    @cached_property
    def citations(self) -> DataFrame:
        return stored(extract.resolved_citations(self.chunks, self.documents, self.titles, self.aliases))

    @cached_property
    def plain(self) -> DataFrame:
        """Plain references that are no quoted ones."""
        quoted = self.citations.select("doc_iri", "value").distinct()
        return stored(extract.plain_references(self.documents, self.titles).join(quoted, ["doc_iri", "value"], "left_anti"))

    @cached_property
    def references(self) -> DataFrame:
        return self.citations.select("doc_iri", "value").distinct().unionByName(self.plain)

    @cached_property
    def named(self) -> DataFrame:
        return stored(extract.organisations(self.chunks, self.documents))

    @cached_property
    def mentions(self) -> DataFrame:
        return stored(self.named.drop("label").join(extract.whole_organisations(self.named, self.judge), "canon"))

    @cached_property
    def chunk_links(self) -> DataFrame:
        """(chunk_id, iri): what each chunk says something about, once for each time."""
        parts = [
            self.chunks.where("unit <> '조' OR unit IS NULL").join(self.documents.select("doc_ord", "doc_iri"), "doc_ord").select("chunk_id", F.col("doc_iri").alias("iri")),
            self.articles.select("chunk_id", F.col("article_iri").alias("iri")),
            self.terms.select("chunk_id", F.col("term_iri").alias("iri")),
            self.citations.select("chunk_id", F.col("value").alias("iri")),
            self.mentions.select("chunk_id", ids.organisation(F.col("canon")).alias("iri")),
        ]
        return reduce(DataFrame.unionByName, parts).where("chunk_id IS NOT NULL")

    @cached_property
    def chunk_nodes(self) -> DataFrame:
        return self.chunk_links.groupBy("chunk_id").agg(F.array_sort(F.collect_set("iri")).alias("kg_nodes"))

    def annotated(self) -> DataFrame:
        """Chunks with kg_nodes, empty where nothing was found."""
        return self.chunks.drop("kg_nodes").join(self.chunk_nodes, "chunk_id", "left").withColumn("kg_nodes", F.coalesce("kg_nodes", F.array().cast("array<string>")))

    @cached_property
    def triples(self) -> DataFrame:
        """(ord, s, p, o, kind): kind is iri, lit, date or bool; ord is the place in the written graph."""
        c, type_, label = F.col, "rdf:type", "rdfs:label"
        docs, terms, first = self.documents, self.terms, extract.first_terms(self.terms)
        dated = lambda col: T.iso_date(F.coalesce(F.col(col), F.lit("")))
        published = F.when(c("cls") == "eli:LegalResource", F.lit("eli:date_publication")).otherwise(F.lit("dct:issued"))
        external, mentions = extract.external_laws(self.citations), self.mentions
        org = ids.organisation(c("canon"))
        prose = self.chunks.where("unit <> '조' OR unit IS NULL").join(docs.select("doc_ord", "doc_iri"), "doc_ord")
        per_doc = mentions.groupBy("canon", "doc_iri").agg(F.min("doc_ord").alias("doc_ord"), F.bool_or("established").alias("established"))
        parts = [
            _rows(self.aliases, 0, _at(c("at.doc_ord"), 0, 0, c("at.pos")), (c("iri"), "skos:altLabel", c("surface"), "lit")),
            _rows(docs, 1, _at("doc_ord", 0), (c("doc_iri"), type_, c("cls"), "iri"), (c("doc_iri"), label, c("title"), "lit"), (c("doc_iri"), "dct:type", F.when(c("doc_type") != "", c("doc_type")).otherwise(c("family")), "lit")),
            _rows(prose, 1, _at("doc_ord", 1, "seq"), (c("doc_iri"), "dct:identifier", c("chunk_id"), "lit")),
            _rows(docs, 1, _at("doc_ord", 2), (c("doc_iri"), published, dated("enacted"), "date"), (c("doc_iri"), "dct:modified", dated("amended"), "date")),
            _rows(
                self.articles, 1, _at("doc_ord", 3, "seq"), (c("article_iri"), type_, F.lit("eli:LegalResourceSubdivision"), "iri"), (c("article_iri"), label, c("label"), "lit"),
                (c("doc_iri"), "eli:has_part", c("article_iri"), "iri"), (c("article_iri"), "dct:identifier", c("chunk_id"), "lit"),
            ),
            _rows(
                first, 1, _at(c("at.doc_ord"), 4, c("at.seq"), c("at.pos")), (c("term_iri"), type_, F.lit("skos:Concept"), "iri"),
                (c("term_iri"), "skos:prefLabel", c("term"), "lit"), (c("term_iri"), "skos:definition", c("definition"), "lit"),
            ),
            _rows(terms.groupBy("term_iri", "doc_iri").agg(F.min(F.struct("doc_ord", "seq", "pos")).alias("at")), 1, _at(c("at.doc_ord"), 5, c("at.seq"), c("at.pos")), (c("term_iri"), "rdfs:isDefinedBy", c("doc_iri"), "iri")),
            _rows(
                external, 1, _at(c("at.doc_ord"), 6, c("at.seq"), c("at.pos")), (c("iri"), type_, F.lit("eli:LegalResource"), "iri"),
                (c("iri"), label, c("label"), "lit"), (c("iri"), "reg:external", F.lit("true"), "bool"),
            ),
            _rows(mentions.groupBy("canon").agg(F.min("label").alias("label")), 2, _at(0, 0, 0, 0, "canon"), (org, type_, F.lit("org:Organization"), "iri"), (org, label, c("label"), "lit")),
            _rows(per_doc, 2, _at("doc_ord", 1, 0, 0, "canon"), (org, "reg:mentionedIn", c("doc_iri"), "iri"), (org, "reg:establishedBy", F.when(c("established"), c("doc_iri")), "iri")),
            _rows(mentions.select("canon", "chunk_id").distinct(), 2, _at(0, 2, 0, 0, F.concat("canon", "chunk_id")), (org, "dct:identifier", c("chunk_id"), "lit")),
            _rows(terms.select("term_iri", "chunk_id").distinct(), 3, _at(0, 0, 0, 0, F.concat("term_iri", "chunk_id")), (c("term_iri"), "dct:identifier", c("chunk_id"), "lit")),
            _rows(self.references, 4, _at(0, 0, 0, 0, F.concat("doc_iri", "value")), (c("doc_iri"), "dct:references", c("value"), "iri")),
        ]
        said = reduce(DataFrame.unionByName, parts)
        # organisations are written name by name
        name_first = F.when(c("stage") == 2, c("at.name")).otherwise("")
        return stored(said.select(F.struct("stage", name_first.alias("name"), "at", "i").alias("ord"), "s", "p", "o", "kind"))

    def stats(self) -> DataFrame:
        """(counter, n)."""
        count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        mentions, triples = self.mentions, self.triples
        per_doc = mentions.groupBy("canon", "doc_iri").agg(F.bool_or("established").alias("e"))
        whole = stored(extract.whole_organisations(self.named))
        prose = self.chunks.where("(unit <> '조' OR unit IS NULL) AND chunk_id IS NOT NULL")
        linked = [prose.select("chunk_id"), self.articles.where("chunk_id IS NOT NULL").select("chunk_id")]
        said = [self.terms.select("term_iri", "chunk_id"), mentions.select("canon", "chunk_id")]
        said = [x.where("chunk_id IS NOT NULL").distinct().select("chunk_id") for x in said]
        parts = [
            count(self.documents, "documents"), count(self.documents.where("nth > 1"), "doc_title_collisions"), count(self.aliases, "aliases"),
            count(self.articles, "articles"), count(triples.where("kind = 'date'"), "dates"), count(self.terms.select("term_iri").distinct(), "def_terms"),
            count(self.citations.where("external").select("value").distinct(), "ext_refs_unique"), count(self.references, "cite_edges"),
            count(self.plain, "plaintext_refs"), count(self.citations, "chunk_cite_links"), count(per_doc.select("canon").distinct(), "orgs"),
            count(per_doc.where("e"), "org_established"), count(self.named.select("canon").distinct().join(whole, "canon", "left_anti"), "org_fragments_dropped"),
            count(whole.join(mentions, "canon", "left_anti"), "org_llm_dropped"),
            count(reduce(DataFrame.unionByName, linked), "chunk_links"), count(reduce(DataFrame.unionByName, said), "chunk_attr_links"),
            count(self.chunk_nodes, "chunks_annotated"), count(triples, "triples"),
        ]
        return reduce(DataFrame.unionByName, parts)


def with_overlay(triples: DataFrame, typed: DataFrame) -> DataFrame:
    """A graph and its typed edges (s, p, o), which come last."""
    blank = F.struct(F.lit(0).cast("long").alias("doc"), F.lit(0).alias("part"), F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.lit("").alias("name"))
    last = F.struct(F.lit(9).alias("stage"), F.concat_ws(" ", "s", "p", "o").alias("name"), blank.alias("at"), F.lit(0).alias("i"))
    return triples.unionByName(typed.select(last.alias("ord"), "s", "p", "o", F.lit("iri").alias("kind")))
