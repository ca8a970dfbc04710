"""The document graph: edges, neighbourhoods, seeds, facts and the node index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import patterns as P
from quern.functions import text as T
from quern.sinks.store import stored


def labels(triples: DataFrame) -> DataFrame:
    """(iri, label): the last label of each node."""
    said = triples.where("p = 'rdfs:label' AND kind = 'lit'")
    return said.groupBy(F.col("s").alias("iri")).agg(F.max_by("o", "ord").alias("label"))


def document_nodes(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == "rdf:type") & F.col("o").isin(*P.DOCUMENT_CLASSES)).select(F.col("s").alias("iri")).distinct()


def _label_of(p: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[p], p)


def edges(triples: DataFrame, predicates: tuple[str, ...] = P.WALKED, nodes: DataFrame | None = None, include_external: bool = True) -> DataFrame:
    """(src, dst, via): both directions of the walked edges between documents, each once; via of the last statement."""
    nodes = document_nodes(triples) if nodes is None else nodes
    if not include_external:
        nodes = nodes.join(triples.where("p = 'reg:external'").select(F.col("s").alias("iri")), "iri", "left_anti")
    one = triples.where(F.col("p").isin(*predicates) & (F.col("kind") == "iri")).select("s", "p", "o", "ord")
    one = one.join(nodes.select(F.col("iri").alias("s")), "s", "left_semi").join(nodes.select(F.col("iri").alias("o")), "o", "left_semi")
    both = one.select(F.col("s").alias("src"), F.col("o").alias("dst"), "p", "ord").unionByName(one.select(F.col("o").alias("src"), F.col("s").alias("dst"), "p", "ord"))
    names = P.PREDICATE_LABEL_LIBRARY if predicates == P.WALKED_BY_LIBRARY else P.PREDICATE_LABEL
    return both.groupBy("src", "dst").agg(_label_of(F.max_by("p", "ord"), names).alias("via"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(iri, distance, parent, via): nodes within `hops` of the seeds (iri), by levels; of several parents the smallest.

    Every level is written before the next one reads it: the plan does not grow with the hops."""
    edges = stored(edges)
    seen = seeds.select("iri", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via")).distinct()
    seen = level = stored(seen)
    for hop in range(1, hops + 1):
        step = level.select(F.col("iri").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("iri")).agg(F.min(F.struct("src", "via")).alias("from"))
        fresh = step.join(seen.select("iri"), "iri", "left_anti")
        level = stored(fresh.select("iri", F.lit(hop).alias("distance"), F.col("from.src").alias("parent"), F.col("from.via").alias("via")))
        seen = seen.unionByName(level)
    return seen


def paths(found: DataFrame, names: DataFrame, hops: int = 3) -> DataFrame:
    """Adds label and path (array of 'label –relation→ label' from the seed on) to a neighbourhood."""
    named = stored(found.join(names, "iri", "left").withColumn("label", F.coalesce("label", "iri")))
    up = named.select(F.col("iri").alias("parent"), F.col("label").alias("up_label"))
    named = named.join(up, "parent", "left").withColumn("step", F.concat(F.col("up_label"), F.lit(" –"), F.col("via"), F.lit("→ "), F.col("label")))
    out = named.where("distance = 0").select("iri", "distance", "parent", "label", F.array().cast("array<string>").alias("path"))
    last = out
    for hop in range(1, hops + 1):
        before = last.select(F.col("iri").alias("parent"), F.col("path").alias("before"))
        last = named.where(F.col("distance") == hop).join(before, "parent").select("iri", "distance", "parent", "label", F.concat("before", F.array("step")).alias("path"))
        out = out.unionByName(last)
    return out


def related(found: DataFrame, names: DataFrame, most: int = 50) -> DataFrame:
    """(iri, label, distance): the `most` nearest that are no seeds."""
    return found.where("distance > 0").join(names, "iri", "left").select("iri", F.coalesce("label", "iri").alias("label"), "distance").orderBy("distance", "iri").limit(most)


def scope(found: DataFrame, names: DataFrame, hops: int = 2, most: int = 50) -> DataFrame:
    """(label): the seeds and the related within `hops`."""
    own = found.where("distance = 0").join(names, "iri", "left").select(F.coalesce("label", "iri").alias("label"))
    return own.unionByName(related(found, names, most).where(F.col("distance") <= hops).select("label")).distinct()


def seeds_by_coverage(names: DataFrame, question: Column, most: int = 3, limit: bool = True) -> DataFrame:
    """Labels whose own words stand in the question: by the share of their length, then by the longest."""
    q = T.toknorm(question)
    generic = F.array(*map(F.lit, P.GENERIC_TOKENS))
    core = F.filter(F.transform(F.split(T.strip(F.col("label")), P.SPACE), T.toknorm), lambda t: (F.length(t) >= 2) & ~F.array_contains(generic, t))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, t: n + F.length(t))
    rows = names.withColumn("core", core).withColumn("hit", F.filter("core", lambda t: F.contains(q, t))).where(F.size("hit") > 0)
    rows = rows.withColumns({"coverage": total(F.col("hit")) / total(F.col("core")), "longest": F.array_max(F.transform("hit", F.length))})
    rows = rows.where("coverage >= 0.6 OR longest >= 6").drop("core", "hit")
    return rows.orderBy(F.desc("coverage"), F.desc("longest"), "iri").limit(most) if limit else rows


def seeds_by_overlap(names: DataFrame, question: Column, most: int = 3, limit: bool = True) -> DataFrame:
    """Labels that contain the question or that it contains (5), and their common words (1 each)."""
    q, n = T.norm(question), T.norm(F.col("label"))
    score = F.when(F.contains(q, n) | F.contains(n, q), 5).otherwise(0) + F.size(F.array_intersect(T.tokens(F.col("label")), T.tokens(question)))
    rows = names.withColumn("score", score).where("score > 0")
    return rows.orderBy(F.desc("score"), "iri").limit(most) if limit else rows


def facts(triples: DataFrame, seeds: DataFrame, most: int = 20) -> DataFrame:
    """(prio, fact): relations of the seeds in both directions as sentences, strong ones first."""
    names = labels(triples)
    ko = _label_of(F.col("p"), P.PREDICATE_LABEL)
    said = triples.where(F.col("p").isin(*P.FACT_PREDICATES) & (F.col("kind") == "iri"))
    seed = seeds.join(names, "iri", "left").select("iri", F.coalesce("label", "iri").alias("own"))
    other = names.select(F.col("iri").alias("end"), "label")
    out = said.join(seed, said.s == seed.iri).withColumn("end", F.col("o")).join(other, "end").select(F.concat_ws(" ", "own", ko, "label").alias("fact"), ko.alias("ko"), "ord")
    into = said.join(seed, said.o == seed.iri).withColumn("end", F.col("s")).join(other, "end").select(F.concat_ws(" ", "label", ko, "own").alias("fact"), ko.alias("ko"), "ord")
    prio = F.coalesce(F.create_map(*[F.lit(x) for pair in P.FACT_PRIORITY.items() for x in pair])[F.col("ko")], F.lit(9))
    rows = out.unionByName(into).groupBy("fact", "ko").agg(F.min("ord").alias("ord")).withColumn("prio", prio)
    return rows.groupBy("fact").agg(F.min("prio").alias("prio")).orderBy("prio", "fact").limit(most)


def links(triples: DataFrame) -> DataFrame:
    """The triples between nodes, types left out."""
    return triples.where((F.col("kind") == "iri") & (F.col("p") != "rdf:type"))


def node_index(triples: DataFrame) -> DataFrame:
    """(iri, label, types, attrs, out, in): everything said of every node; schema nodes are left out.

    out and in count the links of each predicate, (p, n): a node that all others cite is a row as short as any.  The links
    themselves are in `ego` and `edge_groups`.
    """
    local = lambda c: F.element_at(F.split(c, ":"), -1)
    is_type, is_label = F.col("p") == "rdf:type", F.col("p").isin("rdfs:label", "skos:prefLabel") & (F.col("kind") == "lit")
    subjects = triples.groupBy(F.col("s").alias("iri")).agg(
        F.max_by(F.when(is_label, F.col("o")), F.when(is_label, F.col("ord"))).alias("label"),
        F.array_sort(F.collect_set(F.when(is_type, local(F.col("o"))))).alias("types"),
    )
    values = triples.where(~is_type & ~is_label & (F.col("kind") != "iri")).groupBy(F.col("s").alias("iri"), "p").agg(F.array_sort(F.collect_list("o")).alias("vals"))
    attrs = values.groupBy("iri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "vals")))).alias("attrs"))

    def counted(end: str, name: str) -> DataFrame:
        each = links(triples).groupBy(F.col(end).alias("iri"), "p").agg(F.count("*").alias("n"))
        return each.groupBy("iri").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias(name))

    nodes = subjects.join(attrs, "iri", "left").join(counted("s", "out"), "iri", "left").join(counted("o", "in"), "iri", "full_outer")
    types = F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit("(untyped)")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<p: STRING, n: BIGINT>>)")
    return nodes.select(
        "iri", F.coalesce("label", local(F.col("iri"))).alias("label"), types.alias("types"),
        F.coalesce("attrs", F.expr("CAST(map() AS MAP<STRING, ARRAY<STRING>>)")).alias("attrs"), F.coalesce("out", none).alias("out"), F.coalesce("in", none).alias("in"),
    ).where(~F.arrays_overlap("types", F.array(*map(F.lit, P.SCHEMA_TYPES))))


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def search(nodes: DataFrame, text: str = "", types: list[str] | None = None) -> DataFrame:
    found = nodes.where(F.contains(F.lower("label"), F.lit(text.lower())))
    return found.where(F.arrays_overlap("types", F.array(*map(F.lit, types)))) if types else found


def page(nodes: DataFrame, number: int, size: int = 100, collation: str | None = None) -> DataFrame:
    order = F.collate(F.col("label"), collation) if collation else F.col("label")
    return nodes.orderBy(order, "iri").offset(max(0, number) * size).limit(size)


def ego(triples: DataFrame, iri: str, most: int = 16) -> DataFrame:
    """(p, other, outgoing): the first neighbours of a node, outgoing ones first; every task keeps `most` rows."""
    said = links(triples)
    both = said.where(F.col("s") == iri).select("p", F.col("o").alias("other"), F.lit(True).alias("outgoing"))
    both = both.unionByName(said.where(F.col("o") == iri).select("p", F.col("s").alias("other"), F.lit(False).alias("outgoing")))
    return both.orderBy(F.desc("outgoing"), "p", "other").limit(most)


def edge_groups(triples: DataFrame, most: int = 200) -> DataFrame:
    """(iri, p, n, shown): a node's outgoing edges by predicate, with the first `most` of them."""
    said = links(triples).select(F.col("s").alias("iri"), "p", "o")
    place = F.row_number().over(W.partitionBy("iri", "p").orderBy("o"))
    shown = said.withColumn("place", place).where(F.col("place") <= most).groupBy("iri", "p").agg(F.array_sort(F.collect_list("o")).alias("shown"))
    return said.groupBy("iri", "p").agg(F.count("*").alias("n")).join(shown, ["iri", "p"])
