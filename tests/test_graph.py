import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import ids
from quern.operators import classify, corpus, extract, graph, vector
from quern.operators.resolve import containing, resolve
from quern.plans.build import Graph, with_overlay
from quern.plans.hybrid import HybridSession
from quern.sinks.store import stored

COLUMNS = [c.split()[0] for c in corpus.CHUNKS.split(", ")]


def chunks(spark, *docs):
    """Documents as (title, family, texts or (label, text) pairs), with other fields by name in a dict at the end."""
    rows = []
    for n, (title, family, texts, *more) in enumerate(docs):
        extra = more[0] if more else {}
        for seq, t in enumerate(texts):
            label, text = t if isinstance(t, tuple) else ("", t)
            rows.append((n, f"{n}.json", seq, title, extra.get("source", f"규정_{n}.json"), family, "", extra.get("enacted", ""), extra.get("amended", ""), "조" if label else "본문", label, "", text))
    names = ", ".join(c for c in corpus.CHUNKS.split(", ") if not c.startswith(("chunk_id", "content_hash")))
    return corpus.assign_chunk_ids(spark.createDataFrame(rows, names)).select(*COLUMNS)


def said(g, *predicates):
    return {(r.s, r.p, r.o) for r in g.triples.where(F.col("p").isin(*predicates)).collect()}


def iri(spark, title, kind=ids.document):
    return spark.range(1).select(kind(F.lit(title))).first()[0]


def test_citations_resolve_in_order(spark):
    g = Graph(chunks(
        spark, ("신용보증규정", "법규체", ["「신용보증」 「외부특별법」 「보증」 「신용보증규정」"]), ("신용보증요령", "법규체", ["「신용보증」을 본다. 평문 신용보증규정에 따른다"]),
        ("가나다라마바사아규정", "법규체", ["본문"]), ("다른문서", "공문체", ["가나다라 마바사아규정 참조", "「기금법」(이하 「기금」이라 한다)"]),
    ))
    a, b, c, d = (iri(spark, t) for t in ("신용보증규정", "신용보증요령", "가나다라마바사아규정", "다른문서"))
    ext = iri(spark, "외부특별법", ids.external)
    fund = iri(spark, "기금법", ids.external)
    assert said(g, "dct:references") == {(a, "dct:references", ext), (b, "dct:references", a), (d, "dct:references", c), (d, "dct:references", fund)}
    assert (ext, "reg:external", "true") in said(g, "reg:external") and (ext, "rdf:type", "eli:LegalResource") in said(g, "rdf:type")


def test_aliases_lead_to_the_full_title(spark):
    g = Graph(chunks(spark, ("신용보증기금법", "법규체", ["본문"]), ("감사규정집", "법규체", ["「신용보증기금법」(이하 「기금법률」이라 한다) 그리고 「기금법률」 제1조"])))
    assert [(r.alias_norm, r.surface) for r in g.aliases.collect()] == [("기금법률", "기금법률")]
    assert (iri(spark, "신용보증기금법"), "skos:altLabel", "기금법률") in said(g, "skos:altLabel")
    assert g.citations.where("external").count() == 0


def test_terms_end_at_numbered_lines(spark):
    text = '제2조(정의) 1. "보증"이란 채무를 말한다.\n2. “기금”이라 함은 재산을 말한다. 끝'
    g = Graph(chunks(spark, ("보증규정", "법규체", [("제2조", text)]), ("보증법규", "법규체", [("제2조", text.replace("\n", " "))]), ("보증문서", "공문체", [text])))
    got = {(r.doc_ord, r.term, r.definition) for r in g.terms.collect()}
    assert got == {(0, "보증", "채무를 말한다."), (0, "기금", "재산을 말한다."), (1, "보증", "채무를 말한다.")}
    assert len(said(g, "rdfs:isDefinedBy")) == 3 and len(said(g, "skos:prefLabel")) == 2


def test_organisations(spark):
    g = Graph(chunks(spark, ("기관규정", "법규체", ["기술평가위원회를 둔다. 기술3평가위원회 관리위원회 리스크관리위원회는 운영한다", "여신운영위원회는 폐지한다. 제16조에 따른심의위원회"])))
    got = {r.canon: r.established for r in g.mentions.groupBy("canon").agg(F.bool_or("established").alias("established")).collect()}
    assert got == {"기술평가위원회": True, "리스크관리위원회": True, "여신운영위원회": False}
    kept = Graph(g.chunks, judge=lambda names: [n for n in names if n != "기술평가위원회"])
    assert {r.canon for r in kept.mentions.select("canon").distinct().collect()} == {"리스크관리위원회", "여신운영위원회"}


def test_same_titles_stay_apart(spark):
    g = Graph(chunks(spark, ("감사규정집", "법규체", ["가"], {"source": "a.json"}), ("감사 규정집", "법규체", ["나"], {"source": "b.json"}), ("다른문서", "공문체", ["「감사규정집」"])))
    nodes = [r.doc_iri for r in g.documents.orderBy("doc_ord").collect()]
    assert len(set(nodes)) == 3 and said(g, "dct:references") == {(nodes[2], "dct:references", nodes[0])}
    stats = {r.counter: r.n for r in g.stats().collect()}
    assert stats["doc_title_collisions"] == 1 and stats["documents"] == 3 and stats["cite_edges"] == 1


def test_dates_articles_and_notes(spark):
    g = Graph(chunks(spark, ("감사규정집", "법규체", [("제1조", "가"), ("제1조", "나"), ("제2조", "다"), "라"], {"enacted": "2023. 5. 1.", "amended": "’24.1.2"})))
    d = iri(spark, "감사규정집")
    assert said(g, "eli:date_publication", "dct:modified") == {(d, "eli:date_publication", "2023-05-01"), (d, "dct:modified", "2024-01-02")}
    assert {o for _, p, o in said(g, "eli:has_part")} == {d + "_제1조", d + "_제2조"}
    notes = {r.seq: r.kg_nodes for r in g.annotated().collect()}
    assert notes == {0: [d + "_제1조"], 1: [], 2: [d + "_제2조"], 3: [d]}


def test_typed_edges_and_gates(spark):
    docs = corpus.documents(chunks(
        spark, ("감사업무규정", "법규체", ["「보증업무규정」 및 「심사업무기준」의 예에 준용. 「상위업무규정」을 준용하지 아니한다. 개정 위임 근거 보증업무규정"]),
        ("보증업무규정", "법규체", ["「심사업무기준」을 준용한다"]), ("심사업무기준", "법규체", ["가"]), ("상위업무규정", "법규체", ["나"]),
    ))
    a, b = iri(spark, "감사업무규정"), iri(spark, "보증업무규정")
    assert {tuple(r) for r in classify.typed_edges(docs).collect()} == {(a, "eli:applies", b)}
    assert {(r.src, r.accepted) for r in classify.applied(docs).collect()} == {("감사업무규정", True), ("보증업무규정", False)}
    made = [
        ("보증업무규정", "applies", "개정 위임 근거"), ("보증업무규정", "cites", ""), ("심사업무기준", "based_on", "위임"), ("없는문서", "cites", "근거"),
        ("보증업무규정", "amends", "개정"), ("보증업무규정", "other", "근거"), ("보증업무규정", "applies", "의 예에 준용"),
    ]
    rows = spark.createDataFrame([("감사업무규정", *m) for m in made], "src_title string, target string, relation string, evidence string")
    got = sorted((r.target, r.pred or "", r.evidence, r.outcome) for r in classify.gate(rows, docs).collect())
    assert got == sorted([
        ("보증업무규정", "eli:cites", "개정 위임 근거", "kept"), ("보증업무규정", "eli:cites", "", "rej_evidence"), ("심사업무기준", "eli:based_on", "위임", "rej_direction"),
        ("없는문서", "eli:cites", "근거", "rej_unknown"), ("보증업무규정", "eli:amends", "개정", "kept"), ("보증업무규정", "", "근거", "rej_unknown"), ("보증업무규정", "eli:applies", "의 예에 준용", "kept"),
    ])
    cache = docs.where("doc_ord = 1").select(F.col("title").alias("src_title"), ids.content_hash(F.col("text")).alias("content_hash"))
    assert {r.src_title for r in classify.missing_proposals(docs, cache).collect()} == {"감사업무규정"}


def test_containment_is_the_nested_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("가나다ab") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(60)]
    keys = [(i, word(rng.randint(1, 6))) for i in range(80)]
    t, k = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(keys, "k int, key string")
    got = {(r.t, r.k) for r in containing(t, "text", k, "key", 3).collect()}
    assert got == {(i, j) for i, x in texts for j, y in keys if len(y) >= 3 and y in x} and got
    names = k.selectExpr("key AS title_norm", "concat('v', k) AS value", "k AS doc_ord").dropDuplicates(["title_norm"])
    known = {r.title_norm: (r.doc_ord, r.value) for r in names.collect()}
    wanted = {x[:7] for _, x in texts if x} | {word(2)}
    for r in resolve(spark.createDataFrame([(w,) for w in wanted], "nt string"), names, min_len=4).collect():
        want = known.get(r.nt, (0, None))[1]
        if want is None and len(r.nt) >= 4:
            want = min(((o, v) for n, (o, v) in known.items() if n in r.nt or r.nt in n), default=(0, None))[1]
        assert r.value == want


@pytest.fixture(scope="module")
def small(spark):
    g = Graph(chunks(
        spark, ("감사업무규정", "법규체", ["「보증업무규정」을 준용한다 「공통특별법」"]), ("보증업무규정", "법규체", ["「심사업무기준」"]),
        ("심사업무기준", "법규체", ["가"]), ("멀리있는지침", "공문체", ["「공통특별법」"]),
    ))
    return stored(with_overlay(g.triples, classify.typed_edges(g.documents)))


def test_neighbourhood_paths_and_facts(spark, small):
    names, edges = graph.labels(small), graph.edges(small)
    seed = spark.createDataFrame([(iri(spark, "감사업무규정"),)], "iri string")
    found = graph.neighbourhood(edges, seed)
    label = {r.iri: r.label for r in names.collect()}
    assert {label[r.iri]: r.distance for r in found.collect()} == {"감사업무규정": 0, "보증업무규정": 1, "공통특별법": 1, "심사업무기준": 2, "멀리있는지침": 2}
    assert {label[r.iri]: r.distance for r in graph.neighbourhood(graph.edges(small, include_external=False), seed).collect()}.get("멀리있는지침") is None
    path = {r.label: r.path for r in graph.paths(found, names).collect()}
    assert path["심사업무기준"] == ["감사업무규정 –준용→ 보증업무규정", "보증업무규정 –참조→ 심사업무기준"] and path["감사업무규정"] == []
    assert [r.fact for r in graph.facts(small, seed).collect()] == ["감사업무규정 준용 보증업무규정", "감사업무규정 참조 공통특별법", "감사업무규정 참조 보증업무규정"]
    assert {r.label for r in graph.scope(found, names, hops=1).collect()} == {"감사업무규정", "보증업무규정", "공통특별법"}
    library = graph.edges(small, graph.P.WALKED_BY_LIBRARY)
    assert {label[r.iri] for r in graph.neighbourhood(library, seed).collect()} == {"감사업무규정", "보증업무규정"}


def test_seeds(spark, small):
    names = graph.labels(small)
    got = graph.seeds_by_coverage(names, F.lit("「감사업무규정」 절차")).collect()
    assert [(r.label, r.coverage) for r in got] == [("감사업무규정", 1.0)]
    assert [r.score for r in graph.seeds_by_overlap(names, F.lit("감사업무규정 절차")).collect()] == [6]


def test_node_index_and_pages(spark, small):
    nodes = stored(graph.node_index(small))
    law = nodes.where("label = '공통특별법'").first()
    assert law.types == ["LegalResource"] and law.attrs == {"reg:external": ["true"]} and [tuple(x) for x in law["in"]] == [("dct:references", 2)] and law.out == []
    assert {r.type: r.n for r in graph.type_histogram(nodes).collect()} == {"LegalResource": 5}
    assert [r.label for r in graph.page(graph.search(nodes, "업무"), 0, 2).collect()] == ["감사업무규정", "보증업무규정"]
    first = graph.ego(small, iri(spark, "보증업무규정")).collect()
    assert [r.outgoing for r in first] == sorted([r.outgoing for r in first], reverse=True) and len(first) == 3
    assert graph.edge_groups(small).where("n > 1").count() == 1


def test_hybrid_session(spark, small):
    rows = [(i, d, f"{d} 본문 {i}", [float(i == j) + 0.1 for j in range(4)]) for i, d in enumerate(["감사업무규정", "보증업무규정", "없는문서", "멀리있는지침"])]
    rows += [(9, "보증업무규정", "보증업무규정 본문 1", [0.1, 1.0, 0.1, 0.1])]
    vectors = spark.createDataFrame(rows, "row_id long, doc string, text string, embedding array<float>")
    session = HybridSession(small, vectors, chat=lambda system, user: f"답 {len(user) > 10}")
    session.settings = type(session.settings)(top_k=2)
    got = session.answer("감사업무규정 절차", [1.0, 0.0, 0.0, 0.0])
    assert got["kg"]["method"] == "string" and got["answer"] == "답 True" and [h["doc"] for h in got["vector_global"]] == ["감사업무규정", "보증업무규정"]
    assert [h["doc"] for h in got["vector_scoped"]] == ["멀리있는지침"]
    fallback = session.retrieve("모르는 말", [0.0, 1.0, 0.0, 0.0])
    assert fallback["method"] == "vector" and fallback["seeds"] == [iri(spark, "보증업무규정")]
    events = list(session.events("감사업무규정", [1.0, 0.0, 0.0, 0.0], lambda q: iter("가나")))
    assert len(events) == 4 and '"meta"' in events[0] and '"done"' in events[-1]


def test_context_keeps_first_place_and_last_content(spark):
    head = "가" * 60
    hits = lambda *rows: spark.createDataFrame(list(rows), "row_id long, doc string, text string, score double")
    lines = vector.context(hits((1, "a", head + "1", 0.5), (2, "b", "나", 0.4)), hits((3, "c", head + "3", 0.9))).orderBy("n").collect()
    assert [r.line for r in lines] == [f"[1] (c) {head}3", "[2] (b) 나"]


def test_top_k_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "row_id long, embedding array<float>")
    assert [r.row_id for r in vector.top_k(rows, [1.0, 0.0], 2).withColumn("score", F.round("score", 6)).collect()][:2] == [1, 3]
    batch = vector.top_k_batch(rows, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<float>"), 2)
    assert {r.row_id for r in batch.collect()} == {1, 3}


def test_batch_top_k_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROWS", 20, raising=False)
    monkeypatch.setattr(vector, "QUERIES", 4_000, raising=False)
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((50, 4)), rng.standard_normal((10_050, 4))
    v[30:45] = v[3]  # ties go by key
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "row_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(q.tolist())], "query_id long, query array<double>")
    got = vector.top_k_batch(rows, queries, 6).orderBy("query_id", "rank").collect()
    score = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 8)
    want = np.argsort(-score, axis=1, kind="stable")[:, :6]
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6] * 10_050
    assert [r.row_id for r in got] == want.ravel().tolist()
    assert vector.top_k_batch(rows, queries.limit(0)).isEmpty() and vector.top_k_batch(rows.limit(0), queries.limit(3)).isEmpty()


def test_containment_is_brute_force(spark):
    texts = [(1, "가나다라마바사"), (2, "가나다라마바사"), (3, None), (4, ""), (5, "다라마"), (6, "xx가나다가나다라\n마바"), (6, "xx가나다가나다라\n마바")]
    keys = [(1, "가나다"), (2, "다라마바"), (3, "나다"), (4, ""), (5, None), (6, "다라\n마"), (7, "가나다"), (8, "가나다라마바사")]
    got = containing(spark.createDataFrame(texts, "id int, text string"), "text", spark.createDataFrame(keys, "k int, key string"), "key", 3)
    want = [(i, t, k, y) for i, t in texts for k, y in keys if t and y and len(y) >= 3 and y in t]
    assert got.columns == ["id", "text", "k", "key"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert containing(spark.createDataFrame([], "id int, text string"), "text", spark.createDataFrame(keys, "k int, key string"), "key", 3).isEmpty()


def test_articles_of_documents_that_share_an_id(spark):
    """Later documents of one title and one source have one id; none loses its articles to another."""
    rows = [(k, s, "가나 규정", "같은 파일", "법규체", "조", f"제{s}조", f"d#{k}{s}") for k in (1, 2, 3) for s in (1, 2)]
    chunks = spark.createDataFrame(rows, "doc_ord long, seq int, doc_title string, source_file string, doc_family string, unit string, article_label string, chunk_id string")
    more = {c: F.lit("") for c in ("file_name", "doc_type", "enacted", "last_amended", "article_title", "text")}
    chunks = chunks.withColumns(more)
    got = extract.articles(chunks, corpus.documents(chunks)).collect()
    assert sorted((r.doc_ord, r.label) for r in got) == [(k, f"제{s}조") for k in (1, 2, 3) for s in (1, 2)]


def test_evidence_in_any_document_of_a_title(spark):
    texts = [(1, "가나 운영규정", "이 규정은 「다라 업무규정」을 준용한다."), (2, "가나 운영규정", "「다라 업무규정」에 따른다."), (3, "다라 업무규정", "목적")]
    docs = spark.createDataFrame([(*r, "법규체") for r in texts], "doc_ord long, title string, text string, family string").withColumn("title_norm", F.regexp_replace("title", " ", ""))
    docs = docs.withColumn("doc_iri", F.concat(F.lit("doc:"), F.col("doc_ord").cast("string")))
    made = [("가나 운영규정", "다라 업무규정", "applies", e) for e in ("다라 업무규정」을 준용한다", "준용한다고 쓴 적 없는 말", None)]
    got = classify.gate(spark.createDataFrame(made, "src_title string, target string, relation string, evidence string"), docs).collect()
    assert sorted((r.evidence or "", r.outcome) for r in got) == [("", "rej_evidence"), ("다라 업무규정」을 준용한다", "kept"), ("준용한다고 쓴 적 없는 말", "rej_evidence")]
