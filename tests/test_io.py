import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import hooks
from quern.operators import chunking, corpus
from quern.sinks import tables, turtle as sink
from quern.sources import chunks, files, payloads, turtle, vectors
from quern.streaming import incremental


def test_chunk_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"doc_title": "나", "text": "1", "unit": "조"}, {"text": " "}], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps([{"doc_title": "가", "text": "2"}], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("no json")
    got = chunks.read(spark, str(tmp_path))
    assert [(r.doc_ord, r.seq, r.doc_title, r.text) for r in got.orderBy("doc_ord", "seq").collect()] == [(0, 0, "가", "2"), (1, 0, "나", "1"), (1, 1, None, " ")]
    assert {tuple(r) for r in chunks.for_embedding(got).collect()} == {("가", "2"), ("나", "1")}
    tables.write_chunk_files(got, str(tmp_path / "out"))
    back = {r.file_name: json.loads(r.chunks) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [c.get("text") for c in back["b.json"]] == ["1", " "]


def test_raw_layout(spark, tmp_path):
    doc = {"document": {"doc_title": "가"}, "chunks": [{"text": "1"}, {"content": "2"}, {"text": ""}]}
    for name in ("a.json", "_b.json", "kg_x.json", "chunks_y.json"):
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    assert sorted(tuple(r) for r in chunks.raw(spark, str(tmp_path)).collect()) == [("가", "1"), ("가", "2")]


def test_text_and_zipped_documents(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "규정.txt").write_bytes("제1조(목적) 이 규정은 2023-5-1 목적을 정한다\r\n\n 제2조(정의) 다음과 같이 정의한다 제3조(삭제) 삭제되었다는 뜻의 글이다 \xff".encode("utf-8", "surrogateescape") + b"\xff")
    xml = f'<x xmlns:hp="{files.PARAGRAPH[1:-1]}"><hp:p><hp:t>가\xa0 나</hp:t><hp:t>다</hp:t></hp:p><hp:p/></x>'
    with zipfile.ZipFile(tmp_path / "in" / "deep" / "b.hwpx", "w") as z:
        z.writestr("Contents/section1.xml", xml)
        z.writestr("Contents/section0.xml", "<broken")
    (tmp_path / "in" / "c.hwpx").write_bytes(b"no zip")
    found = files.read_txt(spark, str(tmp_path / "in")).unionByName(files.read_hwpx(spark, str(tmp_path / "in")))
    got = {r.file_name: r.paragraphs for r in found.collect()}
    assert got["b.hwpx"] == ["가 나다"] and got["c.hwpx"] == [] and len(got["규정.txt"]) == 2
    rows = chunking.local_chunks(found.withColumn("doc_ord", F.xxhash64("path"))).orderBy("file_name", "seq").collect()
    assert [(r.doc_title, r.doc_family, r.unit, r.article_label) for r in rows] == [("b", "공문체", "문서", ""), ("규정", "법규체", "조", "제1조"), ("규정", "법규체", "조", "제2조")]
    assert rows[1].enacted == "2023. 5. 1."


def test_articles_do_not_split_at_inline_references(spark):
    text = "제1조(목적) 이 법은 제7조제2항에 따른 특례를 정하는 법이다 제2조의2(특례) 특례 글이다 제3조(정의) 다음과 같이 정의한다"
    got = spark.range(1).select(chunking.split_articles(F.lit(text))).first()[0]
    assert [(a.label, a.title) for a in got] == [("제1조", "목적"), ("제3조", "정의")]


def test_outline_windows(spark):
    long = " ".join(f"문장 번호 {i}번이다." for i in range(200))
    full = "1. 첫째 절의 내용은 서른 글자를 넘어야 하므로 조금 길게 적는다 그렇다\n제2장 둘째\n" + long + "\n3. 짧다"
    got = spark.range(1).select(chunking.chunk_outline(F.lit(full), 300)).first()[0]
    assert all(30 <= len(s) <= 301 for s in got) and "".join(" ".join(got).split()).count("번이다.") >= 198
    assert spark.range(1).select(chunking.chunk_outline(F.lit("가" * 2000))).first()[0] == ["가" * 2000]


def test_statute_payloads(spark, tmp_path):
    units = [
        {"조문번호": "1", "조문여부": "전문", "조문내용": "제1장 총칙"}, {"조문번호": "1", "조문제목": "목적", "조문내용": "제1조(목적) <b>가</b>", "항": [{"항내용": "① 나", "호": [{"호내용": "1. 다"}]}]},
        {"조문번호": "2", "조문내용": "제2조 삭제"},
    ]
    one = {"법령": {"기본정보": {"공포일자": "20230501"}, "조문": {"조문단위": units}}}
    two = {"행정규칙": {"조문내용": ["제1조(목적) 이 규정은 목적을 정하는 규정이다 제2조(적용) 이 규정은 어디에나 적용한다"]}}
    rows = [(0, "가", json.dumps(one, ensure_ascii=False)), (1, "나", json.dumps(two, ensure_ascii=False)), (2, "다", json.dumps({"x": {"본문내용": "그냥 글"}}, ensure_ascii=False)), (3, "라", "no json")]
    got = chunking.statute_chunks(spark.createDataFrame(rows, "doc_ord long, name string, payload string")).orderBy("doc_ord", "seq").collect()
    assert [(r.doc_title, r.unit, r.article_label, r.article_title) for r in got] == [("가", "조", "제1조", "목적"), ("나", "조", "제1조", "목적"), ("나", "조", "제2조", "적용"), ("다", "문서", "", "")]
    assert got[0].text == "제1조(목적) 가 ① 나 1. 다" and got[0].enacted == "2023. 5. 1." and got[3].text == "그냥 글"
    (tmp_path / "a.json").write_text("사용자 정보 검증에 실패하였습니다", encoding="utf-8")
    with pytest.raises(payloads.NotAuthorised):
        payloads.read(spark, str(tmp_path))


def test_search_answers_and_attachments(spark):
    page = lambda *xs: json.dumps({"AdmRulSearch": {"admrul": [{"행정규칙일련번호": str(s), "행정규칙명": n} for s, n in xs]}}, ensure_ascii=False)
    answers = spark.createDataFrame([("q1", 1, page((1, "업무편람"), (2, "고시"))), ("q2", 1, page((1, "업무편람"), (3, "안내서")))], "query string, page int, payload string")
    got = payloads.manuals(payloads.hits(answers, "admrul")).orderBy("sid").collect()
    assert [(r.sid, r["query"]) for r in got] == [("1", "q1"), ("3", "q2")]
    svc = lambda n, u: json.dumps({"a": {"첨부파일명": n, "첨부파일링크": u}}, ensure_ascii=False)
    rows = spark.createDataFrame([("1", svc(["별표.pdf", "본문.PDF", "x.hwp"], ["u1", "u2", "u3"])), ("2", svc("하나.pdf", "v1")), ("3", "{}")], "sid string, payload string")
    assert [tuple(r) for r in payloads.attachments(rows).orderBy("sid", "pos").collect()] == [("1", 0, "본문.PDF", "u2"), ("1", 1, "별표.pdf", "u1"), ("2", 0, "하나.pdf", "v1")]
    texts = spark.createDataFrame([("1", 0, "가" * 399), ("1", 1, "가" * 400), ("2", 0, "x")], "sid string, pos int, text string")
    assert [(r.sid, len(r.text)) for r in payloads.readable(texts).collect()] == [("1", 400)]


def test_hits_under_other_keys(spark):
    item = {"자치법규일련번호": 77, "자치법규명": " 조례 ", "발령일자": 20230501, "시행일자": "20240102"}
    answers = spark.createDataFrame([("q", 1, json.dumps({"x": {"law": [item, {"자치법규일련번호": 78}]}}, ensure_ascii=False))], "query string, page int, payload string")
    assert [tuple(r) for r in payloads.hits(answers).collect()] == [("q", 1, 0, "77", "조례", "2023. 5. 1.", "2024. 1. 2.")]


def test_commands(spark, tmp_path, monkeypatch):
    from quern.__main__ import main
    from quern.plans import readiness

    said = json.dumps({"admrul": [{"행정규칙일련번호": "1", "행정규칙명": "업무편람"}]}, ensure_ascii=False)
    spark.createDataFrame([("q", 1, said)], "query string, page int, payload string").write.parquet(str(tmp_path / "answers"))
    spark.createDataFrame([("1", 0, "짧다"), ("1", 1, "가나다 " * 200)], "sid string, pos int, text string").write.parquet(str(tmp_path / "texts"))
    main(["manuals", str(tmp_path / "answers"), str(tmp_path / "texts"), str(tmp_path / "manuals")])
    got = spark.read.parquet(str(tmp_path / "manuals")).collect()
    assert [(r.doc_title, r.doc_key) for r in got] == [("업무편람", "manual_업무편람")] and got[0].text == ("가나다 " * 200).strip()
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "a.json").write_text(json.dumps([{"doc_title": "가", "text": "하나"}, {"text": "둘둘둘"}], ensure_ascii=False), encoding="utf-8")
    main(["embed", str(tmp_path / "chunks"), "tests.test_io:lengths", str(tmp_path / "vectors")])
    assert [(r.row_id, r.text, r.embedding) for r in vectors.read_parquet(spark, str(tmp_path / "vectors")).orderBy("row_id").collect()] == [(0, "둘둘둘", [3.0]), (1, "하나", [2.0])]
    text = "기술평가위원회를 둔다. 심사관리위원회를 설치한다."
    (tmp_path / "chunks" / "b.json").write_text(json.dumps([{"doc_title": "나 규정", "doc_family": "법규체", "unit": "조", "text": text, "chunk_id": "d1#0001"}], ensure_ascii=False), encoding="utf-8")
    for gate, names in (("1", {"심사관리위원회"}), ("0", {"심사관리위원회", "기술평가위원회"})):
        monkeypatch.setenv("KG_ORG_LLM_GATE", gate)
        main(["build", str(tmp_path / "chunks"), str(tmp_path / f"built{gate}"), "--judge", "tests.test_io:not_the_first"])
        rows = turtle.read(spark, str(tmp_path / f"built{gate}" / "kg")).where("s LIKE 'orgn:%' AND p = 'rdfs:label'").collect()
        assert {r.o for r in rows} == names
        stats = json.loads(spark.read.text(str(tmp_path / f"built{gate}" / "kg_stats")).first()[0])
        assert stats["org_llm_dropped"] == 2 - len(names) and stats["documents"] == 2
        assert "src_with_targets" in json.loads(spark.read.text(str(tmp_path / f"built{gate}" / "edge_stats")).first()[0])
    main(["stream", str(tmp_path / "manuals"), str(tmp_path / "store"), str(tmp_path / "check")])
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    paths = [str(tmp_path / x) for x in ("vectors", "none")]
    assert list(readiness.present(spark, paths).values()) == [True, False]
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "row_id long, embedding array<double>")
    got = readiness.vectors(rows, rows.where("row_id = 0"), 2).first()
    assert (got.n_rows, got.n_meta, got.dim_min, got.dim_max, got.agree, got.fits) == (2, 1, 1, 2, False, False)


def not_the_first(labels):
    return sorted(labels)[1:]


def lengths(texts):
    return [[float(len(t))] for t in texts]


def test_pages_end_at_the_first_empty_one(spark):
    answers = spark.createDataFrame([(q, p) for q in "ab" for p in (1, 2, 3, 4)], "query string, page int")
    hits = spark.createDataFrame([("a", 1, 0, "1", "x"), ("a", 1, 1, "1", "y"), ("a", 2, 0, "2", "z"), ("a", 4, 0, "3", "late"), ("b", 1, 0, "1", "x"), ("b", 2, 0, "1", "w")], "query string, page int, pos int, sid string, name string")
    got = sorted((r["query"], r.sid, r.name) for r in payloads.paged(hits, answers).collect())
    assert got == [("a", "1", "x"), ("a", "2", "z"), ("b", "1", "x")]


def test_sections_with_nested_paragraphs():
    ns = files.PARAGRAPH[1:-1]
    xml = f'<s xmlns:p="{ns}"><p:p><p:t>밖 </p:t><p:tbl><p:p><p:t>안\u00a0하나</p:t></p:p><p:p><p:t> </p:t></p:p></p:tbl><p:t>끝</p:t></p:p><p:p><p:t>둘</p:t></p:p></s>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("Contents/section0.xml", xml)
        z.writestr("Contents/header.xml", xml)
    got = sorted(files.section_paragraphs(made.getvalue()))
    assert [t for _, _, t in got] == ["밖 안 하나 끝", "안 하나", "둘"]


def test_turtle_round_trip_and_foreign_lines(spark, tmp_path):
    rows = [(1, "doc:d1", "rdfs:label", 'a "b" \\ c', "lit"), (2, "doc:d1", "dct:modified", "2023-05-01", "date"), (3, "doc:d1", "reg:external", "true", "bool"), (4, "doc:d1", "eli:cites", "doc:d2", "iri")]
    df = spark.createDataFrame(rows, "ord int, s string, p string, o string, kind string")
    sink.write(df, str(tmp_path / "kg"), one_file=True)
    assert {tuple(r)[1:] for r in turtle.read(spark, str(tmp_path / "kg")).collect()} == {r[1:] for r in rows}
    lines = ["@prefix a: <b> .", "", 'doc:d9 rdf:type reg:Manual ;', '    rdfs:label "가 나" .', "doc:d8 broken", "  eli:cites doc:d7 ."]
    got = turtle.statements(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, raw string")).orderBy("ord").collect()
    assert [(r.s, r.p, r.o) for r in got] == [("doc:d9", "rdf:type", "reg:Manual"), ("doc:d9", "rdfs:label", "가 나"), ("doc:d9", "eli:cites", "doc:d7")]


def test_vectors_in_and_out(spark, tmp_path):
    m = np.arange(12, dtype=np.float16).reshape(3, 4)
    np.save(tmp_path / "v.npy", m)
    (tmp_path / "v.meta.jsonl").write_text('{"id": "a", "doc": "가", "text": "1"}\nbroken\n{"id": "c", "doc": "다", "text": "3"}\n', encoding="utf-8")
    got = vectors.read_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "v.meta.jsonl")).orderBy("row_id")
    assert [(r.row_id, r.id, r.embedding) for r in got.collect()] == [(0, "a", [0.0, 1.0, 2.0, 3.0]), (2, "c", [8.0, 9.0, 10.0, 11.0])]
    assert tables.export_npy(got, str(tmp_path / "w.npy")) == 2 and np.load(tmp_path / "w.npy").dtype == np.float16
    (tmp_path / "x.jsonl").write_text('{"doc": "가", "text": "1", "embedding": [1, 2]}\n{broken\n', encoding="utf-8")
    assert [(r.doc, r.embedding) for r in vectors.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()] == [("가", [1.0, 2.0])]


def test_embedding_halves_a_failing_batch(spark):
    calls = []

    def embedder(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise RuntimeError("too many")
        return [[float(len(t))] for t in texts]

    assert hooks.embed_batch(embedder, ["a", "bb", "ccc", "dddd", "e"], tries=2, wait=0) == [[1.0], [2.0], [3.0], [4.0], [1.0]] and max(calls) == 5
    with pytest.raises(RuntimeError):
        hooks.embed_batch(lambda t: (_ for _ in ()).throw(RuntimeError()), ["a"], tries=1, wait=0)
    df = spark.createDataFrame([("가", "x" * 2000), ("나", "y")], "doc string, text string")
    assert {r.doc: r.embedding for r in hooks.embed(df, lambda t: [[float(len(x))] for x in t], wait=0).collect()} == {"가": [1000.0], "나": [1.0]}


def test_stream_hands_on_what_changed(spark, tmp_path):
    src, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    seen = []
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, text string")
    for batch in (rows(("a", "1"), ("b", "2")), rows(("a", "1"), ("b", "3"), ("c", "4"))):
        batch.coalesce(1).write.mode("append").parquet(src)
        incremental.follow(spark, src, "chunk_id string, text string", store, check, lambda df, n: seen.append(sorted(r.chunk_id for r in df.collect()))).awaitTermination(120)
    assert seen == [["a", "b"], ["b", "c"]]


def test_written_tables(spark, tmp_path):
    df = corpus.assign_chunk_ids(spark.createDataFrame([("가/나 규정", 0, "t")], "doc_title string, seq int, text string"))
    tables.write_chunks(df, str(tmp_path / "c"))
    assert [r.doc_key for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["law_가_나_규정"]
    tables.write_stats(spark.createDataFrame([("b", 2), ("a", 1)], "counter string, n long"), str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0]) == {"a": 1, "b": 2}
    tables.append_proposals(df, str(tmp_path / "p"), "r1")
    tables.append_proposals(df, str(tmp_path / "p"), "r1")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_statute_payloads_come_in_small_batches(spark):
    """Whole payloads in a batch of 10,000 rows are more than a worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    units = [{"조문번호": str(i), "조문여부": "조문", "조문내용": f"제{i}조(목적) " + "글 " * 2_000} for i in range(1, 40)]
    said = json.dumps({"법령": {"조문": {"조문단위": units}}}, ensure_ascii=False)
    rows = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_ord"), F.lit("가").alias("name"), F.lit(said).alias("payload"))
    got = chunking.statute_chunks(rows)
    assert got.count() == 60 * 39 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "Exchange" not in plan
    odd = {"법령": {"조문": {"조문단위": [{"조문번호": 3, "조문여부": "전문", "조문내용": "머리"}, {"조문번호": 2, "조문내용": "제2조 삭제"}, None, "x"], "조문내용": ["앞", None, {"a": 1}]}}}
    one = chunking.statute_chunks(spark.createDataFrame([(7, "나", json.dumps(odd, ensure_ascii=False))], "doc_ord long, name string, payload string")).collect()
    assert [(r.doc_ord, r.seq, r.unit, r.text) for r in one] == [(7, 0, "문서", '앞 {"a": 1}')]


def test_turtle_files_are_read_in_splits(spark, tmp_path):
    """No row holds a file, nor all statements of a subject; a subject goes on from split to split."""
    rows = [("doc:hub", "reg:x", str(i), "lit") for i in range(3_000)] + [(f"doc:d{i}", "eli:cites", "doc:hub", "iri") for i in range(200)] + [("doc:e", "reg:x", "끝", "lit")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, s string, p string, o string, kind string")
    sink.write_continued(df.repartition(3), str(tmp_path / "kg"), compression="gzip")
    lines = [x.value for x in spark.read.text(str(tmp_path / "kg")).collect()]
    assert len(lines) == len(rows) and sum(x.startswith("doc:hub ") for x in lines) < 20 and all(x.endswith((" .", " ;")) for x in lines)
    assert sorted(tuple(r)[1:] for r in turtle.read(spark, str(tmp_path / "kg")).collect()) == sorted(rows)
    plain = ["    reg:x doc:none ."] + ["doc:a reg:x doc:b ;"] + [f'    reg:x "{i}" ;' for i in range(2_000)] + ["doc:c reg:x doc:b ."]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.ttl").write_text("\n".join(plain), encoding="utf-8")
    (tmp_path / "one" / "b.ttl").write_text("\n".join(["    reg:x doc:none ;", "doc:z reg:x doc:b ."]), encoding="utf-8")
    for k, v in (("maxPartitionBytes", "4096"), ("openCostInBytes", "64")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    try:
        got = turtle.read(spark, str(tmp_path / "one"))
        assert spark.read.text(str(tmp_path / "one")).rdd.getNumPartitions() > 5
        assert sorted((r.s, r.o) for r in got.collect()) == sorted([("doc:a", "doc:b"), *(("doc:a", str(i)) for i in range(2_000)), ("doc:c", "doc:b"), ("doc:z", "doc:b")])
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")


def test_lines_of_one_name_have_one_number(spark, tmp_path):
    said = lambda t: json.dumps([{"doc_title": t, "text": "1"}], ensure_ascii=False)
    rows = [("b", said("나")), ("a", said("가")), ("b", said("다")), ("0", "[]"), ("c", said("라"))]
    spark.createDataFrame(rows, "file_name string, chunks string").write.json(str(tmp_path / "x"), compression="gzip")
    got = chunks.read_lines(spark, str(tmp_path / "x"))
    assert sorted((r.doc_ord, r.file_name, r.doc_title) for r in got.collect()) == [(0, "a", "가"), (1, "b", "나"), (1, "b", "다"), (2, "c", "라")]
