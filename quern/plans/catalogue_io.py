"""Queries of the catalogue that write with the sinks, read with the sources, or need what the fixture's plain graph has not."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import hooks, ids
from quern.functions import patterns as P
from quern.functions import text as T
from quern.operators import chunking, classify, corpus, extract, graph, vector
from quern.plans.build import Graph, with_overlay
from quern.plans.catalogue import _APPLIED, _PROPOSED, _QUESTION, _RANK, _WALK, C, E, STATS, TRIPLES, _hex, built, first_vector, query, table, vectors
from quern.plans.hybrid import HybridSession
from quern.sinks import tables, turtle
from quern.sinks.store import fresh_path, stored
from quern.sources import chunks as chunk_files_in
from quern.sources import files, payloads
from quern.sources import turtle as turtle_in
from quern.sources import vectors as vectors_in
from quern.streaming import incremental

# --- chunk files

_PLACED = C + """, f AS (SELECT dense_rank() OVER (ORDER BY doc_key) - 1 AS doc_ord, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY seq) - 1 AS INTEGER) AS seq, c.* EXCLUDE (seq), c.seq AS place FROM c)"""


def _documents_written(spark, sf_dir) -> DataFrame:
    """The fixture's chunks, written as one file a document and read again."""
    path = fresh_path(spark, "chunks")
    tables.write_documents(corpus.fixture_chunks(spark, sf_dir), path)
    return chunk_files_in.read(spark, path, "*.txt")


@query(_PLACED + " SELECT doc_ord, seq, doc_title, article_label, md5(text) AS text_md5 FROM f")
def chunk_documents(spark, sf_dir):
    return _documents_written(spark, sf_dir).select("doc_ord", "seq", "doc_title", "article_label", F.md5("text").alias("text_md5"))


@query(_PLACED + f"""SELECT concat('규정_', doc_title, '.json') AS file_name, dense_rank() OVER (ORDER BY concat('규정_', doc_title, '.json')) - 1 AS doc_ord, seq,
'd' || {_hex('doc_title')} || '#' || lpad(CAST(place AS VARCHAR), 4, '0') AS chunk_id FROM f""")
def chunk_lines(spark, sf_dir):
    path = fresh_path(spark, "lines")
    tables.write_chunk_files(built(spark, sf_dir).annotated(), path, compression="gzip")
    return chunk_files_in.read_lines(spark, path).select("file_name", "doc_ord", "seq", "chunk_id")


@query(C + " SELECT doc_title AS doc, trim(text) AS text FROM c WHERE trim(text) <> ''")
def chunks_for_embedding(spark, sf_dir):
    return chunk_files_in.for_embedding(_documents_written(spark, sf_dir))


@query(C + " SELECT doc_title AS doc, md5(text) AS text_md5 FROM c")
def raw_chunks(spark, sf_dir):
    rows = corpus.fixture_chunks(spark, sf_dir)
    said = F.struct(F.when(F.col("seq") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("seq") % 2 == 1, F.col("text")).alias("content"))
    docs = rows.groupBy("doc_ord").agg(F.first("doc_title").alias("t"), F.collect_list(said).alias("chunks"))
    path = fresh_path(spark, "raw")
    docs.select(F.struct(F.col("t").alias("doc_title")).alias("document"), "chunks").write.option("maxRecordsPerFile", 1).json(path)
    return chunk_files_in.raw(spark, path).select("doc", F.md5("text").alias("text_md5"))


@query(C + " SELECT left('law_' || doc_title, 64) AS doc_key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY 1")
def chunks_written(spark, sf_dir):
    path = fresh_path(spark, "parquet")
    tables.write_chunks(corpus.fixture_chunks(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("doc_key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(TRIPLES + STATS)
def stats_written(spark, sf_dir):
    path = fresh_path(spark, "stats")
    tables.write_stats(built(spark, sf_dir).stats(), path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string, bigint>")).alias("counter", "n"))


# --- vectors


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, 'd' || label AS doc, CAST(vec_id AS VARCHAR) AS text, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings")
def vectors_jsonl(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "label").alias("doc"), F.col("vec_id").cast("string").alias("text"), "embedding", "vec_id")
    path = fresh_path(spark, "jsonl")
    rows.orderBy("vec_id").drop("vec_id").write.json(path)
    return vectors_in.read_jsonl(spark, path).select("row_id", "doc", "text", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("SELECT vec_id AS row_id, 'd' || label AS doc, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings")
def vectors_parquet(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS row_id", "'x' AS id", "concat('d', label) AS doc", "'y' AS text", "embedding")
    path = fresh_path(spark, "vectors")
    tables.write_vectors(rows, path)
    return vectors_in.read_parquet(spark, path).select("row_id", "doc", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, 'v' || vec_id AS id, 'd' || label AS doc, CAST(len(embedding) AS INTEGER) AS dim, true AS near FROM embeddings")
def vectors_npy(spark, sf_dir):
    """A float16 matrix and its metadata, written from the driver into the shared folder and read again; near: as float16 can say it."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS row_id", "concat('v', vec_id) AS id", "concat('d', label) AS doc", "'t' AS text", "embedding")
    path = fresh_path(spark, "matrix").removeprefix("file://").removeprefix("file:") + ".npy"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tables.export_npy(rows, path)
    back = vectors_in.read_npy(spark, f"file://{path}", f"file://{path.removesuffix('.npy')}.meta.jsonl")
    near = F.forall(F.zip_with("embedding", "was", lambda x, y: F.abs(x - y) <= 0.001 * F.abs(y) + 1e-6), lambda x: x)
    return back.join(rows.select("id", F.col("embedding").alias("was")), "id").select("row_id", "id", "doc", F.size("embedding").alias("dim"), near.alias("near"))


@query("WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM a ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v)) + 1e-9), 6) AS score FROM a, q")
def cosine_plain(spark, sf_dir):
    q = vector.literal(first_vector(spark, sf_dir))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.cosine_plain(F.col("embedding"), q), 6).alias("score"))


_COS_Q = "list_dot_product(a.v, q.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(q.v, q.v)) + 1e-9))"


@query(f"""WITH a AS (SELECT e.vec_id, CAST(embedding AS DOUBLE[]) AS v, d.source, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id), q AS (SELECT v FROM a ORDER BY vec_id LIMIT 1),
h AS (SELECT vec_id, source, text, {_COS_Q} AS score FROM a, q ORDER BY score DESC, vec_id LIMIT 6)
SELECT source AS doc, round(score, 3) AS score, substr(trim(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), chr(10), ' '), ' ' || chr(9) || chr(13) || chr(10)), 1, 90) AS snippet FROM h""")
def hits_formatted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS row_id", "source AS doc", "text")
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id").join(docs, "row_id")
    first = rows.orderBy("row_id").select("embedding").first()[0]
    return vector.formatted(vector.top_k(rows, first))


@query(f"SELECT DISTINCT 'r' || left(sha1(source || chr(1) || text), 0) AS id, source AS doc, md5(text) AS text_md5, least(length(text), 1000)::DOUBLE AS first, length(text) % 2 = length(text) % 2 AS whole FROM documents WHERE text IS NOT NULL")
def embedded(spark, sf_dir):
    """Texts through two endpoints that return the length of what they are sent."""
    one = lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = hooks.embed(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("doc"), "text"), [one, one], wait=0)
    return rows.distinct().select(F.lit("r").alias("id"), "doc", F.md5("text").alias("text_md5"), F.col("embedding")[0].cast("double").alias("first"), (F.size("embedding") == 2).alias("whole"))


# --- recorded answers

_SEARCH = """SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier"""


def _search(spark, sf_dir) -> DataFrame:
    """(query, page, payload): each nation's suppliers three a page, serial numbers that recur after five; page 4 is empty, page 9 is not."""
    spread = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    rows = table(spark, sf_dir, "supplier").withColumn("r", spread).withColumn("page", (F.col("r") / 3).cast("int") + 1)
    item = F.struct((F.col("r") % 5).cast("string").alias("행정규칙일련번호"), F.concat(F.lit("업무"), F.expr("IF(r % 2 = 0, '편람', '고시')"), F.lit(" "), "s_name").alias("행정규칙명"))
    found = rows.where("page < 4").groupBy("s_nationkey", "page").agg(F.array_sort(F.collect_list(F.struct("r", item.alias("item")))).alias("x"))
    pages = found.select("s_nationkey", "page", F.transform("x", lambda v: v["item"]).alias("admrul"))
    nations = rows.select("s_nationkey").distinct()
    late = nations.select("s_nationkey", F.lit(9).alias("page"), F.array(F.struct(F.lit("99").alias("행정규칙일련번호"), F.lit("편람 끝").alias("행정규칙명"))).alias("admrul"))
    none = nations.select("s_nationkey", F.lit(4).alias("page"), F.array().cast(late.schema["admrul"].dataType).alias("admrul"))
    return pages.unionByName(none).unionByName(late).select(F.col("s_nationkey").alias("query"), "page", F.to_json(F.struct(F.struct("admrul").alias("AdmRulSearch"))).alias("payload"))


@query(f"WITH s AS ({_SEARCH}), p AS (SELECT *, r // 3 + 1 AS page FROM s WHERE r < 9) SELECT s_nationkey AS query, CAST(r % 5 AS VARCHAR) AS sid, '업무' || CASE WHEN r % 2 = 0 THEN '편람' ELSE '고시' END || ' ' || s_name AS name FROM p WHERE r < 5")
def search_pages(spark, sf_dir):
    answers = stored(_search(spark, sf_dir))
    return payloads.paged(payloads.hits(answers, "admrul"), answers).select("query", "sid", "name")


@query(f"""WITH s AS ({_SEARCH}), p AS (SELECT CAST(r % 5 AS VARCHAR) AS sid, '업무' || CASE WHEN r % 2 = 0 THEN '편람' ELSE '고시' END || ' ' || s_name AS name, s_nationkey, r FROM s WHERE r < 5 AND r % 2 = 0)
SELECT sid, arg_min(name, s_nationkey) AS name FROM p GROUP BY sid""")
def manual_hits(spark, sf_dir):
    answers = stored(_search(spark, sf_dir))
    return payloads.manuals(payloads.paged(payloads.hits(answers, "admrul"), answers)).select("sid", "name")


@query(f"WITH s AS ({_SEARCH}) SELECT CAST(r % 5 AS VARCHAR) AS sid, '업무' || CASE WHEN r % 2 = 0 THEN '편람' ELSE '고시' END || ' ' || s_name AS name, 'body ' || s_name AS payload FROM s WHERE r < 5")
def rule_bodies(spark, sf_dir):
    """Bodies recorded under the names of rules."""
    answers = stored(_search(spark, sf_dir))
    found = payloads.paged(payloads.hits(answers, "admrul"), answers)
    recorded = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.lit("편람"), F.lit("고시"))).alias("k"), "s_name")
    recorded = recorded.select(F.concat(F.lit("업무"), "k", F.lit(" "), "s_name").alias("key"), F.concat(F.lit("body "), "s_name").alias("payload"))
    return payloads.bodies(found, recorded, "admrul")


@query("""SELECT s_suppkey, 'https://example.org/lawSearch.do?OC=me&target=law&type=JSON&display=100&page=' || s_nationkey || '&query=' || replace(url_encode('가 나/' || s_name), '%2F', '/') AS search,
'https://example.org/lawService.do?OC=me&target=admrul&type=JSON&LM=' || replace(url_encode('「*' || s_name || '~」'), '%2F', '/') AS body FROM supplier""")
def service_urls(spark, sf_dir):
    name, base = F.col("s_name"), "https://example.org"
    search = payloads.search_url(base, "me", "law", F.concat(F.lit("가 나/"), name), 500, F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", search.alias("search"), payloads.body_url(base, "me", "admrul", F.concat(F.lit("「*"), name, F.lit("~」"))).alias("body"))


@query("""WITH a AS (SELECT p_partkey, unnest([0, 1, 2, 3]) AS nth FROM part), n AS (SELECT p_partkey, nth, CASE nth WHEN 0 THEN '별표 1.pdf' WHEN 1 THEN '본문' || p_partkey % 9 || '.PDF' WHEN 2 THEN '본문.hwp'
ELSE '부록.pdf' END AS name FROM a), k AS (SELECT *, CASE WHEN nth = 0 THEN 1 ELSE 0 END AS aux FROM n WHERE nth <> 2)
SELECT CAST(p_partkey AS VARCHAR) AS sid, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY aux, nth) - 1 AS INTEGER) AS pos, name, 'u' || nth AS url FROM k""")
def attachment_lists(spark, sf_dir):
    names = F.array(F.lit("별표 1.pdf"), F.concat(F.lit("본문"), F.col("p_partkey") % 9, F.lit(".PDF")), F.lit("본문.hwp"), F.lit("부록.pdf"))
    said = F.struct(names.alias("첨부파일명"), F.array(*[F.lit(f"u{i}") for i in range(4)]).alias("첨부파일링크"))
    answers = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sid"), F.to_json(F.struct(said.alias("행정규칙"))).alias("payload"))
    return payloads.attachments(answers)


@query("""WITH a AS (SELECT s_suppkey, unnest([0, 1, 2]) AS pos FROM supplier), t AS (SELECT s_suppkey, pos, (s_suppkey * 37 + pos * 211) % 600 AS n FROM a)
SELECT CAST(s_suppkey AS VARCHAR) AS sid, arg_min(n, pos) AS n FROM t WHERE n >= 400 GROUP BY s_suppkey""")
def readable_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    text = F.expr("concat(repeat('가', CAST((s_suppkey * 37 + pos * 211) % 600 AS INT)), repeat(' x1', 300))")
    got = payloads.readable(rows.select(F.col("s_suppkey").cast("string").alias("sid"), "pos", text.alias("text")))
    return got.select("sid", T.hangul_count(F.col("text")).cast("long").alias("n"))


@query("""SELECT '{"법령":{"ID":' || s_suppkey || ',"명":"' || s_name || '"}}' AS payload FROM supplier""")
def recorded_answers(spark, sf_dir):
    path = fresh_path(spark, "answers")
    said = F.to_json(F.struct(F.struct(F.col("s_suppkey").alias("ID"), F.col("s_name").alias("명")).alias("법령")))
    table(spark, sf_dir, "supplier").select(said).repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return payloads.read(spark, path).select(T.strip(F.col("payload")).alias("payload"))


@query(C + """, f AS (SELECT doc_key, doc_title, article_label, seq, CASE WHEN unit = '조' THEN '제' || seq || '조(제목' || seq % 7 || ') ' || text ELSE text END AS said, doc_family FROM c)
SELECT doc_key AS doc_ord, doc_title, '2020. 1. ' || (1 + doc_key % 28) || '.' AS enacted, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY seq) - 1 AS INTEGER) AS seq,
'조' AS unit, '제' || seq || '조' AS article_label, '제목' || seq % 7 AS article_title, md5(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS text_md5 FROM f WHERE doc_family = '법규체'""")
def statute_payloads(spark, sf_dir):
    """Payloads of article units; the first unit of each is a heading and no article."""
    rows = corpus.fixture_chunks(spark, sf_dir).where(F.col("doc_family") == P.LEGAL)
    no, title = F.col("seq").cast("string"), F.concat(F.lit("제목"), (F.col("seq") % 7).cast("string"))
    unit = F.struct(no.alias("조문번호"), F.lit("조문").alias("조문여부"), title.alias("조문제목"), F.concat(F.lit("제"), no, F.lit("조("), title, F.lit(") "), "text").alias("조문내용"))
    head = F.struct(F.lit("1").alias("조문번호"), F.lit("전문").alias("조문여부"), F.lit("").alias("조문제목"), F.lit("제1장 총칙").alias("조문내용"))
    docs = rows.groupBy("doc_ord", F.col("doc_title").alias("name")).agg(F.array_sort(F.collect_list(F.struct("seq", unit.alias("u")))).alias("x"))
    info = F.struct(F.concat(F.lit("202001"), F.lpad((1 + F.col("doc_ord") % 28).cast("string"), 2, "0")).alias("공포일자"))
    body = F.struct(F.concat(F.array(head), F.transform("x", lambda v: v["u"])).alias("조문단위"))
    docs = docs.select("doc_ord", "name", F.to_json(F.struct(F.struct(info.alias("기본정보"), body.alias("조문")).alias("법령"))).alias("payload"))
    return chunking.statute_chunks(docs).select("doc_ord", "doc_title", "enacted", F.col("seq").cast("int").alias("seq"), "unit", "article_label", "article_title", F.md5("text").alias("text_md5"))


@query("""SELECT p_partkey, '가' || p_partkey % 5 AS name, p_partkey % 3 || ' 나' AS inner_name, CAST(2 + p_partkey % 4 AS INTEGER) AS n_texts FROM part""")
def json_keys(spark, sf_dir):
    """Values under keys that contain a word, a level before those below it, and all texts under keys that end in one."""
    said = F.expr("""concat('{"x": {"a": [{"명칭": "', p_partkey % 3, ' 나"}, ', repeat('{"호내용": "t"}, ', CAST(p_partkey % 4 AS INT)), '{"항내용": "u", "z": {"내용": "v"}}]}, "법령명": "가', p_partkey % 5, '"}')""")
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("j"))
    return rows.select(
        "p_partkey", chunking.find_key(F.col("j"), "령명").alias("name"), chunking.find_key(F.col("j"), "명칭").alias("inner_name"), F.size(chunking.collect_text(F.col("j"))).alias("n_texts")
    )


# --- local documents

_LOCAL = """WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN '업무 안내 ' || n_name ELSE '제1조(목적) 이 규정은 2021-3-' || (1 + n_nationkey) || ' ' || n_name || '의 목적을 정한다' END AS one,
  CASE WHEN n_nationkey % 3 = 0 THEN '둘째 줄이다' ELSE '제2조(적용) 이 규정은 ' || n_name || '에 널리 적용한다' END AS two FROM nation),
u AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN one || ' ' || two ELSE one END AS text, 0 AS seq FROM n UNION ALL SELECT n_nationkey, two, 1 FROM n WHERE n_nationkey % 3 <> 0)
SELECT CAST(seq AS INTEGER) AS seq, CASE WHEN n_nationkey % 3 = 0 THEN '공문체' ELSE '법규체' END AS doc_family, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '2021. 3. ' || (1 + n_nationkey) || '.' END AS enacted,
CASE WHEN n_nationkey % 3 = 0 THEN '문서' ELSE '조' END AS unit, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '제' || (seq + 1) || '조' END AS article_label,
CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN seq = 0 THEN '목적' ELSE '적용' END AS article_title, text FROM u"""


def _local(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    one = F.when(n % 3 == 0, F.concat(F.lit("업무 안내 "), "n_name")).otherwise(F.concat(F.lit("제1조(목적) 이 규정은 2021-3-"), n + 1, F.lit(" "), "n_name", F.lit("의 목적을 정한다")))
    two = F.when(n % 3 == 0, F.lit("둘째 줄이다")).otherwise(F.concat(F.lit("제2조(적용) 이 규정은 "), "n_name", F.lit("에 널리 적용한다")))
    return table(spark, sf_dir, "nation").select("n_nationkey", one.alias("one"), two.alias("two"))


_SHOWN = ("seq", "doc_family", "enacted", "unit", "article_label", "article_title", "text")


@query(_LOCAL)
def local_text_files(spark, sf_dir):
    """A text file for each nation, in folders, with empty and blank lines."""
    path = fresh_path(spark, "text")
    rows = _local(spark, sf_dir).withColumn("folder", F.col("n_nationkey") % 4)
    rows.select("folder", F.concat_ws("\n", F.lit(""), "one", F.lit("   "), F.concat(F.lit("  "), "two", F.lit("\t"))).alias("value")).write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    return chunking.local_chunks(files.read_txt(spark, path).withColumn("doc_ord", F.xxhash64("path"))).select(*_SHOWN)


@query(_LOCAL)
def local_zipped_files(spark, sf_dir):
    """The same as zipped documents of two sections, one paragraph within another's table, and a section that is no XML."""
    path = fresh_path(spark, "zipped")
    ns = files.PARAGRAPH[1:-1]
    for r in _local(spark, sf_dir).collect():  # the nations are 25
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("Contents/section1.xml", f'<s xmlns:p="{ns}"><p:p><p:t> {r.two.split(" ", 1)[0]}\xa0</p:t><p:t>{r.two.split(" ", 1)[1]}</p:t></p:p><p:p/></s>')
            z.writestr("Contents/section0.xml", f'<s xmlns:p="{ns}"><p:p><p:t>{r.one}</p:t></p:p></s>')
            z.writestr("Contents/section2.xml", "<broken")
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/n{r.n_nationkey}.hwpx")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(made.getvalue()))
        out.close()
    return chunking.local_chunks(files.read_hwpx(spark, path).withColumn("doc_ord", F.xxhash64("path"))).select(*_SHOWN)


# --- the graph


@query(TRIPLES + " SELECT s, p, o, kind FROM t")
def turtle_continued(spark, sf_dir):
    """The graph in the other form: a subject once, its further statements on indented lines."""
    path = fresh_path(spark, "turtle")
    turtle.write_continued(built(spark, sf_dir).triples, path, compression="gzip")
    return turtle_in.read(spark, path).select("s", "p", "o", "kind")


_TYPED = _APPLIED.replace(C, E) + f""", v AS (SELECT 'doc:d' || {_hex('src')} AS s, 'doc:d' || {_hex('target')} AS o FROM y WHERE {_RANK.format('src')} >= {_RANK.format('target')}),
vb AS (SELECT s AS src, o AS dst FROM v UNION SELECT o, s FROM v),
w AS (SELECT b.src, b.dst, CASE WHEN vb.src IS NULL THEN '참조' ELSE '준용' END AS via FROM b LEFT JOIN vb USING (src, dst) UNION SELECT src, dst, '준용' FROM vb)"""


def _overlaid(spark, sf_dir) -> DataFrame:
    g = built(spark, sf_dir)
    return stored(with_overlay(g.triples, classify.typed_edges(g.documents)))


@query(_TYPED + " SELECT src, dst, via FROM w")
def overlay_edges(spark, sf_dir):
    return graph.edges(_overlaid(spark, sf_dir))


@query(_TYPED + """, s AS (SELECT iri FROM d WHERE doc_key = 1), h(iri, distance) AS (SELECT iri, 0 FROM s UNION SELECT vb.dst, h.distance + 1 FROM h JOIN vb ON vb.src = h.iri WHERE h.distance < 2)
SELECT iri, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY iri""")
def overlay_walk(spark, sf_dir):
    """Two hops over typed edges alone."""
    seed = built(spark, sf_dir).documents.where("doc_ord = 1").select(F.col("doc_iri").alias("iri"))
    return graph.neighbourhood(graph.edges(_overlaid(spark, sf_dir), ("eli:applies",)), seed, 2).select("iri", "distance")


@query(_APPLIED + f""", w AS (SELECT src, target, row_number() OVER (ORDER BY src, target) AS k FROM y),
r AS (SELECT src, target, {_PROPOSED} AS rel, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN target || '」을 준용한다' ELSE '없는 말' END AS ev FROM w),
z AS (SELECT *, CASE WHEN rel = 'applies' AND NOT contains(ev, '준용') THEN 'cites' WHEN rel IN ('amends', 'based_on') THEN 'cites' ELSE rel END AS kind FROM r),
x AS (SELECT src, target, kind, CASE WHEN kind = 'other' THEN 'rej_unknown' WHEN ev = '' OR ev = '없는 말' THEN 'rej_evidence'
  WHEN kind = 'applies' AND {_RANK.format('src')} < {_RANK.format('target')} THEN 'rej_direction' ELSE 'kept' END AS outcome FROM z),
g AS (SELECT * FROM d WHERE doc_family = '법규체'),
many AS (SELECT d.doc_title AS src, t.doc_title AS target FROM c JOIN d USING (doc_key) JOIN d t ON t.doc_title = regexp_extract(c.text, '「([^」]+)」을 준용한다', 1)
  WHERE d.doc_family = '법규체' AND t.doc_family = '법규체' AND d.doc_title <> t.doc_title)
SELECT 'src_with_targets' AS counter, count(DISTINCT a.doc_title) AS n FROM g a JOIN g b ON a.doc_key <> b.doc_key AND contains(a.squeezed, b.doc_title)
UNION ALL SELECT 'rej_direction_det', count(*) FROM many WHERE {_RANK.format('src')} < {_RANK.format('target')}
UNION ALL SELECT o, (SELECT count(*) FROM x WHERE outcome = o) FROM (VALUES ('kept'), ('rej_unknown'), ('rej_evidence'), ('rej_direction')) AS names(o)
UNION ALL SELECT 'llm_calls', count(DISTINCT src) FROM x
UNION ALL SELECT 'applies_deterministic', count(*) FROM (SELECT DISTINCT src, target FROM y WHERE {_RANK.format('src')} >= {_RANK.format('target')}
  EXCEPT SELECT src, target FROM x WHERE outcome = 'kept' AND kind = 'applies')""")
def edge_stats(spark, sf_dir):
    docs = built(spark, sf_dir).documents
    pairs = stored(classify.applied(docs).select("src", "target").distinct().withColumn("k", F.row_number().over(W.orderBy("src", "target"))))
    ev = F.expr("CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN concat(target, '」을 준용한다') ELSE '없는 말' END")
    return classify.stats(docs, pairs.select(F.col("src").alias("src_title"), "target", F.expr(_PROPOSED).alias("relation"), ev.alias("evidence")))


@query(_APPLIED + " SELECT src AS src_title, target, 'r' || run AS run FROM y, (VALUES (1), (2)) AS v(run)")
def proposal_runs(spark, sf_dir):
    """Proposals of two runs, the second written twice."""
    made = classify.applied(built(spark, sf_dir).documents).select(F.col("src").alias("src_title"), "target").distinct()
    path = fresh_path(spark, "proposals")
    for run in ("r1", "r2", "r2"):
        tables.append_proposals(made, path, run)
    return spark.read.parquet(path)


@query(TRIPLES + " SELECT s AS iri, p, string_agg(o, '|' ORDER BY o) AS vals FROM t WHERE kind <> 'iri' AND p NOT IN ('rdfs:label', 'skos:prefLabel') GROUP BY s, p")
def node_attributes(spark, sf_dir):
    nodes = graph.node_index(built(spark, sf_dir).triples)
    return nodes.select("iri", F.explode("attrs").alias("p", "vals")).select("iri", "p", F.array_join("vals", "|").alias("vals"))


@query(C + " SELECT iri FROM d WHERE doc_key % 2 = 0")
def schema_nodes(spark, sf_dir):
    """Documents of a graph in which every other one is said to be a class."""
    g = built(spark, sf_dir)
    odd = g.documents.where("doc_ord % 2 = 1").select(F.col("doc_iri").alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"))
    nodes = graph.node_index(with_overlay(g.triples, odd))
    return nodes.join(g.documents.select(F.col("doc_iri").alias("iri")), "iri", "left_semi").select("iri")


@query(TRIPLES + " SELECT a.iri, string_agg(a.article, ' ' ORDER BY k.seq) AS parts FROM a JOIN k USING (chunk_id) GROUP BY a.iri")
def triple_order(spark, sf_dir):
    """A document's articles as the graph lists them."""
    parts = built(spark, sf_dir).triples.where("p = 'eli:has_part'").groupBy(F.col("s").alias("iri"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("ord", "o"))).alias("x")).select("iri", F.array_join(F.transform("x", lambda v: v["o"]), " ").alias("parts"))


@query(C + """, f AS (SELECT d.iri, c.seq, '제' || c.seq % 3 || '조' AS label, c.doc_key FROM c JOIN d USING (doc_key) WHERE c.unit = '조')
SELECT iri || '_' || label AS article_iri, CAST(min(seq) AS INTEGER) AS seq FROM f GROUP BY iri, label""")
def articles_repeated(spark, sf_dir):
    """Chunks whose labels recur: the first of each label is the article."""
    rows = corpus.fixture_chunks(spark, sf_dir).withColumn("article_label", F.when(F.col("unit") == "조", F.concat(F.lit("제"), F.col("seq") % 3, F.lit("조"))).otherwise(F.col("article_label")))
    return extract.articles(rows, built(spark, sf_dir).documents).select("article_iri", "seq")


@query(C + """, m AS (SELECT count(*) AS m FROM d), s AS (SELECT d.iri, d.doc_key, min(c.seq) AS seq FROM c JOIN d USING (doc_key) GROUP BY ALL)
SELECT s.iri AS doc_iri, t.iri AS value FROM s, m JOIN d t ON t.doc_key = (s.doc_key + 1) % m + 1 WHERE t.iri <> s.iri""")
def alias_citations(spark, sf_dir):
    """Every document introduces a short form for its title in its first chunk, which the one before it cites."""
    n = table(spark, sf_dir, "supplier").count()
    rows = corpus.fixture_chunks(spark, sf_dir)
    name = lambda k: F.format_string("줄임%04d", k)
    said = F.concat(F.lit("「"), "doc_title", F.lit("」(이하 「"), name(F.col("doc_ord")), F.lit("」이라 한다) 「"), name((F.col("doc_ord") + 1) % n + 1), F.lit("」에 따른다."))
    first = F.col("seq") == F.min("seq").over(W.partitionBy("doc_ord"))
    g = Graph(rows.withColumn("first", first).withColumn("text", F.when(F.col("first"), said).otherwise(F.lit(""))).drop("first"))
    return g.citations.where("target LIKE '줄임%'").select("doc_iri", "value").distinct()


@query("SELECT p_partkey, p_name || ' \"x\" ' || p_partkey AS said FROM part WHERE p_partkey % 3 <> 2")
def literal_values(spark, sf_dir):
    """What literals hold, of a table in which every third object is none."""
    whole = F.concat(F.col("p_name"), F.lit(' "x" '), F.col("p_partkey").cast("string"))
    o = F.when(F.col("p_partkey") % 3 == 2, F.lit("doc:d1")).otherwise(F.concat(F.lit('"'), T.escape(whole), F.lit('"')))
    rows = table(spark, sf_dir, "part").select(F.struct(F.lit("f").alias("file"), "p_partkey").alias("at"), "p_partkey", o.alias("o"))
    lines = rows.select(F.lit("f").alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("doc:d0 reg:x "), "o", F.lit(" .")).alias("raw"))
    return turtle_in.statements(lines).where("kind = 'lit'").select(F.col("ord.line").alias("p_partkey"), F.col("o").alias("said"))


@query("SELECT DISTINCT '위원회' || p_partkey % 400 AS canon FROM part WHERE (p_partkey % 400) % 3 <> 0")
def organisations_judged(spark, sf_dir):
    """Names that a judge lets pass, asked in batches."""

    def judge(labels):
        return [x for x in labels if int(x.removeprefix("위원회")) % 3]

    names = table(spark, sf_dir, "part").select(F.concat(F.lit("위원회"), (F.col("p_partkey") % 400).cast("string")).alias("canon")).distinct()
    return extract.judged(names.withColumn("label", F.col("canon")), judge).select("canon")


# --- questions


def _session(spark, sf_dir, **more) -> HybridSession:
    return HybridSession(built(spark, sf_dir).triples, vectors(spark, sf_dir), **more)


@query(E + """, m AS (SELECT iri FROM l ORDER BY label, iri LIMIT 2), v AS (SELECT l.iri FROM l WHERE label = (SELECT min(doc_title) FROM d WHERE doc_title LIKE '%시행령'))
SELECT 'llm' AS how, iri FROM m UNION ALL SELECT 'library', iri FROM m UNION ALL SELECT 'library string', iri FROM l WHERE label = '기관0001시행령'""")
def seeds_by_model(spark, sf_dir):
    """A question without a title: what a model picks of the labels it is shown; the library asks the model first."""
    pick = lambda question, labels: sorted(labels)[:2] + ["no such title"]
    session, plain = _session(spark, sf_dir, choose=pick), _session(spark, sf_dir)
    rows = [(how, x) for x in session.seeds("절차")[1] for how in [session.seeds("절차")[0]]]
    rows += [("library", x) for x in session.library_seeds("기관0001시행령")[1]] + [("library string", x) for x in plain.library_seeds("기관0001시행령")[1]]
    return spark.createDataFrame(rows, "how string, iri string")


@query(C + f""", a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM a ORDER BY vec_id LIMIT 1),
h AS (SELECT vec_id FROM a, q ORDER BY {_COS_Q} DESC, vec_id LIMIT 1)
SELECT 'vector' AS method, d.iri FROM h JOIN d ON d.doc_key = vec_id % (SELECT count(*) FROM supplier) + 1""")
def seeds_by_vector(spark, sf_dir):
    """A question that names nothing begins at the document of the nearest text."""
    got = _session(spark, sf_dir).retrieve("???", first_vector(spark, sf_dir))
    return spark.createDataFrame([(got["method"], x) for x in got["seeds"]], "method string, iri string")


@query(E + """, v AS (SELECT count(*) AS n FROM embeddings JOIN d ON doc_key = vec_id % (SELECT count(*) FROM supplier) + 1)
SELECT 'ok' AS status, (SELECT count(*) FROM l) AS regulations, n AS chunks, n AS embedded FROM v""")
def service_health(spark, sf_dir):
    got = _session(spark, sf_dir).health()
    return spark.createDataFrame([tuple(got.values())], "status string, regulations long, chunks long, embedded long")


@query(_WALK + """, rel AS (SELECT f.iri, l.label, f.distance FROM f JOIN l USING (iri) WHERE distance > 0 ORDER BY distance, f.iri LIMIT 50)
SELECT 'string' AS method, (SELECT count(*) FROM rel) AS n_related, (SELECT count(*) FROM (SELECT DISTINCT a.label || z.label FROM e JOIN l a ON a.iri = e.src JOIN l z ON z.iri = e.dst
  WHERE e.src IN (SELECT iri FROM s) OR e.dst IN (SELECT iri FROM s) LIMIT 20)) AS n_facts, 6::BIGINT AS n_hits, '답: 기관0001시행령 절차' AS answer""")
def answered(spark, sf_dir):
    chat = lambda system, user: "답: " + user.rsplit("질문: ", 1)[1]
    got = _session(spark, sf_dir, chat=chat).answer("기관0001시행령 절차", first_vector(spark, sf_dir))
    row = (got["kg"]["method"], len(got["kg"]["related"]), len(got["kg"]["facts"]), len(got["vector_global"]), got["answer"])
    return spark.createDataFrame([row], "method string, n_related long, n_facts long, n_hits long, answer string")


@query(C + " SELECT DISTINCT doc_title AS doc, length(text)::DOUBLE AS first FROM c")
def lazily_embedded(spark, sf_dir):
    """A session that embeds its chunks when it is first asked."""
    one = lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = corpus.fixture_chunks(spark, sf_dir).select(F.col("doc_title").alias("doc"), "text")
    session = HybridSession.over_chunks(built(spark, sf_dir).triples, rows, one)
    session.retrieve("기관0001시행령")
    return session.vectors.select("doc", F.col("embedding")[0].cast("double").alias("first")).distinct()


# --- streams


@query("""SELECT 0 AS batch, CAST(doc_id AS VARCHAR) AS chunk_id, substr(sha1(text), 1, 12) AS content_hash FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 1, CAST(doc_id AS VARCHAR), substr(sha1(text || '!'), 1, 12) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL""")
def stream_changes(spark, sf_dir):
    """Two deliveries of all documents, a third of them changed in the second, through a stream of files."""
    source, store, checkpoint = (fresh_path(spark, x) for x in ("delivered", "known", "stream"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    for n in range(2):
        text = F.when((F.col("doc_id") % 3 == 0) & F.lit(n == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        rows.select("chunk_id", text.alias("text")).coalesce(4).write.mode("append").parquet(source)
        incremental.follow(spark, source, "chunk_id string, text string", store, checkpoint).awaitTermination(600)
    return spark.read.parquet(store).select("batch", "chunk_id", "content_hash")
