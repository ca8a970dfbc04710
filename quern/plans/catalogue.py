"""Every query of the library by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import patterns as P
from quern.functions import text as T
from quern.operators import chunking, classify, corpus, extract, graph, vector
from quern.operators.resolve import containing, resolve
from quern.plans import readiness
from quern.plans.build import Graph
from quern.plans.hybrid import HybridSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The fixture corpus in DuckDB: chunks c, and documents d with their texts.
C = (
    "WITH RECURSIVE c AS (" + corpus.FIXTURE_SQL.format(supplier="supplier", lineitem="lineitem") + "),\n"
    "d AS MATERIALIZED (SELECT doc_key, doc_title, doc_family, text, squeezed, 'doc:d' || {id_title} AS iri FROM (SELECT doc_key, min(doc_title) AS doc_title, min(doc_family) AS doc_family, string_agg(text, chr(10) ORDER BY seq) AS text,\n"
    "  regexp_replace(string_agg(text, '' ORDER BY seq), '\\s+', '', 'g') AS squeezed FROM c GROUP BY doc_key))"
)
_NS = P.NAMESPACE.replace("-", "")


def _hex(x: str, digits: int = 16) -> str:
    h = f"sha1(unhex('{_NS}') || encode({x}))"
    return f"substr(substr({h}, 1, 12) || '5' || substr({h}, 14, 3), 1, {digits})"


C = C.replace("{id_title}", _hex("doc_title"))
#: e: references between documents and to statutes outside (dst, label).
E = (
    C + """,
x AS (SELECT d.doc_key, d.iri AS src, trim(u.t) AS t FROM c JOIN d USING (doc_key), unnest(regexp_extract_all(c.text, '[「『]([^」』]{2,40})[」』]', 1)) AS u(t)),
q AS (SELECT DISTINCT x.src, d.iri AS dst FROM x JOIN d ON d.doc_title = x.t WHERE d.iri <> x.src),
o AS (SELECT DISTINCT x.src, 'doc:ext' || """ + _hex("x.t", 12) + """ AS dst, x.t AS label FROM x LEFT JOIN d ON d.doc_title = x.t
      WHERE d.iri IS NULL AND regexp_matches(x.t, '(법|법률|시행령|시행규칙|령|규칙)$')),
p AS MATERIALIZED (SELECT DISTINCT a.iri AS src, b.iri AS dst FROM d a JOIN d b ON a.iri <> b.iri AND contains(a.squeezed, b.doc_title)),
e AS (SELECT src, dst FROM q UNION SELECT src, dst FROM p UNION SELECT src, dst FROM o),
l AS (SELECT iri, doc_title AS label FROM d UNION SELECT dst, label FROM o),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""
)

#: t: all triples of the graph (s, p, o, kind); k: chunks with their ids; n: links of chunks to nodes.
TRIPLES = (
    E + """,
k AS (SELECT c.*, d.iri, substr(d.iri, 5) || '#' || lpad(CAST(c.seq AS VARCHAR), 4, '0') AS chunk_id FROM c JOIN d USING (doc_key)),
a AS (SELECT iri, iri || '_' || article_label AS article, article_label, chunk_id FROM k WHERE unit = '조'),
w AS (SELECT iri, chunk_id, regexp_extract(text, '"([^"]+)"이란', 1) AS term FROM k WHERE doc_family = '법규체' AND contains(text, '제2조(정의)')),
y AS (SELECT *, 'term:t' || """ + _hex("term") + """ AS term_iri FROM w),
z AS (SELECT *, 'orgn:o' || """ + _hex("'신용보증심의회'") + """ AS org FROM k WHERE contains(text, '신용보증심의회')),
r AS (SELECT k.iri AS src, k.chunk_id, trim(u.t) AS said FROM k, unnest(regexp_extract_all(k.text, '[「『]([^」』]{2,40})[」』]', 1)) AS u(t)),
n AS (SELECT chunk_id, iri FROM k WHERE unit <> '조' UNION SELECT chunk_id, article FROM a UNION SELECT chunk_id, term_iri FROM y UNION SELECT chunk_id, org FROM z
      UNION SELECT chunk_id, d.iri FROM r JOIN d ON d.doc_title = said WHERE d.iri <> src UNION SELECT chunk_id, dst FROM r JOIN o ON o.label = said),
t(s, p, o, kind) AS (
  SELECT iri, 'rdf:type', 'eli:LegalResource', 'iri' FROM d UNION ALL SELECT iri, 'rdfs:label', doc_title, 'lit' FROM d UNION ALL SELECT iri, 'dct:type', '법령', 'lit' FROM d
  UNION ALL SELECT iri, 'eli:date_publication', '2020-01-' || lpad(CAST(1 + doc_key % 28 AS VARCHAR), 2, '0'), 'date' FROM d
  UNION ALL SELECT iri, 'dct:modified', '2021-02-0' || (1 + doc_key % 9), 'date' FROM d WHERE doc_key % 3 = 0
  UNION ALL SELECT iri, 'dct:identifier', chunk_id, 'lit' FROM k WHERE unit <> '조'
  UNION ALL SELECT article, 'rdf:type', 'eli:LegalResourceSubdivision', 'iri' FROM a UNION ALL SELECT article, 'rdfs:label', article_label, 'lit' FROM a
  UNION ALL SELECT iri, 'eli:has_part', article, 'iri' FROM a UNION ALL SELECT article, 'dct:identifier', chunk_id, 'lit' FROM a
  UNION ALL SELECT DISTINCT term_iri, 'rdf:type', 'skos:Concept', 'iri' FROM y UNION ALL SELECT DISTINCT term_iri, 'skos:prefLabel', term, 'lit' FROM y
  UNION ALL SELECT DISTINCT term_iri, 'skos:definition', '업무를 말한다.', 'lit' FROM y UNION ALL SELECT DISTINCT term_iri, 'rdfs:isDefinedBy', iri, 'iri' FROM y
  UNION ALL SELECT DISTINCT term_iri, 'dct:identifier', chunk_id, 'lit' FROM y
  UNION ALL SELECT DISTINCT dst, 'rdf:type', 'eli:LegalResource', 'iri' FROM o UNION ALL SELECT DISTINCT dst, 'rdfs:label', label, 'lit' FROM o
  UNION ALL SELECT DISTINCT dst, 'reg:external', 'true', 'bool' FROM o
  UNION ALL SELECT DISTINCT org, 'rdf:type', 'org:Organization', 'iri' FROM z UNION ALL SELECT DISTINCT org, 'rdfs:label', '신용보증심의회', 'lit' FROM z
  UNION ALL SELECT DISTINCT org, 'reg:mentionedIn', iri, 'iri' FROM z UNION ALL SELECT DISTINCT org, 'reg:establishedBy', iri, 'iri' FROM z
  UNION ALL SELECT DISTINCT org, 'dct:identifier', chunk_id, 'lit' FROM z UNION ALL SELECT src, 'dct:references', dst, 'iri' FROM e)"""
)


def query(sql: str | None = None):
    """Registers a query, and its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GRAPHS: dict[tuple, Graph] = {}


def built(spark: SparkSession, sf_dir: str) -> Graph:
    """The fixture's graph, built once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = Graph(corpus.fixture_chunks(spark, sf_dir))
    return _GRAPHS[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors of the fixture: row n belongs to document n mod (number of documents) + 1."""
    n = table(spark, sf_dir, "supplier").count()
    docs = corpus.fixture_chunks(spark, sf_dir).where("seq = 1").select("doc_ord", F.col("doc_title").alias("doc"))
    rows = table(spark, sf_dir, "embeddings").withColumn("doc_ord", F.col("vec_id") % n + 1)
    return rows.join(docs, "doc_ord").select(F.col("vec_id").alias("row_id"), "doc", F.concat(F.lit("본문 "), (F.col("vec_id") % 97).cast("string")).alias("text"), "embedding")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


# --- vectors

_UNIT = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_COS = "list_dot_product(a.v, q.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(q.v, q.v)) + 1e-9))"


@query(f"WITH a AS ({_UNIT}), q AS (SELECT v FROM a ORDER BY vec_id LIMIT 1) SELECT vec_id, round({_COS}, 6) AS score FROM a, q ORDER BY {_COS} DESC, vec_id LIMIT 6")
def vector_topk_global(spark, sf_dir):
    rows = vector.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), key="vec_id")
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH a AS ({_UNIT}), q AS (SELECT v FROM a ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, {_COS} AS score FROM a, q),
g AS (SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 6)
SELECT vec_id, round(score, 6) AS score FROM s WHERE label IN (1, 3, 5) AND vec_id NOT IN (SELECT vec_id FROM g) ORDER BY s.score DESC, vec_id LIMIT 6""")
def vector_topk_scoped(spark, sf_dir):
    rows, q = table(spark, sf_dir, "embeddings").withColumn("text", F.col("vec_id").cast("string")), first_vector(spark, sf_dir)
    scope = spark.createDataFrame([(1,), (3,), (5,)], "label int")
    got = vector.top_k_scoped(rows, q, scope, vector.top_k(rows, q, key="vec_id"), key="vec_id", label="label")
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH a AS ({_UNIT}), q AS (SELECT vec_id AS query_id, v FROM a WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, {_COS} AS score FROM a, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 6""")
def vector_topk_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.top_k_batch(rows, queries, key="vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH a AS ({_UNIT}) SELECT vec_id, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-9), 6) AS first, round(sqrt(list_dot_product(v, v)) / (sqrt(list_dot_product(v, v)) + 1e-9), 6) AS length FROM a")
def vector_normalize(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").withColumn("u", vector.normalized(F.col("embedding")))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(vector.norm(F.col("u")), 6).alias("length"))


@query("""SELECT count(*) AS n_rows, (SELECT count(*) FROM documents) AS n_meta, min(len(embedding))::INTEGER AS dim_min, max(len(embedding))::INTEGER AS dim_max,
count(*) = (SELECT count(*) FROM documents) AND count(*) = (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS agree,
min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS fits FROM embeddings""")
def preflight_counts(spark, sf_dir):
    """Vectors against the documents' rows, which need not agree, and a dimension."""
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return readiness.vectors(table(spark, sf_dir, "embeddings"), meta, 64, key="vec_id")


# --- ids and texts


@query(f"SELECT doc_id, 'd' || {_hex('source')} || '#' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS chunk_id, substr(sha1(text), 1, 12) AS content_hash FROM documents")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ids.chunk(F.col("source"), F.col("doc_id") % 10000).alias("chunk_id"), ids.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT substr(sha1(text), 1, 12) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(ids.content_hash(F.col("text")).alias("content_hash"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""SELECT page_id, trim(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(10), ' '), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM pages""")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("body"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '@{2,}', ' ', 'g'), '[·∙‥…]{2,}', ' ', 'g'), '[\\x{E000}-\\x{F8FF}]', ' ', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '[•■-◿☀-➿]', ' ', 'g'), '[ \\t]{2,}', ' ', 'g')) AS cleaned FROM a""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '.' AS shown,
strftime(o_orderdate, '%Y-%m-%d') AS iso, '20' || strftime(o_orderdate, '%y-%m-%d') AS iso_short FROM orders""")
def date_normalize(spark, sf_dir):
    day = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").withColumn("shown", T.format_date(F.date_format(day, "yyyyMMdd")))
    short = F.concat(F.lit("’"), F.date_format(day, "yy.MM.dd"))
    return rows.select("o_orderkey", "shown", T.iso_date(F.col("shown")).alias("iso"), T.iso_date(short).alias("iso_short"))


_DEFECT = "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN '| 표' WHEN 2 THEN '2023. 1. 2.' WHEN 3 THEN '-제목' WHEN 4 THEN '가나' ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, {_DEFECT} AS title, p_name AS name FROM part)
SELECT p_partkey, p_partkey % 6 <> 5 AS bad, CASE WHEN p_partkey % 6 = 5 THEN trim(name) ELSE name || 'x' END AS cleaned FROM t""")
def title_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("title", F.expr(_DEFECT))
    source = F.concat(F.lit("규정_"), F.col("p_name"), F.lit("x_abcdef01_"), F.col("p_name"), F.lit("x_2023-01-02.hwpx"))
    return rows.select("p_partkey", T.is_bad_title(F.col("title")).alias("bad"), T.clean_title(F.col("title"), source).alias("cleaned"))


_TITLE = """concat('기관', p_partkey, CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN '설치법' WHEN 1 THEN '시행령' WHEN 2 THEN '시행규칙' WHEN 3 THEN '업무규정'
WHEN 4 THEN '운영요령' WHEN 5 THEN '요령집' WHEN 6 THEN '처리지침' WHEN 7 THEN '안내' WHEN 8 THEN '정관' ELSE '법률 시행규칙' END)"""


@query(f"""SELECT {_TITLE} AS title, CAST(CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN -3 WHEN 1 THEN -2 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -2 WHEN 5 THEN 2
WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 8 THEN 1 ELSE -3 END AS INTEGER) AS tier FROM part""")
def rank_ladder(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.expr(_TITLE).alias("title")).select("title", T.rank(F.col("title")).alias("tier"))


# --- chunking


@query(C + """, j AS (SELECT doc_key, '제1조(목적) 이 규정은 다음과 같다. ' || replace(text, chr(10), ' 제7조(내용) 다음을 정한다. ') AS t FROM d),
m AS (SELECT doc_key, unnest(string_split(regexp_replace(t, '(제\\s*\\d+\\s*조\\s*\\()', '@@\\1', 'g'), '@@')) AS p FROM j)
SELECT doc_key, regexp_extract(trim(p), '^제\\s*(\\d+)\\s*조\\s*\\(([^)]{1,40})\\)', 1) AS no, count(*) AS n, sum(length(trim(p)))::BIGINT AS chars FROM m
WHERE regexp_matches(trim(p), '^제\\s*(\\d+)\\s*조\\s*\\(([^)]{1,40})\\)') AND length(trim(p)) > 15 AND NOT contains(left(trim(p), 22), '삭제') GROUP BY 1, 2""")
def article_split(spark, sf_dir):
    docs = corpus.documents(corpus.fixture_chunks(spark, sf_dir))
    full = F.concat(F.lit("제1조(목적) 이 규정은 다음과 같다. "), F.replace("text", F.lit("\n"), F.lit(" 제7조(내용) 다음을 정한다. ")))
    rows = docs.select(F.col("doc_ord").alias("doc_key"), F.inline(chunking.split_articles(full)))
    return rows.groupBy("doc_key", F.regexp_replace("label", "[제조]", "").alias("no")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_OUTLINE = r"""WITH RECURSIVE a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '@{2,}', ' ', 'g'), '[·∙‥…]{2,}', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[•■-◿☀-➿]', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM a),
c AS (SELECT doc_id, string_split(regexp_replace(t, '(\n\s*(제\s*\d+\s*[장절]|[ⅠⅡⅢⅣⅤⅥ]\.|\d{1,2}\.\s))', '@#@\1', 'g'), '@#@') AS ps FROM b),
d AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, trim(regexp_replace(unnest(ps), '\s+', ' ', 'g'), ' ') AS p FROM c),
e AS (SELECT doc_id, i, string_split(regexp_replace(p, '([.。!?·])\s+', '\1@#@', 'g'), '@#@') AS ss FROM d WHERE length(p) > 900),
r(doc_id, i, j, waiting, piece) AS (
  SELECT doc_id, i, 0, '', NULL::VARCHAR FROM e
  UNION ALL SELECT r.doc_id, r.i, r.j + 1, CASE WHEN waiting <> '' AND length(waiting) + length(ss[r.j + 1]) > 900 THEN '' ELSE waiting END || ss[r.j + 1] || ' ',
    CASE WHEN waiting <> '' AND length(waiting) + length(ss[r.j + 1]) > 900 THEN trim(waiting, ' ') END
  FROM r JOIN e USING (doc_id, i) WHERE r.j < len(ss)),
f AS (SELECT doc_id, i, 0 AS j, p AS piece FROM d WHERE length(p) <= 900 UNION ALL SELECT doc_id, i, j, piece FROM r
      UNION ALL SELECT doc_id, i, j + 1, trim(waiting, ' ') FROM r JOIN e USING (doc_id, i) WHERE r.j = len(ss))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos, CAST(length(piece) AS INTEGER) AS n_chars, substr(sha1(piece), 1, 12) AS content_hash
FROM f WHERE length(piece) >= 30"""


@query(_OUTLINE)
def outline_window(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunk_outline(F.col("text"))).alias("pos", "piece"))
    return pieces.select("doc_id", "pos", F.length("piece").alias("n_chars"), ids.content_hash(F.col("piece")).alias("content_hash"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\n{2,}', chr(10), 'g'), '(\\n\\s*(제\\s*\\d+\\s*[장절]|[ⅠⅡⅢⅣⅤⅥ]\\.|\\d{1,2}\\.\\s))', '@#@\\1', 'g'), '@#@')) AS p FROM documents)
SELECT doc_id, count(*) AS n_sections FROM s WHERE trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '' GROUP BY 1""")
def outline_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.outline_sections(F.col("text"))).cast("long").alias("n_sections"))
    return rows.where("n_sections > 0")


# --- extraction


@query(C + " SELECT doc_key AS doc_ord, CAST(seq AS INTEGER) AS seq, trim(u.t) AS target FROM c, unnest(regexp_extract_all(text, '[「『]([^」』]{2,40})[」』]', 1)) AS u(t)")
def citations_extract(spark, sf_dir):
    return extract.citations(corpus.fixture_chunks(spark, sf_dir)).select("doc_ord", "seq", "target")


@query(E + " SELECT DISTINCT src AS doc_iri, dst AS value, false AS external FROM q UNION ALL SELECT src, dst, true FROM o")
def citations_resolve(spark, sf_dir):
    return built(spark, sf_dir).citations.select("doc_iri", "value", "external").distinct()


@query(E + " SELECT DISTINCT dst AS iri, label FROM o")
def external_refs(spark, sf_dir):
    return extract.external_laws(built(spark, sf_dir).citations).select("iri", "label")


@query(E + " SELECT src AS doc_iri, dst AS value FROM p EXCEPT SELECT src, dst FROM q")
def plaintext_refs(spark, sf_dir):
    return built(spark, sf_dir).plain


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) >= 12 AND contains(d.text, b.text)")
def benchmark_containment(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", items, "item", 12, keep=["doc_id"]).select("doc_id", "item_id").distinct()


@query("""WITH p AS (SELECT p_partkey, '외부' || (p_partkey % 40) || '관리규정' AS t FROM part), k AS (SELECT DISTINCT t, min(p_partkey) AS ord FROM p GROUP BY t),
w AS (SELECT DISTINCT '외부' || (s_suppkey % 60) || '관리' AS nt FROM supplier)
SELECT nt, arg_min(k.t, k.ord) AS value FROM w LEFT JOIN k ON contains(k.t, w.nt) OR contains(w.nt, k.t) GROUP BY nt""")
def fuzzy_resolve(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(F.expr("concat('외부', p_partkey % 40, '관리규정')").alias("title_norm"), F.col("p_partkey").alias("doc_ord"))
    keys = keys.groupBy("title_norm").agg(F.min("doc_ord").alias("doc_ord")).withColumn("value", F.col("title_norm"))
    wanted = table(spark, sf_dir, "supplier").select(F.expr("concat('외부', s_suppkey % 60, '관리')").alias("nt"))
    return resolve(wanted, keys)


@query(C + f""", t AS (SELECT iri, '줄임' || lpad(CAST(doc_key AS VARCHAR), 4, '0') AS surface FROM d) SELECT surface, iri FROM t""")
def aliases(spark, sf_dir):
    chunks = corpus.fixture_chunks(spark, sf_dir)
    said = F.concat(F.lit("「"), "doc_title", F.lit("」(이하 「줄임"), F.lpad(F.col("doc_ord").cast("string"), 4, "0"), F.lit("」이라 한다) "), "text")
    graph_ = Graph(chunks.withColumn("text", F.when(F.col("seq") == 1, said).otherwise(F.col("text"))))
    return graph_.aliases.select("surface", "iri")


@query(C + """, t AS (SELECT d.iri AS doc_iri, c.doc_key, c.seq, regexp_extract(c.text, '"([^"]+)"이란', 1) AS term FROM c JOIN d USING (doc_key)
WHERE c.doc_family = '법규체' AND regexp_matches(c.text, '제2조\\(정의\\)'))
SELECT term, 'term:t' || """ + _hex("term") + """ AS term_iri, '업무를 말한다.' AS definition, count(DISTINCT doc_iri) AS n_docs FROM t GROUP BY term""")
def defined_terms(spark, sf_dir):
    g = built(spark, sf_dir)
    n = g.terms.groupBy("term_iri").agg(F.countDistinct("doc_iri").alias("n_docs"))
    return extract.first_terms(g.terms).join(n, "term_iri").select("term", "term_iri", "definition", "n_docs")


@query(C + " SELECT d.iri AS doc_iri, '신용보증심의회' AS canon, true AS established FROM c JOIN d USING (doc_key) WHERE contains(c.text, '신용보증심의회') GROUP BY d.iri")
def org_mentions(spark, sf_dir):
    return built(spark, sf_dir).mentions.groupBy("doc_iri", "canon").agg(F.bool_or("established").alias("established"))


@query("""WITH n AS (SELECT DISTINCT '지역' || (s_suppkey % 30) || '호관리위원회' AS canon FROM supplier UNION SELECT DISTINCT '호관리위원회' FROM supplier
UNION SELECT DISTINCT '제' || '지역' || (s_suppkey % 7) || '호관리위원회' FROM supplier)
SELECT canon FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.canon <> n.canon AND contains(o.canon, n.canon))""")
def org_fragments(spark, sf_dir):
    parts = ("concat('지역', s_suppkey % 30, '호관리위원회')", "'호관리위원회'", "concat('제지역', s_suppkey % 7, '호관리위원회')")
    names = table(spark, sf_dir, "supplier").select(F.explode(F.array(*map(F.expr, parts))).alias("canon"), F.col("s_suppkey").alias("doc_ord"))
    rows = names.select("canon", F.col("canon").alias("label"), "doc_ord", F.lit(0).alias("seq"), F.lit(0).alias("pos"))
    return extract.whole_organisations(rows).select("canon")


@query(C + " SELECT d.iri || '_' || c.article_label AS article_iri, c.article_label AS label FROM c JOIN d USING (doc_key) WHERE c.unit = '조'")
def articles_first(spark, sf_dir):
    return built(spark, sf_dir).articles.select("article_iri", "label")


@query(TRIPLES + """ SELECT k.chunk_id, coalesce(string_agg(n.iri, ' ' ORDER BY n.iri), '') AS kg_nodes FROM k LEFT JOIN n USING (chunk_id) GROUP BY k.chunk_id""")
def chunk_nodes(spark, sf_dir):
    return built(spark, sf_dir).annotated().select("chunk_id", F.array_join("kg_nodes", " ").alias("kg_nodes"))


@query(TRIPLES + " SELECT s, p, o, kind FROM t")
def kg_triples(spark, sf_dir):
    return built(spark, sf_dir).triples.select("s", "p", "o", "kind")


STATS = """ SELECT 'documents' AS counter, count(*) AS n FROM d UNION ALL SELECT 'doc_title_collisions', count(*) - count(DISTINCT doc_title) FROM d
UNION ALL SELECT 'aliases', count(*) FROM t WHERE p = 'skos:altLabel' UNION ALL SELECT 'articles', count(*) FROM a UNION ALL SELECT 'dates', count(*) FROM t WHERE kind = 'date'
UNION ALL SELECT 'def_terms', count(DISTINCT term_iri) FROM y UNION ALL SELECT 'ext_refs_unique', count(DISTINCT dst) FROM o UNION ALL SELECT 'cite_edges', count(*) FROM e
UNION ALL SELECT 'plaintext_refs', count(*) FROM (SELECT src, dst FROM p EXCEPT SELECT src, dst FROM q)
UNION ALL SELECT 'chunk_cite_links', (SELECT count(*) FROM r JOIN d ON d.doc_title = said WHERE d.iri <> src) + (SELECT count(*) FROM r WHERE said IN (SELECT label FROM o))
UNION ALL SELECT 'orgs', count(DISTINCT org) FROM z UNION ALL SELECT 'org_established', count(DISTINCT iri) FROM z
UNION ALL SELECT 'org_fragments_dropped', count(*) FROM z WHERE org = iri UNION ALL SELECT 'org_llm_dropped', count(*) FROM z WHERE org IS NULL
UNION ALL SELECT 'chunk_links', (SELECT count(*) FROM k WHERE unit <> '조') + (SELECT count(*) FROM a)
UNION ALL SELECT 'chunk_attr_links', (SELECT count(*) FROM (SELECT DISTINCT org, chunk_id FROM z)) + (SELECT count(*) FROM (SELECT DISTINCT term_iri, chunk_id FROM y))
UNION ALL SELECT 'chunks_annotated', count(DISTINCT chunk_id) FROM n UNION ALL SELECT 'triples', count(*) FROM t"""


@query(TRIPLES + STATS)
def kg_stats(spark, sf_dir):
    return built(spark, sf_dir).stats()


@query(f"""WITH t AS (SELECT s_suppkey, '기관' || (s_suppkey % 10) || '규정' AS title, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) AS nth FROM supplier)
SELECT s_suppkey AS doc_ord, CASE WHEN nth = 1 THEN 'doc:d' || {_hex('title')} ELSE 'doc:d' || {_hex("title || chr(1) || 'f' || s_suppkey")} END AS doc_iri FROM t""")
def title_collisions(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS doc_ord", "'' AS file_name", "0 AS seq", "concat('기관', s_suppkey % 10, '규정') AS doc_title", "concat('f', s_suppkey) AS source_file",
        "'법규체' AS doc_family", "'' AS doc_type", "'' AS enacted", "'' AS last_amended", "'' AS text",
    )
    return corpus.documents(rows).select("doc_ord", "doc_iri")


# --- typed edges

_RANK = "CASE right({0}, 2) WHEN '치법' THEN -3 WHEN '행령' THEN -2 WHEN '규칙' THEN -1 WHEN '규정' THEN 1 WHEN '요령' THEN -2 ELSE 3 END"
_APPLIED = (
    C + """, y AS (SELECT DISTINCT d.doc_title AS src, t.doc_title AS target FROM c JOIN d USING (doc_key) JOIN d t
ON t.doc_title = regexp_extract(c.text, '「([^」]+)」을 준용한다', 1) WHERE d.doc_family = '법규체' AND t.doc_family = '법규체' AND d.doc_title <> t.doc_title)"""
)


@query(_APPLIED + f" SELECT 'doc:d' || {_hex('src')} AS s, 'eli:applies' AS p, 'doc:d' || {_hex('target')} AS o FROM y WHERE {_RANK.format('src')} >= {_RANK.format('target')}")
def typed_edges_det(spark, sf_dir):
    return classify.typed_edges(built(spark, sf_dir).documents)


_PROPOSED = "CASE CAST(k % 5 AS INT) WHEN 0 THEN 'applies' WHEN 1 THEN 'amends' WHEN 2 THEN 'based_on' WHEN 3 THEN 'cites' ELSE 'other' END"


@query(_APPLIED + f""", w AS (SELECT src, target, row_number() OVER (ORDER BY src, target) AS k FROM y),
r AS (SELECT src, target, {_PROPOSED} AS rel, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN target || '」을 준용한다' ELSE '없는 말' END AS ev FROM w),
z AS (SELECT *, CASE WHEN rel = 'applies' AND NOT contains(ev, '준용') THEN 'cites' WHEN rel IN ('amends', 'based_on') THEN 'cites' ELSE rel END AS kind FROM r)
SELECT src AS src_title, target, CASE WHEN kind = 'other' THEN 'rej_unknown' WHEN ev = '' OR ev = '없는 말' THEN 'rej_evidence'
WHEN kind = 'applies' AND {_RANK.format('src')} < {_RANK.format('target')} THEN 'rej_direction' ELSE 'kept' END AS outcome FROM z""")
def proposal_gates(spark, sf_dir):
    docs = built(spark, sf_dir).documents
    pairs = classify.applied(docs).select("src", "target").distinct().withColumn("k", F.row_number().over(W.orderBy("src", "target")))
    ev = F.expr("CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN concat(target, '」을 준용한다') ELSE '없는 말' END")
    made = pairs.select(F.col("src").alias("src_title"), "target", F.expr(_PROPOSED).alias("relation"), ev.alias("evidence"))
    return classify.gate(made, docs).select("src_title", "target", "outcome")


@query(C + """, g AS (SELECT * FROM d WHERE doc_family = '법규체'), t AS (
SELECT a.doc_key, a.doc_title, a.text, b.doc_title AS target FROM g a JOIN g b ON a.doc_key <> b.doc_key AND contains(a.squeezed, b.doc_title))
SELECT doc_title AS src_title, substr(sha1(text), 1, 12) AS content_hash, CAST(count(DISTINCT target) AS INTEGER) AS n_targets FROM t WHERE doc_key % 2 <> 0 GROUP BY 1, 2""")
def proposals_missing(spark, sf_dir):
    docs = built(spark, sf_dir).documents
    cache = docs.where("doc_ord % 2 = 0").select(F.col("title").alias("src_title"), ids.content_hash(F.col("text")).alias("content_hash"))
    return classify.missing_proposals(docs, cache).select("src_title", "content_hash", F.size("targets").alias("n_targets"))


# --- the graph


@query(E + " SELECT src, dst, '참조' AS via FROM b")
def doc_graph_edges(spark, sf_dir):
    return graph.edges(built(spark, sf_dir).triples)


def _seed(spark, sf_dir) -> DataFrame:
    return built(spark, sf_dir).documents.where("doc_ord = 1").select(F.col("doc_iri").alias("iri"))


_WALK = E + """, s AS (SELECT iri FROM d WHERE doc_key = 1), h(iri, distance) AS (SELECT iri, 0 FROM s UNION SELECT b.dst, h.distance + 1 FROM h JOIN b ON b.src = h.iri WHERE h.distance < 3),
f AS (SELECT iri, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY iri)"""


@query(_WALK + " SELECT iri, distance FROM f")
def bfs_3hop(spark, sf_dir):
    return graph.neighbourhood(graph.edges(built(spark, sf_dir).triples), _seed(spark, sf_dir)).select("iri", "distance")


@query(_WALK + ", k AS (SELECT f.iri, l.label, f.distance FROM f JOIN l USING (iri) WHERE distance > 0 ORDER BY distance, f.iri LIMIT 50) SELECT label, distance FROM k WHERE distance <= 2")
def bfs_scope(spark, sf_dir):
    g = built(spark, sf_dir)
    found = graph.neighbourhood(graph.edges(g.triples), _seed(spark, sf_dir))
    return graph.related(found, graph.labels(g.triples)).where("distance <= 2").select("label", "distance")


@query(_WALK + """, u AS (SELECT f.iri, f.distance, min(b.src) AS parent FROM f JOIN b ON b.dst = f.iri JOIN f g ON g.iri = b.src AND g.distance = f.distance - 1 GROUP BY 1, 2),
w AS (SELECT f.iri, '' AS path FROM f WHERE distance = 0 UNION ALL SELECT u.iri, w.path || ' | ' || lp.label || ' –참조→ ' || lc.label FROM w JOIN u ON u.parent = w.iri
JOIN l lp ON lp.iri = u.parent JOIN l lc ON lc.iri = u.iri) SELECT iri, CASE WHEN path = '' THEN '' ELSE substr(path, 4) END AS path FROM w""")
def bfs_paths(spark, sf_dir):
    g = built(spark, sf_dir)
    found = graph.neighbourhood(graph.edges(g.triples), _seed(spark, sf_dir))
    return graph.paths(found, graph.labels(g.triples)).select("iri", F.array_join("path", " | ").alias("path"))


_QUESTION = "기관0001시행령 및 기관0005처리지침 절차를 알려줘"


@query(C + f" SELECT iri, 1.0::DOUBLE AS coverage, length(doc_title)::INTEGER AS longest FROM d WHERE contains('{_QUESTION}', doc_title)")
def seeds_string(spark, sf_dir):
    return graph.seeds_by_coverage(graph.labels(built(spark, sf_dir).triples), F.lit(_QUESTION)).select("iri", "coverage", "longest")


@query(C + " SELECT iri, 6 AS score FROM d WHERE doc_title IN ('기관0001시행령', '기관0005처리지침')")
def seeds_overlap(spark, sf_dir):
    return graph.seeds_by_overlap(graph.labels(built(spark, sf_dir).triples), F.lit("기관0001시행령 기관0005처리지침 절차")).select("iri", "score")


@query(E + """, f AS (SELECT a.label || ' 참조 ' || z.label AS fact FROM e JOIN l a ON a.iri = e.src JOIN l z ON z.iri = e.dst
WHERE e.src = (SELECT iri FROM d WHERE doc_key = 1) OR e.dst = (SELECT iri FROM d WHERE doc_key = 1)) SELECT DISTINCT 4 AS prio, fact FROM f ORDER BY fact LIMIT 20""")
def kg_facts(spark, sf_dir):
    return graph.facts(built(spark, sf_dir).triples, _seed(spark, sf_dir)).select("prio", "fact")


_INDEX = TRIPLES + """, u AS (SELECT * FROM t WHERE kind = 'iri' AND p <> 'rdf:type'),
un AS (SELECT s AS iri, string_agg(p || ' ' || n, ', ' ORDER BY p) AS n_out FROM (SELECT s, p, count(*) AS n FROM u GROUP BY ALL) GROUP BY s),
ui AS (SELECT o AS iri, string_agg(p || ' ' || n, ', ' ORDER BY p) AS n_in FROM (SELECT o, p, count(*) AS n FROM u GROUP BY ALL) GROUP BY o),
nodes AS (SELECT s AS iri, max(o) FILTER (WHERE p IN ('rdfs:label', 'skos:prefLabel')) AS label, string_agg(DISTINCT split_part(o, ':', 2), ' ') FILTER (WHERE p = 'rdf:type') AS types,
  CAST(count(DISTINCT p) FILTER (WHERE kind <> 'iri' AND p NOT IN ('rdfs:label', 'skos:prefLabel')) AS INTEGER) AS n_attrs FROM t GROUP BY s)"""


@query(_INDEX + " SELECT iri, label, types, coalesce(n_out, '') AS n_out, coalesce(n_in, '') AS n_in, n_attrs FROM nodes LEFT JOIN un USING (iri) LEFT JOIN ui USING (iri)")
def node_index_counts(spark, sf_dir):
    nodes = graph.node_index(built(spark, sf_dir).triples)
    said = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws(" ", x["p"], x["n"].cast("string"))), ", ")
    return nodes.select("iri", "label", F.array_join("types", " ").alias("types"), said(F.col("out")).alias("n_out"), said(F.col("in")).alias("n_in"), F.size("attrs").alias("n_attrs"))


@query(TRIPLES + " SELECT split_part(o, ':', 2) AS type, count(DISTINCT s) AS n FROM t WHERE p = 'rdf:type' GROUP BY 1")
def type_histogram(spark, sf_dir):
    return graph.type_histogram(graph.node_index(built(spark, sf_dir).triples))


@query(E + " SELECT iri, doc_title AS label FROM d WHERE contains(doc_title, '시행령')")
def node_search(spark, sf_dir):
    return graph.search(graph.node_index(built(spark, sf_dir).triples), "시행령", ["LegalResource"]).select("iri", "label")


@query(TRIPLES + " SELECT s AS iri, o AS label FROM t WHERE p IN ('rdfs:label', 'skos:prefLabel') ORDER BY label COLLATE ko, iri LIMIT 20 OFFSET 20")
def node_page(spark, sf_dir):
    return graph.page(graph.node_index(built(spark, sf_dir).triples), 1, 20, "ko").select("iri", "label")


@query(TRIPLES + """, i AS (SELECT iri FROM d WHERE doc_key = 1), v AS (SELECT p, o AS other, true AS outgoing FROM t, i WHERE s = iri AND kind = 'iri' AND p <> 'rdf:type'
UNION ALL SELECT p, s, false FROM t, i WHERE o = iri AND kind = 'iri' AND p <> 'rdf:type') SELECT * FROM v ORDER BY outgoing DESC, p, other LIMIT 16""")
def ego_graph(spark, sf_dir):
    g = built(spark, sf_dir)
    return graph.ego(g.triples, _seed(spark, sf_dir).first()[0])


@query(TRIPLES + " SELECT s AS iri, p, count(*) AS n, CAST(least(count(*), 200) AS INTEGER) AS n_shown, md5(array_to_string(list_slice(list_sort(list(o)), 1, 200), ' ')) AS shown_md5 FROM t WHERE kind = 'iri' AND p <> 'rdf:type' GROUP BY s, p")
def edge_groups(spark, sf_dir):
    shown = graph.edge_groups(built(spark, sf_dir).triples)
    return shown.select("iri", "p", "n", F.size("shown").alias("n_shown"), F.md5(F.array_join("shown", " ")).alias("shown_md5"))


# --- hybrid


def _session(spark, sf_dir) -> HybridSession:
    return HybridSession(built(spark, sf_dir).triples, vectors(spark, sf_dir))


_HITS = (
    _WALK + """, rel AS (SELECT f.iri, l.label, f.distance FROM f JOIN l USING (iri) WHERE distance > 0 ORDER BY distance, f.iri LIMIT 50),
sc AS (SELECT label FROM rel WHERE distance <= 2 UNION SELECT l.label FROM s JOIN l USING (iri)),
vq AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1),
va AS (SELECT vec_id, c.doc_title AS doc, '본문 ' || (vec_id % 97) AS text, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
       JOIN c ON c.seq = 1 AND c.doc_key = vec_id % (SELECT count(*) FROM supplier) + 1),
vs AS (SELECT a.vec_id, a.doc, a.text, """ + _COS.replace("q.v", "vq.v") + """ AS score FROM va a, vq),
glo AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS n FROM vs QUALIFY n <= 6),
loc AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS n FROM vs
        WHERE doc IN (SELECT label FROM sc) AND text NOT IN (SELECT text FROM glo) QUALIFY n <= 6)"""
)


@query(_HITS + """, fa AS (SELECT DISTINCT a.label || ' 참조 ' || z.label AS fact FROM e JOIN l a ON a.iri = e.src JOIN l z ON z.iri = e.dst
WHERE e.src IN (SELECT iri FROM s) OR e.dst IN (SELECT iri FROM s) ORDER BY fact LIMIT 20)
SELECT 'global' AS part, n, doc AS label, round(score, 6) AS score FROM glo UNION ALL SELECT 'scoped', n, doc, round(score, 6) FROM loc
UNION ALL SELECT 'related', distance, label, NULL FROM rel UNION ALL SELECT 'fact', 4, fact, NULL FROM fa""")
def hybrid_retrieve(spark, sf_dir):
    """Global hits, hits within the graph's scope, related documents and facts, as (part, n, label, score)."""
    got = _session(spark, sf_dir).retrieve("기관0001시행령 절차", first_vector(spark, sf_dir))
    place = F.row_number().over(W.orderBy(F.desc("score"), "row_id"))
    hits = lambda df, part: df.select(F.lit(part).alias("part"), place.alias("n"), F.col("doc").alias("label"), F.round("score", 6).alias("score"))
    related = got["related"].select(F.lit("related").alias("part"), "distance", F.col("label"), F.lit(None).cast("double"))
    facts = got["facts"].select(F.lit("fact").alias("part"), "prio", "fact", F.lit(None).cast("double"))
    return hits(got["overall"], "global").unionByName(hits(got["scoped"], "scoped")).union(related).union(facts)


@query(_HITS + """, hs AS (SELECT n AS place, doc, text FROM loc UNION ALL SELECT 6 + n, doc, text FROM glo),
once AS (SELECT min(place) AS place, arg_max(doc, place) AS doc, text FROM hs GROUP BY text), g AS (SELECT *, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS n FROM once)
SELECT n, '[' || n || '] (' || doc || ') ' || text AS line FROM g""")
def answer_context(spark, sf_dir):
    got = _session(spark, sf_dir).retrieve("기관0001시행령 절차", first_vector(spark, sf_dir))
    return vector.context(got["scoped"], got["overall"])


@query(_WALK + """, rel AS (SELECT f.iri FROM f WHERE distance > 0 ORDER BY distance, f.iri LIMIT 50),
fa AS (SELECT DISTINCT a.label || ' 참조 ' || z.label AS fact FROM e JOIN l a ON a.iri = e.src JOIN l z ON z.iri = e.dst WHERE e.src IN (SELECT iri FROM s) OR e.dst IN (SELECT iri FROM s)
  ORDER BY fact LIMIT 20)
SELECT 0 AS n, 'meta' AS type, NULL AS t, (SELECT count(*) FROM rel)::INTEGER AS n_related, (SELECT md5(string_agg(fact, '|' ORDER BY fact)) FROM fa) AS facts
UNION ALL SELECT 1, 'tok', '가', 0, NULL UNION ALL SELECT 2, 'tok', '나', 0, NULL UNION ALL SELECT 3, 'done', NULL, 0, NULL""")
def sse_events(spark, sf_dir):
    events = list(_session(spark, sf_dir).events("기관0001시행령 절차", first_vector(spark, sf_dir), lambda q: iter(["가", "나"])))
    schema = "type string, t string, kg struct<related: array<struct<iri: string>>, facts: array<string>>"
    rows = spark.createDataFrame(list(enumerate(events)), "n int, event string").withColumn("m", F.from_json(F.regexp_extract("event", r"(?s)^data: (.*)\n\n$", 1), schema))
    facts = F.md5(F.array_join(F.array_sort("m.kg.facts"), "|"))
    return rows.select("n", "m.type", "m.t", F.when(F.col("m.kg").isNotNull(), F.size("m.kg.related")).otherwise(0).alias("n_related"), facts.alias("facts"))


@query(TRIPLES + " SELECT s, p, o, kind FROM t")
def turtle_roundtrip(spark, sf_dir):
    """The triples of the graph, written as Turtle and read again."""
    from quern.sinks import turtle as sink
    from quern.sinks.store import shared_dir
    from quern.sources import turtle as source

    triples = built(spark, sf_dir).triples
    path = f"{shared_dir(spark)}/turtle-{triples.sparkSession.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    sink.write(triples, path, mode="overwrite", compression="gzip")
    return source.read(spark, path).select("s", "p", "o", "kind")


@query("""SELECT doc_id, substr(sha1(text), 1, 12) AS content_hash FROM documents WHERE doc_id % 3 = 0""")
def incremental_changed(spark, sf_dir):
    from quern.streaming.incremental import changed

    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    old = rows.select("chunk_id", ids.content_hash(F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("text"))).alias("content_hash"))
    return changed(rows, old).select("doc_id", "content_hash")


@query("""WITH h AS (SELECT conv_id, turn, length(regexp_replace(text, '[^가-힣]', '', 'g')) + 2 * (conv_id % 400) + turn % 3 AS n FROM conversations)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n_hangul, n >= 400 AS passes FROM h""")
def hangul_gate(spark, sf_dir):
    said = "concat(text, ' ', repeat('한 글ㄱA', CAST(conv_id % 400 AS INT)), repeat('힣', CAST(turn % 3 AS INT)), '1가나'), '가나', '')"
    n = T.hangul_count(F.expr(f"replace({said}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n_hangul"), (n >= 400).alias("passes"))


@query("SELECT event_id, CAST(event_id % 7 AS BIGINT) AS a, CAST(event_id % 11 AS BIGINT) AS b FROM events")
def json_scrape(spark, sf_dir):
    said = F.concat(F.lit("결과는 ["), (F.col("event_id") % 7).cast("string"), F.lit(", "), (F.col("event_id") % 11).cast("string"), F.lit("] 입니다"))
    return table(spark, sf_dir, "events").select("event_id", T.json_array(said, "array<bigint>").alias("x")).select("event_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
