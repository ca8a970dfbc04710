"""Chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import text as T

CHUNKS = (
    "doc_ord long, file_name string, seq int, doc_title string, source_file string, doc_family string, doc_type string, enacted string, "
    "last_amended string, unit string, article_label string, article_title string, text string, chunk_id string, content_hash string"
)


def assign_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id from the raw title and the position, content_hash from the text."""
    return chunks.withColumns({"chunk_id": ids.chunk(F.col("doc_title"), F.col("seq")), "content_hash": ids.content_hash(F.col("text"))})


def documents(chunks: DataFrame) -> DataFrame:
    """One row for each document; its first chunk carries its metadata.  A later document of the same normalised title gets an id of its own."""
    first = lambda c: F.min_by(F.coalesce(F.col(c), F.lit("")), "seq").alias(c)
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("t"))))
    docs = chunks.groupBy("doc_ord").agg(
        first("doc_title"), first("source_file"), first("doc_family"), first("doc_type"), first("enacted"), first("last_amended"),
        F.first("file_name").alias("file_name"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"),
    )
    source = F.when(F.col("source_file") != "", F.col("source_file")).otherwise(F.coalesce("file_name", F.lit("")))
    docs = docs.select(
        "doc_ord", T.clean_title(F.col("doc_title"), source).alias("title"), F.col("doc_family").alias("family"), "doc_type",
        F.col("source_file").alias("source"), "enacted", F.col("last_amended").alias("amended"), "text",
        T.document_class(F.col("doc_family"), F.col("source_file")).alias("cls"),
    ).withColumn("title_norm", T.norm(F.col("title")))
    nth = F.row_number().over(W.partitionBy("title_norm").orderBy("doc_ord"))
    salt = F.when(F.col("source") != "", F.col("source")).otherwise((F.col("nth") - 1).cast("string"))
    return docs.withColumn("nth", nth).withColumn(
        "doc_iri", F.when(F.col("nth") == 1, ids.document(F.col("title"))).otherwise(ids.document_again(F.col("title"), salt))
    )


_TITLE = """concat('기관', lpad(CAST({k} AS STRING), 4, '0'), CASE CAST({k} % 6 AS INT) WHEN 0 THEN '설치법' WHEN 1 THEN '시행령' WHEN 2 THEN '시행규칙'
           WHEN 3 THEN '업무규정' WHEN 4 THEN '운영요령' ELSE '처리지침' END)"""

#: One statement, valid in Spark and in DuckDB: documents from supplier, chunks from all of lineitem; a document names four others,
#: one of them never in brackets.
FIXTURE_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM {{supplier}}),
li AS (
  SELECT l_suppkey AS k, l_partkey AS p,
         (l_suppkey + CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 11 ELSE 29 END) % n.n AS named,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS seq
  FROM {{lineitem}} CROSS JOIN n WHERE l_suppkey IN (SELECT s_suppkey FROM {{supplier}})),
x AS (SELECT k, p, seq, k % 4 <> 3 AS legal, {_TITLE.format(k='k')} AS doc_title, {_TITLE.format(k='named')} AS other FROM li)
SELECT k AS doc_key, doc_title, CASE WHEN legal THEN '법규체' ELSE '공문체' END AS doc_family, CAST(seq AS BIGINT) AS seq,
       CASE WHEN legal THEN '조' ELSE '본문' END AS unit,
       CASE WHEN legal THEN concat('제', CAST(seq AS STRING), '조') ELSE concat('§', CAST(seq AS STRING)) END AS article_label,
       CASE
         WHEN p % 7 = 0 AND p % 4 <> 3 THEN concat('이 규정은 「', other, '」을 준용한다.')
         WHEN p % 7 = 1 AND p % 4 <> 3 THEN concat('이 규정은 「', other, '」을 준용하지 아니한다.')
         WHEN p % 7 = 2 THEN concat('제2조(정의) 1. "용어', CAST(p % 50 AS STRING), '"이란 업무를 말한다.')
         WHEN p % 7 = 3 THEN concat('기술', CAST(p % 10 AS STRING), '평가위원회 및 신용보증심의회를 둔다.')
         WHEN p % 7 = 4 THEN concat('외부 『외부', CAST(p % 30 AS STRING), '특별법』에 따른다.')
         WHEN p % 7 <> 6 THEN concat('평문으로 ', other, '에서 정한 바에 따른다.')
         ELSE concat('개정 2023. 5. ', CAST(1 + p % 28 AS STRING), '. 부칙을 둔다.') END AS text
FROM x"""


def fixture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture corpus as chunks; doc_ord is the supplier's key."""
    raw = spark.sql(FIXTURE_SQL, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return assign_chunk_ids(
        raw.selectExpr(
            "doc_key AS doc_ord", "concat('규정_', doc_title, '.json') AS file_name", "CAST(seq AS INT) AS seq", "doc_title",
            "concat('규정_', doc_title, '.json') AS source_file", "doc_family", "'법령' AS doc_type",
            "concat('2020. 1. ', 1 + doc_key % 28, '.') AS enacted", "IF(doc_key % 3 = 0, concat('’21.02.0', 1 + doc_key % 9), '') AS last_amended",
            "unit", "article_label", "'' AS article_title", "text",
        )
    ).select(*[c.split()[0] for c in CHUNKS.split(", ")])
