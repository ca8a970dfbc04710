"""Recorded answers of a statute service: search lists, bodies and attachments.  Nothing here calls a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import patterns as P
from quern.functions import text as T
from quern.operators.chunking import find_key


class NotAuthorised(RuntimeError):
    """The service refused; what it said instead of data must not be taken for data."""


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, payload); fails if any answer is a refusal."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("payload"))
    if not rows.where(F.contains("payload", F.lit(P.AUTH_FAILURE))).isEmpty():
        raise NotAuthorised("an answer says that its caller is not registered")
    return rows


def search_url(base: str, caller: str, target: str, query: Column, display: int = 100, page: Column | None = None) -> Column:
    """The address of a search, its query as UTF-8 percent escapes."""
    parts = [F.lit(f"{base}/lawSearch.do?OC={caller}&target={target}&type=JSON&display={min(display, 100)}")]
    parts += [F.lit("&page="), page.cast("string")] if page is not None else []
    return F.concat(*parts, F.lit("&query="), _escaped(query))


def body_url(base: str, caller: str, target: str, key: Column) -> Column:
    """The address of a body: of a rule by its name, of a statute by its serial number."""
    return F.concat(F.lit(f"{base}/lawService.do?OC={caller}&target={target}&type=JSON&{'LM' if target == 'admrul' else 'MST'}="), _escaped(key))


def _escaped(c: Column) -> Column:
    # a path's escapes: url_encode is that of forms
    c = F.url_encode(c.cast("string"))
    for form, path in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        c = F.replace(c, F.lit(form), F.lit(path))
    return c


def bodies(found: DataFrame, answers: DataFrame, target: str) -> DataFrame:
    """(sid, name, payload): of recorded bodies (key, payload) that of each hit, by name for rules, by serial number for statutes."""
    key = F.col("name" if target == "admrul" else "sid")
    return found.select("sid", "name", key.alias("key")).distinct().join(answers.select("key", "payload"), "key").select("sid", "name", "payload")


def paged(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Hits before the first page of their query (answers: query, page) that has none; of a serial number within a query the first."""
    empty = answers.select("query", "page").distinct().join(found.select("query", "page").distinct(), ["query", "page"], "left_anti")
    end = empty.groupBy("query").agg(F.min("page").alias("end"))
    nth = F.row_number().over(W.partitionBy("query", "sid").orderBy("page", "pos"))
    rows = found.join(end, "query", "left").where("end IS NULL OR page < end").drop("end")
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def hits(answers: DataFrame, key: str = "law") -> DataFrame:
    """(query, page, pos, sid, name, enacted, amended) of search answers (query, page, payload); key: part of the name of the list.

    Serial numbers and names stand under known keys, or else under the first that contains 일련번호 or 명.
    """
    items = F.from_json(find_key(F.col("payload"), key, "list"), "array<string>")
    rows = answers.select("query", "page", F.posexplode(items).alias("pos", "item"))
    known = lambda *keys: [F.get_json_object("item", f"$.{k}") for k in keys]
    sid = F.coalesce(*known("법령일련번호", "행정규칙일련번호", "MST", "ID"), find_key(F.col("item"), "일련번호", "any"))
    name = F.coalesce(*known("법령명한글", "행정규칙명", "법령명"), find_key(F.col("item"), "명"))
    dates = [T.format_date(find_key(F.col("item"), k, "any")).alias(n) for k, n in (("발령일자", "enacted"), ("시행일자", "amended"))]
    return rows.select("query", "page", "pos", sid.alias("sid"), T.strip(name).alias("name"), *dates).where("sid IS NOT NULL AND name <> ''")


def manuals(found: DataFrame) -> DataFrame:
    """Hits whose name tells of a manual, each serial number once: the first query's, page's and place's."""
    nth = F.row_number().over(W.partitionBy("sid").orderBy("query", "page", "pos"))
    return found.where(F.col("name").rlike(P.MANUAL_HINT)).withColumn("nth", nth).where("nth = 1").drop("nth")


def attachments(answers: DataFrame) -> DataFrame:
    """(sid, pos, name, url) of the PDF attachments of answers (sid, payload): texts before annexes and forms, else as listed."""
    as_list = lambda key: F.coalesce(
        F.from_json(find_key(F.col("payload"), key, "any"), "array<string>"), F.array_compact(F.array(find_key(F.col("payload"), key, "string")))
    )
    pairs = F.arrays_zip(as_list("첨부파일명").alias("name"), as_list("첨부파일링크").alias("url"))
    rows = answers.select("sid", F.posexplode(pairs).alias("at", "p")).select("sid", "at", "p.name", "p.url").where("url IS NOT NULL AND lower(name) LIKE '%.pdf'")
    order = W.partitionBy("sid").orderBy(F.col("name").rlike(P.ATTACHMENT_AUXILIARY).cast("int"), "at")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("sid", "pos", "name", "url")


def readable(texts: DataFrame, least: int = 400) -> DataFrame:
    """Of the texts (sid, pos, text) of each document the first with enough hangul syllables; documents without one are left out."""
    good = texts.where(T.hangul_count(F.col("text")) >= least)
    return good.groupBy("sid").agg(F.min_by("text", "pos").alias("text"))
