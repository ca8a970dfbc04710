"""From raw text to chunks: articles, outline windows and the fallbacks between them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import patterns as P
from quern.functions import text as T
from quern.functions.config import bounded_batches


def split_articles(full: Column) -> Column:
    """Array of (label, title, text): pieces that begin with an article's number and title, are longer than 15 characters and not repealed."""
    pieces = F.transform(F.split(full, P.ARTICLE_SPLIT), T.strip)
    good = F.filter(pieces, lambda p: p.rlike(P.ARTICLE_HEAD) & (F.length(p) > 15) & ~F.contains(F.substring(p, 1, 22), F.lit("삭제")))
    return F.transform(
        good,
        lambda p: F.struct(
            F.concat(F.lit("제"), F.regexp_extract(p, P.ARTICLE_HEAD, 1), F.lit("조")).alias("label"), T.strip(F.regexp_extract(p, P.ARTICLE_HEAD, 2)).alias("title"), p.alias("text")
        ),
    )


def outline_sections(full: Column) -> Column:
    """Array of the sections of a cleaned text, white space collapsed."""
    cleaned = T.strip(T.clean(F.regexp_replace(full, r"\n{2,}", "\n")))
    return F.filter(F.transform(F.split(cleaned, P.OUTLINE_SPLIT), T.collapse), lambda s: s != "")


def pack_sentences(section: Column, window: int = 900) -> Column:
    """Array of pieces of whole sentences, none over `window` characters but single sentences.

    Only lengths are summed from sentence to sentence; each piece is joined once.
    """
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("open"))

    def step(acc, x):
        full = (acc["open"] > 0) & (acc["open"] + x["n"] > window)
        return F.struct(F.when(full, F.array_append(acc["cuts"], x["i"])).otherwise(acc["cuts"]).alias("cuts"), (F.when(full, 0).otherwise(acc["open"]) + x["n"] + 1).alias("open"))

    def pieces(x):
        ends = F.concat(F.slice(x["cuts"], F.lit(2), F.size(x["cuts"])), F.array(F.size(x["said"])))
        return F.zip_with(x["cuts"], ends, lambda lo, hi: T.strip(F.array_join(F.slice(x["said"], lo + 1, hi - lo), " ")))

    def cut(said):
        sizes = F.transform(said, lambda s, i: F.struct(i.alias("i"), F.length(s).alias("n")))
        return F.struct(said.alias("said"), F.aggregate(sizes, start, step, lambda acc: acc["cuts"]).alias("cuts"))

    # arrays of one element bind what is used several times, so it is made once
    packed = F.flatten(F.transform(F.transform(F.array(F.split(section, P.SENTENCE_SPLIT)), cut), pieces))
    return F.when(F.length(section) <= window, F.array(section)).otherwise(F.filter(packed, lambda s: s != ""))


def chunk_outline(full: Column, window: int = 900, least: int = 30) -> Column:
    """Array of chunks of prose: sections, long ones cut at sentences; pieces under `least` characters are dropped."""
    return F.filter(F.flatten(F.transform(outline_sections(full), lambda s: pack_sentences(s, window))), lambda s: F.length(s) >= least)


def local_chunks(files: DataFrame) -> DataFrame:
    """Chunks of (doc_ord, file_name, title, paragraphs): by articles, or else one chunk of 8,000 characters."""
    full = T.collapse(F.array_join("paragraphs", " "))
    rows = files.withColumn("full", full).where("full <> ''").withColumn("pieces", split_articles(F.col("full")))
    head = F.col("full").rlike(P.ARTICLE_HEAD.replace("(?U)^", "(?U)"))
    date = [F.regexp_extract("full", P.DATE_LOCAL, i) for i in (1, 2, 3)]
    shown = F.when(date[0] != "", F.concat(date[0], F.lit(". "), date[1].cast("int").cast("string"), F.lit(". "), date[2].cast("int").cast("string"), F.lit(".")))
    whole = F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("title"), F.substring("full", 1, 8000).alias("text")))
    rows = rows.withColumns({
        "family": F.when(head, P.LEGAL).otherwise(P.PROSE), "enacted": F.coalesce(shown, F.lit("")),
        "unit": F.when(F.size("pieces") > 0, "조").otherwise("문서"), "pieces": F.when(F.size("pieces") > 0, F.col("pieces")).otherwise(whole),
    })
    rows = rows.select("doc_ord", "file_name", F.col("title").alias("doc_title"), "family", "enacted", "unit", F.posexplode("pieces").alias("seq", "p"))
    return rows.select(
        "doc_ord", "file_name", "seq", "doc_title", F.col("file_name").alias("source_file"), F.col("family").alias("doc_family"), F.lit("문서").alias("doc_type"),
        "enacted", F.lit("").alias("last_amended"), "unit", F.col("p.label").alias("article_label"), F.col("p.title").alias("article_title"), F.col("p.text").alias("text"),
    )


def _texts(x, suffix: str, out: list) -> list:
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        if isinstance(k, str) and k.endswith(suffix) and isinstance(v, str):
            out.append(v)
        else:
            _texts(v, suffix, out)
    return out


_FITS = {"string": lambda v: isinstance(v, str) and bool(v.strip()), "list": lambda v: isinstance(v, list), "any": lambda v: v is not None}


def _first(x, part: str, fits):
    if isinstance(x, dict):
        for k, v in x.items():
            if part in k and fits(v):
                return v
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        if (found := _first(v, part, fits)) not in (None, "", []):
            return found
    return None


def _loaded(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _shown(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def collect_text(value: Column, suffix: str = "내용") -> Column:
    """Array of the texts under keys with a suffix in a JSON document (a string), depth first."""

    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda text: _texts(_loaded(text), suffix, []))

    return F.pandas_udf(run, "array<string>")(value)


def find_key(value: Column, part: str, kind: str = "string") -> Column:
    """The first value (as JSON) under a key that contains `part` in a JSON document, a level before those below it; kind: string, list or any."""
    fits = _FITS[kind]

    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda text: _shown(_first(_loaded(text), part, fits)))

    return F.pandas_udf(run, "string")(value)


_PAYLOAD = "doc_ord long, doc_title string, published string, enforced string, units array<struct<no: string, title: string, text: string>>, body string"


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload, parsed once: its dates as given, its article units, and its body unless one of the units is surely an article."""
    for b in batches:
        found = {"published": [], "enforced": [], "units": [], "body": []}
        for text in b.column(2):
            doc = _loaded(text.as_py())
            units, sure = [], False
            for u in _first(doc, "조문단위", _FITS["list"]) or ():
                u = _loaded(u) if isinstance(u, str) else u
                own = u if isinstance(u, dict) else {}
                if _shown(own.get("조문여부")) != "전문":
                    said = " ".join(_texts(u, "내용", []))
                    units.append({"no": _shown(own.get("조문번호")) or "", "title": _shown(own.get("조문제목")) or "", "text": said})
                    sure = sure or "삭제" not in said and bool(re.sub("<[^>]+>", " ", said).strip())
            found["published"].append(_first(doc, "공포일자", _FITS["string"]))
            found["enforced"].append(_first(doc, "시행일자", _FITS["string"]))
            found["units"].append(units)
            listed = None if sure else _first(doc, "조문내용", _FITS["list"])
            body = _texts(doc, "내용", []) if listed is None else [_shown(x) for x in listed if x is not None]
            found["body"].append(None if sure else " ".join(body))
        kinds = {"units": pa.list_(pa.struct([("no", pa.string()), ("title", pa.string()), ("text", pa.string())]))}
        more = [pa.array(v, kinds.get(k, pa.string())) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=["doc_ord", "doc_title", *found])


def statute_chunks(payloads: DataFrame, doc_type: str = "법령") -> DataFrame:
    """Chunks of recorded statute payloads (doc_ord, name, payload as JSON text): article units, or the body split by articles, or 8,000
    characters of it.  A payload is parsed once and its chunks come out of one row; payloads travel a few megabytes at a time."""
    bounded_batches(payloads.sparkSession)
    rows = payloads.select(F.col("doc_ord").cast("long"), F.col("name").alias("doc_title"), "payload").mapInArrow(_payloads, _PAYLOAD)
    piece = lambda unit, label, title, text: F.struct(F.lit(unit).alias("unit"), label.alias("label"), title.alias("title"), text.alias("text"))
    plain = lambda c: T.collapse(F.regexp_replace(c, "<[^>]+>", " "))
    no, none = lambda u: T.strip(u["no"]), F.lit("")
    one = F.transform("units", lambda u: piece("조", F.when(no(u) != "", F.concat(F.lit("제"), no(u), F.lit("조"))).otherwise(""), T.strip(u["title"]), plain(u["text"])))
    rows = rows.withColumn("one", F.filter(one, lambda p: (p["text"] != "") & ~p["text"].rlike(r"(?U)^제\s*\d+\s*조\s*삭제")))
    rows = rows.withColumn("full", F.when(F.size("one") == 0, plain(F.col("body"))))
    rows = rows.withColumn("two", F.transform(split_articles(F.col("full")), lambda a: piece("조", a["label"], a["title"], a["text"])))
    three = F.array(piece("문서", none, none, F.substring("full", 1, 8000)))
    pieces = F.when(F.size("one") > 0, F.col("one")).when(F.size("two") > 0, F.col("two")).when(F.col("full") != "", three)
    out = rows.select("doc_ord", "doc_title", T.format_date(F.col("published")).alias("enacted"), T.format_date(F.col("enforced")).alias("last_amended"), F.posexplode(pieces).alias("seq", "p"))
    source = F.concat(F.lit(doc_type + "_"), "doc_title", F.lit(".json"))
    return out.select(
        "doc_ord", source.alias("file_name"), "seq", "doc_title", source.alias("source_file"), F.lit(P.LEGAL).alias("doc_family"), F.lit(doc_type).alias("doc_type"),
        "enacted", "last_amended", F.col("p.unit").alias("unit"), F.col("p.label").alias("article_label"), F.col("p.title").alias("article_title"), F.col("p.text").alias("text"),
    )
