"""From raw documents to token ids: quality, near-duplicates, secrets, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs; all but the last keep the columns of documents, whatever others are there besides and however they are named.  Empty tables go
through all stages, repeated rows are documents of their own but for the stage that drops copies, and very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, minhash, mixing, quality, secrets
from quern.llm.scratch import Scratch


def _apart(docs: DataFrame):
    """(docs with names that no operator uses for the columns it doesn't read; the way back to those of docs)."""
    own = [c if c in ("doc_id", "text", "source") else f"__column{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*own), lambda out: out.select(*own).toDF(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's labelled documents, rejects go.

    A null text is scored as an empty one; rows with a null doc_id are scored and never learned from."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, back = _apart(docs)
    return back(quality.score(inner, weights).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; rows of one doc_id are one document.

    Rows with a null doc_id and null or wordless texts stay."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to their kind; null texts stay null, and every row stays."""
    inner, back = _apart(docs)
    out = back(secrets.redact(inner))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, in shuffled shards; the last draw of a source may be a part of a text.

    Null and wordless texts have no words to draw, so they are in no shard; null sources and doc_ids are sources and doc_ids."""
    inner, back = _apart(docs)
    out = back(mixing.mix(inner))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn text, and whether they decode to it; other columns end here."""
    ids = bpe.encode(docs.select("doc_id", "source", "text"), decoded=True)
    return ids.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained model, hypergeometric draws and a tokenizer have no SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        since, old = Scratch.made(), docs
        docs = scratch.keep(stage(spark, docs, sf_dir))
        Scratch.clear(spark, since)
        if i:
            scratch.drop(old)
    return docs
