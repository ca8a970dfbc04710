import random

import pytest

NASTY = ["", " ", "\n\t ", "a", "é ü", " x y", "x" * 200_000, "one two three four", "ab " * 20_000]


def make_documents(seed: int = 1):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvwzäß") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))

    def edited(text, n):
        w = text.split(" ")
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    passage, base = prose(70), prose(200)
    texts = [None, *NASTY, *(prose(rng.randint(1, 160)) for _ in range(60)), base]
    texts += [base] * 4 + [edited(base, k % 7) for k in range(40)]
    texts += [prose(rng.randint(0, 40)) + " " + passage + "\t" + prose(rng.randint(0, 40)) for _ in range(12)]
    texts += [passage, "  " + passage.upper() + "\n", passage + " " + passage, "word " * 120, "word " * 121]
    rng.shuffle(texts)
    return [(i, t, "en", rng.choice(["b", "a", "A", None, "a" if i % 3 else "hot"]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    rows = make_documents()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


@pytest.fixture(scope="session")
def odd(documents):
    """The same with null ids, repeated rows and columns that clash with those of the operators."""
    from pyspark.sql import functions as F

    df = documents.unionByName(documents.where("doc_id % 9 = 0"))
    df = df.unionByName(documents.where("doc_id % 10 = 1").withColumn("doc_id", F.lit(None).cast("long")))
    names = "score predicted ids decoded n_bytes n_tokens secrets size source_size target draws rep keys sig h1 h2 n mkey seg mark begin spans kept component_id label quality".split()
    return df.select("*", *[F.lit("x").alias(c) for c in names])


@pytest.fixture(scope="session")
def folder(spark, documents, tmp_path_factory):
    """A table folder as the queries read it."""
    d = tmp_path_factory.mktemp("tables")
    documents.write.parquet(f"{d}/documents.parquet")
    labels = documents.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "0 AS toxic").where("doc_id % 4 <> 0")
    labels.unionByName(labels.limit(1).selectExpr("doc_id", "CAST(NULL AS INT) AS quality", "toxic")).write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_folder(spark, documents, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    documents.limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)
