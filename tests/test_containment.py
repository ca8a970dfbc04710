"""Containment by automata, by rounds of them and by rare grams gives the rows of testing every pair."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import resolve
from quern.sinks.store import numbered


@pytest.mark.parametrize("limit, rounds", [(1_000_000, 8), (60, 1_000), (60, 1)])
def test_containing_is_every_pair(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(resolve, "AUTOMATON", limit)
    monkeypatch.setattr(resolve, "ROUNDS", rounds)
    rng = random.Random(limit + rounds)
    some = lambda n: "".join(rng.choice("가나다a(\n\U0001f600") for _ in range(n))
    # keys share a long prefix, one repeats, one is too short
    keys = [(i, "공통머리" + some(3)) for i in range(40)] + [(i, some(4)) for i in range(40, 80)] + [(80, "가나"), (81, "공통머리"), (82, "공통머리"), (83, None)]
    texts = [(i, some(20) + rng.choice(keys[:80])[1] * rng.randint(0, 2) + some(30)) for i in range(60)] + [(60, ""), (61, None), (62, "공통머리"), (62, "공통머리")]
    left = spark.createDataFrame(texts, "t int, text string").repartition(3)
    right = spark.createDataFrame(keys, "k int, key string")
    got = sorted((r.t, r.k) for r in resolve.containing(left, "text", right, "key", 4).collect())
    want = sorted((t, k) for t, x in texts for k, y in keys if x is not None and y is not None and len(y) >= 4 and y in x)
    assert got == want and len(want) > 50
    assert resolve.containing(left, "text", right, "key", 4, keep=["t"]).columns == ["t", "k", "key"]
    assert resolve.containing(left, "text", right.limit(0), "key", 4).count() == 0


def test_numbered_counts_from_zero_in_order(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("x")).repartition(7)
    got = [(r.n, r.x) for r in numbered(df, "n", "x").collect()]
    assert sorted(got) == list(enumerate(sorted(x for _, x in got)))
    assert numbered(df.limit(0), "n", "x").count() == 0
