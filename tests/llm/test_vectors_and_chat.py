import math
import random

import numpy as np
import pytest

from quern.llm import quotes, topk, vector_dedup
from tests.llm import brute


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(400)]
    for i in range(400, 520):  # near copies of a few at several distances, and copies
        base = np.array(rows[i % 5][1])
        rows.append((i, (base + rng.standard_normal(24) * [0, 0.1, 0.2, 0.3][i % 4]).tolist()))
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [float("nan")] * 24), (604, [None] * 24), (605, [float("inf")] + [1.0] * 23), (700, rows[0][1])]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, i % 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n string").repartition(4), rows


def test_signed_digits():
    for x in (0, 1, -1, 7, -7, 1023, 12345, -99999):
        digits = topk.signed_digits(x)
        assert sum((-1 if neg else 1) << place for place, neg in digits) == x
        assert all(abs(a[0] - b[0]) > 1 for a, b in zip(digits, digits[1:]))


def test_top_k_is_brute_force(vectors, monkeypatch):
    df, rows = vectors
    want = brute.top(rows)
    for block, chunk in ((1 << 16, 128), (100, 2)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERIES", chunk)
        v = topk.quantised(df)
        got: dict = {}
        for r in topk.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want


def test_top_k_breaks_ties_and_runs_short(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 1.0]), (3, [0.5, -9.0]), (5, [0.5]), (5, [0.5]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 524288), (0, 2, 5, 524288), (0, 3, 5, 524288)]
    assert topk.top_k(v, v.where("vec_id % 100 = 0"), k=50).count() == 4


def test_top_k_is_exact_for_all_finite_components(spark):
    rng = np.random.default_rng(8)
    big = [[1e300, 0.0], [-1e300, 0.0], [1.7e308, 1.7e308], [3e6, -3e6], [2.0**40, 1.0], [0.0, 2.0**52], [5e-324, -5e-324], [40_000.0, 40_000.0]]
    rows = [(i, rng.standard_normal(2).tolist()) for i in range(1, 100)] + [(100 + i, x) for i, x in enumerate(big)] + [(200, [1.0, 0.0]), (300, [-1e200, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = topk.quantised(df)
    got: dict = {}
    for r in topk.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    top = 2**63 - 1
    assert got == {q: [(i, max(-top - 1, min(s, top))) for i, s in x] for q, x in brute.top(rows).items()}
    assert got[200][:2] == [(102, top), (100, top)]


def test_score_keys_keep_the_order():
    x = sorted({s * (2**p + d) for p in (0, 7, 8, 15, 16, 62, 63, 64, 1000) for d in (-1, 0, 1) for s in (1, -1)})
    assert [k for _, k in sorted((topk._key(k), k) for k in x)] == x


def test_vector_links_are_brute_force(vectors, monkeypatch):
    df, rows = vectors
    want = brute.links(rows)
    for cell, block in ((4000, 4000), (20, 30)):
        monkeypatch.setattr(vector_dedup, "CELL", cell)
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.link_vectors(df).collect()}
        linked = sum(n for n, _ in want.values())
        assert linked > 1000 and set(got) == set(want)
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.97 * linked
        assert sum(got[i][1] != want[i][1] for i in want) <= 5


def test_collisions_are_those_in_sorted_windows(monkeypatch):
    rng = np.random.default_rng(2)
    left, right = rng.standard_normal((10, 40)).round(1), rng.standard_normal((10, 300)).round(1)
    right[:, 200:] = 0.5  # many equal projections
    for least in (1, 4, 7):
        count = (np.abs(left[:, :, None] - right[:, None, :]) <= 0.75).sum(axis=0)
        for strip in (1 << 20, 700):
            monkeypatch.setattr(vector_dedup, "STRIP", strip)
            i, j = (np.concatenate(x).tolist() for x in zip(*vector_dedup.colliding(left, right, 0.75, least)))
            assert list(zip(i, j)) == list(zip(*(x.tolist() for x in np.nonzero(count >= least))))
    assert sum(len(i) for i, _ in vector_dedup.colliding(left, right[:, :0], 0.75, 1)) == 0


def test_recall_of_vector_links_does_not_fall_with_the_cells(spark, monkeypatch):
    """Pairs just over the threshold, in a table that is one cell, or has some hundred, or that many in two coordinates."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((5_000, 24)))
    side = rng.standard_normal(a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9501 * a + math.sqrt(1 - 0.9501**2) * side
    df = spark.createDataFrame([(i, x) for i, x in enumerate(np.concatenate([a, b]).tolist())], "vec_id long, embedding array<double>").repartition(8)
    for cell, choices in ((20_000, 128), (50, 128), (50, 8)):
        monkeypatch.setattr(vector_dedup, "CELL", cell)
        monkeypatch.setattr(vector_dedup, "DIRECTIONS", choices)
        lost = vector_dedup.link_vectors(df).where("n_links = 0").count() / 2
        assert lost <= 10


def test_least_count():
    assert vector_dedup.least_count(10, 1.0) == 10 and 4 <= vector_dedup.least_count(10, 0.9) <= 7


def chat(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn, r.role): r for r in quotes.link_quotes(df).collect()}


def test_quotes_are_linked_and_removed(spark):
    got = chat(spark, [
        (1, 0, "a", "First question.\nSecond line\n\nanother   Paragraph"),
        (1, 1, "b", "Ann wrote:\n> first  QUESTION. second\n> line\nIndeed so."),
        (1, 2, "c", "> > another paragraph\n>\n> Indeed so.\n\nNo, wait"),
        (1, 3, "d", "> first question. second line\n back to the start"),
        (2, 0, "e", "> No, wait\nfrom elsewhere"),
        (2, 1, "f", "> never said\nhm"),
        (3, 5, "g", None), (None, 1, "h", "> First question."), (4, 0, "i", ""), (4, 0, "j", "twin"),
    ])
    say = lambda *k: (lambda r: (r.body, r.n_quoted, r.n_linked, r.parent_conv, r.parent_turn, r.thread_conv, r.depth))(got[k])
    assert say(1, 0, "a") == ("First question.\nSecond line\n\nanother   Paragraph", 0, 0, None, None, 1, 0)
    assert say(1, 1, "b") == ("Indeed so.", 1, 1, 1, 0, 1, 1)
    assert say(1, 2, "c") == ("No, wait", 2, 2, 1, 1, 1, 2)
    assert say(1, 3, "d") == ("back to the start", 1, 1, 1, 0, 1, 1)
    assert say(2, 0, "e") == ("from elsewhere", 1, 1, 1, 2, 1, 3)
    assert say(2, 1, "f") == ("hm", 1, 0, 2, 0, 1, 4)
    assert say(3, 5, "g")[0] == "" and say(None, 1, "h")[1:] == (0, 0, None, None, None, 0)
    assert say(4, 0, "i")[0] == "" and say(4, 0, "j")[0] == "twin"


def test_chat_is_its_sql(spark, tmp_path, monkeypatch):
    """The registered SQL on conversations that quote, some passages very often, with clashing columns."""
    import duckdb

    from quern.llm import queries

    rng = random.Random(5)
    said = ["yes", "no way", "a  Longer passage\nof two lines", "third", "popular passage"] + [f"p{i}" for i in range(40)]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            text = "\n\n".join(rng.choice(["> ", "", "", "> > "]) + rng.choice(said).replace("\n", "\n> ") for _ in range(rng.randint(0, 4)))
            rows.append((c, t + (t > 3), rng.choice(["user", "bot"]), rng.choice([text, text, "Ann wrote:\n> popular passage\n" + text, None]), "x", 7))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hash string, depth int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    ran = con.execute(queries.ORACLE_SQL["op5_chat_format"])
    names = [c[0] for c in ran.description]
    want = ran.fetchall()
    for share in (1_000, 3):
        monkeypatch.setattr(quotes, "SHARE", share)
        got = queries.QUERIES["op5_chat_format"](spark, str(tmp_path)).select(*names).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r[names.index("n_linked")] for r in want) > 20


def test_long_threads(spark):
    n = 300
    rng = random.Random(2)
    rows = [(9, 0, "r", "m0")]
    parent = {0: None}
    for t in range(1, n):
        parent[t] = rng.randrange(t)
        rows.append((9, t, "r", f"> m{parent[t]}\nm{t}"))
    got = chat(spark, rows)
    depth = {0: 0}
    for t in range(1, n):
        depth[t] = depth[parent[t]] + 1
    assert {t: got[9, t, "r"].depth for t in range(n)} == depth
    assert all(got[9, t, "r"].parent_turn == parent[t] for t in range(1, n))


def test_long_text_and_plan_is_native(spark):
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(20_000))
    got = chat(spark, [(1, 0, "a", "line 7"), (1, 1, "b", text)])
    assert got[1, 1, "b"].n_quoted == 20_000 and got[1, 1, "b"].n_linked == 1 and got[1, 1, "b"].body.count("\n") == 19_999
    plan = quotes.link_quotes(spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
