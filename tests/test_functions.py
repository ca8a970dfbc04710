import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import patterns as P
from quern.functions import text as T
from quern.functions.config import Settings, env_file

NS = uuid.UUID(P.NAMESPACE)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_ids_are_those_of_uuid_and_hashlib(spark):
    for title in ("감사규정", " 감사\t규정 ", "", "a b", "é"):
        name = "".join(title.split())
        want = uuid.uuid5(NS, name).hex
        got = one(
            spark, ids.document(F.lit(title)), ids.term(F.lit(title)), ids.organisation(F.lit(title)), ids.external(F.lit(title)), ids.chunk(F.lit(title), F.lit(7)),
            ids.vector_row(F.lit(title), F.lit("t")), ids.content_hash(F.lit(title)), ids.document_again(F.lit(title), F.lit("s")),
        )
        assert got == (
            "doc:d" + want[:16], "term:t" + want[:16], "orgn:o" + want[:16], "doc:ext" + want[:12], f"d{want[:16]}#0007",
            uuid.uuid5(NS, title + "\x01t").hex, hashlib.sha1(title.encode()).hexdigest()[:12], "doc:d" + uuid.uuid5(NS, name + "\x01s").hex[:16],
        )
    assert one(spark, ids.document(F.lit("감사규정")))[0] == "doc:d1d4507cc15755e4e"


def test_white_space(spark):
    s = "\x1c a\xa0b　c\n\x85 "
    assert one(spark, T.norm(F.lit(s)), T.strip(F.lit(s)), T.collapse(F.lit(s))) == ("abc", "a\xa0b　c", "a b c")
    assert one(spark, T.norm(F.lit(None).cast("string")), T.toknorm(F.lit("『가-A1』!"))) == ("", "가A1")
    assert one(spark, T.tokens(F.lit("업무 절차 절차 a 감사규정 및")))[0] == ["절차", "감사규정"]


@pytest.mark.parametrize(
    "said, want",
    [("2023. 5. 1.", "2023-05-01"), ("’18.01.02", "2018-01-02"), ("2023.13.45", "2023-13-45"), ("없음", None), ("", None), ("제정 1999.12.31 개정 2001.1.1", "1999-12-31")],
)
def test_dates(spark, said, want):
    assert one(spark, T.iso_date(F.lit(said)))[0] == want


def test_format_date(spark):
    assert one(spark, T.format_date(F.lit("20230501")), T.format_date(F.lit("2023-05-01")), T.format_date(F.lit("2023")), T.format_date(F.lit(None))) == (
        "2023. 5. 1.", "2023. 5. 1.", "", "",
    )


def test_ranks(spark):
    titles = ["보증법", "보증법 시행령", "보증법 시행규칙", "감사규정", "보증요령", "요령집", "심사기준", "안내서"]
    assert list(one(spark, *[T.rank(F.lit(t)) for t in titles])) == [-3, -2, -1, 1, -2, 2, 3, 4]


def test_bad_titles(spark):
    bad = ["", "  ", "| 표", "a---b", "x.json", "-제목", "가 나", "2023. 1. 2.", "2023년 1월 2일(월)"]
    good = ["감사규정", "(고용노동부) 지침", "2026년 사업계획", "1회용품 지침"]
    assert all(one(spark, *[T.is_bad_title(F.lit(t)) for t in bad])) and not any(one(spark, *[T.is_bad_title(F.lit(t)) for t in good]))
    source = F.lit("규정_감사규정_abcdef12_감사규정_시행세칙집_(20.hwpx")
    assert one(spark, T.clean_title(F.lit("|"), source), T.clean_title(F.lit("보증규정"), source), T.clean_title(F.lit("--"), F.lit("규정_1.hwpx"))) == ("감사규정", "보증규정", "--")


def test_texts(spark):
    got = one(
        spark, T.strip_markup(F.lit("<b>가</b>\n나 ")), T.clean(F.lit("a@@@@b····cd■e   f")), T.escape(F.lit(' a"b\\c\nd ')),
        T.definition_sentence(F.lit("업무를  말한다. 다음은 아니다.")), T.hangul_count(F.lit("가a나")), T.literal(F.lit('"가"^^x')), T.literal(F.lit("iri")),
    )
    assert got == ("가  나", "a b c d e f", 'a\\"b\\\\c d', "업무를 말한다.", 2, "가", None)
    assert one(spark, T.json_array(F.lit("예: [1, 2] 끝"), "array<int>"), T.json_array(F.lit("없음"), "array<int>")) == ([1, 2], None)


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("TOP_K=9\n# x=1\nKG_GRAPH_HOPS = '2'\n", encoding="utf-8")
    (tmp_path / "a" / "b").mkdir(parents=True)
    s = Settings.read(env_file(tmp_path / "a" / "b"))
    assert (s.top_k, s.hops, s.answer_hops) == (9, 2, 2) and s.judge_organisations
    all_ = {"KG_TTL": "a", "CHUNKS_DIR": "b", "VECTORS_PATH": "c", "KG_ORG_LLM_GATE": "0", "KG_MAX_RELATED": "7", "KG_ANSWER_HOPS": "1"}
    s = Settings.read(all_)
    assert (s.graph, s.chunks, s.vectors, s.judge_organisations, s.max_related, s.answer_hops) == ("a", "b", "c", False, 7, 1)
