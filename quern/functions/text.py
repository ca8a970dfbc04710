"""Text expressions: built-in functions only, so that they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, P.SPACE, " "))


def norm(c: Column) -> Column:
    """Without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), P.SPACE, "")


def toknorm(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z가-힣]", "")


def tokens(c: Column) -> Column:
    """Different words of two or more characters that are no stop words."""
    stop = F.array(*map(F.lit, P.STOP_TOKENS))
    return F.array_distinct(F.filter(F.split(c, P.SPACE), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def strip_markup(c: Column) -> Column:
    return strip(F.replace(F.regexp_replace(c, "<[^>]+>", " "), F.lit("\n"), F.lit(" ")))


def clean(c: Column) -> Column:
    """Without what is left of dotted leaders, private-use glyphs, bullets and symbols."""
    for pattern in (r"@{2,}", r"[·∙‥…]{2,}", r"[\x{E000}-\x{F8FF}]", r"[•\x{25A0}-\x{25FF}\x{2600}-\x{27BF}]", r"[ \t]{2,}"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def format_date(c: Column) -> Column:
    """YYYYMMDD (other characters ignored) as 'YYYY. M. D.', otherwise empty."""
    d = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", "")
    shown = F.concat_ws(
        " ", F.concat(F.substring(d, 1, 4), F.lit(".")),
        F.concat(F.substring(d, 5, 2).cast("int").cast("string"), F.lit(".")), F.concat(F.substring(d, 7, 2).cast("int").cast("string"), F.lit(".")),
    )
    return F.when(F.length(d) == 8, shown).otherwise("")


def iso_date(c: Column) -> Column:
    """The first date as YYYY-MM-DD, with no look at the calendar; two-digit years are of this century; null without one."""

    def said(pattern: str, century: str) -> Column:
        part = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
        shown = F.concat(F.lit(century), part[0], F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0"))
        return F.when(part[0] != "", shown)

    return F.coalesce(said(P.DATE_LONG, ""), said(P.DATE_SHORT, "20"))


def definition_sentence(c: Column) -> Column:
    d = collapse(F.coalesce(c, F.lit("")))
    end = strip(F.regexp_extract(d, P.DEFINITION_END, 0))
    return F.substring(F.when(end != "", end).otherwise(d), 1, 180)


def escape(c: Column) -> Column:
    """As it stands between the quotes of a literal."""
    c = F.coalesce(c, F.lit(""))
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return strip(c)


def rank(title: Column) -> Column:
    """Tier of a document by its title, the highest first; tests go from the top, so a decree is found before its suffix (and 요령 by it)."""
    ladder = (
        (title.endswith("법") | title.contains("법률"), -3),
        (title.contains("시행령") | title.endswith("령"), -2),
        (title.contains("시행규칙") | title.endswith("규칙"), -1),
        (title.rlike("규정|정관|고시|훈령|예규"), 1),
        (title.contains("요령"), 2),
        (title.rlike("기준|지침|세칙"), 3),
    )
    first, *rest = ladder
    return reduce(lambda c, step: c.when(*step), rest, F.when(*first)).otherwise(4)


def is_bad_title(title: Column) -> Column:
    s = strip(F.coalesce(title, F.lit("")))
    return (s == "") | s.rlike(P.BAD_TITLE) | s.rlike(P.BAD_TITLE_START) | (F.length(norm(s)) < 3) | s.rlike(P.BAD_TITLE_DATE)


def clean_title(title: Column, source: Column) -> Column:
    """A bad title gives way to the segment of the file name that occurs most, the longest or first of several."""
    t = strip(F.coalesce(title, F.lit("")))
    stem = F.regexp_replace(F.coalesce(F.when(source != "", source), t), P.TITLE_FILE_SUFFIX, "")
    stem = F.regexp_replace(stem, P.TITLE_FILE_DATE, "")
    dropped = F.array(*map(F.lit, P.TITLE_DROPPED))
    found = F.filter(
        F.transform(F.split(stem, "_"), strip),
        lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9a-f]{6,}$") & ~p.rlike(r"^[(\[]?\d") & ~F.array_contains(dropped, p),
    )
    scored = F.transform(
        found,
        lambda p, i: F.struct((-F.size(F.filter(found, lambda q: q == p))).alias("n"), (-F.length(p)).alias("long"), i.alias("at"), p.alias("p")),
    )
    best = F.element_at(F.array_sort(scored), 1)["p"]
    return F.when(~is_bad_title(title), t).otherwise(F.when(F.size(found) > 0, best).otherwise(t))


def document_class(family: Column, source: Column) -> Column:
    by = F.create_map(*[F.lit(x) for pair in P.PREFIX_CLASS.items() for x in pair])
    return F.when(family == P.LEGAL, F.lit("eli:LegalResource")).otherwise(F.coalesce(by[F.split_part(F.coalesce(source, F.lit("")), F.lit("_"), F.lit(1))], F.lit("reg:Document")))


def hangul_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^가-힣]", ""))


def json_array(c: Column, schema: str) -> Column:
    """The array between the first '[' and the last ']' of free text, null if it is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), schema)


def literal(o: Column) -> Column:
    """What stands between the first two quotes of an object; null for others."""
    return F.when(o.startswith('"') & F.substring(o, 2, 1_000_000_000).contains('"'), F.split_part(o, F.lit('"'), F.lit(2)))
