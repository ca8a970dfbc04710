"""Operator 5, chat formatting by quotation linking (built-in functions only).

A message's lines are quoted as deep as the number of '>' before them.  Neighbouring lines of one depth form a passage,
which a blank line ends.  A line that names the author of the quotation under it ("... wrote:") goes with the quotation.
Passages are normalised (lower case, white space as one space) and hashed; a quoted passage is linked to the first message
that has it among its own words: of the same conversation and an earlier turn, or else of the smallest earlier
conversation.  A message replies to what its shallowest linked quotation names (the latest of several); without one, to
turn - 1 of its conversation; or else it begins a thread.  Threads are found by pointer doubling, and every message gets
its thread, its depth in it and its body without quotations; order by (thread, depth, turn) is the reply order.

Originals are reduced to one row for each passage (and conversation) before any join, so a passage that a third of
all messages share costs one row; no conversation or thread is ever gathered.  Messages that quote a passage which very many
quote are sent the original instead of meeting at its hash: passages quoted in more than a SHAREth of all quotations are fewer than
SHARE and are broadcast.  Null texts have an empty body; messages with a null conv_id or turn stand alone; messages that share
both are one node of a thread, each with its own body; repeated rows are each returned.  Very long texts are parsed whole, an
empty table gives no rows, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

SHARE = 1_000

_LINES = r"""transform(split(translate(coalesce(text, ''), '\u0001\u0002', '  '), '\\r\\n|\\n|\\r', -1), s -> named_struct(
    'lv', length(regexp_replace(regexp_extract(s, '^((?:[ \\t]?>)*)', 1), '[^>]', '')),
    'c', trim(regexp_replace(s, '^(?:[ \\t]?>)*', ''))))"""
_NAMED = r"x.c RLIKE '(?i)(wrote|schrieb|a écrit|escribió)\\s*:$' AND next.lv > x.lv"
_PASSAGES = """filter(split(array_join(zip_with(lines, slice(concat(array(CAST(NULL AS STRUCT<lv: INT, c: STRING>)), lines), 1, size(lines)),
    (x, last) -> CASE WHEN x.c = '' THEN ''
                      WHEN last.lv = x.lv AND last.c <> '' THEN concat(' ', x.c)
                      ELSE concat('\u0002', x.lv, '\u0001', x.c) END), ''), '\u0002'), p -> p <> '')"""


def parse(messages: DataFrame) -> DataFrame:
    """Adds body and passages (array of level, hash) to messages with conv_id, turn and text."""
    keep = [c for c in messages.columns if c not in ("lines", "passages", "body")]
    named = f"zip_with(lines, slice(concat(lines, array(CAST(NULL AS STRUCT<lv: INT, c: STRING>))), 2, size(lines)), (x, next) -> IF({_NAMED}, named_struct('lv', next.lv, 'c', ''), x))"
    parts = "split(p, '\u0001')"
    return (
        messages.select(*keep, F.expr(_LINES).alias("lines"))
        .withColumn("lines", F.expr(named))
        .select(
            *keep,
            F.expr("trim(BOTH '\\n ' FROM array_join(transform(filter(lines, l -> l.lv = 0), l -> l.c), '\\n'))").alias("body"),
            F.expr(_PASSAGES).alias("passages"),
        )
        .withColumn(
            "passages",
            F.expr(f"""transform(passages, p -> named_struct('level', CAST(element_at({parts}, 1) AS INT),
                'hash', sha2(lower(regexp_replace(trim(element_at({parts}, 2)), '\\\\s+', ' ')), 256)))"""),
        )
    )


def _threads(parents: DataFrame, scratch: Scratch, most: int = 40) -> DataFrame:
    """conv_id, turn, thread_conv, thread_turn, depth from conv_id, turn, p_conv, p_turn (null: begins a thread)."""
    # a node is done once its ancestor is the root of its thread; only the others are joined again
    state = scratch.keep(
        parents.select(
            "conv_id", "turn", F.coalesce("p_conv", "conv_id").alias("a_conv"), F.coalesce("p_turn", "turn").alias("a_turn"),
            F.col("p_conv").isNotNull().cast("long").alias("depth"), F.col("p_conv").isNull().alias("done"),
        )
    )
    for _ in range(most):
        if state.where("NOT done").isEmpty():
            break
        up = state.select(
            F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("a_conv").alias("b_conv"), F.col("a_turn").alias("b_turn"),
            F.col("depth").alias("more"), F.col("done").alias("last"),
        )
        moved = state.where("NOT done").join(up, ["a_conv", "a_turn"]).select(
            "conv_id", "turn", F.col("b_conv").alias("a_conv"), F.col("b_turn").alias("a_turn"), (F.col("depth") + F.col("more")).alias("depth"), F.col("last").alias("done")
        )
        old, state = state, scratch.keep(state.where("done").unionByName(moved))
        scratch.drop(old)
    else:
        raise RuntimeError(f"threads did not settle in {most} rounds")
    return state.drop("done").withColumnsRenamed({"a_conv": "thread_conv", "a_turn": "thread_turn"})


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quoted, n_linked, parent_conv, parent_turn, thread_conv, thread_turn and depth of each row."""
    scratch = Scratch(messages.sparkSession)
    rows = scratch.keep(parse(messages.select("conv_id", "turn", "role", "text")).drop("text"))
    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    passages = placed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash")
    own = passages.where("level = 0")
    here = own.groupBy("hash", "conv_id").agg(F.min("turn").alias("o_turn"))
    anywhere = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o"))
    anywhere = anywhere.select("hash", F.col("o.conv_id").alias("w_conv"), F.col("o.turn").alias("w_turn"))
    quoted = scratch.keep(passages.where("level > 0").distinct().join(here, ["hash", "conv_id"], "left"))
    often = quoted.groupBy("hash").count().where(F.col("count") > quoted.count() // SHARE).select("hash")
    often = scratch.keep(often.join(anywhere, "hash", "left"))
    rest = quoted.join(F.broadcast(often.select("hash")), "hash", "left_anti").join(anywhere, "hash", "left")
    linked = (
        quoted.join(F.broadcast(often), "hash").unionByName(rest)
        .selectExpr(
            "conv_id", "turn", "level",
            "CASE WHEN o_turn < turn THEN conv_id WHEN w_conv < conv_id THEN w_conv END AS o_conv",
            "CASE WHEN o_turn < turn THEN o_turn WHEN w_conv < conv_id THEN w_turn END AS o_turn",
        )
    )
    quotes = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quoted"),
        F.count("o_conv").alias("n_linked"),
        F.expr("max_by(struct(o_conv, o_turn), struct(-level, o_conv, o_turn)) FILTER (WHERE o_conv IS NOT NULL)").alias("q"),
    )
    nodes = placed.select("conv_id", "turn").distinct()
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("b_turn"))
    parents = scratch.keep(
        nodes.join(quotes, ["conv_id", "turn"], "left")
        .join(before, ["conv_id", "turn"], "left")
        .selectExpr(
            "conv_id", "turn", "coalesce(n_quoted, 0L) AS n_quoted", "coalesce(n_linked, 0L) AS n_linked",
            "CASE WHEN q IS NOT NULL THEN q.o_conv WHEN b_turn IS NOT NULL THEN conv_id END AS p_conv",
            "coalesce(q.o_turn, b_turn) AS p_turn",
        )
    )
    threads = _threads(parents, scratch)
    facts = parents.join(threads, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "role", "body").join(facts, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("p_conv").alias("parent_conv"), F.col("p_turn").alias("parent_turn"), "thread_conv", "thread_turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """The same rows, sorted by thread, depth and turn over all partitions."""
    return link_quotes(messages).orderBy("thread_conv", "thread_turn", "depth", "conv_id", "turn")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
