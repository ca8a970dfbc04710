"""Operator 1, mixing sources to target weights by a hypergeometric splitting tree.

Weights 3, 1, 2, repeating over the sources in code point order (null last), share 150 % of all words; no source may
exceed 2 times its own, and what it gives up is shared again by weight.  Every source's documents are dealt by hash
into blocks of about equal words.  A source's quota is whole passes over its blocks and a last pass over a permuted
part of them, whose final block is cut so that the words taken meet the target.  A binary tree splits the vector of
block quotas over the output shards: at each node the left half draws its share without replacement from all blocks
there, a multivariate hypergeometric draw, so the shards' counts add up to the quotas exactly.  Each shard then takes
the next blocks of each source's permuted draws, disjoint from every other shard's, and is shuffled by hash where it lies:
buckets of a shard are dealt by the hash, and each is sorted in the task that gets it.

Sizes, ranks, targets and quotas of sources are tables, however many sources there are.  The tree alone runs on the driver, over
BUNDLES numbers at most: where there are more sources, several share an entry of its vector and their draws are interleaved by hash.
Sources have MAX_BLOCKS blocks together, and one each at least.

Null texts have size 0 and take nothing; a null source is a source, and a null doc_id a doc_id; repeated rows are dealt each for
itself; an empty table gives an empty mix; very long texts are counted, and cut by words, whole.  Columns named as a result
are replaced, others kept.  Draws depend on doc_id, source and seed alone, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SHARDS = 16
BLOCK_WORDS = 20_000
MAX_BLOCKS = 1 << 16
BUNDLES = 1 << 12
#: Words of a bucket of a shard, about: what a task sorts.
BUCKET_WORDS = 2_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `rank` (in code point order, null last) and `target` (words) to source and n, one row for each source."""
    ranged = scratch.keep(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    # the rank is the place in the partition and the rows of those before it: one row for each partition
    part = F.shiftright("id", 33)
    counts = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, told = 0, []
    for k, n in counts:
        told.append((k, before))
        before += n
    told = sizes.sparkSession.createDataFrame(told, "part long, before long")
    ranked = ranged.join(F.broadcast(told), part == told["part"]).withColumn("rank", F.col("before") + F.expr("id & 8589934591"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = scratch.keep(ranked.select("source", "n", "rank", weight.alias("w")))
    every = ranked.agg(F.sum("n"), F.sum("w")).first()
    left, open_ = SHARE * (every[0] or 0), every[1] or 1
    while True:  # each round caps more sources, until the share of no other is too much
        over = F.lit(left) * F.col("w") / F.lit(open_) > MOST * F.col("n")
        gone, still = ranked.agg(F.sum(F.when(over, MOST * F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
        new = SHARE * (every[0] or 0) - (gone or 0), still or 1
        if new == (left, open_):
            break
        left, open_ = new
    aim = F.when(over, (MOST * F.col("n")).cast("double")).otherwise(F.lit(left) * F.col("w") / F.lit(open_))
    return ranked.select("source", "n", "rank", aim.alias("target"))


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shard, entry] block counts; each node of the tree draws its left half's from all blocks at the node."""
    out = np.zeros((shards, len(counts)), np.int64)

    def go(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        total = int(counts.sum())
        left, need, rest = np.zeros_like(counts), total * (mid - lo) // (hi - lo), total
        for i, c in enumerate(counts.tolist()):
            rest -= c
            left[i] = rng.hypergeometric(c, rest, need) if need and c else 0
            need -= int(left[i])
        go(left, lo, mid)
        go(counts - left, mid, hi)

    go(np.asarray(counts, np.int64), 0, shards)
    return out


def _rng(*key) -> np.random.Generator:
    digest = hashlib.sha256(repr(key).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))


def _quotas(blocks: pa.Table, seed: int) -> pa.Table:
    """The draws of a bundle's sources in order: of each source whole passes over its blocks, and a part of a last one."""
    of: dict[int, list[tuple[int, int]]] = {}
    for s, b, words in zip(*(blocks[c].to_pylist() for c in ("s", "b", "words"))):
        of.setdefault(s, []).append((b, words))
    facts = dict(zip(blocks["s"].to_pylist(), zip(*(blocks[c].to_pylist() for c in ("source", "target", "blocks")))))
    out: list[tuple[int, int, int, int | None]] = []
    for s in sorted(of):
        words = dict(of[s])
        source, target, n = facts[s]
        left, turn = int(target), 0
        while left > 0 and any(words.values()):
            for k in _rng(seed, source, turn).permutation(n).tolist():
                have = words.get(k, 0)
                if have and left > 0:
                    out.append((s, k, turn, None if have <= left else left))
                    left -= min(have, left)
            turn += 1
    bundle = blocks["bundle"][0].as_py()
    if len(of) > 1:
        out = [out[i] for i in _rng(seed, bundle).permutation(len(out))]
    kinds = {"s": pa.int64(), "b": pa.int32(), "pass": pa.int32(), "cut": pa.int64()}
    drawn = {name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())}
    return pa.table({"bundle": pa.array([bundle] * len(out), pa.int32()), "at": pa.array(range(len(out)), pa.int64()), **drawn})


def allocate(docs: DataFrame, shards: int = SHARDS, seed: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds size, source_size, target and draws, an array of (pass, shard, words): what the mix takes of each row."""
    scratch = Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "draws")]
    h = F.xxhash64(F.lit(seed), "doc_id", "source")
    sized = scratch.keep(docs.select(F.col("source"), n_words(F.col("text")).alias("size"), h.alias("h")))
    sizes = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("n")))
    n_sources, total = sizes.agg(F.count("*"), F.sum("n")).first()
    block_words = max(block_words, math.ceil((total or 0) / MAX_BLOCKS))
    told = targets(sizes, scratch).select(
        F.col("source").alias("__source"), F.col("rank").alias("__s"), F.col("n").alias("source_size"), "target",
        F.greatest(F.ceil(F.col("n") / block_words), F.lit(1)).cast("long").alias("__blocks"),
    )
    told = scratch.keep(told)
    # sent to all tasks while there are no more sources than blocks; joined by shuffle beyond
    near = F.broadcast(told) if n_sources <= MAX_BLOCKS else told

    def placed(rows: DataFrame, h: Column) -> DataFrame:
        out = rows.join(near, rows["source"].eqNullSafe(near["__source"]))
        return out.withColumn("__b", F.pmod(h, F.col("__blocks")).cast("int"))

    blocks = placed(sized, F.col("h")).groupBy("__s", "__b").agg(F.sum("size").alias("words"))
    bundles = max(1, min(n_sources, BUNDLES))
    draws = (
        blocks.join(near, "__s")
        .select((F.col("__s") % bundles).cast("int").alias("bundle"), F.col("__s").alias("s"), F.col("__b").alias("b"), "words", F.col("__source").alias("source"), "target", F.col("__blocks").alias("blocks"))
        .groupBy("bundle")
        .applyInArrow(lambda x: _quotas(x, seed), "bundle int, at long, s long, b int, pass int, cut long")
    )
    draws = scratch.keep(draws)
    counts = np.zeros(bundles, np.int64)
    for r in draws.groupBy("bundle").count().collect():
        counts[r["bundle"]] = r["count"]
    upto = np.cumsum(split(counts, shards, seed), axis=0).T
    upto = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(upto.tolist())], "bundle int, upto array<long>")
    shard = F.expr("size(filter(upto, n -> n <= at))").alias("shard")
    plan = scratch.keep(
        draws.join(F.broadcast(upto), "bundle").select(F.col("s").alias("__s"), F.col("b").alias("__b"), "pass", shard, "cut").groupBy("__s", "__b")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "cut"))).alias("__plan"), F.max("cut").alias("__cut"))
    )
    few = plan.count() <= 2 * MAX_BLOCKS
    rows = placed(docs.select(*keep, h.alias("__h")), F.col("__h")).drop("__source", "__blocks")
    rows = rows.join(F.broadcast(plan) if few else plan, ["__s", "__b"], "left")
    before = F.sum("size").over(W.partitionBy("__s", "__b").orderBy("__h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    whole = rows.where("__cut IS NULL").withColumns({"size": n_words(F.col("text")), "__before": F.lit(0).cast("long")})
    # a cut block has as many rows with words as it has words at most; rows without are not gathered
    cut = rows.where("__cut IS NOT NULL").withColumn("size", n_words(F.col("text")))
    # conditions that name __cut stay above the join, so words are counted in the rows of cut blocks alone
    none = cut.where("IF(__cut IS NULL, 1, size) = 0").withColumn("__before", F.lit(0).cast("long"))
    cut = cut.where("IF(__cut IS NULL, 0, size) > 0").withColumn("__before", F.coalesce(before, F.lit(0)))
    rows = whole.unionByName(cut).unionByName(none)
    part = "IF(d.cut IS NULL, size, greatest(0L, least(size, d.cut - __before)))"
    return rows.select(
        *keep, "size", "source_size", "target",
        F.expr(f"""filter(transform(coalesce(__plan, array()), d -> named_struct('pass', d.pass, 'shard', d.shard,
            'words', {part})), d -> d.words > 0)""").alias("draws"),
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 1, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The mix itself: the columns of docs, a row for each draw, with `shard`, `pass` and `words`; a draw of a part of a text
    holds its first words.  A bucket of a shard is a partition of its own, in shuffled order."""
    drawn = allocate(docs, shards, seed).withColumn("d", F.explode("draws"))
    first = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, CAST(d.words AS INT)), '')")
    drawn = drawn.withColumn("text", F.when(F.col("d.words") < F.col("size"), first).otherwise(F.col("text")))
    place = F.xxhash64(F.lit(seed + 1), "doc_id", "source", F.col("d.pass"))
    total = docs.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    buckets = max(1, math.ceil(SHARE * total / shards / bucket_words))
    return (
        drawn.select(*docs.columns, "d.shard", "d.pass", "d.words", place.alias("__place"))
        .withColumn("__part", (F.col("shard") * buckets + F.pmod(F.xxhash64("__place"), F.lit(buckets))).cast("int"))
        .repartitionById(shards * buckets, "__part")
        .sortWithinPartitions("__place")
        .drop("__place", "__part")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: what each output shard takes of the document, as shard:words, in the order of the draws."""
    return allocate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target",
        F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)").alias("taken"),
        F.expr("array_join(transform(draws, d -> concat(d.shard, ':', d.words)), ',')").alias("shards"),
    )
