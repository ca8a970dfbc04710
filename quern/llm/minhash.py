"""Operator 8, MinHash near-duplicates by an inverted join on signature coordinates.

A document's set holds its distinct runs of five words (A-Z lower-cased); fewer words count as one run; no words make
an empty set that links with nothing.  Two sets link when 100 * shared >= 85 * united.

1. Equal sets form a class; only its smallest doc_id goes on, so copies are never compared.
2. Every class is posted under the first PREFIX of its COORDS (coordinate, value) pairs.  A pair that agrees on MATCH
   coordinates must share one of any COORDS - MATCH + 1 posting lists: no later coordinate is posted (prefix).
3. Within a posting list collisions are counted over the whole signature, which travels with the posting.  A class
   that is already connected to the rest of its list is skipped.  A list emits edges of a forest only, fewer than its
   members.  A list over HOT members is first dealt again by pairs of coordinates, where the same prefix rule holds.
   In a list that is still longer, members that match its smallest class are linked to it, in parallel; only the others
   are left to be compared with the whole list, in pairs of blocks of HOT.
   At a similarity of 0.85 a pair misses 10 or fewer of 24 coordinates but for 3 in 10,000 pairs.
4. Components of these edges are clusters, outside of which no link can be.  Each is cut into blocks of BLOCK classes;
   a task has two blocks, with the whole texts, counts shared runs through an inverted list and emits a forest of
   confirmed links.  Components of those are the result.  A pair is left out only when both are connected already.

Nothing grows with the square of a group of copies, and no task holds more than two blocks of different texts: repeated rows
of a cluster go on once.  A null doc_id is returned as its own, unlinked row; a null text has an empty set; repeated rows share
their class; an empty table gives no rows; very long texts are taken whole, at some 100 bytes of a worker's memory for each word;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textvec as tv
from quern.llm.grouped import bounds, whole_groups
from quern.llm.scratch import Scratch, components

SHINGLE = 5
PERCENT = 85
COORDS = 24
MATCH = 14
PREFIX = COORDS - MATCH + 1
HOT = 5_000
BLOCK = 800

_A = tv.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_B = tv.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct run hashes of each row."""
    words = tv.Words(data, offsets, lower=True)
    h = words.hashes()
    all_runs = tv.runs(h, k)
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(all_runs[a : b - k + 1])
        elif b > a:
            yield tv.runs(h[a:b] + np.uint64(b - a), b - a)
        else:
            yield np.zeros(0, np.uint64)


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), h1, h2 (of the set), keys (postings) and sig (a 16-bit digest of each coordinate)."""
    tag = np.arange(COORDS, dtype=np.uint64) << np.uint64(56)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, low = [], [], [], []
            for _, _, data, offsets in tv.slices(b.column(1)):
                for u in sets(data, offsets):
                    n.append(len(u))
                    h1.append(u.sum(dtype=np.uint64))
                    h2.append(np.bitwise_xor.reduce(u * u * _A[0] + u, initial=np.uint64(0)))
                    low.append((u * _A[:, None] + _B[:, None]).min(axis=1) if len(u) else _B)
            low = np.array(low, np.uint64).reshape(-1, COORDS)
            keys = tv.mix(low[:, :PREFIX] ^ tag[:PREFIX])
            sig = (tv.mix(low) >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PREFIX), pa.array(keys.ravel().view(np.int64))),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "keys", "sig"],
            )

    return tv.carry(docs, ["doc_id", "text"])[0].mapInArrow(run, "doc_id long, n long, h1 long, h2 long, keys array<long>, sig binary")


def forest(n: int, links) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1 in which links(i) gives the neighbours of i.

    Leaves out the links of nodes in a component of more than half of them: a link to another component has an end
    outside it, which is asked.
    """
    label = np.arange(n)
    size = np.ones(n, np.int64)
    out: list[tuple[int, int]] = []
    for i in range(n):
        if size[label[i]] * 2 > n:
            continue
        near = links(i)
        own = label[i]
        others, at = np.unique(label[near], return_index=True)
        for lab, j in zip(others.tolist(), near[at].tolist()):
            if lab != own:
                out.append((i, j))
                label[label == lab] = own
                size[own] += size[lab]
                size[lab] = 0
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["key"], rows=20_000):
        key = t["key"].to_numpy()
        ids = t["rep"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, COORDS)
        edge = bounds(key)
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        same = (sig[two] == sig[two + 1]).sum(axis=1) >= MATCH
        a, b = [ids[two[same]]], [ids[two[same] + 1]]
        for lo, g in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
            s = np.ascontiguousarray(sig[lo : lo + g].T)
            got = forest(g, lambda i: np.flatnonzero((s == s[:, i : i + 1]).sum(axis=0, dtype=np.uint8) >= MATCH))
            if got:
                x = np.array(got)
                a.append(ids[lo + x[:, 0]])
                b.append(ids[lo + x[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _cut_long(posted: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges of lists over HOT members to their smallest class, postings): of those lists only what these edges leave open is posted, by blocks."""
    posted = scratch.keep(posted)
    lists = posted.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "sig")).alias("least")).where(F.col("size") > HOT)
    lists = scratch.keep(lists)
    same = f"aggregate(sequence(0, {COORDS - 1}), 0, (k, c) -> k + IF(substring(sig, 2 * c + 1, 2) = substring(least.sig, 2 * c + 1, 2), 1, 0))"
    long = scratch.keep(posted.join(lists, "key").select("key", "rep", "sig", "size", F.col("least.rep").alias("least"), F.expr(f"{same} >= {MATCH}").alias("near")))
    open_ = scratch.keep(long.where("NOT near").groupBy("key").agg(F.count("*").alias("others")))
    blocks = lambda n: F.ceil(F.col(n) / HOT).cast("int")
    left = long.join(open_, "key").withColumns({"of_all": blocks("size"), "of_others": blocks("others")})
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    met = left.select("key", "rep", "sig", own("of_all").alias("x"), count("of_others").alias("y"))
    met = met.unionByName(left.where("NOT near").select("key", "rep", "sig", count("of_all").alias("x"), own("of_others").alias("y")))
    rest = posted.join(lists.select("key"), "key", "left_anti").select("key", "rep", "sig")
    return long.where("near").select(F.col("least").alias("a"), F.col("rep").alias("b")), rest.unionByName(met.select(F.xxhash64("key", "x", "y").alias("key"), "rep", "sig"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["cluster", "x", "y"]):
        cols = [t[c].to_numpy() for c in ("cluster", "x", "y")]
        edge = bounds(*cols).tolist()
        for lo, hi in zip(edge[:-1], edge[1:]):
            part = t.slice(lo, hi - lo)
            ids = part["rep"].to_numpy()
            own = [u for _, _, d, o in tv.slices(part["text"].combine_chunks()) for u in sets(d, o)]
            n = np.array([len(u) for u in own])
            where = np.repeat(np.arange(len(own)), n)
            values, local = np.unique(np.concatenate(own), return_inverse=True)
            order = np.argsort(local, kind="stable")
            start = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(values)))])
            posted = where[order]
            first = np.concatenate([[0], np.cumsum(n)])

            def links(i: int) -> np.ndarray:
                mine = local[first[i] : first[i + 1]]
                a, c = start[mine], start[mine + 1] - start[mine]
                c_end = np.cumsum(c)
                hits = posted[np.repeat(a - (c_end - c), c) + np.arange(c_end[-1])]
                shared = np.bincount(hits, minlength=len(own))
                return np.flatnonzero(100 * shared >= PERCENT * (n + n[i] - shared))

            got = np.array(forest(len(own), links), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[got[:, 0]]), pa.array(ids[got[:, 1]])], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(_features(docs))
    classes = scratch.keep(
        rows.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("h1", "h2", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    )
    posted = classes.select(F.explode("keys").alias("key"), "rep", "sig")
    hot = posted.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    posted = posted.join(hot, "key", "left")
    again = posted.where("hot").select(
        F.explode(F.expr(f"transform(sequence(0, {PREFIX}), c -> xxhash64(key, c, substring(sig, 2 * c + 1, 2)))")).alias("key"), "rep", "sig"
    )
    edges, again = _cut_long(again, scratch)
    posted = posted.where("hot IS NULL").select("key", "rep", "sig").unionByName(again)
    edges = edges.unionByName(posted.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates, "a long, b long"))
    clusters = scratch.keep(components(edges, scratch))
    sizes = clusters.groupBy("component").count().select("component", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "component").select(
        F.col("component").alias("cluster"), F.col("node").alias("rep"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("x")
    )
    # a sort-merge join at every size: the clusters grow with the documents, so they are not to be broadcast
    texts = docs.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("mark")).hint("merge").join(placed, "rep").dropDuplicates(["rep", "mark"])
    tasks = texts.select(
        "cluster", "rep", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "x"
    ).select("cluster", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "rep", "text")
    links = tasks.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(_confirm, "a long, b long")
    found = components(links, scratch)
    classed = classes.select("h1", "h2", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classed = classed.select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    return (
        rows.select("doc_id", "n", "h1", "h2")
        .join(classed, ["h1", "h2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
