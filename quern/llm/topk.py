"""Operator 4, exact top-k search with a bit-sliced index.

Every component x becomes floor(1024 * x).  Rows are dealt into blocks of BLOCK; a block's index holds, for each
component, one bitmap for each bit of its value (moved to be non-negative).  A query's inner product with all rows of
a block is a sum of these bitmaps at the places of the query's binary digits, in signed digits so that few are needed
(a negative digit takes the complement).  Bitmaps of equal weight are added three at a time by bitwise carry-save
adders, the last two by a ripple.  The k best rows are then selected from the most significant slice of the sum
downward; rows that still tie at the end are taken by smaller vec_id, so the result is exact.

Queries, in chunks, meet every block once: the work is that of the stated query set against all rows.  A task builds the
index of its block and then streams the queries of its chunk through it, so it holds no more than one block's rows, whose
index is packed component by component; rows are sent once for each QUERIES queries.  A block passes k rows for each query on.

Components beyond what keeps every sum within 62 bits are not in the bitmaps: rows that have such a component, and queries
that have one, are scored one by one in integers of any length, so the ranking is exact for all finite components; a score
beyond the range of a long is shown as the nearest long.

Vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as padded with
zeros.  Repeated rows are each a candidate; a query id that occurs several times
with different vectors is answered for each, with the same vector once.  No row but the query's own is left out: rows
of the same vec_id are its own.  An empty table, or one without queries, gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.grouped import bounds
from quern.llm.scratch import Scratch

SCALE = 1024
BLOCK = 1 << 16
#: Components of two vectors of 2**m components below 2**(LIMIT_BITS - m / 2) have an inner product below 2**62.
LIMIT_BITS = 31
#: Queries of a chunk: as many as QUERIES, fewer where there would be fewer tasks than TASKS.
QUERIES = 1 << 14
TASKS = 16
LEAST_QUERIES = 128


def usable(vector: str) -> str:
    """SQL: a vector with components, all of them finite."""
    return f"{vector} IS NOT NULL AND size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (the integer components) and, where one is too large for a sum in 62 bits, `wide`, the components as they were."""
    x = f"transform({vector}, x -> CAST(x AS DOUBLE))"
    out = df.where(usable(vector)).where(f"{key} IS NOT NULL").select(F.col(key).cast("long").alias("vec_id"), F.expr(x).alias("x"))
    wide = f"exists(x, a -> abs(a) * {SCALE}D >= shiftleft(1L, {LIMIT_BITS} - CAST(ceil(log2(size(x)) / 2) AS INT)))"
    return out.select(
        "vec_id",
        F.expr(f"IF({wide}, transform(x, a -> 0L), transform(x, a -> CAST(floor({SCALE}D * a) AS BIGINT)))").alias("v"),
        F.expr(f"IF({wide}, x, NULL)").alias("wide"),
    )


def signed_digits(x: int) -> list[tuple[int, bool]]:
    """(place, negative) of the non-adjacent form of x."""
    out, place, neg = [], 0, x < 0
    x = abs(x)
    while x:
        if x & 1:
            down = x & 3 == 3
            out.append((place, down != neg))
            x += 1 if down else -1
        x >>= 1
        place += 1
    return out


class BitSlices:
    """The slices of a block of rows: `planes[d, b]` is bit b of component d, less `low[d]`, of all rows."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], v[order]
        n, dim = v.shape
        self.low = v.min(axis=0)
        u = v - self.low
        self.bits = max(1, int(u.max()).bit_length())
        wide = -(-n // 64) * 64
        self.planes = np.zeros((dim, self.bits, wide // 64), np.uint64)
        one = np.zeros((self.bits, wide), bool)
        for d in range(dim):
            one[:, :n] = u[:, d] >> np.arange(self.bits)[:, None] & 1
            self.planes[d] = np.packbits(one, axis=1, bitorder="little").view(np.uint64)
        valid = np.zeros(wide, bool)
        valid[:n] = True
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the score of all rows, from the least significant; what is to be added to them)."""
        columns: dict[int, list[np.ndarray]] = {}
        add = int(q @ self.low)
        top = (1 << self.bits) - 1
        for d, x in enumerate(q.tolist()):
            for place, negative in signed_digits(x):
                if negative:
                    add -= top << place
                for b in range(self.bits):
                    columns.setdefault(place + b, []).append(~self.planes[d, b] if negative else self.planes[d, b])
        out: list[np.ndarray] = []
        w = min(columns, default=0)
        out += [np.zeros_like(self.valid)] * w
        carried: list[np.ndarray] = []
        while columns or carried:
            rows = columns.pop(w, []) + carried
            carried = []
            x = np.array(rows) if rows else np.zeros((1, len(self.valid)), np.uint64)
            while len(x) > 1:
                if len(x) == 2:
                    carried.append(x[0] & x[1])
                    x = (x[0] ^ x[1])[None]
                    break
                third = len(x) // 3
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                t = a ^ b
                carried += list((a & b) | (t & c))
                x = np.concatenate([t ^ c, x[3 * third :]])
            out.append(x[0])
            w += 1
        return out, add

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the k best rows but the query's own."""
        slices, add = self.sums(q)
        tied = self.valid.copy()
        lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        for i in range(lo, hi):
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure = np.zeros_like(tied)
        for s in reversed(slices):
            more = sure | (tied & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied &= s
            else:
                sure = more
                tied &= ~s
                if n == k:
                    tied[:] = 0
                    break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(tied)[: k - len(rows)]])
        score = np.full(len(rows), add, np.int64)
        block, at = rows >> 6, (rows & 63).astype(np.uint64)
        for w, s in enumerate(slices):
            score += ((s[block] >> at) & np.uint64(1)).astype(np.int64) << w
        return self.ids[rows], score

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == dim).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists.to_numpy(zero_copy_only=False)):
        out[i, : len(x)] = x
    return out


def _key(x: int) -> bytes:
    """Bytes in the order of the integers."""
    size = x.bit_length() // 8 + 1
    lead = (1 << 31) + (size if x >= 0 else -size)
    return lead.to_bytes(4, "big") + (x if x >= 0 else x + (1 << 8 * size)).to_bytes(size, "big")


def _exact(v: np.ndarray, wide: list[float] | None) -> list[int]:
    return v.tolist() if wide is None else [math.floor(Fraction(x) * SCALE) for x in wide]


class Block:
    """Rows of a block: the index of those it can hold, and the others as integers of any length."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        ids = np.concatenate([np.zeros(0, np.int64), *(p.column("vec_id").to_numpy() for p in parts)])
        v = np.concatenate([np.zeros((0, dim), np.int64), *(_matrix(p.column("v"), dim) for p in parts)])
        wide = [x for p in parts for x in p.column("wide").to_pylist()]
        fits = np.array([x is None for x in wide], bool)
        self.index = BitSlices(ids[fits], v[fits]) if fits.any() else None
        self.others = [(int(i), _exact(v[k], wide[k])) for i, k in zip(ids[~fits], np.flatnonzero(~fits))]
        self.ids, self.v = ids[fits], v[fits]

    def best(self, own: int, q: np.ndarray, wide: list[float] | None, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows but the query's own."""
        exact = _exact(q, wide)
        rest = self.others
        found = []
        if wide is not None:
            rest = rest + list(zip(self.ids.tolist(), self.v.tolist()))
        elif self.index:
            found = [(-s, i) for i, s in zip(*(x.tolist() for x in self.index.best(q, own, k)))]
        found += [(-sum(a * b for a, b in zip(exact, x)), i) for i, x in rest if i != own]
        return [(i, -s) for s, i in heapq.nsmallest(k, found)]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows.  Both inputs are as `quantised` gives them."""
    spark = rows.sparkSession
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    queries = queries.dropDuplicates(["vec_id", "v", "wide"])
    nq, q_dim = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, q_dim)
    blocks = -(-n // BLOCK)
    chunks = max(-(-nq // QUERIES), min(-(-TASKS // blocks), -(-nq // LEAST_QUERIES)))
    h = F.xxhash64("vec_id", "v", "wide")
    # the side of the rows goes to every chunk of queries, the queries to every block of rows
    left = rows.select("vec_id", "v", "wide", F.lit(None).cast("long").alias("query"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.select("vec_id", "v", "wide", h.alias("query"), F.pmod(h, F.lit(chunks)).cast("int").alias("chunk"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, block = [], None, None
        for b in batches:
            at = bounds(b.column("block").to_numpy(), b.column("chunk").to_numpy(), b.column("query").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip(at[:-1], at[1:]):
                part = b.slice(lo, hi - lo)
                here = (part.column("block")[0].as_py(), part.column("chunk")[0].as_py())
                if here != key:
                    held, key, block = [], here, None
                if not part.column("query")[0].is_valid:
                    held.append(part)
                    continue
                if block is None:
                    block, held = Block(held, dim), []
                vectors, wide = _matrix(part.column("v"), dim), part.column("wide").to_pylist()
                best = [block.best(q, x, w, k) for q, x, w in zip(part.column("vec_id").to_pylist(), vectors, wide)]
                of = pa.array(np.repeat(np.arange(hi - lo), [len(x) for x in best]))
                score = [s for x in best for _, s in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(of), part.column("query").take(of), pa.array([i for x in best for i, _ in x], pa.int64()),
                        pa.array([max(-(1 << 63), min(s, (1 << 63) - 1)) for s in score], pa.int64()), pa.array([_key(s) for s in score], pa.binary()),
                    ],
                    names=["query_id", "query", "vec_id", "score", "by"],
                )

    dealt = left.unionByName(right).repartition(int(blocks * chunks), "block", "chunk").sortWithinPartitions("block", "chunk", F.col("query").asc_nulls_first())
    found = dealt.select("block", "chunk", "query", "vec_id", "v", "wide").mapInArrow(run, "query_id long, query long, vec_id long, score long, by binary")
    order = W.partitionBy("query_id", "query").orderBy(F.desc("by"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = Scratch(spark).keep(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
