"""Operator 9, near-duplicate vectors by collisions of sorted one-dimensional projections.

Vectors are scaled to length 1 and equal ones become one class with a count.

1. Dealing.  In each of several tables a class goes to the cell of the random direction on which its projection is the
   most extreme, with its sign; with very many classes to the cell of several such directions at once.  Cells have CELL
   classes on average.  How often a pair at the threshold shares a cell is calibrated by simulation, and there are as many
   tables as it takes to let all but 1 - RECALL of such pairs meet: the number of tables grows with a small power of
   the number of classes (about 0.1), and that is all by which the work of a class grows.
2. Counting.  Within a cell EARLY projections are sorted, and for each class a window centred on its own value is opened
   in every one; what lies there is found by binary search and counted for each pair.  For a pair at the threshold the
   difference of a projection has a standard deviation of sqrt(2 - 2 * threshold), and a window reaches WIDTH of these.
   Pairs below the count that a linked pair misses once in 10,000 times are left; the others are counted over all PROJECTIONS.
3. Verifying.  Pairs that reach the count in all of these as well are verified by the cosine in double precision, in the first
   table in which they share a cell, so a link is counted once.

Cells over BLOCK classes are cut into pairs of blocks, so no task holds more than two; the work there is that of the pairs.
Recall at the threshold itself is about RECALL whatever the number of vectors, and higher above it; tests measure it
against all pairs.  No link is returned below the threshold.

Links are summed where they are found; only sums and a forest leave a task.  Vectors that are null, empty, zero or hold
null or non-finite components link with nothing.  Vectors of another length are compared as if padded with zeros.  A null
vec_id is returned unlinked; an empty table gives no rows.  Rows that share a vec_id and a vector are one vector; labels and other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quern.llm.grouped import bounds, whole_groups
from quern.llm.scratch import Scratch, components
from quern.llm.topk import usable

THRESHOLD = 0.95
PROJECTIONS = 64
EARLY = 10
WIDTH = 2.5
RECALL = 0.999
#: Classes of a cell on average, and directions that one of its coordinates chooses from at most.
CELL = 256
DIRECTIONS = 128
BLOCK = 4_000
MISS = 1e-4
#: Pairs of a cell that are counted at once, about.
STRIP = 1 << 20
#: Rows of cells that a worker takes together, about.
GROUP = 4_000


def least_count(m: int, p: float, miss: float = MISS) -> int:
    """The largest count that a pair colliding with chance p in each of m projections reaches but for `miss`."""
    below = 0.0
    for c in range(m + 1):
        below += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if below > miss:
            return c
    return m


def tables(total: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(tables, coordinates of a cell, directions that each coordinate chooses from) for a number of classes."""
    cells = -(-total // CELL)
    if cells <= 1:
        return 1, 0, 0
    coords = max(1, math.ceil(math.log(cells) / math.log(2 * DIRECTIONS)))
    d = max(2, math.ceil(cells ** (1 / coords) / 2))
    rng = np.random.Generator(np.random.PCG64(7))
    x = rng.standard_normal((20_000, d))
    y = threshold * x + math.sqrt(1 - threshold**2) * rng.standard_normal(x.shape)
    meet = float((extreme(x) == extreme(y)).mean()) ** coords
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1, coords, d


def extreme(x: np.ndarray) -> np.ndarray:
    """Of each row the coordinate with the largest absolute value, and its sign."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] > 0)


def directions(dim: int, m: int = PROJECTIONS, key: tuple[int, ...] = ()) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([9, *key])).standard_normal((dim, m))


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all() and not vectors.null_count:
        out = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    else:
        out = np.zeros((len(vectors), dim))
        for i, x in enumerate(vectors.to_numpy(zero_copy_only=False)):
            out[i, : len(x)] = x
    top = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(top > 0, top, 1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def colliding(left: np.ndarray, right: np.ndarray, w: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (columns of `left`, columns of `right`) within w of each other in `least` of the projections (rows) or more.

    Each projection of `right` is sorted once; only what lies in a window is touched.
    """
    n = right.shape[1]
    order = np.argsort(right, axis=1, kind="stable")
    lines = np.take_along_axis(right, order, axis=1)
    step = max(1, STRIP // max(1, n))
    for at in range(0, left.shape[1], step):
        own = left[:, at : at + step]
        count = np.zeros(own.shape[1] * n, np.int64)
        for x, line, col in zip(own, lines, order):
            lo, size = np.searchsorted(line, x - w, "left"), np.searchsorted(line, x + w, "right")
            size -= lo
            ends = np.cumsum(size)
            base = np.arange(len(x)) * n
            seen = col[np.repeat(lo - (ends - size), size) + np.arange(ends[-1])] + np.repeat(base, size)
            count += np.bincount(seen, minlength=len(count))
        i, j = np.divmod(np.flatnonzero(count >= least), max(1, n))
        yield i + at, j


def _components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_vectors(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    ok = f"{usable('embedding')} AND exists(embedding, x -> x <> 0) AND vec_id IS NOT NULL"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.expr(f"coalesce({ok}, false)").alias("ok"))
    rows = scratch.keep(rows.select("vec_id", "ok", F.expr("IF(ok, embedding, NULL)").alias("embedding"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")))
    classes = scratch.keep(
        rows.where("ok").groupBy("h1", "h2", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")).withColumn("dim", F.size("embedding"))
    )
    total, dim = classes.agg(F.count("*"), F.max("dim")).first()
    dim = dim or 1
    n_tables, coords, d = tables(total, threshold)
    w = WIDTH * math.sqrt(2 - 2 * threshold)
    p = math.erf(WIDTH / math.sqrt(2))
    early, late = least_count(EARLY, p), least_count(PROJECTIONS, p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [[directions(dim, d, (t, c)) for c in range(coords)] for t in range(n_tables)]
        for b in batches:
            unit = _unit(b.column("embedding"), dim)
            cells = np.zeros((b.num_rows, n_tables), np.int64)
            for t, each in enumerate(made):
                for r in each:
                    cells[:, t] = cells[:, t] * (2 * d) + extreme(unit @ r)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n_tables), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=["rep", "n", "embedding", "cells"])

    inner = classes.select("rep", "n", "embedding")
    placed = scratch.keep(inner.mapInArrow(place, StructType([*inner.schema, StructField("cells", ArrayType(LongType()))])))
    # cells of more than a block; of these there are fewer than tables * total / BLOCK
    large = scratch.keep(
        placed.select(F.posexplode("cells").alias("t", "cell")).groupBy("t", "cell").count().where(F.col("count") > BLOCK)
        .select("t", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    tasks = (
        placed.select("*", F.posexplode("cells").alias("t", "cell"))
        .join(large, ["t", "cell"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "n", "embedding", "cells")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = directions(dim)
        for table in whole_groups(batches, ["t", "cell", "x", "y"], rows=GROUP):
            t, cell, x_of, y_of, own, ids, n = (table[c].to_numpy() for c in ("t", "cell", "x", "y", "own", "rep", "n"))
            unit = _unit(table["embedding"].combine_chunks(), dim)
            cells = table["cells"].combine_chunks().flatten().to_numpy().reshape(-1, n_tables)
            proj = np.ascontiguousarray((unit @ r).astype(np.float32).T)
            edge = bounds(t, cell, x_of, y_of).tolist()
            links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for lo, hi in zip(edge[:-1], edge[1:]):
                within = x_of[lo] == y_of[lo]
                left = lo + (np.arange(hi - lo) if within else np.flatnonzero(own[lo:hi] == x_of[lo]))
                right = left if within else lo + np.flatnonzero(own[lo:hi] == y_of[lo])
                if min(len(left), len(right)) < 1 or within and hi - lo < 2:
                    continue
                xs, ys = [], []
                for i, j in colliding(proj[:EARLY, left], proj[:EARLY, right], w, early):
                    i, j = left[i], right[j]
                    if within:
                        i, j = i[i < j], j[i < j]
                    for c in range(0, len(i), 1 << 16):
                        x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                        go = (np.abs(proj[:, x] - proj[:, y]) <= w).sum(axis=0) >= late
                        x, y = x[go], y[go]
                        first = (cells[x, : t[lo]] != cells[y, : t[lo]]).all(axis=1)
                        x, y = x[first], y[first]
                        good = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                        xs.append(x[good])
                        ys.append(y[good])
                x, y = np.concatenate([np.zeros(0, np.int64), *xs]), np.concatenate([np.zeros(0, np.int64), *ys])
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                label[lo:hi] = lo + _components_of(hi - lo, x - lo, y - lo)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(links[some])], names=["a", "b", "links"])

    found = scratch.keep(
        tasks.repartition("t", "cell", "x", "y").sortWithinPartitions("t", "cell", "x", "y").mapInArrow(verify, "a long, b long, links long")
    )
    roots = components(found.select("a", "b"), scratch)
    sums = found.groupBy("a").agg(F.sum("links").alias("links"))
    classed = (
        classes.select("h1", "h2", "embedding", "rep", "n")
        .join(sums.withColumnRenamed("a", "rep"), "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        rows.join(classed, ["h1", "h2", "embedding"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
