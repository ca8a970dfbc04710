"""Vectorised words and hashes over the text column of Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All hashes are
64 bits wide, independent of the batch a row arrives in and of the machine, and
stand in for the words themselves: two different sequences share a hash with a
chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text handled at once; long rows stand alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_WORD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(_R_INV if inverse else _R, 1 << max(12, (n + 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose words are hashed at once; the tables of powers are no longer than that.
HASH_BYTES = 1 << 16


class Words:
    """Words of consecutive rows: `data` bytes, `start`/`end` of each word in it, and `first`
    (rows + 1 entries), the index of each row's first word.

    Beside the bytes this takes three longs a word, however long a row is: bytes are looked at in blocks.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, n, SLICE_BYTES):
            hi = min(n, lo + SLICE_BYTES)
            solid = ~_SPACE[data[max(0, lo - 1) : min(n, hi + 1)]]
            at = lo - max(0, lo - 1)
            own = solid[at : at + hi - lo]
            rows = np.zeros(hi - lo + 1, bool)  # where a row begins
            rows[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
            before = solid[:-1][: hi - lo] if lo else np.concatenate([[False], solid[: hi - lo - 1]])
            after = np.concatenate([solid[at + 1 : at + 1 + hi - lo], np.zeros(hi - lo - len(solid[at + 1 : at + 1 + hi - lo]), bool)])
            starts.append(np.flatnonzero(own & (~before | rows[:-1])) + lo)
            ends.append(np.flatnonzero(own & (~after | rows[1:])) + lo + 1)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(out):
            lo = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, lo + HASH_BYTES, "right")))
            if to == at + 1:
                out[at] = self._long(lo, int(self.end[at]))
            else:
                n = int(self.end[to - 1]) - lo
                total = np.zeros(n + 1, np.uint64)
                np.cumsum((self.data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * powers(HASH_BYTES)[:n], out=total[1:])
                a, z = self.start[at:to] - lo, self.end[at:to] - lo
                out[at:to] = (total[z] - total[a]) * powers(HASH_BYTES, inverse=True)[a]
            at = to
        return mix(out + (self.end - self.start).astype(np.uint64) * _WORD)

    def _long(self, lo: int, hi: int) -> int:
        """What hashes() sums for one word, however long."""
        out = 0
        for at in range(lo, hi, HASH_BYTES):
            part = self.data[at : min(hi, at + HASH_BYTES)].astype(np.uint64) + np.uint64(1)
            out += int((part * powers(HASH_BYTES)[: len(part)]).sum(dtype=np.uint64)) * pow(_R, at - lo, 1 << 64)
        return out & (1 << 64) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row, whatever row they belong to (len - k + 1 of them)."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * powers(n)[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(n, inverse=True)[: n - k + 1])


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k words that lie within one row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[:-1] - (ends - counts), counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for pieces of a string column of at most `most` bytes, whole rows each."""
    most = most or SLICE_BYTES
    data, offsets = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bytes of an Arrow batch at most: rows can be long, and a worker holds some batches at once.
BATCH_BYTES = 4 << 20


def carry(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int, StructType]:
    """(what a worker is sent: `keep` and the text, once; the place of the text; the schema of `keep`).

    Lowers spark.sql.execution.arrow.maxBytesPerBatch of the session to BATCH_BYTES if it is above: plans read it when they run.
    """
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kept = docs.select(*keep)
    if "text" in keep:
        return kept, keep.index("text"), StructType(list(kept.schema))
    return docs.select(*keep, F.col("text").alias("__text")), len(keep), StructType(list(kept.schema))
