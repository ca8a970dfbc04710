"""Operator 2, substring deduplication with a compressed FM-index for each shard.

A window is 50 consecutive words of one document.  Every word is removed that is covered by a window whose word
sequence also starts in a document with a smaller doc_id.

1. Windows are dealt by the smallest hash among their runs of eight words, so equal windows meet in whatever documents
   they stand.  Neighbouring windows with one smallest hash form a segment (at most SPAN of them); a segment is known by
   a hash of its words.
2. Smallest hashes of which only one document has any are done with: no window there repeats elsewhere.
3. A smallest hash whose different segments hold over HOT_WORDS words (a passage that many documents share, each in
   another context) is too much for one shard: its windows are dealt anew by the hash of all their words, each a segment
   of its own, and those of one document are done with as in 2.  The texts are read once more for them, not shuffled.
4. Of the rest, each different segment is taken from the text once, for the smallest doc_id that has it, and sent to the
   shard of its hash.  Shards hold about SHARD_WORDS words, however many documents there are.
5. A shard builds a compressed FM-index (a wavelet tree shaped by the words' frequencies) over its segments and streams
   them through it by backward search.  Where the matching statistic reaches a whole window, the smallest doc_id in the
   interval is reported; neighbouring windows with one answer are one report.
6. Each document that has the segment loses what is reported with a smaller doc_id than its own; documents are cut in
   one last pass.  Every removal, of first holders and of copies alike, is the report of an interval.

A null text has no words.  Rows with a null doc_id are returned whole and make no other row lose words.  Documents
under 50 words are returned whole; an empty table gives no rows.  Rows that share a doc_id are one document to the rule, since none has a smaller
id; each is cut by its own text.  Other columns are ignored, whatever their names.  A very long text takes some 100 bytes of a worker's
memory for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textvec as tv
from quern.llm.fm_index import FMIndex
from quern.llm.grouped import bounds, whole_groups
from quern.llm.scratch import Scratch

WINDOW = 50
SEED = 8
SPAN = 64  # windows of a segment, at most the bits of a long
SHARD_WORDS = 600_000
HOT_WORDS = 100_000
#: Hot smallest hashes that all tasks are told at once; more of them take more rounds.
HOT_KEYS = 1_000_000
#: Words of an Arrow batch that go out together.
PACK = 250_000
SHARE = 1_000


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` values in a row."""
    w, m = 1, x
    while w * 2 <= width:
        m = np.minimum(m[: len(m) - w], m[w:])
        w *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - w : width - w + len(x) - width + 1]) if width > w else m


def _marked(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _segments(docs: DataFrame) -> DataFrame:
    """mkey, seg (a hash of its words), doc_id, row_hash, begin and n (words): all segments of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in tv.slices(b.column(2)):
                words = tv.Words(data, offsets)
                win = tv.inside(words.first, WINDOW)
                if not len(win):
                    continue
                h = words.hashes()
                least = _slide_min(tv.runs(h, SEED), WINDOW - SEED + 1)[win]
                row = np.searchsorted(words.first, win, "right") - 1
                edge = bounds(least, row)
                size = np.diff(edge)
                parts = -(-size // SPAN)
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                lead = np.repeat(edge[:-1], parts) + part * SPAN
                n = np.minimum(np.repeat(size, parts) - part * SPAN, SPAN) + WINDOW - 1
                begin = win[lead]
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * tv.powers(len(h))[: len(h)])])
                seg = tv.mix((total[begin + n] - total[begin]) * tv.powers(len(h), inverse=True)[begin] + n.astype(np.uint64))
                of = row[lead]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[lead].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[at + of]), pa.array(marks[at + of]),
                        pa.array((begin - words.first[of]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=["mkey", "seg", "doc_id", "mark", "begin", "n"],
                )

    return _marked(docs).mapInArrow(run, "mkey long, seg long, doc_id long, mark long, begin int, n int")


def _windows(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """window (a hash of its words), doc_id, mark and begin of all windows whose smallest hash is one of `keys` (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(keys.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.sort(shared.value)
        for b in batches:
            for at, _, data, offsets in tv.slices(b.column(2)):
                words = tv.Words(data, offsets)
                win = tv.inside(words.first, WINDOW)
                if not len(win):
                    continue
                h = words.hashes()
                least = _slide_min(tv.runs(h, SEED), WINDOW - SEED + 1)[win]
                win = win[hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least]
                of = np.searchsorted(words.first, win, "right") - 1
                take = pa.array(at + of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tv.runs(h, WINDOW)[win].view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array((win - words.first[of]).astype(np.int32))],
                    names=["window", "doc_id", "mark", "begin"],
                )

    return _marked(docs).mapInArrow(run, "window long, doc_id long, mark long, begin int")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of each segment asked for."""
    for b in batches:
        asked = b.column(2)
        for at, end, data, offsets in tv.slices(b.column(1)):
            words = tv.Words(data, offsets)
            h = words.hashes()
            own = asked.slice(at, end - at)
            flat = own.flatten()
            k = np.diff(own.offsets.to_numpy())
            begin = flat.field("begin").to_numpy() + np.repeat(words.first[:-1], k)
            n = flat.field("n").to_numpy().astype(np.int64)
            doc = b.column(0).slice(at, end - at).take(pa.array(np.repeat(np.arange(end - at), k)))
            edge = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // PACK)) + 1).tolist(), len(n)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                ends = np.cumsum(n[lo:hi])
                packed = h[np.repeat(begin[lo:hi] - (ends - n[lo:hi]), n[lo:hi]) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                cut = np.concatenate([[0], ends * 8]).astype(np.int32)
                words_of = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut), pa.py_buffer(packed)])
                part = flat.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.field("mkey"), part.field("seg"), doc.slice(lo, hi - lo), part.field("hi"), words_of], names=["mkey", "seg", "doc_id", "hi", "words"]
                )


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the spans (in words) of neighbouring windows whose smallest doc_id, `lo`, is one and below that of
    the last document that has the segment."""
    for t in whole_groups(batches, ["mkey"], rows=8_000):
        words = t["words"].combine_chunks()
        cut = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :] // 8
        values = np.frombuffer(words.buffers()[2], np.uint64)[cut[0] : cut[-1]]
        index = FMIndex(values, (cut - cut[0]).astype(np.int64), t["doc_id"].to_numpy(), WINDOW)
        best = index.matches()
        who = np.repeat(np.arange(len(cut) - 1), index.last - index.first + 1)
        hit = np.flatnonzero(best < t["hi"].to_numpy()[who])
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (who[hit][1:] != who[hit][:-1]) | (best[hit][1:] != best[hit][:-1])
        a = hit[new]
        z = hit[np.append(new[1:], True)[: len(hit)]]
        s = who[a]
        yield pa.RecordBatch.from_arrays(
            [t["mkey"].combine_chunks().take(pa.array(s)), t["seg"].combine_chunks().take(pa.array(s)), pa.array(best[a]),
             pa.array((a - index.first[s]).astype(np.int32)), pa.array((z - index.first[s] + WINDOW).astype(np.int32))],
            names=["mkey", "seg", "lo", "a", "z"],
        )


def _shared(rows: DataFrame, on: list[str], scratch: Scratch) -> DataFrame:
    """The rows whose key more than one document has, with `lo`, the smallest of these.

    Of these rows, keys with more than a SHAREth, fewer than SHARE of them, are broadcast: their rows stay where they are.
    """
    found = rows.groupBy(*on).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows"))
    found = scratch.keep(found.where("lo < hi").drop("hi"))
    many = F.col("rows") > (found.agg(F.sum("rows")).first()[0] or 0) // SHARE
    often, rest = F.broadcast(found.where(many).drop("rows")), found.where(~many).drop("rows")
    return rows.join(often, on).unionByName(rows.join(often, on, "left_anti").join(rest, on))


def _distinct(segments: DataFrame) -> DataFrame:
    """One row for each different segment: where its smallest doc_id has it, and `hi`, the largest."""
    one = F.min(F.struct("doc_id", "mark", "begin", "n")).alias("one")
    return segments.groupBy("mkey", "seg").agg(one, F.max("doc_id").alias("hi")).select("mkey", "seg", "one.*", "hi")


def _dealt_anew(docs: DataFrame, hot: DataFrame, n_hot: int, scratch: Scratch) -> list[DataFrame]:
    """The windows with hot smallest hashes that more than one document has, as segments: a kept table for each round."""
    out = []
    rounds = -(-n_hot // HOT_KEYS)
    for r in range(rounds):  # each sends the keys of a round to all tasks, HOT_KEYS longs or so
        keys = hot.where(F.pmod(F.xxhash64("mkey"), F.lit(rounds)) == r).toPandas()["mkey"].to_numpy(np.int64)
        if len(keys):
            windows = scratch.keep(_windows(docs, keys))
            part = _shared(windows, ["window"], scratch)
            part = scratch.keep(part.select(F.col("window").alias("mkey"), F.col("window").alias("seg"), "doc_id", "mark", "begin", F.lit(WINDOW).alias("n")))
            scratch.drop(windows)
            out.append(part)
    return out


def removed_spans(docs: DataFrame, scratch: Scratch, shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text) and spans, array of (a, z) in words, that are to be removed."""
    all_ = scratch.keep(_segments(docs))
    found = scratch.keep(_shared(all_, ["mkey"], scratch).drop("lo"))
    scratch.drop(all_)
    kept = [scratch.keep(_distinct(found))]
    distinct = kept[0]
    sizes = distinct.groupBy("mkey").agg(F.sum("n").alias("words"))
    hot = scratch.keep(sizes.where(F.col("words") > hot_words).select("mkey"))
    n_hot = hot.count()
    if n_hot:
        parts = _dealt_anew(docs, hot, n_hot, scratch)
        found, distinct = found.join(hot, "mkey", "left_anti"), distinct.join(hot, "mkey", "left_anti")
        for part in parts:
            kept.append(scratch.keep(_distinct(part)))
            found, distinct = found.unionByName(part), distinct.unionByName(kept[-1])
    words = distinct.agg(F.sum("n")).first()[0]
    asked = distinct.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("mkey", "seg", "begin", "n", "hi")).alias("asked"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(asked, ["doc_id", "mark"]).select("doc_id", "text", "asked")
    contents = texts.mapInArrow(_contents, "mkey long, seg long, doc_id long, hi long, words binary")
    dealt = contents.repartition(max(1, -(-(words or 0) // shard_words)), "mkey").sortWithinPartitions("mkey", "seg")
    reports = dealt.mapInArrow(_repeats, "mkey long, seg long, lo long, a int, z int")
    reports = scratch.keep(reports.hint("rebalance"))  # files by bytes, not one for each shard
    scratch.drop(*kept)
    lost = found.join(reports, ["mkey", "seg"]).where("doc_id > lo")
    span = F.struct((F.col("begin") + F.col("a")).alias("a"), (F.col("begin") + F.col("z")).alias("z"))
    return lost.select("doc_id", "mark", span.alias("span")).groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column(2)
        for at, end, data, offsets in tv.slices(b.column(1)):
            words = tv.Words(data, offsets)
            own = spans.slice(at, end - at)
            lists = own.fill_null([])
            flat = lists.flatten()
            row = np.repeat(np.arange(end - at), np.diff(lists.offsets.to_numpy()))
            n = np.diff(words.first)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, words.first[row] + flat.field("a").to_numpy(), 1)
            np.add.at(step, words.first[row] + flat.field("z").to_numpy(), -1)
            stay = np.cumsum(step[:-1]) == 0
            of = words.row_of()
            kept = np.bincount(of[stay], minlength=end - at)
            begin, stop = words.start[stay], words.end[stay]
            size = stop - begin + 1
            ends = np.cumsum(size)
            index = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            out = np.append(data, np.uint8(0x20))[index]
            out[ends - 1] = 0x20
            raw = out.tobytes()
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])].tolist()
            texts = [raw[x : y - 1] if y > x else b"" for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, end - at), pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, joined by one space) of each row of docs."""
    tv.carry(docs, ["doc_id", "text"])
    spans = removed_spans(docs, Scratch(docs.sparkSession))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(spans, ["doc_id", "mark"], "left")
    return texts.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
