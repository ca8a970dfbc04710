"""Operator 3, BPE encoding and decoding with content-defined chunks.

A rolling hash over 16 bytes cuts texts into chunks wherever its top bits are zero, so equal passages fall into
equal chunks in whatever document they stand.  Each different chunk is encoded once for a worker, alone and whole, and
then reused.  Joins are repaired by encoding again until both sides agree:

* The pre-tokenizer reads from left to right, has no memory and looks MARGIN bytes ahead at most.  So what it finds from a
  true boundary on is right up to MARGIN before the end of what it is given.
* Of the left chunk all ids up to its last sure boundary stay.  From there on the text is split again, over the join and
  LOOK bytes into the right chunk.  Where a boundary found so is also one that the right chunk has alone, both readings go on
  alike: they agree, the right chunk's own ids count from there, and what lies between is encoded again.  (A boundary
  between white space and what follows it is passed over: there the left part alone would be split in another way.)
* Without such a boundary the look ahead grows fourfold, and when a chunk is used up the next ones join in, twice as many
  each time, until there is agreement or the text ends.

So the joined ids are exactly those of the whole text.  Texts that hold an added token's string are encoded whole.  Strings of
characters whose class is beyond doubt are split and encoded by the faster of two libraries with the merges of the one file,
all others by the library whose format the file has; a file without such merges is used whole text by whole text.

A null text is encoded as an empty one.  Rows are independent: repeated rows, null doc_ids and other columns do no harm (those
named as a result are replaced), an empty table gives no rows, and very long texts are encoded whole.  What a worker remembers is
bounded by its bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tokenizers import Tokenizer

from quern.llm import textvec as tv

#: The split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every pattern engine in use puts in the same class; a test compares them one by one.
PLAIN = "\x00-\x1b\x20-\x7e\xa1-ȳΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣"

WINDOW = 16
#: Chunks are 2**CUT_BITS bytes long on average.
CUT_BITS = 10
#: Candidates for a cut this near after another are none: a periodic run is not cut to pieces.
LEAST = 32
#: Bytes that the pre-tokenizer looks ahead at most (four characters), and that a repair looks into a chunk at first.
MARGIN, LOOK = 16, 64
#: Bytes of chunks and ids that a worker remembers; the older half goes when they are more.
REMEMBER = 16 << 20
#: Characters of a string that the faster library is given at most.
QUICK_MOST = 20_000
_CONTROL = re.compile(r"[\x1c-\x1f\x7f]")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _first(raw: bytes, n: int) -> bytes:
    """The first n bytes or so, whole characters."""
    while n < len(raw) and raw[n] & 0xC0 == 0x80:
        n += 1
    return raw[:n]


def _apart(raw: bytes, at: int) -> bool:
    """Whether what ends at a boundary is split alike without what follows: white space before a visible character is not, as the
    pre-tokenizer leaves the last of it for that character."""
    before = raw[max(0, at - 4) : at].decode(errors="ignore")[-1:]
    return not before.isspace() or raw[at : at + 1] in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")


def _last_sure(starts: list[int], end: int) -> int:
    """Of boundaries the last one up to `end`."""
    return max((x for x in starts if x <= end), default=0)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Chunk:
    """A chunk encoded alone: its ids and where their bytes end; what lies before `sure`, a boundary, is no matter of what follows."""

    __slots__ = ("raw", "ids", "ends", "sure", "heads")

    def __init__(self, raw: bytes, ids: np.ndarray, ends: np.ndarray):
        self.raw, self.ids, self.ends = raw, ids, ends
        self.heads: dict[int, set[int]] = {}
        self.sure: int | None = None

    def part(self, begin: int, end: int | None = None) -> np.ndarray:
        """The ids between two boundaries."""
        lo = int(np.searchsorted(self.ends, begin, "right")) if begin else 0
        return self.ids[lo:] if end is None else self.ids[lo : int(np.searchsorted(self.ends, end, "right"))]


class Codec:
    """A tokenizer file with its memory of chunks and its table for decoding; one for each worker and file."""

    _made: dict[str, "Codec"] = {}

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, Chunk] = {}
        self.older: dict[bytes, Chunk] = {}
        self.size = 0
        byte_of = _byte_of()
        pieces = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.lengths = np.array([len(p) for p in pieces])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._quick(path, pieces)
        self.odd = regex.compile(f"[^{PLAIN}]").search
        self.split = regex.compile(PATTERN).finditer

    def _quick(self, path: str, pieces: list[bytes]):
        """The same merges in the faster library, if the file is a byte-level BPE whose ids follow the merges' order."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        ids = [model["vocab"][m] for m in merged]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if model["type"] != "BPE" or not plain or odd or ids != sorted(set(ids)) or len(ids) + 256 != len(model["vocab"]):
            return None
        ranks = {pieces[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(model["vocab"]) else None

    def _plain(self, text: str) -> bool:
        return not (_CONTROL.search(text) if text.isascii() else self.odd(text))

    def _ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of strings: plain ones by the faster library, the others as ever."""
        texts = [p.decode() for p in pieces]
        out: list[np.ndarray | None] = [None] * len(texts)
        if self.quick:
            for i, t in enumerate(texts):
                if len(t) <= QUICK_MOST and self._plain(t) and not any(s in t for s in self.special):
                    out[i] = np.array(self.quick.encode_ordinary(t), np.int32)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.int32)
        return out

    def _starts(self, raw: bytes) -> list[int]:
        """Where pre-tokens begin, in bytes."""
        text = raw.decode()
        if self._plain(text):
            at = [m.start() for m in self.split(text)]
        else:
            at = [a for _, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if len(text) == len(raw):
            return at
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return (np.cumsum(size) - size)[at].tolist()

    def _sure(self, chunk: Chunk) -> int:
        """The last boundary of which all before it is sure: white space after a visible character begins a pre-token whatever
        stands around them; a chunk without any is split."""
        if chunk.sure is None:
            end = len(chunk.raw) - MARGIN
            at = max(chunk.raw.rfind(b" ", 1, max(1, end)), 0)
            while at and not 0x20 < chunk.raw[at - 1] < 0x7F:
                at = max(chunk.raw.rfind(b" ", 1, at), 0)
            chunk.sure = at or _last_sure(self._starts(chunk.raw), end)
        return chunk.sure

    def _head(self, chunk: Chunk, look: int) -> set[int]:
        """The boundaries of a chunk that its first `look` bytes make sure."""
        if look not in chunk.heads:
            whole = look >= len(chunk.raw)
            chunk.heads[look] = {x for x in self._starts(_first(chunk.raw, look)) if whole or x <= look - MARGIN}
        return chunk.heads[look]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the chunks of consecutive rows begin and end."""
        n = len(data)
        if n <= WINDOW:
            return np.unique(offsets)
        found = []
        for lo in range(0, n - WINDOW + 1, tv.HASH_BYTES):  # in blocks, so tables and sums stay short
            part = data[lo : lo + tv.HASH_BYTES + WINDOW - 1]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * tv.powers(2 * tv.HASH_BYTES)[: len(part)], out=total[1:])
            rolling = tv.mix((total[WINDOW:] - total[:-WINDOW]) * tv.powers(2 * tv.HASH_BYTES, inverse=True)[: len(part) - WINDOW + 1])
            found.append(np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + (lo + WINDOW))
        cuts = np.concatenate(found)
        cuts = cuts[np.searchsorted(offsets, cuts, "right") == np.searchsorted(offsets, cuts - WINDOW, "right")]
        cuts = cuts[np.diff(cuts, prepend=-LEAST) >= LEAST]
        cuts = cuts[cuts < n]
        for _ in range(3):  # to the end of a character
            cuts = cuts + (data[np.minimum(cuts, n - 1)] & 0xC0 == 0x80)
        return np.unique(np.concatenate([cuts, offsets]))

    def _repaired(self, chunks: list[Chunk]) -> list[np.ndarray | bytes]:
        """The ids of consecutive chunks, and between them the strings that are to be encoded again."""
        out: list[np.ndarray | bytes] = []
        k, begin = 0, 0
        while k + 1 < len(chunks):
            stop = max(begin, self._sure(chunks[k]))
            if stop > begin:
                out.append(chunks[k].part(begin, stop))
            left, more = chunks[k].raw[stop:], 1
            while True:
                # `more` chunks are read, the last of them as far as it takes
                last = min(k + more, len(chunks) - 1)
                lead = left + b"".join(c.raw for c in chunks[k + 1 : last])
                chunk, look, agreed = chunks[last], LOOK, None
                while agreed is None:
                    text = lead + _first(chunk.raw, look)
                    all_ = len(text) - len(lead) == len(chunk.raw)
                    end = len(text) if all_ and last + 1 == len(chunks) else len(text) - MARGIN
                    own = self._head(chunk, look)
                    agreed = next((x - len(lead) for x in self._starts(text) if len(lead) <= x <= end and x - len(lead) in own and _apart(text, x)), None)
                    if all_:
                        break
                    look *= 4
                if agreed is not None or last + 1 == len(chunks):
                    break
                more *= 2
            if agreed is None:
                out.append(lead + chunk.raw)
                return out
            out.append(lead + chunk.raw[:agreed])
            k, begin = last, agreed
        out.append(chunks[k].part(begin))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of each row's first) of consecutive rows."""
        raw = data.tobytes()
        bounds = offsets.tolist()
        special = [s.encode() for s in self.special]
        cuts = self.cuts(data, offsets) if self.quick else np.unique(offsets)
        rows: list[list[bytes]] = []
        for (a, b), lo, hi in zip(zip(bounds[:-1], bounds[1:]), np.searchsorted(cuts, offsets[:-1]).tolist(), np.searchsorted(cuts, offsets[1:]).tolist()):
            whole = hi - lo > 1 and any(x in raw[a:b] for x in special)
            at = [a, b] if whole else cuts[lo : hi + 1].tolist()
            rows.append([raw[x:y] for x, y in zip(at[:-1], at[1:])] if b > a else [])
        found = self._chunks({p for row in rows for p in row})
        parts = [self._repaired([found[p] for p in row]) if len(row) > 1 else [found[p].ids for p in row] for row in rows]
        again = list({x for row in parts for x in row if isinstance(x, bytes)})
        ids_of = dict(zip(again, self._ids(again)))
        flat = [[ids_of[x] if isinstance(x, bytes) else x for x in row] for row in parts]
        first = np.concatenate([[0], np.cumsum([sum(map(len, row)) for row in flat])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *(x for row in flat for x in row)]), first

    def _chunks(self, wanted: set[bytes]) -> dict[bytes, Chunk]:
        """Chunks by their bytes; those not known yet are encoded and remembered."""
        found = {p: c for p in wanted if (c := self.known.get(p) or self.older.get(p))}
        new = [p for p in wanted if p not in found]
        for p, ids in zip(new, self._ids(new)):
            found[p] = Chunk(p, ids, np.cumsum(self.lengths[ids], dtype=np.int32))
        for p in wanted:
            if p not in self.known:
                self.known[p] = found[p]
                self.size += len(p) + 8 * len(found[p].ids) + 2_000  # with the objects around them
        if self.size > REMEMBER // 2:
            self.known, self.older, self.size = {}, self.known, 0
        return found

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The text of each row's ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        data = self.blob[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[first]
        raw = data.tobytes()
        try:
            raw.decode()
            if not (data[offsets[:-1][offsets[:-1] < len(data)]] & 0xC0 == 0x80).any():
                return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        except UnicodeDecodeError:
            pass
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.large_string())


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds `ids` to the columns `keep` of docs (all by default), and with `decoded` also what the ids decode to."""
    path = path or vocabulary()
    added = ["ids", "decoded"] if decoded else ["ids"]
    keep = [c for c in (keep or docs.columns) if c not in added]
    inner, place, kept = tv.carry(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            for at, end, data, offsets in tv.slices(b.column(place)):
                ids, first = codec.encode(data, offsets)
                out = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))]
                if decoded:
                    out.append(codec.decode(ids, first).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, end - at) for c in b.columns[: len(keep)]], *out], names=[*keep, *added])

    schema = kept.add("ids", ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("decoded", StringType())
    return inner.mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the array<int> column `ids` (null: empty)."""
    path = path or vocabulary()
    keep = [c for c in df.columns if c != "decoded"]
    inner = df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            lists = b.column(len(keep))
            first = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], codec.decode(values, first - first[0]).cast(pa.string())], names=[*keep, "decoded"])

    return inner.mapInArrow(run, inner.drop("__ids").schema.add("decoded", StringType()))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, keep=["doc_id"], decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
