"""Operator 7, token counts by the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come back as their own single
token are proved.  A pre-token that is a proved string counts as one; only the others are merged, each different
one once for a worker.  The shortcut splits texts by the published pattern with the `regex` module.  That module and
the library agree on ASCII (except 0x1C-0x1F) and on the blocks in PLAIN, which a test compares character by
character; a text with any other character is counted by the library itself, as a whole.

No pre-token reaches from a character that is no white space over a space, nor does a run of white space take the
last space before such a character.  So where no space has white space (or an end of the text) on both sides, every
space begins a pre-token; there a text is cut at its spaces and each word with its space is looked up: what is between
two such cuts is split and counted once for a worker.  Other texts are split by the pattern as a whole.

A null text counts as an empty one: no bytes, no tokens.  Rows are independent of each other: repeated rows and null doc_ids
do no harm, and an empty table gives no rows.  Very long texts are counted whole.  Other columns pass through; those named
as a result are replaced.  What a worker remembers is bounded by its characters, whatever the script.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quern.llm import textvec as tv
from quern.llm.bpe import PATTERN, PLAIN, QUICK_MOST, Codec, vocabulary

#: Characters of words and pre-tokens that a worker remembers.
REMEMBER = 32_000_000
LIMIT = 512

#: A space that may not begin a pre-token: white space or an end of the text on both sides of it.
_UNSURE = re.compile(r"(?:^|\s) (?:\s|$)")
_CONTROL = re.compile(r"[\x1c-\x1f\x7f]")


def prove_whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as their own single token."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = range(tokenizer.get_vocab_size())
    strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    whole, plain = regex.compile(PATTERN), regex.compile(f"[{PLAIN}]+")
    return [s for i, s, e in zip(ids, strings, found) if e.ids == [i] and s not in special and plain.fullmatch(s) and whole.findall(s) == [s]]


class _Counts(dict):
    """Tokens of a pre-token; merges those not known yet."""

    def __init__(self, merged, proved: list[str]):
        super().__init__(dict.fromkeys(proved, 1))
        self.merged = merged
        self.size = 0

    def __missing__(self, pre: str) -> int:
        n = self[pre] = self.merged(pre)
        self.size += len(pre) + 50
        return n


class _Words(dict):
    """Tokens of a word with the space before it; splits those not known yet."""

    def __init__(self, split, counts: _Counts):
        super().__init__()
        self.split, self.counts, self.size = split, counts, 0

    def __missing__(self, word: str) -> int:
        parts = self.split(" " + word)
        if len(parts) == 1:  # remembered here, so not there
            n = self.counts.get(parts[0]) or self.counts.merged(parts[0])
        else:
            n = sum(map(self.counts.__getitem__, parts))
        self[word] = n
        self.size += len(word) + 50
        return n


class Counter:
    _made: dict[str, "Counter"] = {}

    @classmethod
    def of(cls, path: str, proved: list[str]) -> "Counter":
        if path not in cls._made:
            cls._made[path] = cls(path, proved)
        return cls._made[path]

    def __init__(self, path: str, proved: list[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex

        codec = Codec.of(path)
        self.tokenizer, self.special, self.quick = codec.tokenizer, codec.special, codec.quick
        self.split = regex.compile(PATTERN).findall
        self.odd = regex.compile(f"[^{PLAIN}]").search
        self.proved = proved
        self._forget()

    def _merged(self, pre: str) -> int:
        """Tokens of a pre-token of plain characters, by the faster library if it has the merges of the file."""
        if self.quick and len(pre) <= QUICK_MOST:
            return len(self.quick.encode_ordinary(pre))
        return len(self.tokenizer.encode(pre, add_special_tokens=False).ids)

    def _forget(self) -> None:
        self.counts = _Counts(self._merged, self.proved)
        self.words = _Words(self.split, self.counts)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special) or (_CONTROL.search(text) if text.isascii() else self.odd(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _UNSURE.search(text):
            n = sum(map(self.counts.__getitem__, self.split(text)))
        else:
            first, *rest = text.split(" ")
            n = sum(map(self.counts.__getitem__, self.split(first))) + sum(map(self.words.__getitem__, rest))
        if self.counts.size + self.words.size > REMEMBER:
            self._forget()
        return n


def count_tokens(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes and n_tokens of `text` to the columns `keep` of docs (all by default)."""
    path = path or vocabulary()
    # bounded by the vocabulary
    proved = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))
    keep = [c for c in (keep or docs.columns) if c not in ("n_bytes", "n_tokens")]
    inner, place, kept = tv.carry(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path, proved.value)
        for b in batches:
            for at, end, data, offsets in tv.slices(b.column(place)):
                raw = data.tobytes()
                bounds = offsets.tolist()
                n = [counter.count(raw[x:y].decode()) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, end - at) for c in b.columns[: len(keep)]], pa.array(np.diff(offsets)), pa.array(n, pa.int64())],
                    names=[*keep, "n_bytes", "n_tokens"],
                )

    return inner.mapInArrow(run, kept.add("n_bytes", LongType()).add("n_tokens", LongType()))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, keep=["doc_id"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
