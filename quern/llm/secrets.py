"""Operator 6, secret scans with structural confirmation.

Base kinds are patterns with a least length.  The kinds after them are reported only once what they hold has been
decoded and its structure holds:

* der: base64 (of either alphabet, in one run or in lines of one length) or hex that decodes to an ASN.1 SEQUENCE whose nested
  lengths fill it exactly and that holds an INTEGER or an OBJECT IDENTIFIER, as private and public keys do;
* jwt: three dotted base64url parts, the first, from its first "eyJ" on, a JSON object with a text `alg`, the second a JSON object;
* pem: an armoured private key, its body base64 of one of these or of an OpenSSH key, or said to be encrypted by its headers;
  its line breaks may be escaped as in JSON;
* ssh: base64 of length-prefixed fields that fill it exactly, the first naming a key type.

Spans count code points, ends exclusive.  A null or empty text has none; very long texts are scanned whole, in time that
follows their length: no pattern tries a run of characters twice.  Patterns are touched only where a cheap byte test finds
room for a match.  Rows are independent: repeated rows and null doc_ids do no harm, and an empty table gives no rows.  Other
columns pass through; one named `secrets` is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quern.llm import textvec as tv

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der", "jwt", "pem", "ssh")
SPAN = StructType([StructField("kind", StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType())])

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_ANY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){24,}(?![0-9A-Za-z])")
_B64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_B64_URL = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
_B64_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{48,80}(?:\r\n|\n|\r))++[A-Za-z0-9+/]*+={0,2}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
_DEK = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED\s(?:.{0,200}\s)?DEK-Info:\s*[A-Za-z0-9-]+(?:,\s*[0-9A-Fa-f]+)?(?=\s)")

_RUN = np.zeros((3, 256), bool)
_RUN[0, [*b"0123456789abcdef"]] = True
_RUN[1, [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"]] = True
_WORDS = (b"passw", b"secret", b"token", b"api")


def _der(data: bytes, depth: int = 0) -> int | None:
    """Primitive key parts in nested ASN.1 values that fill data exactly; None if they don't."""
    at, n = 0, 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > len(data):
            return None
        if tag & 0x20:
            inner = _der(data[at : at + size], depth + 1) if depth < 12 else None
            if inner is None:
                return None
            n += inner
        n += tag in (0x02, 0x06) and size > 0
        at += size
    return n


def _is_der(data: bytes) -> bool:
    return len(data) > 20 and data[0] == 0x30 and bool(_der(data))


def _is_ssh(data: bytes) -> bool:
    at, fields = 0, 0
    if not re.match(rb"\0\0\0[\x07-\x30](ssh-|ecdsa-|sk-)", data):
        return False
    while at < len(data):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return at == len(data) and fields >= 2


def _b64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    text += "=" * (-len(text) % 4)
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") if url else text, validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(data: bytes | None) -> dict | None:
    try:
        x = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def _is_pem(body: str) -> bool:
    """Whether what stands between the lines of a PEM text is a key: DER, OpenSSH's form, or anything once a header says it
    is encrypted.  Line breaks may be escaped as in JSON; lines with a colon are headers."""
    body = re.sub(r"\\+(?=/)", "", re.sub(r"\\+[nr]", "\n", body))
    encrypted = _DEK.search(body)
    if encrypted:
        body = body[encrypted.end() :]
    data = _b64("".join("".join(x.split()) for x in body.splitlines() if ":" not in x)) or b""
    return _is_der(data) or data.startswith(b"openssh-key-v1\0") or bool(encrypted and len(data) > 20)


def _jwts(run: str) -> Iterator[tuple[int, int]]:
    """Where a dotted run has three parts that are a signed token."""
    parts = run.split(".")
    at, i = 0, 0
    while i + 2 < len(parts):
        head, lead = parts[i], parts[i].find("eyJ")
        if 0 <= lead < len(head) - 3 and parts[i + 1]:
            end = at + len(head) + len(parts[i + 1]) + len(parts[i + 2]) + 2
            if isinstance((_object(_b64(head[lead:], True)) or {}).get("alg"), str) and _object(_b64(parts[i + 1], True)) is not None:
                yield at + lead, end
                at, i = end + 1, i + 3
                continue
        at, i = at + len(head) + 1, i + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    return [
        *(("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8),
        *(("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16),
        *(("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32),
    ]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded structure holds."""
    out = []
    for m in _PEM.finditer(text):
        if _is_pem(m[2]):
            out.append(("pem", *m.span()))
    for m in _DOTTED.finditer(text) if "eyJ" in text else ():
        out += (("jwt", m.start() + a, m.start() + z) for a, z in _jwts(m[0]))
    for m in _B64.finditer(text):
        if data := _b64(m[0]):
            if _is_der(data):
                out.append(("der", *m.span()))
            elif _is_ssh(data):
                out.append(("ssh", *m.span()))
    for m in _B64_URL.finditer(text):
        if ("-" in m[0] or "_" in m[0]) and _is_der(_b64(m[0], True) or b""):
            out.append(("der", *m.span()))
    for m in _B64_LINES.finditer(text):
        if _is_der(_b64("".join(m[0].split())) or b""):
            out.append(("der", m.start(), m.start() + len(m[0].rstrip())))
    out += (("der", *m.span()) for m in _HEX_ANY.finditer(text) if _is_der(bytes.fromhex(m[0])))
    return sorted(set(out))


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as in KINDS."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _worth(data: np.ndarray, offsets: np.ndarray, raw: bytes) -> np.ndarray:
    """Rows that may have a span."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    for k, least in ((0, 32), (1, 40)):
        stop = np.concatenate([[-1], np.flatnonzero(~_RUN[k][data]), [len(data)]])
        long = stop[:-1][np.diff(stop) > least] + 1
        # a run may go on over the end of a row, so every row that it touches is looked at
        ends = stop[1:][np.diff(stop) > least] - 1
        lo, hi = np.searchsorted(offsets, long, "right") - 1, np.searchsorted(offsets, ends, "right") - 1
        for a, b in zip(lo.tolist(), hi.tolist()):
            out[a : b + 1] = True
    bounds = offsets.tolist()
    for i in np.flatnonzero(~out).tolist():
        row = raw[bounds[i] : bounds[i + 1]]
        if b"AKIA" in row or b"eyJ" in row or b"-----BEGIN" in row:
            out[i] = True
        elif b"=" in row or b":" in row:
            low = row.lower()
            out[i] = any(w in low for w in _WORDS)
    return out


def _scanned(column: pa.Array) -> Iterator[tuple[str | None, list[tuple[str, int, int]]]]:
    """(text, spans) of each row; rows without room for a match have no text here and no spans."""
    for _, _, data, offsets in tv.slices(column):
        raw = data.tobytes()
        bounds = offsets.tolist()
        for i, worth in enumerate(_worth(data, offsets, raw).tolist()):
            text = raw[bounds[i] : bounds[i + 1]].decode() if worth else None
            yield text, scan(text) if worth else []


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds `secrets`, the spans of `text` in order, to the columns `keep` of docs (all by default)."""
    keep = [c for c in (keep or docs.columns) if c != "secrets"]
    inner, place, kept = tv.carry(docs, keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "begin": x, "end": y} for k, x, y in spans] for _, spans in _scanned(b.column(place))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "secrets"])

    return inner.mapInArrow(run, kept.add("secrets", ArrayType(SPAN)))


def _without(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, begin, end in spans:
        if end > at:
            if begin >= at:
                out += (text[at:begin], f"<{kind}>")
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """Every secret in `text` is replaced by <kind>; overlapping spans as one, named by the first.  All else is as in docs."""
    names = docs.columns
    place = names.index("text")
    inner, _, kept = tv.carry(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            with_some, texts = [], []
            for text, spans in _scanned(column):
                with_some.append(bool(spans))
                if spans:
                    texts.append(_without(text, spans))
            if texts:
                column = pc.replace_with_mask(column, pa.array(with_some), pa.array(texts, column.type))
            yield pa.RecordBatch.from_arrays([*b.columns[:place], column, *b.columns[place + 1 :]], names=names)

    return inner.mapInArrow(run, kept)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    said = "transform(filter(secrets, s -> {}), s -> concat_ws(':', s.kind, s.begin, s.end))"
    base = said.format("s.kind IN ('assign', 'access', 'hex')")
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(secrets, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2(array_join({base}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join({said.format('true')}, ',')").alias("spans"),
    )
