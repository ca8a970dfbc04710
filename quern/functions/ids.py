"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.patterns import NAMESPACE
from quern.functions.text import norm


def _sha1(name: Column) -> Column:
    return F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))


def name_hex(name: Column, digits: int = 32) -> Column:
    """The first hex digits of the version-5 UUID of a name: the version digit is 5, the variant's top bits are 10."""
    h = _sha1(name)
    out = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3))
    if digits > 16:
        variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
        out = F.concat(out, F.lower(F.hex(variant)), F.substring(h, 18, 15))
    return F.substring(out, 1, digits)


def document(title: Column) -> Column:
    return F.concat(F.lit("doc:d"), name_hex(norm(title), 16))


def document_again(title: Column, salt: Column) -> Column:
    """Of a later document whose normalised title is taken."""
    return F.concat(F.lit("doc:d"), name_hex(F.concat(norm(title), F.lit("\x01"), salt), 16))


def term(name: Column) -> Column:
    return F.concat(F.lit("term:t"), name_hex(norm(name), 16))


def organisation(name: Column) -> Column:
    return F.concat(F.lit("orgn:o"), name_hex(norm(name), 16))


def external(name: Column) -> Column:
    return F.concat(F.lit("doc:ext"), name_hex(norm(name), 12))


def chunk(title: Column, seq: Column) -> Column:
    return F.format_string("d%s#%04d", name_hex(norm(title), 16), seq.cast("int"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, 12)


def vector_row(doc: Column, text: Column) -> Column:
    return name_hex(F.concat(doc, F.lit("\x01"), text))
