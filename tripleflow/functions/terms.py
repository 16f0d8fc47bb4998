"""Columns of RDF terms in N-Triples syntax, and the hash that placement uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
BLANK = "<urn:blankNode:"


def iri(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{prefix}"), F.concat_ws("-", *[p.cast("string") for p in parts]), F.lit(">"))


def literal(value: Column) -> Column:
    text = value.cast("string")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def skolemise(term: Column) -> Column:
    """Blank nodes as IRIs, so that they can be stored and joined."""
    return F.when(F.startswith(term, F.lit("_:")), F.concat(F.lit(BLANK), F.substr(term, F.lit(3)), F.lit(">"))).otherwise(term)


def restore_blank(term: Column) -> Column:
    """The inverse of skolemise, for output."""
    inner = F.substr(term, F.lit(len(BLANK) + 1), F.length(term) - len(BLANK) - 1)
    return F.when(F.startswith(term, F.lit(BLANK)), F.concat(F.lit("_:"), inner)).otherwise(term)


def fold_hash(term: Column) -> Column:
    """The four 32-bit words of the MD5 of a term's UTF-8 bytes, folded by XOR, as a signed int."""
    digest = F.md5(term.cast("binary"))
    half = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]
    x = half[0].bitwiseXOR(half[1])
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 32))
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def hash_chunk(term: Column, chunks: int) -> Column:
    return F.abs(fold_hash(term) % F.lit(chunks))


def iri_parts(term: Column) -> Column:
    """Reversed host labels, path segments, query and fragment of an IRI, as an array; IRIs without a host have no host labels."""
    text = F.regexp_replace(term, "^<|>$", "")
    rest = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "")
    has_host = F.contains(text, F.lit("://"))
    bare = F.regexp_extract(rest, "^([^?#]*)", 1)
    host = F.when(has_host, F.regexp_extract(bare, "^([^/]*)", 1)).otherwise(F.lit(""))
    path = F.when(has_host, F.regexp_replace(bare, "^[^/]*", "")).otherwise(bare)
    pieces = F.concat(F.reverse(F.split(host, "\\.")), F.split(path, "/"), F.array(F.regexp_extract(rest, "\\?([^#]*)", 1), F.regexp_extract(rest, "#(.*)$", 1)))
    return F.array_remove(pieces, "")
