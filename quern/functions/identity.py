"""Paths, hashes and ids as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_DOMAIN = "quern/document/1"
CACHE_DOMAIN = "quern/embedding-cache/1"


def normalize_path(path: Column) -> Column:
    """A repository-relative path with ``/`` between its parts.

    Null for empty, absolute, drive-prefixed and parent-traversing paths, for those
    with a NUL, and where nothing but dots and slashes is left.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda p: ~p.isin("", "."))
    bad = (path == "") | path.contains("\0") | path.rlike(r"^[/\\]") | (F.substring(path, 2, 1) == ":") | F.array_contains(parts, "..") | (F.size(kept) == 0)
    return F.when(~bad, F.array_join(kept, "/"))


def has_hidden_component(path: Column) -> Column:
    """Whether a part of the path, other than ``.`` and ``..``, starts with a dot."""
    return path.rlike(r"(^|/)\.(?!(\.?)(/|$))")


def content_hash(content: Column) -> Column:
    """SHA-256 of the whole bytes, in lower-case hexadecimal."""
    return F.sha2(content, 256)


def u64_big(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def u64_little(value: Column) -> Column:
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def document_id(path: Column, content_hash_hex: Column, fingerprint_hex: Column, ordinal: Column, start: Column, end: Column, domain: str = DOCUMENT_DOMAIN) -> Column:
    """SHA-256 over domain, path, content hash, index fingerprint and the chunk's place."""
    nul = F.lit(b"\0")
    return F.sha2(F.concat(F.lit(domain.encode()), nul, path.cast("binary"), nul, F.unhex(content_hash_hex), F.unhex(fingerprint_hex), u64_big(ordinal), u64_big(start), u64_big(end)), 256)


def cache_key(doc_id: Column, text: Column, domain: str = CACHE_DOMAIN) -> Column:
    """SHA-256 over domain and the length-prefixed bytes of id and text."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), u64_little(F.octet_length(doc_id).cast("long")), doc_id.cast("binary"), u64_little(F.octet_length(text).cast("long")), text.cast("binary")), 256)


def _fnv(data: Column, start: Column) -> Column:
    """The FNV-1a state (64 bits as two halves) after the bytes of ``data``.

    The product modulo 2**64 is taken over 32-bit halves, so that no step overflows
    a long: the prime is 2**40 + 435.
    """
    digits = F.hex(data)
    n = F.octet_length(data)
    numbers = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(h: Column, byte: Column) -> Column:
        lo = h["lo"].bitwiseXOR(byte)
        low = lo * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        mask = F.lit(0xFFFFFFFF)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(numbers, start, step)


def query_state(query: Column) -> Column:
    """The hash of a query and byte 255, from which ``state_score`` goes on."""
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return _fnv(F.concat(query.cast("binary"), F.lit(b"\xff")), start)


def state_score(state: Column, doc_id: Column) -> Column:
    """The top 23 bits of the hash that goes on over an id, as a float in [0, 1)."""
    return (F.shiftright(_fnv(doc_id.cast("binary"), state)["hi"], 9) / F.lit(float(1 << 23))).cast("float")


def stable_score(query: Column, doc_id: Column) -> Column:
    """FNV-1a (64 bits) over query, byte 255 and id, as a float in [0, 1)."""
    return state_score(query_state(query), doc_id)
