"""Byte-level column helpers.

All positions and lengths of the corpus are UTF-8 bytes. Spark stores strings as UTF-8, so a cast to
BINARY is free of decoding and gives O(1) ``substring`` per position (string ``substring`` counts
characters and is linear in the position).
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DOC_SEP, SENTINEL


def utf8(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("binary")


def byte_len(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.octet_length(c).cast("bigint")


def lit_bytes(b: bytes) -> Column:
    return F.lit(bytearray(b)).cast("binary")


SEP_LIT = bytes([DOC_SEP])
SENTINEL_LIT = bytes([SENTINEL])


def regex_quote(q: str) -> str:
    """Java-regex literal for ``q``: ``\\Q…\\E``, with any ``\\E`` inside split out."""
    return "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def overlap_pattern(q: str) -> str:
    """A zero-width pattern that matches at every start of ``q`` (so overlapping matches count)."""
    return "(?=" + regex_quote(q) + ")"


def has_border(qb: bytes) -> bool:
    """True when a proper prefix of ``qb`` equals a suffix, i.e. occurrences may overlap."""
    fail, k = [0] * len(qb), 0
    for i in range(1, len(qb)):
        while k and qb[i] != qb[k]:
            k = fail[k - 1]
        k += qb[i] == qb[k]
        fail[i] = k
    return k > 0


def successor(qb: bytes) -> bytes:
    """Smallest byte string greater than every string that starts with ``qb``.

    UTF-8 never contains 0xFF, so the last byte can always be incremented without carry.
    """
    if not qb:
        raise ValueError("empty query has no successor")
    assert qb[-1] < 0xFF
    return qb[:-1] + bytes([qb[-1] + 1])


def occurrences(text_col: Column | str, q: str) -> Column:
    """Overlapping occurrences of the literal ``q`` in a string column (JVM side, codegen)."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    qb = q.encode("utf-8")
    if not qb:
        raise ValueError("use the empty-query aggregate for ''")
    if has_border(qb):
        n = F.regexp_count(t, F.lit(overlap_pattern(q)))
    else:
        # Without a border occurrences cannot overlap: the cheaper replace-based count is exact.
        n = F.floor((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(q), F.lit("")))) / F.lit(len(qb)))
    return F.when(F.contains(t, F.lit(q)), n.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
