"""Plain forms of paths, qualified names, digests and edge kinds.

All take and return columns, stay in generated JVM code, and map null to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\s ​﻿"
BLANKS = rf"^[{BLANK}]+|[{BLANK}]+$"
# The kinds of edges.
KINDS = ("imports", "calls", "inherits", "renders", "uses_type")


def stripped(c: Column) -> Column:
    """Without blanks at either end, line ends and invisible ones included."""
    return F.regexp_replace(c, BLANKS, "")


def plain_path(c: Column) -> Column:
    """Relative to the repository: single forward slashes, no leading slash, no `.` segments, no blanks around it."""
    slashed = F.regexp_replace(stripped(c), r"[/\\]+", "/")
    # most values are plain already, here and below; one look tells
    return F.when(c.rlike(r"^[\s\u200b\ufeff./]|[\s\u200b\ufeff]$|\\|//|/\./"), F.regexp_replace(slashed, r"^(\.?/)+|(?<=/)(\./)+", "")).otherwise(c)


def plain_qname(c: Column) -> Column:
    """Dot-separated, without blanks around it and without call brackets; case is kept."""
    bare = F.regexp_replace(stripped(c), r"\s*\([^()]*\)\s*$", "")
    dotted = F.regexp_replace(F.regexp_replace(bare, r"\s*(::|[#/\\])\s*", "."), r"^\.+|\.+$", "")
    return F.when(c.rlike(r"^\.|\.$|[^\w.$-]"), dotted).otherwise(c)


def plain_sha256(c: Column) -> Column:
    """64 lower-case hex digits; an algorithm prefix is removed."""
    return F.when(c.rlike(r"^[0-9a-f]{64}\z"), c).otherwise(F.regexp_replace(F.lower(stripped(c)), r"^sha-?256[:=]\s*", ""))


def plain_kind(c: Column) -> Column:
    """imports, calls, inherits, renders or uses_type."""
    return F.when(c.isin(*KINDS), c).otherwise(F.regexp_replace(F.lower(stripped(c)), r"[\s-]+", "_"))


def blank(c: Column) -> Column:
    """True for null and empty."""
    return c.isNull() | (c == "")
