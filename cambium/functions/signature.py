"""Signature and member functions: parameters at the top level, their names, and what two versions differ in.

Splitting needs a bracket stack, which no built-in has; it runs in Arrow batches. The rest are JVM expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "([{", ")]}"


def paren_content(text: str | None) -> str:
    """What the first parenthesis encloses, up to its partner; empty without one."""
    text = text or ""
    start, level = text.find("("), 0
    if start < 0:
        return ""
    for m in re.finditer(r"[()]", text[start:]):
        level += 1 if m.group() == "(" else -1
        if not level:
            return text[start + 1 : start + m.start()]
    return ""


def top_level_params(text: str | None) -> list[str]:
    """The parameters of a signature, split at commas outside all brackets; an empty last one is dropped."""
    inner = paren_content(text)
    level, at, out = 0, 0, []
    for i, ch in enumerate(inner):
        if ch in OPEN:
            level += 1
        elif ch in CLOSE:
            level -= 1
        elif ch == "," and not level:
            out.append(inner[at:i].strip())
            at = i + 1
    if inner[at:].strip():
        out.append(inner[at:].strip())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def params_of(signature: pd.Series) -> pd.Series:
    return signature.map(top_level_params)


def param_name(token: Column) -> Column:
    """The name in a parameter: before its default and annotation, without spread dots and question mark."""
    bare = F.trim(F.substring_index(F.substring_index(F.trim(token), "=", 1), ":", 1))
    return F.regexp_replace(F.regexp_replace(bare, r"^\.\.\.", ""), r"\?$", "")


def is_optional(token: Column) -> Column:
    head = F.substring_index(F.trim(token), ":", 1)
    return head.contains("?") | head.contains("=") | F.trim(token).startswith("...")


def member_names(text: Column) -> Column:
    """Distinct names before a colon, parenthesis or question mark in the body of a type."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_$][\w$]*)\s*(?=:\s|\(|\?)"), F.lit(1)))


def added_params(old: Column, new: Column) -> Column:
    """Names in `new` (arrays of parameters) that `old` lacks, in order, repeats kept."""
    had = F.transform(old, param_name)
    return F.filter(F.transform(new, param_name), lambda p: ~F.array_contains(had, p))


def signature_risk(old: Column, new: Column, strict: bool = False) -> Column:
    """high if a required parameter is added, medium for any other change of parameter names, else low; old and new are
    arrays of parameters. As names carry no marks, every added one counts as required; with `strict`, those whose
    parameter is optional don't."""
    had = F.transform(old, param_name)
    added, removed = added_params(old, new), added_params(new, old)
    required = F.filter(new, lambda p: ~F.array_contains(had, param_name(p)) & ~is_optional(p)) if strict else added
    return F.when(F.size(required) > 0, "high").when((F.size(added) > 0) | (F.size(removed) > 0), "medium").otherwise("low")


def annotation_candidates(text: Column) -> Column:
    """Dotted names in a type annotation, in order, each once, without the constants."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), F.lit(1)))
    return F.filter(names, lambda n: ~n.isin("None", "True", "False"))
