"""Changing declarations in source text, to see what breaks, and holding a graph against what it should contain.

A declaration is found by its name and lines; changes are made on positions of the blanked copy, so comments and strings
are never mistaken for code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.operators import graph as G
from cambium.operators import spans as S
from cambium.session import ship

RENAMED = "Changed"  # what a renamed declaration gets appended
REQUIRED = {"python": "injected", "typescript": "injected: string", "go": "injected string", "rust": "injected: i32", "java": "int injected"}
RECEIVER = re.compile(r"\s*(?:self|cls|&(?:'\w+\s+)?(?:mut\s+)?self|mut\s+self)\b[^,)]*,?")


def mutated(text: str | None, path: str, name: str, kind: str, first: int, last: int, mutation: str) -> str | None:
    """The text with the declaration of `name` in lines `first` to `last` removed, renamed or given a required parameter;
    null where that can't be done: unknown language or name, a kind the mutation isn't for, no parameters."""
    language = S.language_of(path)
    if not language or not text or kind not in G.MUTATIONS.get(mutation, ()):
        return None
    text = S.normalized(text)
    code = S.lex(text, language)[0]
    starts = [0, *[m.end() for m in re.finditer("\n", text)], len(text)]
    if not 1 <= first <= last < len(starts):
        return None
    begin, end = starts[first - 1], starts[last]
    found = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])").search(code, begin, end)
    if not found:
        return None
    if mutation == "rename":
        return text[: found.end()] + RENAMED + text[found.end() :]
    if mutation == "remove-declaration":
        while first > 1 and re.match(r"[ \t]*(?:@|#\[)", code[starts[first - 2] : begin]):  # decorators and attributes go too
            first, begin = first - 1, starts[first - 2]
        indent = re.match(r"[ \t]*", text[begin:]).group()
        return text[:begin] + (f"{indent}pass\n" if language == "python" and indent else "") + text[end:]
    paren = code.find("(", found.end(), end)
    close = S.pairs(code).get(paren)
    if paren < 0 or close is None:
        return None
    receiver = RECEIVER.match(code, paren + 1) if language in ("python", "rust") else None
    at = receiver.end() if receiver else paren + 1
    before = ", " if receiver and not receiver.group().rstrip().endswith(",") else " " if receiver else ""
    return text[:at] + before + REQUIRED[language] + (", " if code[at:close].strip() else "") + text[at:].lstrip(" " if code[at:close].strip() else "")


def mutate(cases: DataFrame) -> DataFrame:
    """`repo, qname, mutation, path, text` with the mutated text (null where `mutated` is), for cases `repo, qname, name,
    kind, path, line_start, line_end, mutation, text`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [mutated(*row) for row in zip(b["text"], b["path"], b["name"], b["kind"], b["line_start"], b["line_end"], b["mutation"], strict=True)]
            yield b[["repo", "qname", "mutation", "path"]].assign(text=text)

    ship(cases.sparkSession)
    rows = cases.select("repo", "qname", "mutation", "path", "text", "name", "kind", F.coalesce("line_start", F.lit(0)).alias("line_start"), F.coalesce("line_end", F.lit(0)).alias("line_end"))
    return rows.mapInPandas(run, "repo string, qname string, mutation string, path string, text string")


def dispatch_check(g: G.CodeGraph, expected: DataFrame) -> DataFrame:
    """`label, tp, fp, fn, precision, recall` of expectations `label, repo, what, source, target`: edges that must be
    `present` or `absent`, members (`target`) an unresolved usage that may be of the repo must name (`suspect`), and
    symbols (`target`) that must be entries (`external`). A ratio without cases is 1."""
    edges = g.edges.select("repo", F.col("source_qname").alias("source"), F.col("target_qname").alias("target"), F.explode(F.array(F.lit("present"), F.lit("absent"))).alias("what"))
    suspects = g.unresolved.where("bucket <> 'external'").select("repo", F.lit("").alias("source"), F.col("member").alias("target"), F.lit("suspect").alias("what"))
    entries = g.symbols.where("external_entry").select("repo", F.lit("").alias("source"), F.col("qname").alias("target"), F.lit("external").alias("what"))
    facts = edges.unionByName(suspects).unionByName(entries).distinct().withColumn("_there", F.lit(True))
    asked = expected.select("label", "repo", "what", F.coalesce("source", F.lit("")).alias("source"), "target")
    met = asked.join(facts, ["repo", "what", "source", "target"], "left").select("label", "what", F.col("_there").isNotNull().alias("there"))
    wanted = F.col("what") != "absent"
    out = met.groupBy("label").agg(F.count_if(wanted & F.col("there")).alias("tp"), F.count_if(~wanted & F.col("there")).alias("fp"), F.count_if(wanted & ~F.col("there")).alias("fn"))
    ratio = lambda n: F.coalesce(F.try_divide("tp", F.col("tp") + F.col(n)), F.lit(1.0))
    return out.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})
