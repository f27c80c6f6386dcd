"""Problem 4: functions paired with their documentation.

The spans of documentation (comments, and in python the string literals that stand alone) and the spans of functions are
found independently of each other; types and functions are looked for on a copy in which comments and strings are blanked
out, so code inside strings is never seen. The two sorted lists of a whole batch of files then meet in one as-of join on
position: a function takes the nearest comment that ends before it, in python the nearest literal after its header,
and the pair is rejected if a statement lies between. Only the accepted pairs are looked at one by one. No span is
shuffled, nor is the source text: only names and documentation leave the worker.

Five languages by file extension: python, typescript/javascript, go, rust, java. A file with syntax errors gives what
can still be recognised. Null and empty texts give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.functions.plain import plain_path
from cambium.operators.spans import FINDERS, LANGUAGES, Function, Span, blocks_of, language_of, lex, literal_text, lone_literals, normalized, python_functions
from cambium.session import ship

BETWEEN = re.compile(r"\s*(?:(?:@[\w.$]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?|\#!?\[(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*\])\s*)*")
DIRECTIVE = re.compile(r"\s*(?:go:\w|nolint|lint:|line\s+\S+:\d|export\s+\w+\s*$|\+build|eslint|tslint|prettier|jshint|jslint|istanbul|c8\s|v8\s|@ts-|biome-|noinspection|NOSONAR|noqa|type:\s*ignore|pylint|rustfmt|clippy|@formatter|CHECKSTYLE|webpack\w+:|deno-|<reference|cspell|spell-checker|#nosec|sourcery|swift\w+:)", re.I)


def _is_directive(c: Span) -> bool:
    """Whether every line of a comment is a directive to some tool."""
    return all(DIRECTIVE.match(re.sub(r"^\s*(?:/\*+|//+)", "", line)) for line in c.text.split("\n"))


def eligible(c: Span, language: str) -> bool:
    """Whether the language takes this comment for documentation."""
    if language == "go":
        return True
    if c.text.startswith("/**") and not c.text.startswith("/***") and len(c.text) > 4:
        return True
    return language == "rust" and c.text.startswith("///") and not c.text.startswith("////")


@dataclass(slots=True)
class Scanned:
    """The spans of one file."""

    language: str
    text: str
    code: str
    functions: list[Function]
    documentation: list[Span]


def scan(text: str, language: str) -> Scanned:
    text = normalized(text)
    code, comments, strings = lex(text, language)
    if language == "python":
        return Scanned(language, text, code, list(python_functions(text, code)), lone_literals(code, strings))
    return Scanned(language, text, code, sorted(FINDERS[language](text, code), key=lambda f: f.start), blocks_of(comments, text))


def as_of(points: np.ndarray, spans: np.ndarray, forward: bool) -> np.ndarray:
    """For each point the number of the last span position at or before it, or the first at or after it."""
    return np.searchsorted(spans, points, "left") if forward else np.searchsorted(spans, points, "right") - 1


def attach(files: list[Scanned]) -> Iterator[tuple[int, Function, str]]:
    """The as-of join over a batch of files, laid end to end: (number of the file, function, documentation)."""
    base = np.concatenate([[0], np.cumsum([len(f.text) + 2 for f in files])])
    for forward in (False, True):
        mine = [(k, f) for k, f in enumerate(files) if (f.language == "python") == forward]
        functions = [(k, fn) for k, f in mine for fn in f.functions]
        spans = [(k, s) for k, f in mine for s in f.documentation]
        points = np.array([base[k] + (fn.body if forward else fn.start) for k, fn in functions], dtype=np.int64)
        places = np.array([base[k] + (s.start if forward else s.end) for k, s in spans], dtype=np.int64)
        for (k, fn), at in zip(functions, as_of(points, places, forward).tolist(), strict=True):
            if forward:
                if at < len(spans) and spans[at][0] == k and opens_body(files[k], fn, spans[at][1]):
                    yield k, fn, literal_text(spans[at][1].text)
                continue
            below = fn.start
            while at >= 0 and spans[at][0] == k and touches(files[k], spans[at][1], below):
                c = spans[at][1]
                if not _is_directive(c):  # directives lie between; anything else is the documentation or hides it
                    if eligible(c, files[k].language):
                        yield k, fn, comment_text(c, files[k].language)
                    break
                at, below = at - 1, c.start


def touches(f: Scanned, c: Span, below: int) -> bool:
    """Whether nothing but attributes and annotations, and no blank line, which detaches a comment, lies between."""
    gap = f.code[c.end : below]
    return bool(BETWEEN.fullmatch(gap)) and not re.search(r"\n[ \t]*\n", gap)


def opens_body(f: Scanned, fn: Function, s: Span) -> bool:
    """Whether a literal is the first thing in a function's body, comments aside."""
    gap = f.text[fn.body : s.start]
    if gap.replace("\\\n", "").strip() and not re.fullmatch(r"(?:\s*#[^\n]*\n)*\s*", gap):
        return False
    own = f.code[fn.body : s.start]
    return "\n" not in own or len(own.rpartition("\n")[2].expandtabs(8)) > fn.indent


def comment_text(c: Span, language: str) -> str:
    if c.kind == "block":
        body = re.sub(r"^/\*+!?|\*+/$", "", c.text)
        return "\n".join(re.sub(r"^[ \t]*\*+(?=\s|$|[^\s*])[ \t]?", "", line) for line in body.split("\n"))
    lines = [re.sub(r"^[ \t]*//[/!]?", "", line) for line in c.text.split("\n")]
    return "\n".join(line for line in lines if not DIRECTIVE.match(line) or language == "rust")


# Words that stand in for documentation or speak of its absence, and words that go with them. A line of nothing else, the
# words of the function's name and articles aside, says nothing.
STAND_INS = frozenset(
    "todo fixme tbd tba tbc wip tk xxx na nil none null nothing placeholder stub dummy undocumented doc docs docstring documentation document documented description describe described "
    "comment comments summary javadoc jsdoc rustdoc godoc inheritdoc autogenerated explanatory ditto lorem ipsum above below missing blah foo asdf soon".split()
)
GO_WITH = frozenset("n a as no not yet add write insert put fill provide provided available given needed required here there later soon please pending goes without see self to be done added determined written completed explain fix finish this it me your my some any more out in inherit inherited auto generated method function helper class short brief proper code name title says same text details for now has been exists at time and".split())
EMPTY = frozenset("function method helper n a".split())  # say nothing by themselves either
NOTES = frozenset("todo fixme tbd xxx hack".split())
TAG_LINE = re.compile(r"^\s*(?:[@\\](?P<at>\w+)|:(?P<colon>\w+)(?P<arg>[^:\n]*):)(?P<rest>.*)$")
TAKES_NAME = frozenset("param parameter arg argument arguments params property prop keyword kwarg key template tparam typeparam type-param throws throw exception raises raise var ivar cvar".split())
HEADINGS = frozenset("args arguments parameters params returns return raises yields yield example examples note notes throws panics errors safety usage see references attributes warnings todo".split())
ARTICLES = frozenset("a an the der die das ein eine el la los las un una le les".split())


def words(s: str) -> list[str]:
    """The words of a name or text: at underscores, changes of case, and between letters and digits."""
    return re.findall(r"[^\W\d_]+|\d+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s))


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)].rstrip("e")
    return w.rstrip("e") if len(w) > 3 else w


def informative(doc: str, name: str, params: str = "") -> bool:
    """Whether documentation says something: not empty, no stand-in, no bare tags, more than the words of the name."""
    own = {_stem(w) for w in words(name)} | {"".join(words(name)).lower()}
    told, section = False, ""
    for line in doc.split("\n"):
        line = re.sub(r"</?[A-Za-z][^<>]*>|[*`]{1,3}", " ", line).strip()
        if not line:
            continue
        m = TAG_LINE.match(line)
        if m:
            rest = m.group("rest").strip(" \t-:.")
            tag = (m.group("at") or m.group("colon")).lower()
            if m.group("at"):
                rest = re.sub(r"^\{[^{}]*\}\s*", "", rest)
                if tag in TAKES_NAME:
                    rest = re.sub(r"^[\[\]\w.$=*&]+\s*[-:]?\s*", "", rest)
                elif tag in ("return", "returns", "type", "since", "version", "author", "see", "link", "deprecated", "override", "internal", "private", "public", "protected", "async", "static", "readonly"):
                    rest = rest if tag in ("return", "returns", "deprecated") else ""
            section = ""
            line = rest
            if tag in ("type", "rtype"):
                continue
        elif (h := re.fullmatch(r"#*\s*(\w+)\s*:?\s*-*", line)) and h.group(1).lower() in HEADINGS and (line.endswith(":") or line.startswith("#")):
            section = h.group(1).lower()
            continue
        elif re.fullmatch(r"[-=~_*#]{2,}", line):
            continue
        elif section in ("args", "arguments", "parameters", "params", "attributes", "raises"):
            p = re.match(r"^[-*]?\s*\w+\s*(?:\([^()]*\))?\s*(?::|-|$)\s*(.*)$", line)
            line = p.group(1) if p else line
        elif p := re.match(r"^[*-]?\s*(\w+)\s*(?:-|:|–)\s*(.*)$", line):
            line = p.group(2) if p.group(1) in params.split() or _stem(p.group(1)) in own else line
        said = [w.lower() for w in words(line)]
        if said and said[0] in NOTES and (len(said) == 1 or STAND_INS & set(said[1:])):
            continue
        left = [w for w in said if w not in ARTICLES and w not in own and _stem(w) not in own]
        if left and (set(left) - STAND_INS - GO_WITH or not STAND_INS & set(left) and set(left) - EMPTY):
            told = True
            break
    return told


def pairs_of(texts: list[str], paths: list[str]) -> Iterator[tuple[int, str, str, str]]:
    """(number of the file, name within the module, signature, documentation) of every function with informative
    documentation."""
    known = [(i, language) for i, (text, path) in enumerate(zip(texts, paths, strict=True)) if text and (language := language_of(path))]
    files = [scan(texts[i], language) for i, language in known]
    for k, f, doc in attach(files):
        if informative(doc, f.name, " ".join(re.findall(r"\w+", f.signature))):
            yield known[k][0], f"{f.owner}.{f.name}" if f.owner else f.name, f.signature, doc.strip()


BATCH_CHARS = 4_000_000  # texts scanned and joined at once, about


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        step = batch["text"].str.len().cumsum() // BATCH_CHARS
        for _, part in batch.groupby(step, sort=False):
            ids, repos, paths = part["doc_id"].tolist(), part["repo"].tolist(), part["path"].tolist()
            rows = [(ids[i], repos[i], paths[i], *pair) for i, *pair in pairs_of(part["text"].tolist(), paths)]
            yield pd.DataFrame(rows, columns=["doc_id", "repo", "path", "local", "signature", "docstring"])


def documented(documents: DataFrame) -> DataFrame:
    """`doc_id, repo, path, local, signature, docstring` of each documented function in each document with a path.

    Rows with a null doc_id, path or text give nothing; a null repo stays null. Repeated rows give repeated results.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("repo").cast("string").alias("repo"), plain_path(F.col("path")).alias("path"), "text")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("path").isNotNull() & (F.length("text") > 0))
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*LANGUAGES))
    return rows.mapInPandas(_extract, "doc_id bigint, repo string, path string, local string, signature string, docstring string")


def function_pairs(documents: DataFrame, files: DataFrame) -> DataFrame:
    """`doc_id, qname, signature, docstring`, each once, qname being the file's module, the enclosing type and the name.

    A file unknown to `files` takes its module from the path: dotted, without extension. Of several modules of one
    file the least counts. An empty table on either side is no error."""
    module = files.where(F.col("module_qname").isNotNull()).select("repo", plain_path(F.col("path")).alias("path"), "module_qname").groupBy("repo", "path").agg(F.min("module_qname").alias("module"))
    fallback = F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", ".")
    found = documented(documents).join(module, ["repo", "path"], "left")
    return found.select("doc_id", F.concat_ws(".", F.coalesce("module", fallback), "local").alias("qname"), "signature", "docstring").distinct()
