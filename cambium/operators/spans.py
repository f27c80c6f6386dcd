"""Spans in source text: comments and strings, types and functions, for five languages.

A scan finds comments and string literals; types and functions are then looked for on a copy in which those are blanked
out, position by position, so code inside strings is never seen. Files with syntax errors give what can still be
recognised.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "go": "go", "rs": "rust", "java": "java"}

INVISIBLE = re.compile("[\u200b-\u200f\u2060\u00ad\ufeff]")
_C_COMMENTS = r"(?P<line>//[^\n]*)|(?P<block>/\*(?:.*?\*/|.*\Z))"
_QUOTED = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
LEXERS = {
    "python": re.compile(r"""(?P<line>\#[^\n]*)|(?P<str>(?<![\w])(?P<prefix>[A-Za-z]{0,2})(?:(?P<q3>\"\"\"|''')(?:\\.|(?!(?P=q3)).)*(?:(?P=q3)|\Z)|(?P<q1>["'])(?:\\.|(?!(?P=q1))[^\\\n])*(?:(?P=q1)|(?=\n)|\Z)))|(?P<word>\w+)""", re.S),
    "typescript": re.compile(_C_COMMENTS + rf"|(?P<str>{_QUOTED}|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))|(?P<regex>(?<=[=(:,;!&|?\[{{}}\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)", re.S),
    "go": re.compile(_C_COMMENTS + rf"|(?P<str>{_QUOTED}|`[^`]*(?:`|\Z)|'(?:\\.[^'\n]*|[^'\\\n])')", re.S),
    "rust": re.compile(_C_COMMENTS + r"""|(?P<str>\b(?:b|c)?r(?P<h>\#*)".*?(?:"(?P=h)|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\[^'\n]+|[^'\\\n])')""", re.S),
    "java": re.compile(_C_COMMENTS + rf'|(?P<str>"""(?:\\.|(?!""").)*(?:"""|\Z)|{_QUOTED}|\'(?:\\.[^\'\n]*|[^\'\\\n])\')', re.S),
}
_NOT_SPACE = re.compile(r"[^\n]")


@dataclass(slots=True)
class Span:
    start: int
    end: int
    text: str
    kind: str  # line, block, or for strings their prefix


def lex(text: str, language: str) -> tuple[str, list[Span], dict[int, Span]]:
    """The text with comments and strings blanked, its comments in order, and (python) its strings by start."""
    code, comments, strings, at = [], [], {}, 0
    for m in LEXERS[language].finditer(text):
        kind = m.lastgroup if m.lastgroup in ("line", "block", "word", "regex") else "str"
        if kind == "word":
            continue
        a, b = m.span()
        if kind in ("line", "block"):
            if kind == "block" and language == "rust":
                b = _nested_end(text, a, b)
                if b < at:
                    continue
            if a < at:
                continue
            comments.append(Span(a, b, text[a:b], kind))
        elif a < at:
            continue
        elif language == "python":
            strings[a] = Span(a, b, text[a:b], m.group("prefix").lower())
        code += text[at:a], _NOT_SPACE.sub(" ", text[a:b])
        at = b
    code.append(text[at:])
    return "".join(code), comments, strings


def _nested_end(text: str, start: int, end: int) -> int:
    """Where a block comment that may hold others really ends."""
    depth = text.count("/*", start + 2, end)
    while depth > 0:
        nxt = text.find("*/", end)
        if nxt < 0:
            return len(text)
        depth += text.count("/*", end, nxt) - 1
        end = nxt + 2
    return end


def blocks_of(comments: list[Span], text: str) -> list[Span]:
    """Comments that stand at the start of their line, with runs of line comments joined. A run ends where the marker
    changes (`//` and `///`) or a line is skipped."""
    out: list[Span] = []
    for c in comments:
        line = text.rfind("\n", 0, c.start) + 1
        if text[line : c.start].strip():
            continue
        if c.kind == "line" and out and out[-1].kind == "line" and text.count("\n", out[-1].end, c.start) == 1 and _marker(out[-1].text) == _marker(c.text):
            out[-1] = Span(out[-1].start, c.end, out[-1].text + "\n" + c.text, "line")
        else:
            out.append(c)
    return out


def _marker(comment: str) -> str:
    return re.match(r"/{0,3}!?", comment.rpartition("\n")[2]).group()


def pairs(code: str) -> dict[int, int]:
    """Position of each opening bracket to that of its closing one. Unclosed ones are left out."""
    stack, out = [], {}
    for m in re.finditer(r"[()\[\]{}]", code):
        ch = m.group()
        if ch in "([{":
            stack.append((m.start(), ch))
            continue
        want = {")": "(", "]": "[", "}": "{"}[ch]
        while stack and stack[-1][1] != want and want == "{":
            stack.pop()  # an unclosed parenthesis doesn't outlive its braces
        if stack and stack[-1][1] == want:
            out[stack.pop()[0]] = m.start()
    return out


@dataclass(slots=True)
class Function:
    start: int
    name: str
    owner: str
    signature: str
    paren: int = -1  # where its parameters open
    body: int = -1  # python: where its body begins
    indent: int = 0


@dataclass(slots=True)
class Scope:
    name: str
    open: int
    close: int


def _owners(scopes: list[Scope], at: int) -> list[Scope]:
    return [s for s in scopes if s.open < at < s.close]


def _scopes(code: str, close: dict[int, int], pattern: re.Pattern[str]) -> list[Scope]:
    out = []
    for m in pattern.finditer(code):
        brace = code.find("{", m.end())
        semicolon = code.find(";", m.end())
        if brace >= 0 and not 0 <= semicolon < brace:
            out.append(Scope(m.group("name"), brace, close.get(brace, len(code))))
    return out


def _depths(code: str) -> tuple[list[int], list[int]]:
    """Positions where brace depth changes, and the depth from there on."""
    at, depth, d = [0], [0], 0
    for m in re.finditer(r"[{}]", code):
        d = d + 1 if m.group() == "{" else max(d - 1, 0)
        at.append(m.start() + 1)
        depth.append(d)
    return at, depth


def _line_start(code: str, at: int) -> int:
    return code.rfind("\n", 0, at) + 1


def _sig(text: str, a: int, b: int) -> str:
    return re.sub(r"\s+", " ", text[a : b + 1]).strip()


PY_DEF = re.compile(r"^(?P<indent>[ \t]*)(?:(?:async[ \t]+)?(?P<def>def)|(?P<class>class))[ \t]+(?P<name>\w+)", re.M)


def python_functions(text: str, code: str) -> Iterator[Function]:
    """Functions with the place where their body begins."""
    close: dict[int, int] | None = None
    stack: list[tuple[int, str, bool]] = []
    for m in PY_DEF.finditer(code):
        indent = len(m.group("indent").expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, m.group("name"), bool(m.group("class"))))
        if m.group("class"):
            continue
        if close is None:
            close = pairs(code)
        paren = re.compile(r"[ \t]*(?:\[[^\n]*?\][ \t]*)?\(").match(code, m.end())
        end = close.get(paren.end() - 1) if paren else None
        if end is None:
            continue
        colon = _annotation_end(code, end + 1, close)
        if colon >= 0:
            owner = ".".join(name for _, name, is_class in stack[:-1] if is_class)
            yield Function(m.start("indent"), m.group("name"), owner, _sig(text, paren.end() - 1, colon - 1), paren.end() - 1, colon + 1, indent)


def lone_literals(code: str, strings: dict[int, Span]) -> list[Span]:
    """Plain string literals after which a statement ends, in order: what documentation can be in python."""
    ends = re.compile(r"[ \t]*(?:;|\n|\Z)")
    return [s for _, s in sorted(strings.items()) if not set(s.kind) - set("ru") and ends.match(code, s.end)]


def _annotation_end(code: str, at: int, close: dict[int, int]) -> int:
    """The colon that ends a header whose parameters closed just before `at`."""
    while at < len(code):
        ch = code[at]
        if ch == ":":
            return at
        if ch in "([{":
            at = close.get(at, len(code))
        elif ch == ";" or ch == "\n" and not code[_line_start(code, at) : at].rstrip().endswith(("\\", "->")):
            return -1
        at += 1
    return -1


def literal_text(literal: str) -> str:
    body = literal.lstrip("rRuU")
    q = 3 if body[:3] in ('"""', "'''") else 1
    return body[q:-q] if len(body) >= 2 * q and body.endswith(body[:q]) else body[q:]


TS_CLASS = re.compile(r"\b(?:class|interface)\s+(?P<name>[\w$]+)")
TS_FUNCTION = re.compile(r"(?P<start>(?:\b(?:export|default|declare|async)\s+)*)\bfunction\b\s*\*?\s*(?P<name>[\w$]+)")
TS_VARIABLE = re.compile(r"(?P<start>(?:\b(?:export|declare)\s+)*\b(?:const|let|var)\s+)(?P<name>[\w$]+)\s*(?=[:=])")
TS_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?P<start>(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|declare)[ \t]+)*)\*?[ \t]*(?P<name>#?[\w$]+)\s*[?!]?\s*(?P<after>[<(:=])", re.M)
NOT_METHODS = frozenset("if for while switch catch return throw function new typeof await yield else do try with super import export const let var class interface case delete".split())


def _ts_value_is_function(code: str, at: int, close: dict[int, int]) -> int:
    """If the expression at `at` is a function, the position of its parameters, else -1."""
    m = re.compile(r"\s*(?:async\b\s*)?(?:(?P<f>function\b)|(?P<generic><[^;{}=]*?>\s*)?(?P<p>\()|(?P<one>[\w$]+)\s*=>)").match(code, at)
    if not m:
        return -1
    if m.group("f"):
        return code.find("(", m.end())
    if m.group("one"):
        return m.start("one")
    end = close.get(m.start("p"))
    if end is None:
        return -1
    return m.start("p") if re.compile(r"\s*(?::[^;\n]*?)?=>").match(code, end + 1) else -1


def typescript_functions(text: str, code: str) -> Iterator[Function]:
    close = pairs(code)
    scopes = _scopes(code, close, TS_CLASS)
    for m in TS_FUNCTION.finditer(code):
        paren = code.find("(", m.end())
        yield Function(m.start(), m.group("name"), ".".join(s.name for s in _owners(scopes, m.start())), _sig(text, paren, close.get(paren, paren)), paren)
    for m in TS_VARIABLE.finditer(code):
        at = m.end()
        if code[at] == ":":
            eq = re.compile(r":(?:[^=;]|=>)*?=(?!>)").match(code, at)
            if not eq:
                continue
            at = eq.end() - 1
        paren = _ts_value_is_function(code, at + 1, close)
        if paren >= 0:
            yield Function(m.start(), m.group("name"), ".".join(s.name for s in _owners(scopes, m.start())), _sig(text, paren, close.get(paren, paren)), paren)
    if not scopes:
        return
    at, depth = _depths(code)
    for m in TS_METHOD.finditer(code):
        own = _owners(scopes, m.start("name"))
        if not own or m.group("name") in NOT_METHODS:
            continue
        here = depth[bisect_right(at, m.start("name")) - 1]
        if here != depth[bisect_right(at, own[-1].open) - 1] + 1:
            continue
        pos = m.start("after")
        if m.group("after") in ":=":
            eq = re.compile(r":(?:[^=;\n]|=>)*?=(?!>)|=(?!>)").match(code, pos)
            pos = _ts_value_is_function(code, eq.end(), close) if eq else -1
        elif m.group("after") == "<":
            pos = code.find("(", pos)
        end = close.get(pos)
        if end is None or m.group("after") in "<(" and not re.compile(r"\s*(?::[^;]*?)?[{;\n]").match(code, end + 1):
            continue
        yield Function(m.start("start"), m.group("name"), ".".join(s.name for s in own), _sig(text, pos, end), pos)


GO_FUNC = re.compile(r"^(?P<start>)func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\n]*?\]\s*)?\(", re.M)
GO_VAR = re.compile(r"^(?P<start>[ \t]*)(?:var\s+)?(?P<name>\w+)(?:\s+func\b[^=\n]*)?\s*=\s*func\s*\(", re.M)
GO_GROUP = re.compile(r"^(?:var|const)\s*\(", re.M)


def go_functions(text: str, code: str) -> Iterator[Function]:
    close = pairs(code)
    for m in GO_FUNC.finditer(code):
        end = close.get(m.end() - 1, m.end())
        yield Function(m.start(), m.group("name"), m.group("owner") or "", _sig(text, m.end() - 1, end), m.end() - 1)
    groups = [(m.end() - 1, close.get(m.end() - 1, len(code))) for m in GO_GROUP.finditer(code)]
    for m in GO_VAR.finditer(code):
        plain = m.group().lstrip().startswith("var")
        if plain and not m.group("start") or any(a < m.start() < b for a, b in groups):
            yield Function(m.end("start"), m.group("name"), "", _sig(text, m.end() - 1, close.get(m.end() - 1, m.end())), m.end() - 1)


RUST_IMPL = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:default\s+)?(?:impl\b\s*(?P<generic><(?:[^<>{}]|<(?:[^<>{}]|<[^<>{}]*>)*>)*>)?(?P<head>[^{;]*)|trait\s+(?P<trait>\w+)[^{;]*)\{", re.M)
RUST_FN = re.compile(r"(?P<start>(?:\bpub(?:\s*\([^)\n]*\))?\s+)?(?:\b(?:default|const|async|unsafe|extern)\s+(?:\"[^\"\n]*\"\s+|[ ]+)?)*)\bfn\s+(?P<name>(?:r#)?\w+)\s*(?P<after>[<(])")
RUST_VAR = re.compile(r"^(?P<start>[ \t]*(?:pub(?:\s*\([^)\n]*\))?\s+)?(?:const|static|let)\s+)(?:mut\s+)?(?P<name>\w+)\s*(?::[^=\n]*(?:->[^=\n]*)?)?=\s*(?:move\s*)?\|", re.M)


def _rust_type(head: str) -> str:
    head = re.split(r"\bwhere\b", head)[0]
    while "<" in head and (cut := re.sub(r"<[^<>]*>", "", head.replace("->", "  "))) != head:
        head = cut
    if (m := re.search(r"\bfor\s+(?!<)(.*)", head, re.S)) is not None:
        head = m.group(1)
    names = re.findall(r"\w+", re.sub(r"\b(?:dyn|mut)\b|'\w+", " ", head))
    return names[-1] if names else ""


def rust_functions(text: str, code: str) -> Iterator[Function]:
    close = pairs(code)
    scopes = [Scope(m.group("trait") or _rust_type(m.group("head") or ""), m.end() - 1, close.get(m.end() - 1, len(code))) for m in RUST_IMPL.finditer(code)]
    for m in RUST_FN.finditer(code):
        pos = m.start("after") if m.group("after") == "(" else code.find("(", m.end())
        own = _owners(scopes, m.start("name"))
        yield Function(m.start(), m.group("name").removeprefix("r#"), own[-1].name if own else "", _sig(text, pos, close.get(pos, pos)), pos)
    for m in RUST_VAR.finditer(code):
        own = _owners(scopes, m.start("name"))
        yield Function(m.start() + len(m.group("start")) - len(m.group("start").lstrip()), m.group("name"), own[-1].name if own else "", _sig(text, m.end() - 1, code.find("|", m.end())), m.end() - 1)


JAVA_TYPE = re.compile(r"(?<![\w.])(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)")
JAVA_METHOD = re.compile(r"(?:^|(?<=[{};]))[ \t]*(?P<start>)(?:@[\w.]+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<(?:[^<>(){};]|<[^<>(){};]*>)*>\s+)?(?P<type>[\w.]+(?:\s*<(?:[^<>(){};]|<(?:[^<>(){};]|<[^<>(){};]*>)*>)*>)?(?:\s*\[\s*\])*)\s+(?P<name>\w+)\s*\(", re.M)
JAVA_FIELD = re.compile(r"^[ \t]*(?P<start>)(?:@[\w.]+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*[\w.]+(?:\s*<[^;={}()]*>)?\s+(?P<name>\w+)\s*=\s*(?P<params>\([^();]*\)|\w+)\s*->", re.M)
JAVA_NOT = frozenset("return new throw else case if for while switch try catch do assert yield instanceof package import".split())


def java_functions(text: str, code: str) -> Iterator[Function]:
    close = pairs(code)
    scopes = _scopes(code, close, JAVA_TYPE)
    at, depth = _depths(code)
    for m in [*JAVA_METHOD.finditer(code), *JAVA_FIELD.finditer(code)]:
        own = _owners(scopes, m.start("name"))
        if not own or depth[bisect_right(at, m.start("name")) - 1] != depth[bisect_right(at, own[-1].open) - 1] + 1:
            continue
        if "type" in m.re.groupindex:
            if m.group("type") in JAVA_NOT or m.group("name") in JAVA_NOT:
                continue
            end = close.get(m.end() - 1)
            if end is None or not re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\b[^{;]*)?(?:default\b[^;]*)?[{;]").match(code, end + 1):
                continue
            paren, sig = m.end() - 1, _sig(text, m.end() - 1, end)
        else:
            paren, sig = m.start("params"), _sig(text, m.start("params"), m.end("params") - 1)
        yield Function(_first(code, m.start()), m.group("name"), ".".join(s.name for s in own), sig, paren)


def _first(code: str, at: int) -> int:
    return re.compile(r"\s*").match(code, at).end()


FINDERS = {"typescript": typescript_functions, "go": go_functions, "rust": rust_functions, "java": java_functions}


def normalized(text: str) -> str:
    """The text with plain line ends and blanks, and without invisible characters."""
    return INVISIBLE.sub("", text).replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n").replace("\u00a0", " ")


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower())
