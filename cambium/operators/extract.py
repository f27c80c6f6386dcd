"""Symbols, imports, raw references and bindings out of source text, for five languages.

One pass over the texts, in Arrow batches; the result is one flat table of records, written once, of which the relations
are views. Python is parsed by the standard library's parser, the others by the span scanners.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.functions.plain import blank, plain_path
from cambium.operators import spans as S
from cambium.operators.resolve import SEP, Resolver, bucket, first_existing
from cambium.session import cut, ship

# Decorators by which frameworks register what is called from outside.
ROUTES = ("get", "post", "put", "patch", "delete", "options", "head", "route", "add_api_route", "api_route", "websocket", "before_request", "on_event", "on_message")
HINT_LENGTH = 200
# Folders that can be the import root of a Python repository.
PYTHON_ROOTS = ("src", "lib", "python")

SCHEMA = "repo string, path string, version bigint, language string, module string, record string, pos int, owner string, name string, kind string, target string, extra string, line_start int, line_end int, exported boolean, decorated boolean, external_entry boolean, candidates array<string>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Parsed:
    module: str
    path: str
    rows: list[dict[str, object]] = field(default_factory=list)

    def add(self, record: str, **values: object) -> None:
        self.rows.append({"record": record, "pos": len(self.rows), **values})

    def symbol(self, qname: str, kind: str, first: int, last: int, **more: object) -> None:
        self.add("symbol", owner=qname, name=qname.rpartition(".")[2], kind=kind, line_start=first, line_end=last, **more)

    def edge(self, source: str, target: str, kind: str) -> None:
        if target:
            self.add("edge", owner=source, target=target, kind=kind)

    def imported(self, local: str, name: str, spec: str) -> None:
        self.add("import", name=local, kind=name, target=spec)


# Module names and the modules an import may mean


def module_id(path: str, language: str, root: str | None = None) -> str | None:
    """The module of a file: dotted path; packages collapse to their folder in python, files to theirs in go and java;
    rust drops a leading src and the names mod, lib and main, python its import root. Null where a language has no module
    at that place."""
    path = below_root(path, language, root)
    stem = re.sub(r"\.\w+$", "", path)
    parts = [p for p in stem.split("/") if p]
    if language == "python" and parts[-1:] == ["__init__"]:
        parts = parts[:-1]
    elif language in ("go", "java"):
        parts = parts[:-1]
    elif language == "rust":
        parts = parts[1:] if parts[0] == "src" and len(parts) > 1 else parts
        parts = parts[:-1] if len(parts) > 1 and parts[-1] in ("mod", "lib", "main") else parts
    return ".".join(parts) or None


def below_root(path: str, language: str, root: str | None) -> str:
    return path.removeprefix(f"{root}/") if root and language == "python" else path


def tails(parts: list[str]) -> list[str]:
    return [".".join(parts[i:]) for i in range(len(parts))]


def spec_candidates(spec: str, path: str, language: str) -> list[str]:
    """Modules an import may mean, in order."""
    if language == "python":
        dots = len(spec) - len(spec.lstrip("."))
        if not dots:
            return [spec]
        package = [p for p in path.split("/")[:-1] if p]
        base = package[: len(package) - (dots - 1)] if dots - 1 <= len(package) else []
        name = ".".join([*base, *[p for p in spec[dots:].split(".") if p]])
        return [name] if name else []
    if language == "typescript":
        if spec.startswith("@/"):
            base: list[str] = []
            rest = spec[2:]
        elif spec.startswith("."):
            base, rest = path.split("/")[:-1], spec
        else:
            return [re.sub(r"/", ".", spec[1:])] if spec.startswith("@") and "/" in spec else []
        for p in rest.split("/"):
            if p == "..":
                base = base[:-1]
            elif p not in ("", "."):
                base = [*base, p]
        stem = re.sub(r"\.(?:tsx?|jsx?|mjs|cjs)$", "", "/".join(base))
        name = stem.replace("/", ".")
        return [name, f"{name}.index"] if name else []
    if language == "go":
        return tails([p for p in spec.split("/") if p])
    return tails([p for p in spec.split(".") if p])


# Python


def _dotted(n: ast.AST | None) -> str:
    """A name as written; the result of super() and type(x) stands for the receiver, other calls end the chain."""
    parts: list[str] = []
    while n is not None:
        if isinstance(n, ast.Attribute):
            parts.append(n.attr)
            n = n.value
        elif isinstance(n, ast.Name):
            return ".".join([n.id, *reversed(parts)])
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("super", "type"):
            return ".".join([n.func.id, *reversed(parts)])
        elif isinstance(n, (ast.Await, ast.Subscript)):
            n = n.value
        else:
            return ""
    return ""


def _walk(body: list[ast.stmt], stop: tuple[type, ...]) -> Iterator[ast.AST]:
    todo: list[ast.AST] = list(reversed(body))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, stop):
            todo.extend(reversed(list(ast.iter_child_nodes(n))))


def _types(n: ast.AST | None) -> list[str]:
    if n is None:
        return []
    if isinstance(n, ast.Constant) and isinstance(n.value, str):
        try:
            n = ast.parse(n.value, mode="eval").body
        except SyntaxError:
            return []
    return [x.id for x in ast.walk(n) if isinstance(x, ast.Name)]


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse_python(p: Parsed, text: str) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        p.add("error", extra=str(e)[:200])
        _python_by_spans(p, text)
        return
    seen: set[str] = set()
    lazy: dict[str, set[tuple[str, str]]] = {}
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            rows = [(a.asname or a.name.split(".")[0], "*", a.name) for a in n.names] if isinstance(n, ast.Import) else [("*" if a.name == "*" else a.asname or a.name, a.name, "." * n.level + (n.module or "")) for a in n.names]
            for local, name, spec in rows:
                if n in tree.body:
                    p.imported(local, name, spec)
                    seen.add(local)
                else:
                    lazy.setdefault(local, set()).add((name, spec))
    for local, options in lazy.items():  # imports inside functions count where they can mean one thing only
        if local not in seen and len(options) == 1:
            p.imported(local, *next(iter(options)))

    def function(n: ast.FunctionDef | ast.AsyncFunctionDef, scope: str, cls: str | None) -> None:
        q = f"{scope}.{n.name}"
        routes = [ast.unparse(d)[:HINT_LENGTH] for d in n.decorator_list if isinstance(f := d.func if isinstance(d, ast.Call) else d, ast.Attribute) and f.attr in ROUTES]
        returns = f" -> {ast.unparse(n.returns)}" if n.returns else ""
        p.symbol(q, "method" if cls else "function", n.lineno, n.end_lineno or n.lineno, extra=f"({ast.unparse(n.args)}){returns}", exported=cls is None, decorated=bool(n.decorator_list), external_entry=bool(routes), target=routes[0] if routes else None)
        args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *([n.args.vararg] if n.args.vararg else []), *([n.args.kwarg] if n.args.kwarg else [])]
        for t in dict.fromkeys(x for a in [*[a.annotation for a in args], n.returns] for x in _types(a)):
            p.edge(q, t, "uses_type")
        notes = {a.arg: ast.unparse(a.annotation) for a in args if a.annotation}
        for x in _walk(n.body, FUNCTIONS):
            if isinstance(x, ast.Call):
                p.edge(q, _dotted(x.func), "calls")
        for x in _walk(n.body, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            if isinstance(x, (ast.Assign, ast.AnnAssign)) and x.value is not None:
                for left in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    local = left.id if isinstance(left, ast.Name) else _dotted(left) if isinstance(left, ast.Attribute) else ""
                    if "." in local and not (local.startswith("self.") and local.count(".") == 1):
                        continue
                    value = _dotted(x.value.func if isinstance(x.value, ast.Call) else x.value)
                    if local and value and local != value:
                        p.add("binding", owner=cls if cls and local.startswith("self.") else q, name=local, target=value, extra=notes.get(value))

    for n in tree.body:
        if isinstance(n, FUNCTIONS):
            function(n, p.module, None)
        elif isinstance(n, ast.ClassDef):
            q = f"{p.module}.{n.name}"
            p.symbol(q, "class", n.lineno, n.end_lineno or n.lineno, exported=True, decorated=bool(n.decorator_list), external_entry=False)
            for b in n.bases:
                p.edge(q, _dotted(b), "inherits")
            for m in n.body:
                if isinstance(m, FUNCTIONS):
                    function(m, q, q)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            if len(targets) == 1 and isinstance(targets[0], ast.Name) and not targets[0].id.startswith("_"):
                p.symbol(f"{p.module}.{targets[0].id}", "constant", n.lineno, n.end_lineno or n.lineno, exported=True, decorated=False, external_entry=False)


def _python_by_spans(p: Parsed, text: str) -> None:
    """Definitions of a file that doesn't parse."""
    code = S.lex(text, "python")[0]
    line = _liner(text)
    stack: list[tuple[int, str, bool]] = []
    for m in S.PY_DEF.finditer(code):
        indent = len(m.group("indent").expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        is_class = bool(m.group("class"))
        if len(stack) <= 1 and all(c for _, _, c in stack):
            q = ".".join([p.module, *[n for _, n, _ in stack], m.group("name")])
            p.symbol(q, "class" if is_class else "method" if stack else "function", line(m.start()), line(m.start()), exported=not stack, decorated=False, external_entry=False)
        stack.append((indent, m.group("name"), is_class))


# The others


def _liner(text: str) -> Callable[[int], int]:
    ends = [i for i, ch in enumerate(text) if ch == "\n"]
    return lambda at: bisect_right(ends, at - 1) + 1


CALL = {
    "typescript": re.compile(r"(?<![\w$.#@])((?:[A-Za-z_$][\w$]*)(?:\s*(?:\?\.|!?\.)\s*#?[A-Za-z_$][\w$]*)*)\s*(?:<[\w$, .\[\]|]*>)?\("),
    "go": re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)(?:\[[\w., *]+\])?\("),
    "rust": re.compile(r"(?<![\w.:])([A-Za-z_]\w*(?:\s*(?:\.|::)\s*[A-Za-z_]\w*)*)(?:::<[^()<>]*>)?\("),
    "java": re.compile(r"(?<![\w.@])((?:[A-Za-z_]\w*\s*\.\s*)*[A-Za-z_]\w*)\s*\("),
}
NO_CALL = frozenset("if for while switch catch return function new typeof await yield super throw do else with match loop fn func go defer select range synchronized try assert in of void delete instanceof case import require_once async".split())
RENDER = re.compile(r"<([A-Z][\w$.]*)(?=[\s/>])")
TYPE_DECL = {
    "typescript": re.compile(r"^(?P<start>[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:const\s+)?)(?P<kind>class|interface|enum|type)\s+(?P<name>[\w$]+)(?P<head>[^{;]*)", re.M),
    "go": re.compile(r"^(?P<start>)type\s+(?P<name>\w+)(?:\[[^\]\n]*\])?\s+(?P<kind>struct|interface|[\w*\[\]=.]+)(?P<head>)", re.M),
    "rust": re.compile(r"^(?P<start>[ \t]*(?P<export>pub(?:\([^)\n]*\))?\s+)?(?:unsafe\s+)?)(?P<kind>struct|enum|trait|type)\s+(?P<name>\w+)(?P<head>)", re.M),
    "java": re.compile(r"^(?P<start>[ \t]*(?:@[\w.]+(?:\([^()\n]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*)(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)(?P<head>[^{]*)", re.M),
}
KIND = {"struct": "class", "trait": "interface", "record": "class", "type": "type_alias", "class": "class", "interface": "interface", "enum": "enum"}
CONSTANT = {
    "typescript": re.compile(r"^(?P<export>export\s+)?const\s+(?P<name>[\w$]+)", re.M),
    "go": re.compile(r"^(?P<export>)(?:const|var)\s+(?P<name>[A-Za-z]\w*)", re.M),
    "rust": re.compile(r"^(?P<export>pub(?:\([^)\n]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z]\w*)\s*:", re.M),
}


def _type_names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<![\w$.])([A-Z][\w$]*)", text)))


def _heritage(head: str, language: str) -> list[str]:
    head = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", head))
    if language in ("typescript", "java"):
        return [n.strip() for part in re.findall(r"\b(?:extends|implements)\b([^{]*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S) for n in part.split(",") if re.fullmatch(r"[\w$.]+", n.strip())]
    return []


def parse_braces(p: Parsed, text: str, language: str) -> None:
    code = S.lex(text, language)[0]
    line, close = _liner(text), S.pairs(code)
    if code.count("{") != code.count("}") or code.count("(") != code.count(")"):
        p.add("error", extra="unbalanced brackets")
    exported_types: dict[str, bool] = {}
    for m in TYPE_DECL[language].finditer(code):
        kind, name = m.group("kind"), m.group("name")
        brace = code.find("{", m.end("kind"))
        newline = code.find("\n", m.end())
        last = close.get(brace, m.end()) if brace >= 0 and (kind not in ("type", "struct") or brace <= (newline if newline > 0 else len(code))) else m.end()
        kind = KIND.get(kind, "type_alias")
        exported = name[:1].isupper() if language == "go" else "public" in m.group("start") if language == "java" else bool(m.group("export"))
        exported_types[name] = exported
        body = S._sig(text, m.start("kind"), last) if language == "typescript" and kind in ("interface", "type_alias") else None
        q = f"{p.module}.{name}"
        p.symbol(q, kind, line(m.start("kind")), line(last), extra=body, exported=exported, decorated="@" in m.group("start"), external_entry=False)
        for base in _heritage(m.group("head") or "", language):
            p.edge(q, base, "inherits")
        if language == "go" and kind == "interface" and brace >= 0:
            for e in re.findall(r"^[ \t]*([A-Za-z_][\w.]*)[ \t]*$", code[brace + 1 : last], re.M):
                p.edge(q, e, "inherits")
    functions = sorted(S.FINDERS[language](text, code), key=lambda f: f.start)
    bodies = []
    for f in functions:
        if language == "go" and re.match(r"(?:Test|Benchmark|Example)", f.name) and not f.owner:
            continue
        if language == "java" and f.name == f.owner.rpartition(".")[2]:
            continue  # constructors
        end = close.get(f.paren, f.paren)
        brace = code.find("{", end)
        stop = re.compile(r"[;]").search(code, end)
        has_body = brace >= 0 and not (stop and stop.start() < brace)
        last = close.get(brace, len(code) - 1) if has_body else end
        returns = code[end + 1 : brace].strip().rstrip("{=> ").strip() if has_body else ""
        q = ".".join([p.module, *([f.owner] if f.owner else []), f.name])
        before = code[f.start : f.paren]
        if language == "typescript":
            exported, kind = bool(re.match(r"\s*export\b", before)), "method" if f.owner else "function"
            if not f.owner and f.name[:1].isupper() and has_body and RENDER.search(code, brace, last):
                kind = "component"
        elif language == "go":
            exported, kind = f.name[:1].isupper(), "method" if f.owner else "function"
        elif language == "rust":
            exported, kind = bool(re.match(r"\s*pub\b", before)), "method" if f.owner else "function"
        else:
            exported, kind = exported_types.get(f.owner.rpartition(".")[2], False), "method"
        p.symbol(q, kind, line(f.start), line(last), extra=re.sub(r"\s+", " ", f"{f.signature} {returns}").strip(), exported=exported, decorated=code[f.start : f.start + 1] == "@", external_entry=False)
        if language == "typescript":
            for t in _type_names(f.signature + " " + returns):
                if t != f.name:
                    p.edge(q, t, "uses_type")
        if has_body:
            bodies.append((brace, last, q))
    names = {f.name for f in functions}
    if language in CONSTANT:
        for m in CONSTANT[language].finditer(code):
            if m.group("name") not in names:
                p.symbol(f"{p.module}.{m.group('name')}", "constant", line(m.start()), line(m.end()), exported=m.group("name")[:1].isupper() if language == "go" else bool(m.group("export")), decorated=False, external_entry=False)
    for a, b, q in bodies:
        inner = [(x, y) for x, y, _ in bodies if a < x and y < b]
        for m in CALL[language].finditer(code, a, b):
            if any(x < m.start() < y for x, y in inner):
                continue
            target = re.sub(r"\s+|[?!](?=\.)", "", m.group(1)).replace("::", ".")
            root = target.partition(".")[0]
            if root in NO_CALL and root != "super" or language == "rust" and root == "self" and "." in target or language == "java" and root in ("this", "super"):
                continue
            if re.search(r"\b(?:new|fn|func|function)\s+$", code[max(0, m.start() - 12) : m.start()]):
                continue
            p.edge(q, target, "calls")
        if language == "typescript":
            for m in RENDER.finditer(code, a, b):
                if not any(x < m.start() < y for x, y in inner):
                    p.edge(q, m.group(1), "renders")
    IMPORTS[language](p, text, code)


def _ts_imports(p: Parsed, text: str, code: str) -> None:
    for m in re.finditer(r"^[ \t]*(?P<what>import|export)\b(?P<clause>[^;'\"]*?)\bfrom\s*['\"](?P<spec>[^'\"\n]+)['\"]", text, re.M):
        if not re.match(r"import|export", code[m.start("what") : m.end("what")]):
            continue  # inside a comment or string
        clause, spec = re.sub(r"^\s*type\b", "", m.group("clause")).strip(), m.group("spec")
        named = re.search(r"\{([^}]*)\}", clause)
        if m.group("what") == "export" and not named:
            p.imported("*", "*", spec)
            continue
        for part in named.group(1).split(",") if named else []:
            if n := re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*", part):
                p.imported(n.group(2) or n.group(1), n.group(1), spec)
        rest = re.sub(r"\{[^}]*\}", "", clause)
        if ns := re.search(r"\*\s+as\s+([\w$]+)", rest):
            p.imported(ns.group(1), "*", spec)
        if default := re.match(r"\s*([A-Za-z_$][\w$]*)", re.sub(r"\*\s+as\s+[\w$]+", "", rest)):
            p.imported(default.group(1), "default", spec)


def _go_imports(p: Parsed, text: str, code: str) -> None:
    for m in re.finditer(r"^import\s*(?:\((?P<group>[^)]*)\)|(?P<one>[^\n]*))", text, re.M):
        for line in (m.group("group") or m.group("one") or "").split("\n"):
            if n := re.match(r"\s*(?:([\w.]+)\s+)?\"([^\"]+)\"", line):
                local = n.group(1) or n.group(2).rstrip("/").split("/")[-1]
                if local not in (".", "_"):
                    p.imported(local, "*", n.group(2))


def _rust_imports(p: Parsed, text: str, code: str) -> None:
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
        body, _, alias = m.group(1).partition(" as ")
        path = [s.strip() for s in body.split("::") if s.strip()]
        while path and path[0] in ("crate", "self", "super"):
            path.pop(0)
        if not path or any(ch in s for s in path for ch in "{}*"):
            continue
        if len(path) == 1:
            p.imported(path[0], "*", path[0])
        else:
            p.imported(alias.strip() or path[-1], path[-1], ".".join(path[:-1]))


def _java_imports(p: Parsed, text: str, code: str) -> None:
    for m in re.finditer(r"^[ \t]*import\s+(?!static\b)([\w.]+)\s*;", code, re.M):
        spec, _, name = m.group(1).rpartition(".")
        if spec and name:
            p.imported(name, name, spec)


IMPORTS = {"typescript": _ts_imports, "go": _go_imports, "rust": _rust_imports, "java": _java_imports}


@dataclass(frozen=True)
class Backend:
    """What a language needs: its name, `parse`, which adds the records of a text, `module` (path, root) and `candidates`
    (spec, path, root), the modules an import may mean. Functions have to be known to the workers: of a module they
    can import, or plain closures."""

    language: str
    parse: Callable[[Parsed, str], None]
    module: Callable[[str, str | None], str | None]
    candidates: Callable[[str, str, str | None], list[str]]


def _backend(language: str) -> Backend:
    own = parse_python if language == "python" else partial(parse_braces, language=language)
    return Backend(language, own, lambda path, root: module_id(path, language, root), lambda spec, path, root: spec_candidates(spec, below_root(path, language, root), language))


BACKENDS = {ext: _backend(language) for ext, language in S.LANGUAGES.items()}  # by file extension


def parse(text: str, path: str, root: str | None = None, backends: Mapping[str, Backend] = BACKENDS) -> Parsed | None:
    """Everything found in one file, or null where its language has no module there. `root` is the import root."""
    backend = backends.get(path.rpartition(".")[2].lower())
    if not backend or path.endswith((".d.ts", "_test.go")):
        return None
    module = backend.module(path, root)
    if not module:
        return None
    text = S.normalized(text or "")
    p = Parsed(module, path)
    p.symbol(module, "module", 1, text.count("\n") + 1, exported=True, decorated=False, external_entry=False)
    backend.parse(p, text)
    for r in p.rows:
        if r["record"] == "import":
            r["candidates"] = backend.candidates(str(r["target"]), path, root)
    return p


def _extract(batches: Iterator[pd.DataFrame], backends: Mapping[str, Backend]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, text, version, root in zip(batch["repo"], batch["path"], batch["text"], batch["version"], batch["root"], strict=True):
            if (p := parse(text, path, root, backends)) is not None:
                common = {"repo": repo, "path": path, "version": version, "language": backends[path.rpartition(".")[2].lower()].language, "module": p.module}
                rows += [tuple((common | r).get(c) for c in COLUMNS) for r in p.rows]
        yield pd.DataFrame(rows, columns=COLUMNS)


@dataclass(frozen=True)
class Extracted:
    """Views of the records of one extraction."""

    records: DataFrame

    def _of(self, record: str, **names: str) -> DataFrame:
        return self.records.where(F.col("record") == record).select("repo", "path", "version", "module", *[F.col(old).alias(new) for new, old in names.items()])

    @property
    def symbols(self) -> DataFrame:
        return self._of("symbol", qname="owner", name="name", kind="kind", signature="extra", line_start="line_start", line_end="line_end", exported="exported", decorated="decorated", external_entry="external_entry", external_hint="target", language="language")

    @property
    def imports(self) -> DataFrame:
        return self._of("import", local="name", imported="kind", spec="target", candidates="candidates", pos="pos")

    @property
    def edges(self) -> DataFrame:
        return self._of("edge", source="owner", target="target", kind="kind", pos="pos")

    @property
    def bindings(self) -> DataFrame:
        return self._of("binding", owner="owner", local="name", target="target", annotation="extra", pos="pos")

    @property
    def errors(self) -> DataFrame:
        return self._of("error", message="extra")


def import_roots(files: DataFrame) -> DataFrame:
    """`repo, root`: the folder under which the Python modules of a repository are named. That is the one of PYTHON_ROOTS
    that holds Python files, if there is exactly one and no Python file lies at the top. `files`: repo, path."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    tops = files.where(F.col("path").endswith(".py")).select("repo", top.alias("top")).where(F.col("top").isin("", *PYTHON_ROOTS))
    return tops.groupBy("repo").agg(F.count_distinct("top").alias("n"), F.min("top").alias("root")).where("n = 1 and root <> ''").select("repo", "root")


def latest_texts(documents: DataFrame) -> DataFrame:
    """`repo, path, text` of the documents with a path, each path's text collected last (ties: the greatest doc_id). Only the
    ids of those that came before are joined to the texts."""
    rows = documents.select("doc_id", "repo", plain_path(F.col("path")).alias("path"), "collected_at", "text").where(F.col("repo").isNotNull() & ~blank(F.col("path")))
    age = F.struct("collected_at", "doc_id")
    last = rows.groupBy("repo", "path").agg(F.max(age).alias("last"), F.count("*").alias("n")).where("n > 1")
    old = rows.select("doc_id", "repo", "path", age.alias("age")).join(last, ["repo", "path"]).where("age <> last").select("doc_id").distinct()
    return rows.join(old, "doc_id", "left_anti").select("repo", "path", "text")


def extract(sources: DataFrame, roots: DataFrame | None = None, backends: Mapping[str, Backend] | None = None) -> Extracted:
    """Records of source files (repo, path, text), written once. Rows without repo, path or text give nothing. Versions of
    one path stay apart: a record's `version` is a hash of its text. `roots` are the `import_roots`, by default those of the
    sources themselves. `backends`, by file extension, add languages or replace ours."""
    ship(sources.sparkSession)
    rows = sources.select("repo", plain_path(F.col("path")).alias("path"), "text").where(F.col("repo").isNotNull() & ~blank(F.col("path")) & F.col("text").isNotNull())
    rows = rows.withColumn("version", F.xxhash64("text")).join(import_roots(rows) if roots is None else roots, "repo", "left")
    known = None if backends is None else {**BACKENDS, **backends}  # ours are found by the workers themselves
    return Extracted(cut(rows.mapInPandas(lambda batches: _extract(batches, known or BACKENDS), SCHEMA), "extracted"))


@dataclass(frozen=True)
class Resolution:
    """The edges of an extraction (repo, source, target, kind, method), its unresolved calls, inheritances and renderings
    with their bucket (repo, source, target_text, kind, member, bucket), and its `star_exports`."""

    edges: DataFrame
    unresolved: DataFrame
    stars: DataFrame


def resolved(x: Extracted) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved usages of a `resolution`."""
    r = resolution(x)
    return r.edges, r.unresolved


def resolution(x: Extracted) -> Resolution:
    symbols = cut(x.symbols.select("repo", "qname", "name", "kind", "module").distinct(), "universe")
    modules = symbols.where("kind = 'module'").select("repo", F.col("qname").alias("module"))
    imports = cut(first_existing(x.imports, modules.distinct()), "imports")
    raw = x.edges.select("repo", F.concat_ws(SEP, "path", F.col("version").cast("string"), F.col("pos").cast("string")).alias("id"), "module", "source", "target", "kind", "pos")
    stars = star_exports(imports)
    r = Resolver(symbols, imports, stars)
    # bases first: members are then looked for on ancestors too
    inherits = raw.where("kind = 'inherits'")
    bases = inherits.join(r.resolve(inherits), ["repo", "id"]).select("repo", F.col("source").alias("cls"), F.col("hit").alias("base"), "pos")
    hits = cut(r.with_bases(bases).resolve_bound(raw, x.bindings), "hits")
    found = raw.join(hits, ["repo", "id"]).select("repo", "source", F.col("hit").alias("target"), "kind", "method")
    edges = found.unionByName(r.import_edges()).distinct()
    open_ = raw.where("kind in ('calls', 'inherits', 'renders')").join(hits, ["repo", "id"], "left_anti").select("repo", "source", F.col("target").alias("target_text"), "kind")
    return Resolution(edges, bucket(open_, symbols).select("repo", "source", "target_text", "kind", F.substring_index("target_text", ".", -1).alias("member"), "bucket"), stars)


def star_exports(imports: DataFrame) -> DataFrame:
    """`repo, module, target` of the imports (see `first_existing`) that hand on everything of a module."""
    return imports.where("local = '*' and imported = '*' and target is not null").select("repo", "module", "target").distinct()
