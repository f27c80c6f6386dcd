"""Questions by name: the tools behind the command line and a line-based JSON server."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import graph as G
from cambium.session import scope
from cambium.sources import git

ROWS = 1000  # of a list in an answer, by default; a longer one is cut and its true length told under "truncated"
ENTRY_NOTE = "registered with a framework: reached from outside, so no dependants in the repository is no proof of safety"


class Tools:
    """Answers over one graph. `roots` names the folder of each repository, for git facts; `rows` is the longest list in an
    answer, None for no limit."""

    def __init__(self, spark: SparkSession, graph: G.CodeGraph, roots: dict[str, str], rows: int | None = ROWS):
        self.spark, self.graph, self.roots, self.rows = spark, graph, roots, rows
        self.truncated: dict[str, int] = {}

    def answer(self, name: str, **given: Any) -> dict[str, Any]:
        """The answer of a tool; scratch tables of the question go with it, and lists that were cut are named."""
        self.truncated = {}
        with scope(self.spark):
            out = getattr(self, name)(**given)
        return out | ({"truncated": self.truncated} if self.truncated else {})

    def _list(self, name: str, df: DataFrame, *order: str) -> list[dict[str, Any]]:
        if self.rows is None:
            return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
        rows = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(self.rows + 1).collect()]
        if len(rows) > self.rows:
            self.truncated[name] = df.count()
        return rows[: self.rows]

    def _where(self, qname: str) -> DataFrame:
        """The symbol in every repository that has it."""
        return self.graph.symbols.where(F.col("qname") == qname).select("repo", F.col("qname").alias("root"))

    def _consumers(self, roots: DataFrame) -> list[dict[str, Any]]:
        c = G.contract_consumers(self.graph).join(roots.select(F.col("repo").alias("provider_repo"), F.col("root").alias("provider_qname")), ["provider_repo", "provider_qname"], "left_semi")
        return self._list("contract_consumers", c, "id")

    def _reports(self, symbol: str, change: str, heads: list[dict[str, Any]], direct: list[dict[str, Any]], transitive: list[dict[str, Any]], consumers: list[dict[str, Any]]) -> dict[str, Any]:
        """One report a repository that has the symbol; without any, risk none."""
        out = []
        for h in heads:
            mine = lambda rows: [{k: v for k, v in r.items() if k not in ("repo", "root")} for r in rows if r["repo"] == h["repo"]]  # noqa: B023, E731
            near, far = mine(direct), mine(transitive)
            suspects = [] if near or far or not h.get("name") else self._list("suspected", G.suspected(self.graph, h["repo"], h["name"]), "source_qname", "target_text")
            notes = [ENTRY_NOTE] if h.get("external_entry") else []
            if suspects:
                notes.append(f"{len(suspects)} unresolved reference(s) carry this name: suspected, to be checked in the code")
            risk = "low" if h["risk"] == "none" and (suspects or h.get("external_entry")) else h["risk"]
            report = {"symbol": symbol, "change": change, "risk": risk, "confidence": h["confidence"], "notes": notes, "direct": near, "transitive": far, "affected_files": list(dict.fromkeys(r["file_path"] for r in near + far))}
            out.append({"repo": h["repo"], "report": report | {"suspected": suspects, "external_entry": bool(h.get("external_entry")), "external_hint": h.get("external_hint")}})
        found = {"symbol": symbol, "repos": out} if out else {"symbol": symbol, "risk": "none", "notes": ["symbol not found"], "repos": []}
        return found | ({"contract_consumers": consumers} if consumers else {})

    def _heads(self, roots: DataFrame, verdicts: DataFrame) -> list[dict[str, Any]]:
        """What is known of the symbol, with its verdict (repo, risk, confidence), per repository."""
        s = self.graph.symbols.select("repo", F.col("qname").alias("root"), "name", "external_entry", "external_hint")
        return self._list("repos", roots.join(s, ["repo", "root"]).join(verdicts, ["repo", "root"]), "repo")

    def dependents(self, symbol: str, max_depth: int = 2) -> dict[str, Any]:
        roots = self._where(symbol)
        d = G.dependents(self.graph, roots, max_depth)
        heads = self._heads(roots, G.impact(self.graph, roots, max_depth).select("repo", "root", "risk", "confidence"))
        return self._reports(symbol, "impact", heads, self._list("direct", d.where("relation = 'direct'"), "repo", "qname", "edge_kind"), self._list("transitive", d.where("relation = 'transitive'"), "repo", "qname", "edge_kind"), self._consumers(roots))

    impact = dependents

    def would_break(self, symbol: str, change: str = "removed", new_signature: str | None = None) -> dict[str, Any]:
        roots = self._where(symbol)
        targets = roots.select("repo", F.col("root").alias("qname"))
        if new_signature is not None:
            targets = targets.withColumn("new_signature", F.lit(new_signature))
        heads = self._heads(roots, G.would_break(self.graph, targets, change).select("repo", F.col("qname").alias("root"), "risk", "confidence"))
        rows = G.break_rows(self.graph, targets, change).withColumn("relation", F.lit("direct"))
        return self._reports(symbol, change, heads, self._list("direct", rows, "repo", "qname", "edge_kind"), [], self._consumers(roots))

    def changes(self, files: list[str] | None = None) -> dict[str, Any]:
        out, names = [], []
        for repo, root in self.roots.items():
            changed = git.changed(self.spark, root, repo, files)
            names += [r["path"] for r in changed.orderBy("path").collect()]
            out += self._list("affected", G.change_surface(self.graph, changed), "qname", "relation")
        return {"changed_files": names, "affected": out, "affected_files": list(dict.fromkeys(r["file_path"] for r in out))}

    def search(self, query: str, limit: int = 25) -> dict[str, Any]:
        return {"results": self._list("results", G.search(self.graph, query, limit), "kind", "repo", "qname")}

    def symbols_in_file(self, file: str) -> dict[str, Any]:
        return {"file": file, "symbols": self._list("symbols", self.graph.symbols.where(F.col("file_path") == file), "line_start", "qname")}

    def why(self, symbol: str, limit: int = 12) -> dict[str, Any]:
        out = []
        for r in self._list("where", self.graph.symbols.where(F.col("qname") == symbol), "repo"):
            root = self.roots.get(r["repo"], "")
            facts = git.history(self.spark, root, r["file_path"], r["line_start"] or 1, r["line_end"] or r["line_start"] or 1, limit)
            out.append({"repo": r["repo"], "file": r["file_path"], "lines": [r["line_start"], r["line_end"]], "facts": self._list("facts", facts, "date"), "candidates": self._list("candidates", G.candidates(facts), "date"), "git": git.has_history(root)})
        return {"symbol": symbol, "where": out, **({} if out else {"notes": ["symbol not found"]})}

    def audit(self, target: str) -> dict[str, Any]:
        plain = lambda rows: [{k: v for k, v in r.items() if k in ("repo", "file", "confidence")} | {"relations": r["relations"].split(",")} for r in rows]
        common = {"target": target, "change": "removed"}
        health = {"resolution": {r["method"]: r["n"] for r in self._list("resolution", G.resolution_health(self.graph), "method")}}
        if "/" in target or target.endswith(G.SOURCE_SUFFIXES):
            report, files = G.audit_files(self.graph, self.spark.createDataFrame([(r, target) for r in self.roots], "repo string, path string"))
            reports = self._list("reports", report, "repo")
            if not reports:
                return {"kind": "file", "target": target, "notes": ["file not indexed"]}
            worst = max(reports, key=lambda r: r["confidence"])
            found = plain(self._list("files", files, "file"))
            read = [r["file"] for r in self._list("read_set", G.read_set(files, ["repo", "path"]), "n")] or [target]
            return common | {"kind": "file", "risk": worst["risk"], "confidence": worst["confidence"], "worst": worst["worst"], "symbols_audited": sum(r["symbols_audited"] for r in reports), "files": found, "affected_files_count": len(found), "read_set": read} | health
        roots = self._where(target)
        files = G.audit(self.graph, roots)
        own = [r["file_path"] for r in self._list("own", self.graph.symbols.where(F.col("qname") == target), "repo")]
        impact, verdict = self.dependents(target), self._list("verdict", G.would_break(self.graph, roots.select("repo", F.col("root").alias("qname"))), "repo")
        worst = max(verdict, key=lambda r: r["confidence"], default={"risk": "none", "confidence": 0.0})
        reports = [r["report"] for r in impact["repos"]]
        found = plain(self._list("files", files, "file"))
        return common | {
            "kind": "symbol", "root_symbol": target, "risk": worst["risk"], "confidence": worst["confidence"], "symbol_notes": [n for r in reports for n in r["notes"]] or impact.get("notes", []), "files": found, "affected_files_count": len(found),
            "read_set": [r["file"] for r in self._list("read_set", G.read_set(files, ["repo", "root"]), "n")] or own, "suspected": [x for r in reports for x in r["suspected"]],
            "external_entry": any(r["external_entry"] for r in reports), "external_hint": next((r["external_hint"] for r in reports if r["external_hint"]), None), "why": self.why(target),
        } | health


# Versions of the protocol that are spoken, the oldest by default.
PROTOCOLS = ("2024-11-05", "2025-03-26", "2025-06-18")
PARAMETERS: dict[str, dict[str, str]] = {
    "impact": {"symbol": "string"}, "dependents": {"symbol": "string"}, "would_break": {"symbol": "string", "change": "string", "new_signature": "string"}, "changes": {"files": "array"},
    "search": {"query": "string", "limit": "integer"}, "symbols_in_file": {"file": "string"}, "audit": {"target": "string"}, "why": {"symbol": "string"},
}


def handle(tools: Callable[[], Tools], message: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to one request; notifications have none."""
    ident, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if ident is None:
        return None
    answer = {"jsonrpc": "2.0", "id": ident}
    if method == "initialize":
        asked = params.get("protocolVersion")
        return answer | {"result": {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "serverInfo": {"name": "cambium", "version": "1"}, "capabilities": {"tools": {}}}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        return answer | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, p in PARAMETERS.items()]}}
    if method != "tools/call":
        return answer | {"error": {"code": -32601, "message": f"no method {method}"}}
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in PARAMETERS or set(given) - set(PARAMETERS[name]):
        return answer | {"error": {"code": -32602, "message": f"no tool {name} with {sorted(given)}"}}
    content = lambda text, failed: answer | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    try:
        return content(json.dumps(tools().answer(name, **given), default=str), False)
    except TypeError as e:
        return answer | {"error": {"code": -32602, "message": str(e)}}
    except Exception as e:
        return content(str(e)[:2000], True)


def serve(tools: Callable[[], Tools], source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """One JSON message a line; lines that are none are dropped."""
    for line in source:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if isinstance(message, dict) and (answer := handle(tools, message)) is not None:
            sink.write(json.dumps(answer, default=str) + "\n")
            sink.flush()
