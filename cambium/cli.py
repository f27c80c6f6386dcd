"""Command line."""

from __future__ import annotations

import argparse
import json
import os
from typing import Any

from cambium.operators.indexing import index_repo, joined_graphs, stored_graph
from cambium.server import Tools, serve
from cambium.session import build_session, shared_folder
from cambium.sources.store import Registry, SnapshotStore, slug
from cambium.streaming.watch import cycle, watch


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cambium")
    p.add_argument("--home")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options: dict[str, Any]) -> None:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for o, kw in options.items():
            s.add_argument("--" + o.replace("_", "-"), **kw)
        s.add_argument("--repo", default=".")
        s.add_argument("--graph")

    verb("index", force={"action": "store_true"}, all_languages={"action": "store_true"})
    for name in ("impact", "dependents", "why"):
        verb(name, "symbol")
    verb("would-break", "symbol", change={"default": "removed"}, new_signature={})
    verb("changes")
    verb("search", "query", limit={"type": int, "default": 25})
    verb("symbols-in-file", "file")
    verb("audit", "target")
    verb("serve")
    verb("watch", once={"action": "store_true"}, interval={"type": float, "default": 1.0})
    for name, args in {"graph-create": ["name"], "graph-list": [], "graph-rm": ["name"], "graph-add-repo": ["name"], "graph-rm-repo": ["name"], "graph-inspect": ["name"], "graph-refresh": ["name"], "contract-add": ["name", "consumer_repo", "consumer_qname", "provider_repo", "provider_qname"], "contract-list": ["name"], "contract-rm": ["name", "id"]}.items():
        verb(name, *args)
    for name, args in {"workspace-add": [], "workspace-list": [], "workspace-rm": ["slug"], "workspace-search": ["query"], "workspace-impact": ["symbol"], "workspace-would-break": ["symbol"]}.items():
        verb(name, *args)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = build_session()
    registry = Registry(a.home)
    root = os.path.abspath(a.repo)
    name = slug(os.path.basename(root))

    def store_of(repo_root: str) -> SnapshotStore:
        base = f"file://{registry.folder.resolve()}" if spark.sparkContext.master.startswith("local") else shared_folder(spark)
        return SnapshotStore(spark, f"{base}/stores/{slug(repo_root)}")

    def tools() -> Tools:
        if a.verb.startswith("workspace"):
            members = {n: r["root"] for n, r in registry.workspace().items()}
        elif a.graph:
            members = {n: r["root"] for n, r in registry.repos(a.graph).items()}
        else:
            members = {name: root}
        graphs = []
        for n, r in members.items():
            s = store_of(r)
            if not s.exists():
                index_repo(spark, r, s, n)
            graphs.append(stored_graph(s))
        if not graphs:
            raise SystemExit("no repositories")
        contracts = registry.contracts_frame(spark, a.graph) if a.graph else graphs[0].contracts
        return Tools(spark, joined_graphs(graphs, contracts), members)

    v = a.verb
    out: Any = None
    try:
        if v == "index":
            out = index_repo(spark, root, store_of(root), name, a.force, not a.all_languages)
        elif v == "watch":
            watch(spark, root, store_of(root), name, a.interval, a.once, lambda r: print(json.dumps(r, default=str)))
        elif v == "serve":
            serve(tools)
        elif v in ("impact", "dependents", "why", "workspace-impact"):
            out = tools().answer(v.removeprefix("workspace-"), symbol=a.symbol)
        elif v == "would-break":
            out = tools().answer("would_break", symbol=a.symbol, change=a.change, new_signature=a.new_signature)
        elif v == "workspace-would-break":
            out = tools().answer("would_break", symbol=a.symbol)
        elif v == "changes":
            out = tools().answer("changes")
        elif v in ("search", "workspace-search"):
            out = tools().answer("search", query=a.query, limit=getattr(a, "limit", 25))
        elif v == "symbols-in-file":
            out = tools().answer("symbols_in_file", file=a.file)
        elif v == "audit":
            out = tools().answer("audit", target=a.target)
        elif v == "graph-create":
            registry.create(a.name)
        elif v == "graph-list":
            out = registry.graphs()
        elif v == "graph-rm":
            out = registry.delete(a.name)
        elif v == "graph-add-repo":
            registry.add_repo(a.name, name, root, store_of(root).folder)
        elif v == "graph-rm-repo":
            out = registry.remove_repo(a.name, name)
        elif v == "graph-inspect":
            out = registry.inspect(a.name)
        elif v == "graph-refresh":
            out = {n: cycle(spark, r["root"], store_of(r["root"]), n) for n, r in registry.repos(a.name).items()}
        elif v == "contract-add":
            a.graph = a.name
            out = registry.add_contract(a.name, tools().graph.symbols, a.consumer_repo, a.consumer_qname, a.provider_repo, a.provider_qname)
        elif v == "contract-list":
            out = registry.contracts(a.name)
        elif v == "contract-rm":
            out = registry.remove_contract(a.name, int(a.id))
        elif v == "workspace-add":
            out = registry.workspace_add(root, store_of(root).folder)
        elif v == "workspace-list":
            out = registry.workspace()
        elif v == "workspace-rm":
            out = registry.workspace_remove(a.slug)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}")
        return 1
    if out is not None:
        print(json.dumps(out, indent=1, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
