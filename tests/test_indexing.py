import json
import os
import subprocess

from cambium import server
from cambium.operators.indexing import index_repo, stored_graph
from cambium.sources import git
from cambium.sources.repository import list_sources
from cambium.sources.store import Registry, SnapshotStore
from cambium.streaming.watch import cycle


def tree(root, files):
    for p, t in files.items():
        os.makedirs(os.path.dirname(root / p), exist_ok=True)
        (root / p).write_text(t)


def test_index_increment_and_ask(spark, tmp_path):
    root = tmp_path / "repo"
    tree(root, {"app/__init__.py": "", "app/util.py": "def helper(v):\n    return v\n", "app/main.py": "from app.util import helper\n\ndef run():\n    return helper(1)\n", "node_modules/x/y.py": "def no(): pass\n", ".hid/z.py": "q = 1\n", "big.py": "#" * 2_000_001})
    os.symlink(root / "app/util.py", root / "app/link.py")
    assert sorted(r.path for r in list_sources(spark, str(root), "r").collect()) == ["app/__init__.py", "app/main.py", "app/util.py"]
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    first = index_repo(spark, str(root), store, "r")
    assert (first["files"], first["changed"], first["edges_by_method"].get("import")) == (3, 3, 2)
    again = index_repo(spark, str(root), store, "r")
    assert again["changed"] == 0 and again["edges"] == first["edges"]
    tree(root, {"app/util.py": "def other(v):\n    return v\n"})
    os.remove(root / "app/__init__.py")
    third = cycle(spark, str(root), store, "r")
    assert (third["changed"], third["removed"]) == (1, 1)
    assert third["language"] == "python" and third["parse_error_files"] == [] and third["reconciled"] == 1 and third["changed_files"] == ["app/util.py"]
    assert {r.path for r in store.read("files").where("deleted").collect()} == {"app/__init__.py"} and store.read("star_exports").count() == 0
    g = stored_graph(store)
    assert {r.qname for r in g.symbols.collect()} == {"app.util", "app.util.other", "app.main", "app.main.run"}
    assert not g.edges.where("target_qname = 'app.util.helper'").count()
    tools = server.Tools(spark, g, {"r": str(root)})
    ask = lambda method, **p: server.handle(lambda: tools, {"id": 1, "method": method, "params": p})
    assert len(ask("tools/list")["result"]["tools"]) == 8
    assert json.loads(ask("tools/call", name="search", arguments={"query": "OTHER"})["result"]["content"][0]["text"])["results"][0]["qname"] == "app.util.other"
    assert json.loads(ask("tools/call", name="audit", arguments={"target": "app/util.py"})["result"]["content"][0]["text"])["kind"] == "file"
    said = lambda name, **p: json.loads(ask("tools/call", name=name, arguments=p)["result"]["content"][0]["text"])
    got = said("impact", symbol="app.util.other")["repos"][0]
    assert got["repo"] == "r" and set(got["report"]) == {"symbol", "change", "risk", "confidence", "notes", "direct", "transitive", "affected_files", "suspected", "external_entry", "external_hint"}
    assert said("impact", symbol="no.such") == {"symbol": "no.such", "risk": "none", "notes": ["symbol not found"], "repos": []}
    brief = said("audit", target="app.main.run")
    assert brief["root_symbol"] == "app.main.run" and brief["read_set"] == ["app/main.py"] and brief["affected_files_count"] == 0 and brief["risk"] == "high"
    assert said("audit", target="no/such.py")["notes"] == ["file not indexed"]
    changes = said("changes", files=["app/util.py"])
    assert changes["changed_files"] == ["app/util.py"] and set(changes) == {"changed_files", "affected", "affected_files"}
    few = server.Tools(spark, g, {"r": str(root)}, rows=1).answer("symbols_in_file", file="app/main.py")
    assert len(few["symbols"]) == 1 and few["truncated"] == {"symbols": 2}
    assert ask("initialize", protocolVersion="2025-03-26")["result"]["protocolVersion"] == "2025-03-26" and ask("initialize", protocolVersion="x")["result"]["protocolVersion"] == "2024-11-05"
    broken = server.handle(lambda: 1 / 0, {"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "x"}}})
    assert broken["result"]["isError"] and "division" in broken["result"]["content"][0]["text"]
    assert ask("nope")["error"]["code"] == -32601 and ask("tools/call", name="x")["error"]["code"] == -32602
    assert server.handle(lambda: tools, {"method": "notifications/initialized"}) is None


def test_git_facts(spark, tmp_path):
    assert git.changed_files(str(tmp_path)) == []
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "fixed because of load")
    (tmp_path / "b.py").write_text("y = 1\n")
    assert git.changed_files(str(tmp_path)) == ["b.py"] and git.changed_files(str(tmp_path), untracked=False) == []
    run("mv", "a.py", "c d.py")
    assert git.changed_files(str(tmp_path)) == ["a.py", "b.py", "c d.py"]
    run("mv", "c d.py", "a.py")
    assert [r.subject for r in git.history(spark, str(tmp_path), "a.py", 1, 1).collect()] == ["fixed because of load"]


def test_registry(spark, tmp_path):
    r = Registry(str(tmp_path))
    r.create("g")
    r.add_repo("g", "a", "/a", "s")
    symbols = spark.createDataFrame([("a", "m.f"), ("b", "m.g")], "repo string, qname string")
    assert r.add_contract("g", symbols, "b", "m.g", "a", "m.f") == 1
    for bad in (lambda: r.add_contract("g", symbols, "b", "no", "a", "m.f"), lambda: r.create("../x"), lambda: r.create("g"), lambda: r.inspect("none")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
    assert r.contracts("g", "a", "m.f")[0]["consumer_qname"] == "m.g" and r.contracts_frame(spark, "g").count() == 1
    assert r.remove_contract("g", 1) and not r.remove_contract("g", 1) and r.remove_repo("g", "a") and r.graphs() == ["g"] and r.delete("g")
    assert r.workspace_add("/x/app", "s") == "app" and r.workspace_add("/y/app", "s") == "app-1" and r.workspace_add("/x/app", "s") == "app"
    assert r.workspace_remove("app") and list(r.workspace()) == ["app-1"]
