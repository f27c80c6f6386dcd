"""Versioned tables with atomic swap, and the small registries of repositories, graphs and contracts.

A version is a folder of parquet tables. Readers follow a pointer file that is replaced by one rename, so they see
the old version or the new one, never a mixture, and a writer that dies leaves the old one in place.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.session import delete
from cambium.sources.pointer import Pointer

NAME = re.compile(r"[A-Za-z0-9_.-]{1,120}")


class SnapshotStore:
    """Tables below `folder`, which all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> dict:
        return Pointer(self.spark, self.folder).read() or {"version": None, "tables": [], "meta": {}}

    def _point(self, state: dict) -> None:
        Pointer(self.spark, self.folder).swap(state)

    def exists(self) -> bool:
        return self._pointer()["version"] is not None

    def read(self, name: str) -> DataFrame:
        state = self._pointer()
        if name not in state["tables"]:
            raise FileNotFoundError(f"{name} in {self.folder}; index the repository first")
        return self.spark.read.parquet(f"{self.folder}/{state['version']}/{name}")

    def write(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None, keep: int = 2) -> None:
        """All tables of a new version, then the pointer; versions before the last `keep` are deleted."""
        state, version = self._pointer(), f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{version}/{name}")
        past = [*state.get("past", []), *([state["version"]] if state["version"] else [])]
        kept = past[-keep + 1 :] if keep > 1 else []
        self._point({"version": version, "past": kept, "tables": sorted(tables), "meta": state["meta"] | (meta or {})})
        for old in past[: len(past) - len(kept)]:  # only now: until the swap, readers follow them
            delete(self.spark, f"{self.folder}/{old}")

    def get_meta(self, key: str) -> str | None:
        return self._pointer()["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        state = self._pointer()
        self._point(state | {"meta": state["meta"] | {key: value}})


def slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", text.strip()).strip("-") or "repo"


class Registry:
    """Named graphs of repositories with contracts between them, and a workspace; one small JSON file each, below a local
    folder. Tables of repositories live in `SnapshotStore`s."""

    def __init__(self, folder: str | None = None):
        self.folder = Path(folder or os.environ.get("CAMBIUM_HOME") or Path.cwd() / ".cambium")

    def _path(self, name: str) -> Path:
        if not NAME.fullmatch(name):
            raise ValueError(f"not a graph name: {name!r}")
        return self.folder / "graphs" / f"{name}.json"

    @staticmethod
    def _save(path: Path, value: dict) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        fresh = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        fresh.write_text(json.dumps(value, indent=1))
        fresh.replace(path)

    def _load(self, name: str) -> dict:
        path = self._path(name)
        if not path.exists():
            raise ValueError(f"no graph {name!r}")
        return json.loads(path.read_text())

    def create(self, name: str) -> None:
        if self.exists(name):
            raise ValueError(f"graph {name!r} exists")
        self._save(self._path(name), {"repos": {}, "contracts": [], "next": 1})

    def exists(self, name: str) -> bool:
        return self._path(name).exists()

    def delete(self, name: str) -> bool:
        found = self.exists(name)
        self._path(name).unlink(missing_ok=True)
        return found

    def graphs(self) -> list[str]:
        return sorted(p.stem for p in (self.folder / "graphs").glob("*.json"))

    def add_repo(self, name: str, repo: str, root: str, store: str) -> None:
        g = self._load(name)
        g["repos"][repo] = {"root": root, "store": store}
        self._save(self._path(name), g)

    def remove_repo(self, name: str, repo: str) -> bool:
        g = self._load(name)
        found = g["repos"].pop(repo, None) is not None
        self._save(self._path(name), g)
        return found

    def repos(self, name: str) -> dict[str, dict[str, str]]:
        return self._load(name)["repos"]

    def inspect(self, name: str) -> dict:
        g = self._load(name)
        return {"graph": name, "repos": sorted(g["repos"]), "contracts": len(g["contracts"])}

    def add_contract(self, name: str, symbols: DataFrame, consumer_repo: str, consumer_qname: str, provider_repo: str, provider_qname: str, kind: str = "calls") -> int:
        """Both ends must be symbols (repo, qname) when the contract is declared."""
        ends = {(consumer_repo, consumer_qname), (provider_repo, provider_qname)}
        is_end = F.lit(False)
        for repo, qname in ends:
            is_end = is_end | (F.col("repo") == repo) & (F.col("qname") == qname)
        known = {(r[0], r[1]) for r in symbols.where(is_end).select("repo", "qname").distinct().collect()}
        if missing := sorted(ends - known):
            raise ValueError(f"no such symbol: {missing}")
        g = self._load(name)
        row = {"id": g["next"], "consumer_repo": consumer_repo, "consumer_qname": consumer_qname, "provider_repo": provider_repo, "provider_qname": provider_qname, "kind": kind}
        g["contracts"].append(row)
        g["next"] += 1
        self._save(self._path(name), g)
        return row["id"]

    def contracts(self, name: str, provider_repo: str | None = None, provider_qname: str | None = None) -> list[dict]:
        rows = sorted(self._load(name)["contracts"], key=lambda r: r["id"])
        return [r for r in rows if provider_repo in (None, r["provider_repo"]) and provider_qname in (None, r["provider_qname"])]

    def remove_contract(self, name: str, contract_id: int) -> bool:
        g = self._load(name)
        left = [r for r in g["contracts"] if r["id"] != contract_id]
        found = len(left) < len(g["contracts"])
        self._save(self._path(name), g | {"contracts": left})
        return found

    def contracts_frame(self, spark: SparkSession, name: str) -> DataFrame:
        rows = [(r["id"], r["consumer_repo"], r["consumer_qname"], r["provider_repo"], r["provider_qname"], r["kind"]) for r in self.contracts(name)]
        return spark.createDataFrame(rows, "id bigint, consumer_repo string, consumer_qname string, provider_repo string, provider_qname string, kind string")

    # The workspace: repositories without contracts

    def _workspace(self) -> dict:
        path = self.folder / "workspace.json"
        return json.loads(path.read_text()) if path.exists() else {"repos": {}}

    def workspace_add(self, root: str, store: str) -> str:
        """The slug of the repository; a taken one gets a number."""
        w = self._workspace()
        for known, r in w["repos"].items():
            if r["root"] == root:
                return known
        base = slug(Path(root).name)
        name, i = base, 1
        while name in w["repos"]:
            name, i = f"{base}-{i}", i + 1
        w["repos"][name] = {"root": root, "store": store}
        self._save(self.folder / "workspace.json", w)
        return name

    def workspace_remove(self, name: str) -> bool:
        w = self._workspace()
        found = w["repos"].pop(name, None) is not None
        self._save(self.folder / "workspace.json", w)
        return found

    def workspace(self) -> dict[str, dict[str, str]]:
        return self._workspace()["repos"]
