"""From a source tree to a stored code graph, incrementally."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import extract as X
from cambium.operators import graph as G
from cambium.session import cut, scope
from cambium.sources.repository import list_sources
from cambium.sources.store import SnapshotStore

ENGINE_VERSION = "2"  # a change of what extraction yields; another stored one means a full run


def index_repo(spark: SparkSession, root: str, store: SnapshotStore, repo: str, force: bool = False, dominant_only: bool = True) -> dict:
    """Brings `store` up to date with the tree and returns a summary.

    Only files whose digest or module changed are parsed; records of the others are kept. References are resolved anew over
    the whole repository, so the graph never depends on the order of runs. With `dominant_only` files of other
    languages than the most frequent are left out."""
    began = time.time()
    with scope(spark):
        return _index(spark, root, store, repo, force, dominant_only) | {"duration_s": round(time.time() - began, 3)}


def _index(spark: SparkSession, root: str, store: SnapshotStore, repo: str, force: bool, dominant_only: bool) -> dict:
    listed = cut(list_sources(spark, root, repo), "listing")
    languages = [r["language"] for r in G.dominant_language(listed).collect()]
    if dominant_only:
        listed = listed.where(F.col("language").isin(languages)) if languages else listed.where("false")
    roots = cut(X.import_roots(listed), "roots")
    layout = json.dumps([r["root"] for r in roots.collect()])
    listed = listed.withColumn("module_qname", F.lit(None).cast("string"))
    # another import root gives every module another name
    fresh = force or not store.exists() or store.get_meta("engine_version") != ENGINE_VERSION or store.get_meta("import_root") != layout
    stored = None if fresh else store.read("files")
    if fresh:
        changed, removed = listed.select("repo", "path"), listed.select("repo", "path").where("false")
    else:
        diff = cut(G.snapshot_diff(stored.where("not deleted").withColumn("module_qname", F.lit(None).cast("string")), listed), "diff")
        changed, removed = diff.where("change <> 'removed'").select("repo", "path"), diff.where("change = 'removed'").select("repo", "path")
    records = X.extract(listed.join(changed, ["repo", "path"], "left_semi"), roots).records
    if not fresh:
        kept = store.read("records").join(changed.unionByName(removed), ["repo", "path"], "left_anti")
        records = cut(kept.unionByName(records), "records")
    x = X.Extracted(records)
    found = X.resolution(x)
    edges, unresolved = cut(found.edges, "edges"), cut(found.unresolved, "unresolved")
    # two files that claim one name: the first path keeps it
    symbols = x.symbols.withColumnRenamed("path", "file_path").groupBy("repo", "qname").agg(*[F.min_by(c, "file_path").alias(c) for c in ("name", "kind", "signature", "line_start", "line_end", "external_hint", "exported", "decorated", "external_entry")], F.min("file_path").alias("file_path"))
    symbols = cut(symbols, "symbols")
    modules = x.symbols.where("kind = 'module'").select("repo", "path", F.col("qname").alias("module_qname")).distinct()
    files = listed.drop("text", "module_qname").join(modules, ["repo", "path"], "left").withColumn("deleted", F.lit(False))
    if not fresh:  # files that are gone stay known, marked as such
        files = files.unionByName(G.mark_deleted(stored, listed).where("deleted").select(*files.columns))
    store.write(
        {"files": files, "records": records, "symbols": symbols, "edges": edges.withColumnsRenamed({"source": "source_qname", "target": "target_qname"}), "unresolved": unresolved.withColumnRenamed("source", "source_qname"), "star_exports": found.stars},
        {"engine_version": ENGINE_VERSION, "repo_root": root, "import_root": layout},
    )
    changed_files = [r["path"] for r in changed.orderBy("path").collect()]
    by_method = {r["method"]: r["n"] for r in edges.groupBy("method").agg(F.count("*").alias("n")).collect()}
    buckets = {r["bucket"]: r["n"] for r in unresolved.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    n_files = listed.count()
    reconciled = 0 if fresh or not (changed_files or removed.count()) else G.reconcile_candidates(stored_graph(store), changed).count()
    return {
        "repo": repo, "language": languages[0] if dominant_only and languages else None, "files": n_files, "changed": len(changed_files), "changed_files": changed_files, "removed": removed.count(), "untouched": n_files - len(changed_files), "reconciled": reconciled, "symbols": symbols.count(),
        "edges": sum(by_method.values()), "edges_by_method": by_method, "unresolved": sum(buckets.values()), **{f"unresolved_{b}": buckets.get(b, 0) for b in ("external", "in_repo", "dynamic")}, "parse_error_files": sorted(r["path"] for r in x.errors.select("path").distinct().collect()),
    }


def stored_graph(store: SnapshotStore, contracts: DataFrame | None = None) -> G.CodeGraph:
    """The graph in a store, in the shape the questions take."""
    spark = store.spark
    contracts = contracts if contracts is not None else spark.createDataFrame([], "id bigint, consumer_repo string, consumer_qname string, provider_repo string, provider_qname string, kind string")
    u = store.read("unresolved").withColumn("id", F.lit(None).cast("bigint"))
    return G.CodeGraph(store.read("symbols"), store.read("files").where("not deleted"), store.read("edges"), u, contracts)


def joined_graphs(graphs: list[G.CodeGraph], contracts: DataFrame) -> G.CodeGraph:
    """Several repositories as one graph; the repo column keeps them apart."""
    parts = {n: [getattr(g, n) for g in graphs] for n in ("symbols", "files", "edges", "unresolved")}
    out = {}
    for n, frames in parts.items():
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        out[n] = df
    return G.CodeGraph(**out, contracts=contracts)
