"""The code graph as relations, and the questions asked of it.

All tables carry the repo, so one job answers for every repository at once. Walks of bounded depth are joins composed
in a loop; nothing is collected. Joins choose their own strategy from sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cambium.functions.plain import blank, plain_kind, plain_path, plain_qname, plain_sha256
from cambium.functions.signature import member_names, params_of, signature_risk
from cambium.session import ship, table

KEY = ["repo", "qname"]
# Kinds of edges, how far a way of resolving is trusted, the words of subjects that give reasons, and the
# endings of source files.
DEPENDENCY_KINDS = ("calls", "inherits", "renders", "imports", "uses_type")
USAGE_KINDS = ("calls", "inherits", "renders")
SURFACE_KINDS = ("calls", "inherits", "renders", "imports")
CONFIDENCE = {"import": 0.95, "same": 0.9, "global": 0.6, "attr": 0.6, "static": 0.5}
CANDIDATE_WORDS = r"(?i)\b(fix(es|ed)?|break(s|ing|s)?|must|never|always|because|migration|renam(e|ed)|remov(e|ed)|deprecat(e|ed)|refactor(ed)?|revert(ed)?|why|behaviour change|behavior change|contract)\b"
SOURCE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java")


@dataclass(frozen=True)
class CodeGraph:
    """`symbols`, one live row a (repo, qname); `files`, the valid row of each live (repo, path); distinct `edges`;
    `unresolved` usages; `contracts` between repositories."""

    symbols: DataFrame
    files: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    contracts: DataFrame


def live_symbols(symbols: DataFrame) -> DataFrame:
    """Rows that are not removed, one a key; where several differ, each column takes its least (flags: their or)."""
    rows = symbols.where(F.col("removed_at").isNull() & F.col("repo").isNotNull()).withColumn("qname", plain_qname(F.col("qname"))).where(~blank(F.col("qname")))
    least = [F.min(c).alias(c) for c in ("name", "kind", "file_path", "signature", "line_start", "line_end", "external_hint")]
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("exported", "decorated", "external_entry")]
    return rows.groupBy(*KEY).agg(*least, *flags)


def live_files(files: DataFrame) -> DataFrame:
    """The row recorded last of each (repo, path), unless it says the file is gone."""
    rows = files.where(F.col("repo").isNotNull() & ~blank(F.col("path"))).select("repo", plain_path(F.col("path")).alias("path"), F.struct("recorded_at", F.coalesce("deleted", F.lit(False)).alias("deleted"), "module_qname", "language", plain_sha256(F.col("sha256")).alias("sha256"), "line_count").alias("r"))
    return rows.groupBy("repo", "path").agg(F.max("r").alias("r")).where("not r.deleted").select("repo", "path", "r.module_qname", "r.language", "r.sha256", "r.line_count")


def distinct_references(edges: DataFrame) -> DataFrame:
    """Edges in plain form without ids, each once; a missing method is static."""
    e = edges.select("repo", plain_qname(F.col("source_qname")).alias("source_qname"), plain_qname(F.col("target_qname")).alias("target_qname"), plain_kind(F.col("kind")).alias("kind"), F.coalesce("method", F.lit("static")).alias("method"))
    return e.where(F.col("repo").isNotNull() & ~blank(F.col("source_qname")) & ~blank(F.col("target_qname"))).distinct()


def load_graph(spark: SparkSession, folder: str) -> CodeGraph:
    u = table(spark, folder, "unresolved").select("id", "repo", plain_qname(F.col("source_qname")).alias("source_qname"), "target_text", plain_kind(F.col("kind")).alias("kind"), "bucket", "member").distinct()
    c = table(spark, folder, "contracts").select("id", "consumer_repo", plain_qname(F.col("consumer_qname")).alias("consumer_qname"), "provider_repo", plain_qname(F.col("provider_qname")).alias("provider_qname"), plain_kind(F.col("kind")).alias("kind")).distinct()
    return CodeGraph(live_symbols(table(spark, folder, "symbols")), live_files(table(spark, folder, "files")), distinct_references(table(spark, folder, "edges")), u, c)


# Scans


def symbol_rows(g: CodeGraph) -> DataFrame:
    """Symbols with the language and module of their file."""
    f = g.files.select("repo", F.col("path").alias("file_path"), "language", "module_qname")
    return g.symbols.join(f, ["repo", "file_path"])


def symbol(g: CodeGraph, repo: str, qname: str) -> DataFrame:
    return symbol_rows(g).where((F.col("repo") == repo) & (F.col("qname") == qname))


def symbols_in_file(g: CodeGraph, repo: str, path: str) -> DataFrame:
    return symbol_rows(g).where((F.col("repo") == repo) & (F.col("file_path") == path))


def search(g: CodeGraph, text: str, limit: int = 25) -> DataFrame:
    """Symbols whose name or qname holds `text`, whatever its case; `%` and `_` in it stand for any characters."""
    like = f"%{text}%"
    return g.symbols.where(F.col("name").ilike(like) | F.col("qname").ilike(like)).select("repo", "qname", "kind", "name", "file_path").orderBy("kind", "repo", "qname").limit(limit)


def edges_from(g: CodeGraph, sources: DataFrame) -> DataFrame:
    """Edges that leave any of `sources` (repo, qname)."""
    return g.edges.join(sources.select("repo", F.col("qname").alias("source_qname")).distinct(), ["repo", "source_qname"], "left_semi").select(*g.edges.columns)


def edges_to(g: CodeGraph, repo: str, qname: str, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    return g.edges.where((F.col("repo") == repo) & (F.col("target_qname") == qname) & F.col("kind").isin(*kinds))


def resolution_health(g: CodeGraph) -> DataFrame:
    return g.edges.groupBy("method").agg(F.count("*").alias("n"))


def confidence(method: Column) -> Column:
    out = F.lit(0.5)
    for m, c in CONFIDENCE.items():
        out = F.when(method == m, c).otherwise(out)
    return out


def dominant_language(files: DataFrame) -> DataFrame:
    """The language of most live files in each repo; ties go by the order below."""
    order = F.array(*[F.lit(x) for x in ("typescript", "python", "go", "rust", "java")])
    n = files.groupBy("repo", "language").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo").orderBy(F.desc("n"), F.array_position(order, F.col("language")), "language")
    return n.where("language is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("repo", "language", "n")


def unique_names(symbols: DataFrame) -> DataFrame:
    """`repo, name, qname` of the names that one symbol of the repo has; modules don't count."""
    g = symbols.where("kind <> 'module'").groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("qname").alias("qname"))
    return g.where("n = 1").select("repo", "name", "qname")


# Walks


def dependents(g: CodeGraph, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """Who depends on each of `roots` (repo, root), directly and over up to `max_depth` steps.

    One row per edge: `repo, root, qname, kind, file_path, relation, edge_kind, confidence, evidence, path`. A
    dependant that reaches the root by several edges has several rows; one that was met before and depends on another
    dependant is listed again, with the path by which it was first met. The root itself is never listed. Sources
    without a live symbol are skipped.
    """
    e = g.edges.where(F.col("kind").isin(*DEPENDENCY_KINDS)).select("repo", F.col("source_qname").alias("s"), F.col("target_qname").alias("t"), F.col("kind").alias("edge_kind"), "method")
    node = g.symbols.select("repo", F.col("qname").alias("s"), "kind", "file_path")
    e = e.join(node, ["repo", "s"])
    front = roots.select("repo", "root", F.col("root").alias("t"), F.array("root").alias("to")).distinct()
    known, visited, out = None, None, None
    for depth in range(max_depth):
        rows = front.join(e, ["repo", "t"]).where("s <> root")
        if visited is not None:
            rows = rows.join(visited, ["repo", "root", "s"], "left_anti")
        first = rows.groupBy("repo", "root", "s").agg(F.min(F.struct("t", "to")).alias("p")).select("repo", "root", "s", F.concat("p.to", F.array("s")).alias("path"))
        if known is not None:
            first = first.join(known, ["repo", "root", "s"], "left_anti").unionByName(known)
        level = rows.join(first, ["repo", "root", "s"]).select("repo", "root", F.col("s").alias("qname"), "kind", "file_path", F.lit("transitive" if depth else "direct").alias("relation"), "edge_kind", confidence(F.col("method")).alias("confidence"), F.concat("edge_kind", F.lit(" "), "t", F.lit(" ("), "method", F.lit(")")).alias("evidence"), "path")
        out = level if out is None else out.unionByName(level)
        done = front.select("repo", "root", F.col("t").alias("s"))
        visited = done if visited is None else visited.unionByName(done)
        met = rows.select("repo", "root", "s").distinct().join(visited, ["repo", "root", "s"], "left_anti")
        known = first
        front = met.join(known, ["repo", "root", "s"]).select("repo", "root", F.col("s").alias("t"), F.col("path").alias("to"))
    return out


def impact(g: CodeGraph, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """One report row a root: how many depend on it, the risk and the confidence; roots nobody depends on are included,
    `found` tells whether the root is a live symbol, `suspected` how many unresolved calls name it where nothing
    depends on it."""
    d = dependents(g, roots, max_depth).groupBy("repo", "root").agg(F.count_if(F.col("relation") == "direct").alias("direct"), F.count_if(F.col("relation") == "transitive").alias("transitive"), F.round(F.max(F.when(F.col("relation") == "direct", F.col("confidence"))), 2).alias("confidence"), F.count_distinct("file_path").alias("affected_files"))
    known = g.symbols.select("repo", F.col("qname").alias("root"), "name", "external_entry", "external_hint", F.lit(True).alias("found"))
    hints = suspects(g).groupBy("repo", "member").agg(F.count("*").alias("hints"))
    r = roots.select("repo", "root").distinct().join(known, ["repo", "root"], "left").join(d, ["repo", "root"], "left")
    r = r.join(hints.withColumnRenamed("member", "name"), ["repo", "name"], "left")
    n = F.coalesce("direct", F.lit(0))
    lonely = (n == 0) & (F.coalesce("transitive", F.lit(0)) == 0)
    suspected = F.when(lonely, F.coalesce("hints", F.lit(0))).otherwise(0)
    return r.select(
        "repo", "root", F.coalesce("found", F.lit(False)).alias("found"), n.alias("direct"), F.coalesce("transitive", F.lit(0)).alias("transitive"), F.coalesce("affected_files", F.lit(0)).alias("affected_files"),
        F.when(n > 0, "high").when(suspected > 0, "low").otherwise("none").alias("risk"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), suspected.alias("suspected"), F.coalesce("external_entry", F.lit(False)).alias("external_entry"), "external_hint",
    )


def suspects(g: CodeGraph) -> DataFrame:
    """Unresolved calls that may mean something in the repo: `repo, member, source_qname, target_text, bucket, file_path`."""
    at = g.symbols.select("repo", F.col("qname").alias("source_qname"), "file_path")
    u = g.unresolved.where((F.col("kind") == "calls") & (F.col("bucket") != "external") & ~blank(F.col("member")))
    return u.join(at, ["repo", "source_qname"], "left").select("repo", "member", "source_qname", "target_text", "bucket", "file_path")


def suspected(g: CodeGraph, repo: str, member: str, limit: int = 20) -> DataFrame:
    return suspects(g).where((F.col("repo") == repo) & (F.col("member") == member)).orderBy("source_qname", "target_text").limit(limit)


def kinds_broken_by(change: str) -> tuple[str, ...]:
    return DEPENDENCY_KINDS if change.lower() in ("removed", "renamed", "type", "members") else USAGE_KINDS


def would_break(g: CodeGraph, targets: DataFrame, change: str = "removed") -> DataFrame:
    """One report row per live symbol in `targets` (repo, qname and, for signature and members, new_signature): what
    the change breaks directly, with risk and confidence. Recursive references count."""
    change = change.lower()
    kinds = kinds_broken_by(change)
    hit = g.edges.where(F.col("kind").isin(*kinds)).join(g.symbols.select("repo", F.col("qname").alias("source_qname"), "file_path"), ["repo", "source_qname"])
    per = hit.groupBy("repo", F.col("target_qname").alias("qname")).agg(F.count("*").alias("direct"), F.round(F.max(confidence(F.col("method"))), 2).alias("confidence"), F.count_distinct("file_path").alias("files"))
    have_new = "new_signature" in targets.columns
    t = targets.select("repo", "qname", *(["new_signature"] if have_new else [])).distinct().join(g.symbols.select("repo", "qname", "signature"), KEY).join(per, KEY, "left")
    direct = F.coalesce("direct", F.lit(0))
    other = F.when(direct > 0, "high").otherwise("none")
    new = F.col("new_signature") if have_new else F.lit(None).cast("string")
    if change in ("removed", "renamed"):
        risk = F.lit("high")
    elif change in ("type", "return_type"):
        risk = F.lit("medium")
    elif change == "signature" and have_new:
        ship(targets.sparkSession)
        t = t.withColumns({"_old": params_of(F.coalesce("signature", F.lit(""))), "_new": params_of(F.coalesce("new_signature", F.lit("")))})
        risk = F.when(blank(new), other).otherwise(signature_risk(F.col("_old"), F.col("_new")))
    elif change == "members" and have_new:
        had, has = member_names(F.col("signature")), member_names(new)
        risk = F.when(new.isNull(), other).when(F.size(F.array_except(had, has)) > 0, "high").when(F.size(F.array_except(has, had)) > 0, "medium").otherwise("low")
    else:
        risk = other
    return t.select("repo", "qname", F.lit(change).alias("change"), direct.alias("direct"), F.coalesce("files", F.lit(0)).alias("files"), risk.alias("risk"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def break_rows(g: CodeGraph, targets: DataFrame, change: str = "removed") -> DataFrame:
    """The dependants behind `would_break`, one row an edge."""
    hit = g.edges.where(F.col("kind").isin(*kinds_broken_by(change))).join(targets.select("repo", F.col("qname").alias("target_qname")).distinct(), ["repo", "target_qname"])
    s = g.symbols.select("repo", F.col("qname").alias("source_qname"), F.col("kind").alias("symbol_kind"), "file_path")
    evidence = F.when(F.col("kind") == "imports", F.concat(F.lit("imports "), "target_qname", F.lit(" by name ("), "method", F.lit(")"))).otherwise(F.concat("kind", F.lit(" "), "source_qname", F.lit(" ("), "method", F.lit(" resolution)")))
    return hit.join(s, ["repo", "source_qname"]).select("repo", F.col("target_qname").alias("root"), F.col("source_qname").alias("qname"), F.col("symbol_kind").alias("kind"), "file_path", F.col("kind").alias("edge_kind"), F.round(confidence(F.col("method")), 2).alias("confidence"), evidence.alias("evidence"))


def change_surface(g: CodeGraph, changed: DataFrame) -> DataFrame:
    """What a set of changed files (repo, path, gone) reaches outside itself: `repo, qname, kind, file_path, relation,
    edge_kind`. Dependants of exported symbols of those files, and, for files that are gone, whoever imports their
    module. One row per relation and dependant (the least edge kind)."""
    ch = changed.where(F.col("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SOURCE_SUFFIXES) + ")$")).select("repo", F.col("path").alias("file_path"), "gone").distinct()
    e = g.edges.where(F.col("kind").isin(*SURFACE_KINDS))
    exported = g.symbols.where("exported").join(ch.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi").select("repo", F.col("qname").alias("target_qname"))
    by_symbol = e.join(exported, ["repo", "target_qname"], "left_semi").select("repo", "source_qname", "kind")
    modules = ch.where("gone").join(g.files.select("repo", F.col("path").alias("file_path"), "module_qname"), ["repo", "file_path"], "left")
    modules = modules.select("repo", F.coalesce("module_qname", F.regexp_replace(F.regexp_replace("file_path", r"\.\w+$", ""), "/", ".")).alias("target_qname")).distinct()
    by_module = e.where("kind = 'imports'").join(modules, ["repo", "target_qname"], "left_semi").select("repo", "source_qname", "kind")
    dep = g.symbols.select("repo", F.col("qname").alias("source_qname"), F.col("kind").alias("symbol_kind"), "file_path")
    rows = by_symbol.unionByName(by_module).distinct().join(dep, ["repo", "source_qname"]).join(ch.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
    relation = F.when(F.col("kind") == "imports", "file-level").otherwise("direct")
    return rows.groupBy("repo", F.col("source_qname").alias("qname"), relation.alias("relation")).agg(F.min("symbol_kind").alias("kind"), F.min("file_path").alias("file_path"), F.min("kind").alias("edge_kind"))


def audit(g: CodeGraph, roots: DataFrame) -> DataFrame:
    """Files that depend on each root within two steps: `repo, root, file, relations, confidence`."""
    d = dependents(g, roots)
    return d.groupBy("repo", "root", F.col("file_path").alias("file")).agg(F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"), F.round(F.max("confidence"), 2).alias("confidence"))


def audit_files(g: CodeGraph, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Brief of each file in `targets` (repo, path): its report row, and the files that depend on it.

    Symbols other than modules are audited, or all where a file has nothing else. The report takes risk and confidence
    of the symbol with the greatest confidence above 0, named `worst` (ties: the least name); a file without dependants
    stays at low and names none."""
    inside = g.symbols.join(targets.select("repo", F.col("path").alias("file_path")).distinct(), ["repo", "file_path"])
    only = F.min(F.col("kind") == "module").over(Window.partitionBy("repo", "file_path"))
    picked = inside.withColumn("only", only).where("kind <> 'module' or only").select("repo", "qname", F.col("file_path").alias("path"))
    wb = would_break(g, picked.select(*KEY)).join(picked, KEY)
    report = wb.groupBy("repo", "path").agg(F.count("*").alias("symbols_audited"), F.min(F.struct(-F.col("confidence"), "qname")).alias("w"), F.max("confidence").alias("confidence"))
    report = report.select("repo", "path", "symbols_audited", F.when(F.col("confidence") > 0, "high").otherwise("low").alias("risk"), "confidence", F.when(F.col("confidence") > 0, F.col("w.qname")).alias("worst"))
    d = dependents(g, picked.select("repo", F.col("qname").alias("root"))).drop("path").join(picked.select("repo", F.col("qname").alias("root"), "path"), ["repo", "root"])
    files = d.groupBy("repo", "path", F.col("file_path").alias("file")).agg(F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"), F.round(F.max("confidence"), 2).alias("confidence"))
    return report, files


def read_set(files: DataFrame, by: list[str], limit: int = 15) -> DataFrame:
    """The first files by path to read before a change."""
    w = Window.partitionBy(*by).orderBy("file")
    return files.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(*by, "file", "n")


def candidates(facts: DataFrame, subject: str = "subject") -> DataFrame:
    """Facts whose subject suggests a reason for the code to be as it is."""
    return facts.where(F.col(subject).rlike(CANDIDATE_WORDS))


def contract_consumers(g: CodeGraph, across_only: bool = False) -> DataFrame:
    """Declared consumers of providers that exist, with the consumer's file: `id, provider_repo, provider_qname,
    consumer_repo, consumer_qname, kind, file_path`. Consumers without a live symbol keep a null file, or are left out
    with `across_only`, as are those within the provider's own repo."""
    c = g.contracts.where(~blank(F.col("consumer_qname")))
    p = g.symbols.select(F.col("repo").alias("provider_repo"), F.col("qname").alias("provider_qname"))
    s = g.symbols.select(F.col("repo").alias("consumer_repo"), F.col("qname").alias("consumer_qname"), "file_path")
    out = c.join(p, ["provider_repo", "provider_qname"], "left_semi").join(s, ["consumer_repo", "consumer_qname"], "left")
    if across_only:
        out = out.where(F.col("file_path").isNotNull() & (F.col("consumer_repo") != F.col("provider_repo")))
    return out.select("id", "provider_repo", "provider_qname", "consumer_repo", "consumer_qname", "kind", "file_path")


# Upkeep


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """`repo, path, change` between two listings (repo, path, sha256, module_qname): added, changed or removed."""
    o = old.select("repo", "path", F.col("sha256").alias("o_sha"), F.col("module_qname").alias("o_module"), F.lit(True).alias("o"))
    n = new.select("repo", "path", F.col("sha256").alias("n_sha"), F.col("module_qname").alias("n_module"), F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o_sha").eqNullSafe(F.col("n_sha")) | ~F.col("o_module").eqNullSafe(F.col("n_module")), "changed")
    return o.join(n, ["repo", "path"], "full").select("repo", "path", change.alias("change")).where("change is not null")


def replace_of_files(current: DataFrame, replaced: DataFrame, fresh: DataFrame, path: str = "file_path", unique: list[str] | None = None) -> DataFrame:
    """`current` without the rows of the `replaced` files (repo, path), plus `fresh` rows. With `unique`, a fresh row gives
    way to a kept one of the same key, so the file that came first keeps a name."""
    gone = replaced.select("repo", F.col("path").alias(path)).distinct()
    kept = current.join(gone, ["repo", path], "left_anti")
    if unique:
        fresh = fresh.join(kept.select(*unique), unique, "left_anti").dropDuplicates(unique)
    return kept.unionByName(fresh.select(*current.columns))


def edges_replaced(g: CodeGraph, replaced: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after the outgoing ones of the `replaced` files gave way to `fresh` ones; each edge once."""
    inside = g.symbols.join(replaced.select("repo", F.col("path").alias("file_path")).distinct(), ["repo", "file_path"], "left_semi").select("repo", F.col("qname").alias("source_qname"))
    return g.edges.join(inside, ["repo", "source_qname"], "left_anti").unionByName(fresh.select(*g.edges.columns)).distinct()


def mark_deleted(files: DataFrame, listed: DataFrame) -> DataFrame:
    """`files` as last stored, with those `listed` (repo, path) no longer names marked `deleted`; their rows stay."""
    now = listed.select("repo", "path", F.lit(True).alias("_there")).distinct()
    return files.join(now, ["repo", "path"], "left").withColumn("deleted", F.col("_there").isNull()).drop("_there")


def without_files(g: CodeGraph, removed: DataFrame) -> CodeGraph:
    """The graph after files (repo, path) are gone: their symbols go, and edges at either end of those."""
    files = g.files.join(removed.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    symbols = g.symbols.join(removed.select("repo", F.col("path").alias("file_path")).distinct(), ["repo", "file_path"], "left_anti").select(*g.symbols.columns)
    ids = symbols.select("repo", "qname")
    edges = g.edges.join(ids.withColumnRenamed("qname", "source_qname"), ["repo", "source_qname"], "left_semi").join(ids.withColumnRenamed("qname", "target_qname"), ["repo", "target_qname"], "left_semi")
    return CodeGraph(symbols, files, edges.select(*g.edges.columns), g.unresolved, g.contracts)


def reconcile_candidates(g: CodeGraph, changed: DataFrame) -> DataFrame:
    """Unchanged files (repo, path) whose edges may have to be resolved anew after `changed` (repo, path): those with
    globally resolved edges, with unresolved usages, and importers of changed modules."""
    at = g.symbols.select("repo", F.col("qname").alias("source_qname"), F.col("file_path").alias("path"))
    loose = g.edges.where("method = 'global'").join(at, ["repo", "source_qname"]).select("repo", "path")
    open_ = g.unresolved.join(at, ["repo", "source_qname"]).select("repo", "path")
    modules = g.files.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", F.col("module_qname").alias("target_qname")).distinct()
    importers = g.edges.where("kind = 'imports'").join(modules, ["repo", "target_qname"], "left_semi").join(at, ["repo", "source_qname"]).select("repo", "path")
    rows = loose.unionByName(open_).unionByName(importers).distinct()
    return rows.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_anti").join(g.files.select("repo", "path"), ["repo", "path"], "left_semi")


# Evaluation

# Kinds of symbols that can be mutated, and the mutations of each.
MUTABLE_KINDS = ("function", "constant", "class", "interface", "type_alias", "enum", "method")
MUTATIONS = {"remove-declaration": MUTABLE_KINDS, "rename": MUTABLE_KINDS, "add-required-param": ("function", "method", "constant")}


def mutation_candidates(g: CodeGraph, min_cross: int = 0) -> DataFrame:
    """Exported symbols that can be mutated, with `cross`, the number of edges from other files."""
    at = g.symbols.select("repo", F.col("qname").alias("source_qname"), F.col("file_path").alias("from_file"))
    to = g.symbols.select("repo", F.col("qname").alias("target_qname"), "file_path")
    cross = g.edges.where(F.col("kind").isin(*SURFACE_KINDS)).join(to, ["repo", "target_qname"]).join(at, ["repo", "source_qname"]).where("from_file <> file_path").groupBy("repo", F.col("target_qname").alias("qname")).agg(F.count("*").alias("cross"))
    rows = g.symbols.where(F.col("kind").isin(*MUTABLE_KINDS) & F.col("exported")).join(cross, KEY, "left").withColumn("cross", F.coalesce("cross", F.lit(0)))
    return rows.where(F.col("cross") >= min_cross).select("repo", "qname", "kind", "file_path", "cross")


def predicted_files(g: CodeGraph, cases: DataFrame) -> DataFrame:
    """`repo, qname, mutation, file`: the files that a mutation of a symbol is expected to break, besides its own."""
    own = g.symbols.select("repo", "qname", F.col("file_path").alias("own"))
    at = g.symbols.select("repo", F.col("qname").alias("source_qname"), F.col("file_path").alias("file"))
    hit = cases.join(own, KEY).join(g.edges.withColumnRenamed("target_qname", "qname").withColumnRenamed("kind", "edge_kind"), KEY)
    hit = hit.where(F.col("edge_kind").isin(*USAGE_KINDS) | (F.col("edge_kind") == "imports") & (F.col("mutation") != "add-required-param"))
    return hit.join(at, ["repo", "source_qname"]).where("file <> own").select("repo", "qname", "mutation", "file").distinct()


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall of predicted (repo, qname, mutation, file) rows, in all (mutation null) and per
    mutation; a ratio without cases is null."""
    key = ["repo", "qname", "mutation", "file"]
    both = predicted.select(*key).distinct().withColumn("p", F.lit(1)).join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "full")
    out = both.rollup("mutation").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return out.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 3), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 3)})
