"""Queries over the code graph, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions.plain import plain_path, plain_qname
from cambium.operators import graph as G
from cambium.operators import extract, incremental, resolve
from cambium.plans.problems import _P1, sql_kind, sql_path, sql_qname, sql_sha
from cambium.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_GRAPH = f"""
sym as (
  select repo, {sql_qname('qname')} qname, min(name) as name, min(kind) kind, min(file_path) file_path, min(signature) signature, min(line_start) line_start, min(line_end) line_end,
    min(external_hint) external_hint, bool_or(coalesce(exported, false)) exported, bool_or(coalesce(external_entry, false)) external_entry
  from symbols where removed_at is null group by 1, 2),
fil as (
  select repo, path, module_qname, language, sha256, line_count from (
    select repo, {sql_path('path')} path, module_qname, language, {sql_sha('sha256')} sha256, line_count, deleted,
      row_number() over (partition by repo, {sql_path('path')} order by recorded_at desc, deleted desc, module_qname desc nulls last, language desc nulls last, {sql_sha('sha256')} desc nulls last, line_count desc nulls last) rn from files)
  where rn = 1 and not deleted),
edg as (select distinct repo, {sql_qname('source_qname')} source_qname, {sql_qname('target_qname')} target_qname, {sql_kind('kind')} kind, coalesce(method, 'static') as method from edges),
unr as (select distinct id, repo, {sql_qname('source_qname')} source_qname, target_text, {sql_kind('kind')} kind, bucket, member from unresolved),
con as (select distinct id, consumer_repo, {sql_qname('consumer_qname')} consumer_qname, provider_repo, {sql_qname('provider_qname')} provider_qname, {sql_kind('kind')} kind from contracts),
conf as (select * from (values ('import', 0.95::double), ('same', 0.9), ('global', 0.6), ('attr', 0.6), ('static', 0.5)) t(method, c))
"""
_WITH = "with " + _GRAPH
_CONF = "coalesce((select max(c) from conf where conf.method = {m}.method), 0.5::double)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


ROOT = ("atlas-mono", "core.db.session_scope")
FILE = ("atlas-mono", "core/db.py")


def _root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([ROOT], "repo string, root string")


def _all(g: G.CodeGraph) -> DataFrame:
    return g.symbols.select("repo", F.col("qname").alias("root"))


# Scans


@query(_WITH + "select s.repo, s.qname, s.kind, s.file_path, f.language, f.module_qname from sym s join fil f on f.repo = s.repo and f.path = s.file_path")
def symbol_rows(spark, d):
    return G.symbol_rows(G.load_graph(spark, d)).select("repo", "qname", "kind", "file_path", "language", "module_qname")


@query(_WITH + f"select s.repo, s.qname, s.kind, s.signature, f.language from sym s join fil f on f.repo = s.repo and f.path = s.file_path where s.repo = '{ROOT[0]}' and s.qname = '{ROOT[1]}'")
def symbol_lookup(spark, d):
    return G.symbol(G.load_graph(spark, d), *ROOT).select("repo", "qname", "kind", "signature", "language")


@query(_WITH + f"select s.repo, s.qname, s.line_start, s.line_end from sym s join fil f on f.repo = s.repo and f.path = s.file_path where s.repo = '{ROOT[0]}' and s.qname = '{ROOT[1]}'")
def symbol_lines(spark, d):
    return G.symbol(G.load_graph(spark, d), *ROOT).select("repo", "qname", "line_start", "line_end")


@query(_WITH + f"select s.repo, s.qname, s.kind, s.name from sym s join fil f on f.repo = s.repo and f.path = s.file_path where s.repo = '{FILE[0]}' and s.file_path = '{FILE[1]}'")
def symbols_in_file(spark, d):
    return G.symbols_in_file(G.load_graph(spark, d), *FILE).select("repo", "qname", "kind", "name")


@query(_WITH + "select repo, qname, kind, name, file_path from sym where name ilike '%Ledger%' or qname ilike '%Ledger%' order by kind, repo, qname limit 25")
def symbol_search_topk(spark, d):
    return G.search(G.load_graph(spark, d), "Ledger")


@query(_WITH + "select * from fil")
def index_files(spark, d):
    return G.load_graph(spark, d).files


@query(_WITH + "select * from edg e where exists (select 1 from con c where c.consumer_repo = e.repo and c.consumer_qname = e.source_qname)")
def edges_from(spark, d):
    """What the consumers of contracts refer to."""
    g = G.load_graph(spark, d)
    return G.edges_from(g, g.contracts.select(F.col("consumer_repo").alias("repo"), F.col("consumer_qname").alias("qname")))


@query(_WITH + f"select * from edg where repo = '{ROOT[0]}' and target_qname = '{ROOT[1]}' and kind in ('calls', 'imports')")
def edges_to_kinds(spark, d):
    return G.edges_to(G.load_graph(spark, d), *ROOT, kinds=("calls", "imports"))


@query(_WITH + "select distinct repo, source_qname, target_qname from edg where kind = 'inherits'")
def inherits_pairs(spark, d):
    return G.load_graph(spark, d).edges.where("kind = 'inherits'").select("repo", "source_qname", "target_qname").distinct()


@query(_WITH + "select 'symbols' t, count(*) n from sym union all select 'files', count(*) from fil union all select 'edges', count(*) from edg union all select 'unresolved', count(*) from unr")
def table_counts(spark, d):
    g = G.load_graph(spark, d)
    out = None
    for name in ("symbols", "files", "edges", "unresolved"):
        one = getattr(g, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(_WITH + "select method, count(*) n from edg group by 1")
def resolution_health(spark, d):
    return G.resolution_health(G.load_graph(spark, d))


@query(_WITH + "select repo, language, n from (select *, row_number() over (partition by repo order by n desc, list_position(['typescript','python','go','rust','java'], language), language) r from (select repo, language, count(*) n from fil where language is not null group by 1, 2)) where r = 1")
def dominant_language(spark, d):
    return G.dominant_language(G.load_graph(spark, d).files)


@query(_WITH + "select repo, name, min(qname) qname from sym where kind <> 'module' group by 1, 2 having count(*) = 1")
def name_unique(spark, d):
    return G.unique_names(G.load_graph(spark, d).symbols)


@query(_WITH + "select repo, bucket, count(*) n from unr group by 1, 2")
def unresolved_buckets(spark, d):
    return G.load_graph(spark, d).unresolved.groupBy("repo", "bucket").agg(F.count("*").alias("n"))


# Walks

_DEP = """
e as (select x.repo, x.source_qname s, x.target_qname t, x.kind edge_kind, x.method, y.kind, y.file_path from edg x join sym y on y.repo = x.repo and y.qname = x.source_qname
  where x.kind in ('calls','inherits','renders','imports','uses_type')),
l1 as (select r.repo, r.root, e.* exclude (repo) from roots r join e on e.repo = r.repo and e.t = r.root where e.s <> r.root),
f1 as (select distinct repo, root, s from l1),
l2 as (select f.repo, f.root, e.* exclude (repo) from f1 f join e on e.repo = f.repo and e.t = f.s where e.s <> f.root),
p2 as (select repo, root, s, min(t) p from l2 group by 1, 2, 3),
dep as (
  select repo, root, s qname, kind, file_path, 'direct' relation, edge_kind, method, t, root || '>' || s path from l1
  union all
  select l.repo, l.root, l.s, l.kind, l.file_path, 'transitive', l.edge_kind, l.method, l.t,
    case when exists (select 1 from f1 where f1.repo = l.repo and f1.root = l.root and f1.s = l.s) then l.root || '>' || l.s else l.root || '>' || p.p || '>' || l.s end
  from l2 l join p2 p on p.repo = l.repo and p.root = l.root and p.s = l.s)
"""
_IROOTS = ", roots as (select repo, qname root from sym), "
_ONE = f", roots as (select '{ROOT[0]}' repo, '{ROOT[1]}' root), "


@query(_WITH + _IROOTS + _DEP + f"select repo, root, qname, kind, file_path, relation, edge_kind, {_CONF.format(m='dep')} confidence, edge_kind || ' ' || t || ' (' || method || ')' evidence, path from dep")
def dependents_two_hop(spark, d):
    g = G.load_graph(spark, d)
    return G.dependents(g, _all(g)).withColumn("path", F.array_join("path", ">"))


@query(_WITH + _ONE + _DEP + "select repo, root, qname, relation, edge_kind, path from dep where relation = 'direct'")
def dependents_direct(spark, d):
    g = G.load_graph(spark, d)
    return G.dependents(g, _root(spark), 1).select("repo", "root", "qname", "relation", "edge_kind", F.array_join("path", ">").alias("path"))


_IMPACT = f"""
agg as (select repo, root, count(*) filter (where relation = 'direct') direct, count(*) filter (where relation = 'transitive') transitive, max(case when relation = 'direct' then {_CONF.format(m='dep')} end) confidence, count(distinct file_path) affected_files from dep group by 1, 2),
hint as (select repo, member, count(*) hints from unr where kind = 'calls' and bucket <> 'external' and member <> '' group by 1, 2),
imp as (
  select r.repo, r.root, s.qname is not null found_, coalesce(direct, 0) direct, coalesce(transitive, 0) transitive, coalesce(affected_files, 0) affected_files, coalesce(confidence, 0) confidence,
    case when coalesce(direct, 0) = 0 and coalesce(transitive, 0) = 0 then coalesce(hints, 0) else 0 end suspected, coalesce(external_entry, false) external_entry, external_hint
  from roots r left join sym s on s.repo = r.repo and s.qname = r.root left join agg a on a.repo = r.repo and a.root = r.root left join hint h on h.repo = r.repo and h.member = s.name)
select repo, root, found_ as "found", direct, transitive, affected_files, case when direct > 0 then 'high' when suspected > 0 then 'low' else 'none' end risk, confidence, suspected, external_entry, external_hint from imp
"""


@query(_WITH + _IROOTS + _DEP + "," + _IMPACT)
def impact_report(spark, d):
    g = G.load_graph(spark, d)
    return G.impact(g, _all(g))


def _wb_sql(change: str, kinds: str, risk: str) -> str:
    return _WITH + f""", hit as (select x.repo, x.target_qname qname, {_CONF.format(m='x')} c, y.file_path from edg x join sym y on y.repo = x.repo and y.qname = x.source_qname where x.kind in ({kinds})),
    per as (select repo, qname, count(*) direct, max(c) confidence, count(distinct file_path) files from hit group by 1, 2)
    select s.repo, s.qname, '{change}' change, coalesce(direct, 0) direct, coalesce(files, 0) files, {risk} risk, coalesce(confidence, 0) confidence from sym s left join per p on p.repo = s.repo and p.qname = s.qname"""


_ALL_KINDS = "'calls','inherits','renders','imports','uses_type'"
_USE_KINDS = "'calls','inherits','renders'"


@query(_wb_sql("removed", _ALL_KINDS, "'high'"))
def would_break_removed(spark, d):
    g = G.load_graph(spark, d)
    return G.would_break(g, g.symbols)


@query(_wb_sql("return_type", _USE_KINDS, "'medium'"))
def would_break_return_type(spark, d):
    g = G.load_graph(spark, d)
    return G.would_break(g, g.symbols, "return_type")


@query(_wb_sql("visibility", _USE_KINDS, "case when coalesce(direct, 0) > 0 then 'high' else 'none' end"))
def would_break_other(spark, d):
    g = G.load_graph(spark, d)
    return G.would_break(g, g.symbols, "visibility")


_FORMER_SIGS = f"former as (select repo, {sql_qname('qname')} qname, max(signature) new_signature from symbols where removed_at is not null and signature is not null group by 1, 2)"
# Parameters of both signatures, character by character: p is the depth of parentheses, l that of all brackets.
_PARAMS = rf""", {_FORMER_SIGS},
sig as (
  select s.repo, s.qname, 'old' which, coalesce(s.signature, '') t from sym s join former f on f.repo = s.repo and f.qname = s.qname
  union all select s.repo, s.qname, 'new', f.new_signature from sym s join former f on f.repo = s.repo and f.qname = s.qname),
walk as (
  select repo, qname, which, t, instr(t, '(') i, 1 p, 0 l, '' cur, []::varchar[] got, false ended from sig where instr(t, '(') > 0
  union all
  select repo, qname, which, t, i + 1, p2, case when c in ('(', '[', '{{') then l + 1 when c in (')', ']', '}}') then l - 1 else l end,
    case when p2 = 0 or (c = ',' and l = 0) then '' else cur || c end,
    case when (c = ',' and l = 0) or (p2 = 0 and trim(cur) <> '') then list_append(got, trim(cur)) else got end, p2 = 0
  from (select *, substr(t, i + 1, 1) c, p + case substr(t, i + 1, 1) when '(' then 1 when ')' then -1 else 0 end p2 from walk where not ended and i < length(t))),
par as (
  select repo, qname, which, list_transform(got, lambda x: regexp_replace(regexp_replace(trim(split_part(split_part(x, '=', 1), ':', 1)), '^\.\.\.', ''), '\?$', '')) got from walk where ended),
two as (
  select f.repo, f.qname, coalesce((select any_value(got) from par where par.repo = f.repo and par.qname = f.qname and which = 'old'), []::varchar[]) o,
    coalesce((select any_value(got) from par where par.repo = f.repo and par.qname = f.qname and which = 'new'), []::varchar[]) n from former f)"""
_MEMBERS = rf""", {_FORMER_SIGS},
two as (
  select s.repo, s.qname, regexp_extract_all(coalesce(s.signature, ''), '([A-Za-z_$][\w$]*)\s*(:\s|\(|\?)', 1) o, regexp_extract_all(new_signature, '([A-Za-z_$][\w$]*)\s*(:\s|\(|\?)', 1) n
  from sym s join former f on f.repo = s.repo and f.qname = s.qname)"""


def _former_sql(change: str, kinds: str, both: str) -> str:
    risk = "case when len(list_filter(n, lambda x: not list_contains(o, x))) > 0 then 'high' when len(list_filter(o, lambda x: not list_contains(n, x))) > 0 then 'medium' else 'low' end"
    if change == "members":
        risk = "case when len(list_filter(o, lambda x: not list_contains(n, x))) > 0 then 'high' when len(list_filter(n, lambda x: not list_contains(o, x))) > 0 then 'medium' else 'low' end"
    whole = _wb_sql(change, kinds, risk).replace("from sym s left join per", "from sym s join two on two.repo = s.repo and two.qname = s.qname left join per").replace(", hit as", both + ", hit as", 1)
    return whole.replace("with ", "with recursive ", 1)


@query(_former_sql("signature", _USE_KINDS, _PARAMS))
def would_break_signature(spark, d):
    """Going back to the signature of a removed row of the same symbol."""
    g = G.load_graph(spark, d)
    return G.would_break(g, _former_signatures(spark, d), "signature")


@query(_former_sql("members", _ALL_KINDS, _MEMBERS))
def would_break_members(spark, d):
    g = G.load_graph(spark, d)
    return G.would_break(g, _former_signatures(spark, d), "members")


def _former_signatures(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "symbols").where("removed_at is not null and signature is not null")
    return old.groupBy("repo", plain_qname(F.col("qname")).alias("qname")).agg(F.max("signature").alias("new_signature"))


@query(_WITH + _ONE + f"h as (select x.*, {_CONF.format(m='x')} c from edg x join roots r on r.repo = x.repo and r.root = x.target_qname where x.kind in ({_ALL_KINDS})) select h.repo, target_qname root, source_qname qname, y.kind, y.file_path, h.kind edge_kind, c confidence, case when h.kind = 'imports' then 'imports ' || target_qname || ' by name (' || method || ')' else h.kind || ' ' || source_qname || ' (' || method || ' resolution)' end evidence from h join sym y on y.repo = h.repo and y.qname = source_qname")
def would_break_rows(spark, d):
    g = G.load_graph(spark, d)
    return G.break_rows(g, _root(spark).withColumnRenamed("root", "qname"))


@query(_WITH + "select u.repo, member, u.source_qname, target_text, bucket, s.file_path from unr u left join sym s on s.repo = u.repo and s.qname = u.source_qname where u.kind = 'calls' and bucket <> 'external' and member <> ''")
def suspected_callers(spark, d):
    return G.suspects(G.load_graph(spark, d))


_LAST = ", ".join(["last_ as (select r.repo, c.path, bool_or(c.change = 'removed') gone from found c join runs r using (run_id) where r.seq = (select max(seq) from runs q where q.repo = r.repo and q.root = r.root) group by 1, 2)"])
_SURFACE = _P1.rstrip() + ", " + _LAST + "," + _GRAPH + f""",
chg as (select repo, path file_path, gone from last_ where regexp_matches(path, '\\.(ts|tsx|js|jsx|py|go|rs|java)$')),
sur as (select repo, source_qname, target_qname, kind from edg where kind in ('calls','inherits','renders','imports')),
hits as (
  select distinct e.repo, e.source_qname, e.kind from sur e join sym s on s.repo = e.repo and s.qname = e.target_qname join chg c on c.repo = s.repo and c.file_path = s.file_path where s.exported
  union
  select e.repo, e.source_qname, e.kind from sur e join (select c.repo, coalesce(f.module_qname, replace(regexp_replace(c.file_path, '\\.\\w+$', ''), '/', '.')) m from chg c left join fil f on f.repo = c.repo and f.path = c.file_path where c.gone) m on m.repo = e.repo and m.m = e.target_qname where e.kind = 'imports')
select h.repo, h.source_qname qname, case when h.kind = 'imports' then 'file-level' else 'direct' end relation, min(s.kind) kind, min(s.file_path) file_path, min(h.kind) edge_kind
from hits h join sym s on s.repo = h.repo and s.qname = h.source_qname where not exists (select 1 from chg c where c.repo = s.repo and c.file_path = s.file_path) group by 1, 2, 3"""


def _last_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the last run of each root; earlier listings than the one before it aren't read."""
    runs = incremental.ok_runs(table(spark, d, "index_runs")).where("seq >= last - 1")
    found = incremental.run_changes(incremental.listings(table(spark, d, "files"), runs))
    last = runs.where("seq = last").select("repo", "root", "seq")
    return found.join(last, ["repo", "root", "seq"], "left_semi").groupBy("repo", "path").agg(F.max(F.col("change") == "removed").alias("gone"))


@query(_SURFACE)
def change_surface(spark, d):
    """What the files changed in the last run of each root reach."""
    return G.change_surface(G.load_graph(spark, d), _last_changes(spark, d))


@query(_WITH + _ONE + _DEP + f"select repo, root, file_path file, array_to_string(list_sort(list(distinct relation)), ',') relations, max({_CONF.format(m='dep')}) confidence from dep group by 1, 2, 3")
def audit_symbol(spark, d):
    return G.audit(G.load_graph(spark, d), _root(spark))


@query(_WITH + f", roots as (select repo, qname root from sym where repo = '{FILE[0]}' and file_path = '{FILE[1]}' and kind <> 'module'), " + _DEP + f"select repo, '{FILE[1]}' path, file_path file, array_to_string(list_sort(list(distinct relation)), ',') relations, max({_CONF.format(m='dep')}) confidence from dep group by 1, 2, 3")
def audit_file(spark, d):
    g = G.load_graph(spark, d)
    return G.audit_files(g, spark.createDataFrame([FILE], "repo string, path string"))[1]


@query(
    _WITH
    + f""", hit as (select x.repo, x.target_qname qname, {_CONF.format(m='x')} c from edg x join sym y on y.repo = x.repo and y.qname = x.source_qname where x.kind in ({_ALL_KINDS})),
    per as (select repo, qname, max(c) confidence from hit group by 1, 2),
    ins as (select *, min((kind = 'module')::int) over (partition by repo, file_path) only_ from sym)
    select i.repo, file_path path, count(*) symbols_audited, case when max(coalesce(confidence, 0)) > 0 then 'high' else 'low' end risk, max(coalesce(confidence, 0)) confidence
    from ins i left join per p on p.repo = i.repo and p.qname = i.qname where (kind <> 'module' or only_ = 1) and file_path is not null group by 1, 2"""
)
def audit_file_reports(spark, d):
    g = G.load_graph(spark, d)
    return G.audit_files(g, g.symbols.select("repo", F.col("file_path").alias("path")))[0].drop("worst")


@query(_WITH + _ONE + _DEP + ", f as (select distinct repo, root, file_path file from dep) select repo, root, file, n from (select *, row_number() over (partition by repo, root order by file) n from f) where n <= 15")
def read_set(spark, d):
    return G.read_set(G.audit(G.load_graph(spark, d), _root(spark)), ["repo", "root"])


@query(rf"select doc_id from documents where source = 'commit_log' and regexp_matches(text, '{G.CANDIDATE_WORDS}')")
def git_candidates(spark, d):
    return G.candidates(table(spark, d, "documents").where("source = 'commit_log'"), "text").select("doc_id")


@query(_WITH + "select c.id, c.provider_repo, c.provider_qname, c.consumer_repo, c.consumer_qname, c.kind, s.file_path from con c join sym p on p.repo = c.provider_repo and p.qname = c.provider_qname left join sym s on s.repo = c.consumer_repo and s.qname = c.consumer_qname where c.consumer_qname <> ''")
def contract_consumers(spark, d):
    return G.contract_consumers(G.load_graph(spark, d))


@query(_WITH + ", roots as (select distinct provider_repo repo, provider_qname root from con), " + _DEP + "select repo, root, relation, count(*) n, count(distinct qname) qnames from dep group by 1, 2, 3")
def graph_fanout_impact(spark, d):
    """Dependants of every provider of a contract, in whichever repo it lives."""
    g = G.load_graph(spark, d)
    roots = g.contracts.select(F.col("provider_repo").alias("repo"), F.col("provider_qname").alias("root"))
    return G.dependents(g, roots).groupBy("repo", "root", "relation").agg(F.count("*").alias("n"), F.count_distinct("qname").alias("qnames"))


# Upkeep

_SNAP = f"""
runs_ as (select run_id, repo, root, row_number() over (partition by repo, root order by started_at desc, run_id desc) age from index_runs where status = 'ok' and finished_at is not null),
lst as (select r.repo, r.age, {sql_path('f.path')} path, {sql_sha('f.sha256')} sha256, module_qname, deleted, row_number() over (partition by r.run_id, {sql_path('f.path')} order by f.recorded_at desc) rn from files f join runs_ r using (run_id) where r.age <= 2),
nw as (select * from lst where age = 1 and rn = 1 and not deleted), od as (select * from lst where age = 2 and rn = 1 and not deleted)
"""


def _snapshot(spark: SparkSession, d: str, age: int) -> DataFrame:
    runs = incremental.ok_runs(table(spark, d, "index_runs")).where(F.col("seq") == F.col("last") - (age - 1))
    listed = incremental.listings(table(spark, d, "files"), runs)
    modules = table(spark, d, "files").select("run_id", plain_path(F.col("path")).alias("path"), "module_qname").groupBy("run_id", "path").agg(F.max("module_qname").alias("module_qname"))
    rows = listed.groupBy("repo", "run_id", "path").agg(F.max(F.struct("recorded_at", "deleted", "sha256")).alias("r")).where("not r.deleted")
    return rows.join(modules, ["run_id", "path"]).select("repo", "path", "r.sha256", "module_qname")


@query("with " + _SNAP + "select coalesce(o.repo, n.repo) repo, coalesce(o.path, n.path) path, case when o.repo is null then 'added' when n.repo is null then 'removed' else 'changed' end change from od o full join nw n on o.repo = n.repo and o.path = n.path where o.repo is null or n.repo is null or o.sha256 is distinct from n.sha256 or o.module_qname is distinct from n.module_qname")
def snapshot_diff(spark, d):
    """Between the last two successful runs of every root."""
    return G.snapshot_diff(_snapshot(spark, d, 2), _snapshot(spark, d, 1))


_FORMER = f"select distinct repo, {sql_path('file_path')} path from symbols where removed_at is not null"


@query(_WITH + f", rep as ({_FORMER}), kept as (select s.repo, s.qname, s.file_path from sym s where not exists (select 1 from rep r where r.repo = s.repo and r.path = s.file_path)), fresh as (select repo, {sql_qname('qname')} qname, min(file_path) file_path from symbols where removed_at is not null group by 1, 2) select * from kept union all select * from fresh f where not exists (select 1 from kept k where k.repo = f.repo and k.qname = f.qname)")
def symbols_upsert(spark, d):
    """Files with removed symbols go back to those: their live symbols give way to the removed ones."""
    current, old = _upsert_sides(spark, d)
    return G.replace_of_files(current, old.select("repo", F.col("file_path").alias("path")), old, unique=["repo", "qname"])


def _upsert_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = G.load_graph(spark, d)
    old = table(spark, d, "symbols").where("removed_at is not null").groupBy("repo", plain_qname(F.col("qname")).alias("qname")).agg(F.min("file_path").alias("file_path"))
    return g.symbols.select("repo", "qname", "file_path"), old


@query(_WITH + f", rep as ({_FORMER}), own as (select s.repo, s.qname from sym s join rep r on r.repo = s.repo and r.path = s.file_path) select * from edg e where not exists (select 1 from own o where o.repo = e.repo and o.qname = e.source_qname)")
def edges_replace(spark, d):
    """Edges after the outgoing ones of files with removed symbols were deleted and none came anew."""
    g = G.load_graph(spark, d)
    old = table(spark, d, "symbols").where("removed_at is not null").select("repo", F.col("file_path").alias("path"))
    return G.edges_replaced(g, old, g.edges.where("false"))


@query(_WITH + f", rep as ({_FORMER}), ks as (select repo, qname from sym s where not exists (select 1 from rep r where r.repo = s.repo and r.path = s.file_path)) select e.* from edg e join ks a on a.repo = e.repo and a.qname = e.source_qname join ks b on b.repo = e.repo and b.qname = e.target_qname")
def edges_after_removal(spark, d):
    g = G.load_graph(spark, d)
    old = table(spark, d, "symbols").where("removed_at is not null").select("repo", F.col("file_path").alias("path"))
    return G.without_files(g, old).edges


@query(
    _P1.rstrip() + ", " + _LAST + "," + _GRAPH + """, at_ as (select repo, qname source_qname, file_path path from sym),
    c as (select e.repo, a.path from edg e join at_ a on a.repo = e.repo and a.source_qname = e.source_qname where e.method = 'global'
      union select u.repo, a.path from unr u join at_ a on a.repo = u.repo and a.source_qname = u.source_qname
      union select e.repo, a.path from edg e join at_ a on a.repo = e.repo and a.source_qname = e.source_qname join (select f.repo, f.module_qname from fil f join last_ l on l.repo = f.repo and l.path = f.path) m on m.repo = e.repo and m.module_qname = e.target_qname where e.kind = 'imports')
    select c.repo, c.path from c join fil f on f.repo = c.repo and f.path = c.path where not exists (select 1 from last_ l where l.repo = c.repo and l.path = c.path)"""
)
def reconcile_candidates(spark, d):
    return G.reconcile_candidates(G.load_graph(spark, d), _last_changes(spark, d))


# Resolution over the stored relations


@query(_WITH + """, m as (select distinct repo, qname from sym where kind = 'module'), sp as (select distinct repo, array_to_string(string_split(qname, '.')[-2:], '.') spec from m where len(string_split(qname, '.')) > 2)
    select sp.repo, spec, min(qname) module from sp join m on m.repo = sp.repo and ends_with(m.qname, '.' || spec) group by 1, 2 having count(*) = 1""")
def resolve_unique_suffix(spark, d):
    """Two-part ends of modules that are the end of exactly one."""
    modules = G.load_graph(spark, d).symbols.where("kind = 'module'").select("repo", F.col("qname").alias("module"))
    parts = F.split("module", r"\.")
    specs = modules.where(F.size(parts) > 2).select("repo", F.array_join(F.slice(parts, -2, 2), ".").alias("spec"))
    return resolve.unique_suffix(specs, modules)


@query(_WITH + ", miss as (select distinct e.repo, e.target_qname q from edg e where not exists (select 1 from sym s where s.repo = e.repo and s.qname = e.target_qname)) select m.repo, m.q qname, s.qname prefix from miss m join sym s on s.repo = m.repo and starts_with(m.q, s.qname || '.') qualify row_number() over (partition by m.repo, m.q order by length(s.qname) desc) = 1")
def resolve_longest_prefix(spark, d):
    """The longest dotted prefix that exists, of each target that doesn't."""
    g = G.load_graph(spark, d)
    known = g.symbols.select("repo", "qname")
    gone = g.edges.select("repo", F.col("target_qname").alias("qname")).distinct().join(known, G.KEY, "left_anti")
    return resolve.longest_prefix(gone, known).select("repo", "qname", "prefix")


@query(_WITH + f", tops as (select repo, split_part(qname, '.', 1) top from sym where kind = 'module' group by 1, 2), un as (select repo, name from sym where kind <> 'module' group by 1, 2 having count(*) = 1), roots as (select distinct repo, target_text, split_part(target_text, '.', 1) r from unr where target_text <> '') select r.repo, target_text, case when r in ({', '.join(repr(x) for x in resolve.DYNAMIC_ROOTS)}) then 'dynamic' when t.top is not null or u.name is not null then 'in_repo' else 'external' end bucket from roots r left join tops t on t.repo = r.repo and t.top = r.r left join un u on u.repo = r.repo and u.name = r.r")
def classify_unresolved(spark, d):
    g = G.load_graph(spark, d)
    texts = g.unresolved.where("target_text <> ''").select("repo", "target_text").distinct()
    return resolve.bucket(texts, g.symbols).select("repo", "target_text", "bucket")


@query(
    _WITH.replace("with ", "with recursive ", 1) + """, par as (select repo, source_qname c, min(target_qname) p from edg where kind = 'inherits' group by 1, 2),
    up as (select repo, c cls, c anc, 0 pos, [c] seen from par union all select u.repo, u.cls, p.p, u.pos + 1, list_append(u.seen, p.p) from up u join par p on p.repo = u.repo and p.c = u.anc where not list_contains(u.seen, p.p) and u.pos < 9)
    select repo, cls qname, anc ancestor, pos from up"""
)
def ancestor_closure(spark, d):
    """Up to ten classes of each class's chain, itself first."""
    e = G.load_graph(spark, d).edges.where("kind = 'inherits'").select("repo", F.col("source_qname").alias("cls"), F.col("target_qname").alias("base"))
    return resolve.class_chain(e.groupBy("repo", "cls").agg(F.min("base").alias("base")).withColumn("pos", F.lit(0))).select("repo", F.col("cls").alias("qname"), "ancestor", "pos")


_RESOLVE = """,
uni as (select s.repo, s.qname, min(s.name) as name, min(s.kind) kind, min(f.module_qname) m from sym s join fil f on f.repo = s.repo and f.path = s.file_path where f.module_qname is not null group by 1, 2),
ours as (select repo, qname, name, m from uni where kind <> 'module'),
modul as (select repo, qname from uni where kind = 'module'),
own as (select repo, m, name, min(qname) hit from ours group by 1, 2, 3 having count(*) = 1),
anyw as (select repo, name, min(qname) hit from ours group by 1, 2 having count(*) = 1),
imp as (select distinct e.repo, e.source_qname m, e.target_qname target from edg e join modul a on a.repo = e.repo and a.qname = e.source_qname join modul b on b.repo = e.repo and b.qname = e.target_qname where e.kind = 'imports'),
bind as (select repo, m, split_part(target, '.', -1) local, max(target) target from imp group by 1, 2, 3),
par as (select repo, source_qname c, min(target_qname) p from edg where kind = 'inherits' group by 1, 2),
chain as (select repo, qname c, qname a, 0 pos, [qname] seen from uni union all select h.repo, h.c, par.p, h.pos + 1, list_append(h.seen, par.p) from chain h join par on par.repo = h.repo and par.c = h.a where h.pos < 9 and not list_contains(h.seen, par.p)),
asks as (
  select distinct e.repo, e.source_qname source, t.target, x.m from edg e join uni x on x.repo = e.repo and x.qname = e.source_qname,
  unnest([split_part(e.target_qname, '.', -1), array_to_string(string_split(e.target_qname, '.')[-2:], '.'), 'self.' || split_part(e.target_qname, '.', -1), 'super.' || split_part(e.target_qname, '.', -1)]) t(target) where e.kind <> 'imports'),
r as (
  select *, split_part(target, '.', 1) f1, case when contains(target, '.') then substr(target, instr(target, '.') + 1) end rest,
    case when contains(source, '.') then regexp_replace(source, '\\.[^.]*$', '') else source end parent from asks),
q as (
  select r.*, split_part(rest, '.', 1) member, case when near.qname is not null and near.qname <> source then near.qname else own.hit end local, anyw.hit any_hit, bind.target bound, po.qname is not null owned
  from r left join uni near on near.repo = r.repo and near.qname = parent || '.' || f1 left join own on own.repo = r.repo and own.m = r.m and own.name = f1 left join anyw on anyw.repo = r.repo and anyw.name = f1
  left join bind on bind.repo = r.repo and bind.m = r.m and bind.local = f1 left join ours po on po.repo = r.repo and po.qname = parent),
cut_ as (select q.*, k, array_to_string(string_split(rest, '.')[1:k], '.') pre from q, unnest(range(1, len(string_split(rest, '.')) + 1)) t(k) where rest is not null),
cand as (
  select repo, source, target, 10 rank, 0 n, 0 o, local key, 'same' as method from q where rest is null
  union all select repo, source, target, 30, 0, 0, any_hit, 'global' from q where rest is null
  union all select q.repo, source, target, 5, 0, h.pos, h.a || '.' || member, 'same' from q join chain h on h.repo = q.repo and h.c = q.parent where owned and rest is not null and (f1 in ('self', 'cls', 'this', 'type') or (f1 = 'super' and h.pos > 0))
  union all select repo, source, target, 40, -k, 0, bound || '.' || pre, 'import' from cut_
  union all select repo, source, target, 50, -k, 0, local || '.' || pre, 'same' from cut_
  union all select repo, source, target, 60, -k, 0, any_hit || '.' || pre, 'global' from cut_),
met as (select cand.* from cand join uni on uni.repo = cand.repo and uni.qname = cand.key),
first_ as (select * from met qualify row_number() over (partition by repo, source, target order by rank, n, o, key, method) = 1),
deep as (
  select f.repo, f.source, f.target, -k n, h.pos o, h.a || '.' || array_to_string(string_split(q.rest, '.')[2:k + 1], '.') key from first_ f join q on q.repo = f.repo and q.source = f.source and q.target = f.target join chain h on h.repo = f.repo and h.c = f.key, unnest(range(1, len(string_split(q.rest, '.')))) t(k)
  where f.rank = 5 and contains(q.rest, '.')),
deeper as (select d.* from deep d join uni on uni.repo = d.repo and uni.qname = d.key qualify row_number() over (partition by d.repo, d.source, d.target order by n, o, d.key) = 1)
select f.repo, f.source, f.target, coalesce(d.key, f.key) hit, f.method as method from first_ f left join deeper d on d.repo = f.repo and d.source = f.source and d.target = f.target"""


@query(_WITH.replace("with ", "with recursive ", 1).rstrip() + _RESOLVE)
def resolve_stored(spark, d):
    """What the targets of edges would mean to their sources if written as code does (by name, with their owner, as members
    of self and super): by receiver and ancestors, imported modules, scope and module, and unique names, over the stored
    symbols, imports and inheritance."""
    g = G.load_graph(spark, d)
    universe = G.symbol_rows(g).where("module_qname is not null").select("repo", "qname", "name", "kind", F.col("module_qname").alias("module"))
    universe = cut(universe, "universe")
    modules = universe.where("kind = 'module'").select("repo", "qname")
    whole = g.edges.where("kind = 'imports'").join(modules.withColumnRenamed("qname", "source_qname"), ["repo", "source_qname"], "left_semi").join(modules.withColumnRenamed("qname", "target_qname"), ["repo", "target_qname"], "left_semi")
    imports = whole.select("repo", F.col("source_qname").alias("module"), F.substring_index("target_qname", ".", -1).alias("local"), F.lit("*").alias("imported"), F.col("target_qname").alias("spec"), F.col("target_qname").alias("target"), F.col("target_qname").alias("pos")).distinct()
    bases = g.edges.where("kind = 'inherits'").groupBy("repo", F.col("source_qname").alias("cls")).agg(F.min("target_qname").alias("base")).withColumn("pos", F.lit(0))
    r = resolve.Resolver(universe, imports, imports.select("repo", "module", "target").where("false")).with_bases(bases)
    at = universe.select("repo", F.col("qname").alias("source_qname"), "module")
    name = F.substring_index("target_qname", ".", -1)
    texts = F.array(name, F.substring_index("target_qname", ".", -2), F.concat(F.lit("self."), name), F.concat(F.lit("super."), name))
    asks = g.edges.where("kind <> 'imports'").join(at, ["repo", "source_qname"]).select("repo", F.col("source_qname").alias("source"), F.explode(texts).alias("target"), "module").distinct()
    asks = asks.withColumn("id", F.concat_ws(resolve.SEP, "source", "target"))
    return r.resolve(asks).join(asks, ["repo", "id"]).select("repo", "source", "target", "hit", "method")


# Evaluation


@query(
    _WITH + """, cr as (select e.repo, e.target_qname qname, count(*) cross_ from edg e join sym t on t.repo = e.repo and t.qname = e.target_qname join sym s on s.repo = e.repo and s.qname = e.source_qname where e.kind in ('calls','inherits','renders','imports') and s.file_path <> t.file_path group by 1, 2)
    select s.repo, s.qname, s.kind, s.file_path, cross_ as "cross" from sym s join cr on cr.repo = s.repo and cr.qname = s.qname where s.exported and s.kind in ('function','constant','class','interface','type_alias','enum','method')"""
)
def mutation_candidates(spark, d):
    return G.mutation_candidates(G.load_graph(spark, d), 1)


_EVAL = """, cases as (select repo, qname, m mutation, file_path own from sym, (values ('remove-declaration'), ('rename'), ('add-required-param')) t(m) where exported and kind in ('function','constant','class','interface','type_alias','enum','method') and (m <> 'add-required-param' or kind in ('function','method','constant'))),
hits as (select c.repo, c.qname, c.mutation, s.file_path file, e.method from cases c join edg e on e.repo = c.repo and e.target_qname = c.qname join sym s on s.repo = e.repo and s.qname = e.source_qname where s.file_path <> c.own and (e.kind in ('calls','inherits','renders') or (e.kind = 'imports' and c.mutation <> 'add-required-param'))),
p as (select distinct repo, qname, mutation, file from hits), t as (select distinct repo, qname, mutation, file from hits where method <> 'global'),
b as (select coalesce(p.mutation, t.mutation) mutation, p.repo is not null p, t.repo is not null t from p full join t on p.repo = t.repo and p.qname = t.qname and p.mutation = t.mutation and p.file = t.file)
select mutation, count(*) filter (where p and t) tp, count(*) filter (where not t) fp, count(*) filter (where not p) fn, round(count(*) filter (where p and t) / nullif(count(*) filter (where p), 0), 3) as "precision", round(count(*) filter (where p and t) / nullif(count(*) filter (where t), 0), 3) recall from b group by rollup(mutation)"""


@query(_WITH + _EVAL)
def eval_precision_recall(spark, d):
    """Prediction by all edges against a truth that doesn't trust globally resolved ones."""
    g = G.load_graph(spark, d)
    ok = F.lit(False)
    mutation = F.explode(F.array(*[F.lit(m) for m in G.MUTATIONS]))
    cases = g.symbols.where("exported").select("repo", "qname", "kind", mutation.alias("mutation"))
    for m, kinds in G.MUTATIONS.items():
        ok = ok | (F.col("mutation") == m) & F.col("kind").isin(*kinds)
    cases = cases.where(ok).drop("kind")
    trusted = G.CodeGraph(g.symbols, g.files, g.edges.where("method <> 'global'"), g.unresolved, g.contracts)
    return G.precision_recall(G.predicted_files(g, cases), G.predicted_files(trusted, cases))


# Extraction from source text


def _extracted(spark: SparkSession, d: str) -> extract.Extracted:
    return extract.extract(extract.latest_texts(table(spark, d, "documents")))


@query()
def extract_symbols(spark, d):
    return _extracted(spark, d).symbols


@query()
def extract_imports(spark, d):
    return _extracted(spark, d).imports


@query()
def extract_references(spark, d):
    return _extracted(spark, d).edges


@query()
def extract_bindings(spark, d):
    return _extracted(spark, d).bindings


@query()
def resolve_import_candidates(spark, d):
    """Imports with the module they mean: the first candidate that exists, or the only module with that ending."""
    x = _extracted(spark, d)
    modules = x.symbols.where("kind = 'module'").select("repo", F.col("qname").alias("module")).distinct()
    return resolve.first_existing(x.imports, modules).drop("candidates")


@query()
def resolved_edges(spark, d):
    return extract.resolved(_extracted(spark, d))[0]


@query()
def unresolved_from_text(spark, d):
    return extract.resolved(_extracted(spark, d))[1].groupBy("repo", "bucket", "kind").agg(F.count("*").alias("n"))


@query(_WITH.replace("with ", "with recursive ", 1) + ", st as (select distinct e.repo, e.source_qname m, e.target_qname t from edg e join sym a on a.repo = e.repo and a.qname = e.source_qname and a.kind = 'module' join sym b on b.repo = e.repo and b.qname = e.target_qname and b.kind = 'module' where e.kind = 'imports' and e.method = 'static'), up as (select distinct repo, m as module, m reach, [m] seen from st union all select u.repo, u.module, s.t, list_append(u.seen, s.t) from up u join st s on s.repo = u.repo and s.m = u.reach where not list_contains(u.seen, s.t)) select distinct repo, module, reach from up")
def star_closure(spark, d):
    """Modules each module leads to over static imports of modules."""
    g = G.load_graph(spark, d)
    m = g.symbols.where("kind = 'module'").select("repo", "qname")
    e = g.edges.where("kind = 'imports' and method = 'static'").join(m.withColumnRenamed("qname", "source_qname"), ["repo", "source_qname"]).join(m.withColumnRenamed("qname", "target_qname"), ["repo", "target_qname"])
    return resolve.star_closure(e.select("repo", F.col("source_qname").alias("module"), F.col("target_qname").alias("target")))
