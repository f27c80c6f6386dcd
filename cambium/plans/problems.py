"""The p-queries of the general problems, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions.plain import plain_kind, plain_qname
from cambium.operators import hierarchy as H
from cambium.operators import incremental, references, skew
from cambium.session import scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_paths(table(spark, d, "files"), table(spark, d, "index_runs")).select("run_id", "path")


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    found = incremental.changed_paths(table(spark, d, "files"), table(spark, d, "index_runs"))
    return found.groupBy("run_id", "change").agg(F.count("*").alias("n"))


def _two_refreshes(spark: SparkSession, d: str) -> tuple[list, list, incremental.PartitionedRefresh]:
    """One state refreshed with the runs of the first half of the time and what was recorded by then, then with everything:
    the parts recomputed each time."""
    files, runs = table(spark, d, "files"), table(spark, d, "index_runs")
    state = incremental.PartitionedRefresh(spark, scratch(spark, "changed-paths"))
    day = F.to_date("started_at")
    middle = runs.agg(F.date_add(F.min(day), F.floor(F.date_diff(F.max(day), F.min(day)) / 2).cast("int"))).head()[0]
    first = incremental.refresh_changes(files.where(F.to_date("recorded_at") < F.lit(middle)), runs.where(day < F.lit(middle)), state)
    return first, incremental.refresh_changes(files, runs, state), state


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p1_found out of two refreshes."""
    return _two_refreshes(spark, d)[2].read().select("run_id", "path")


def p1_refreshes(spark: SparkSession, d: str) -> DataFrame:
    """How many parts each refresh recomputed, of how many."""
    first, second, state = _two_refreshes(spark, d)
    parts = spark.read.parquet(f"{state.folder}/marks/{state.pointer.read()['gen']}").count()
    return spark.createDataFrame([(1, len(first), len(first)), (2, len(second), parts)], "refresh int, recomputed bigint, parts bigint")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edges").where(plain_kind(F.col("kind")) == "inherits")
    return H.hierarchy(rows, F.col("repo"), plain_qname(F.col("source_qname")), plain_qname(F.col("target_qname")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select(F.col("scope").alias("repo"), F.col("node").alias("qname"), F.col("root").alias("root_qname"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    placed = _classes(spark, d)
    return H.paths(placed).join(placed.select("scope", "node", "descendants"), ["scope", "node"]).select(F.col("scope").alias("repo"), F.col("node").alias("qname"), "path", "descendants")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    placed = _classes(spark, d)
    scopes = placed.groupBy("tree").agg(F.first("scope").alias("repo"))
    return H.ancestor_pairs(placed).join(scopes, "tree").select("repo", F.col("ancestor").alias("qname"), F.col("node").alias("descendant"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = references.code_references(table(spark, d, "edges"), table(spark, d, "contracts"), table(spark, d, "unresolved"))
    return references.orphans(refs, table(spark, d, "symbols"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.per_period(_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "edges"), table(spark, d, "symbols"))


def p6_dependants(spark: SparkSession, d: str) -> DataFrame:
    return skew.dependants(table(spark, d, "edges"))


def p6_definitions(spark: SparkSession, d: str) -> DataFrame:
    return skew.dependants_per_target(table(spark, d, "edges"), table(spark, d, "symbols"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_changes, p1_incremental, p1_refreshes, p2_found, p2_paths, p2_descendants, p3_found, p3_report, p6_found, p6_dependants, p6_definitions)
}

# Plain forms in SQL, as functions of an expression.
_BLANKS = r"'^[\s]+|[\s]+$'"


def sql_path(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, {_BLANKS}, '', 'g'), '[/\\]+', '/', 'g'), '^(\.?/)+', '')"


def sql_qname(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, {_BLANKS}, '', 'g'), '\s*\([^()]*\)\s*$', '')"
    return rf"regexp_replace(regexp_replace({bare}, '\s*(::|[#/\\])\s*', '.', 'g'), '^\.+|\.+$', '', 'g')"


def sql_sha(x: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({x}, {_BLANKS}, '', 'g')), '^sha-?256[:=]\s*', '')"


def sql_kind(x: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({x}, {_BLANKS}, '', 'g')), '[\s-]+', '_', 'g')"


_P1 = f"""
with runs as (
  select run_id, repo, root, row_number() over (partition by repo, root order by started_at, run_id) seq from index_runs where status = 'ok' and finished_at is not null),
rows_ as (
  select r.repo, r.root, r.seq, {sql_path('f.path')} path, {sql_sha('f.sha256')} sha, f.deleted, f.recorded_at from files f join runs r using (run_id)),
valid as (select * from rows_ qualify row_number() over (partition by repo, root, seq, path order by recorded_at desc, deleted desc, sha desc nulls last) = 1),
live as (select * from valid where not deleted),
added as (
  select a.repo, a.root, a.seq, a.path, case when b.path is null then 'added' else 'changed' end change from live a
  left join live b on a.repo = b.repo and a.root = b.root and a.path = b.path and b.seq = a.seq - 1
  where b.path is null or coalesce(a.sha, '') <> coalesce(b.sha, '')),
gone as (
  select b.repo, b.root, b.seq + 1 seq, b.path, 'removed' change from live b
  where exists (select 1 from runs r where r.repo = b.repo and r.root = b.root and r.seq = b.seq + 1)
    and not exists (select 1 from live a where a.repo = b.repo and a.root = b.root and a.path = b.path and a.seq = b.seq + 1)),
found as (select r.run_id, c.path, c.change from (select * from added union all select * from gone) c join runs r using (repo, root, seq))
"""

_P2 = f"""
with recursive raw as (
  select repo, {sql_qname('source_qname')} child, {sql_qname('target_qname')} parent from edges where {sql_kind('kind')} = 'inherits'),
links as (select repo, child, min(parent) parent from raw group by repo, child),
nodes as (select repo, child qname from links union select repo, parent from links),
up as (
  select repo, qname, qname cur, cast(0 as bigint) depth, [qname] seen, false looped from nodes
  union all
  select u.repo, u.qname, l.parent, u.depth + 1, list_append(u.seen, l.parent), list_contains(u.seen, l.parent) from up u
  join links l on l.repo = u.repo and l.child = u.cur where not u.looped),
last as (select * from up u where looped or not exists (select 1 from links l where l.repo = u.repo and l.child = u.cur)),
placed as (
  select repo, qname, looped, case when looped then list_min(seen[list_position(seen, cur):]) else cur end root_qname, case when looped then -1 else depth end depth, seen, cur from last)
"""

_REFS = " union all ".join(
    f"select '{t}' table_name, id row_id, '{f}' field_name, {s} scope, {sql_qname(f)} key, recorded_at from {t} where {f} is not null and {s} is not null"
    for t, f, s in (("edges", "target_qname", "repo"), ("contracts", "provider_qname", "provider_repo"), ("contracts", "consumer_qname", "consumer_repo"), ("unresolved", "source_qname", "repo"))
)
_P3 = f"""
with refs as ({_REFS}),
known as (select repo scope, {sql_qname('qname')} key, min(indexed_at) since, bool_or(removed_at is null) live from symbols group by 1, 2),
found as (
  select distinct table_name, row_id, field_name, case when k.key is null then 'missing' when not live then 'deleted' else 'late' end reason, strftime(recorded_at, '%Y-%m') period
  from refs r left join known k on r.scope = k.scope and r.key = k.key
  where r.key <> '' and (k.key is null or not live or since > recorded_at))
"""
_E = f"with e as (select distinct id, repo, {sql_qname('source_qname')} source_qname, {sql_qname('target_qname')} target_qname from edges)"
_S = f"s as (select repo, {sql_qname('qname')} target_qname, count(*) definitions, count(*) filter (where removed_at is null) live from symbols group by 1, 2)"

ORACLES: dict[str, str] = {
    "p1_found": _P1 + "select run_id, path from found",
    "p1_changes": _P1 + "select run_id, change, count(*) n from found group by 1, 2",
    "p1_incremental": _P1 + "select run_id, path from found",
    "p1_refreshes": """
    with mid as (select min(started_at::date) + (date_diff('day', min(started_at::date), max(started_at::date)) // 2)::int m from index_runs),
    r as (select run_id, floor(date_diff('day', date '1970-01-01', started_at::date) / 7) part, started_at::date < m early, lag(run_id) over (partition by repo, root order by started_at, run_id) before
      from index_runs, mid where status = 'ok' and finished_at is not null),
    behind as (select distinct run_id from files, mid where recorded_at::date >= m),
    c as (select part, early, not early or run_id in (from behind) or coalesce(before in (from behind), false) moved from r)
    select 1 refresh, count(distinct part) recomputed, count(distinct part) parts from c where early
    union all select 2, count(distinct part) filter (where moved), count(distinct part) from c""",
    "p2_found": _P2 + "select repo, qname, root_qname, depth from placed",
    "p2_paths": _P2
    + """, tops as (select repo, qname, case when looped and list_position(seen, cur) = 1 then [qname] when looped then seen[:list_position(seen, cur)] else seen end chain from placed),
    under as (select repo, a anc, count(*) n from tops, unnest(chain) t(a) where a <> qname group by 1, 2)
    select t.repo, t.qname, array_to_string(list_reverse(chain), ' > ') path, coalesce(u.n, 0) descendants from tops t left join under u on u.repo = t.repo and u.anc = t.qname""",
    "p2_descendants": _P2
    + """, tops as (select repo, qname, case when looped and list_position(seen, cur) = 1 then [qname] when looped then seen[:list_position(seen, cur)] else seen end chain from placed)
    select repo, a qname, qname descendant from tops, unnest(chain) t(a) where a <> qname""",
    "p3_found": _P3 + "select * from found",
    "p3_report": _P3 + "select table_name, field_name, reason, period, count(*) n from found group by 1, 2, 3, 4",
    "p6_found": _E + " select repo, target_qname from e group by 1, 2 having count(*) >= 0.01 * (select count(*) from e)",
    "p6_dependants": _E + " select repo, target_qname, count(*) edges, count(distinct source_qname) sources from e group by 1, 2",
    "p6_definitions": _E + f", {_S} select repo, target_qname, count(*) edges, coalesce(any_value(definitions), 0) definitions, count(*) * greatest(coalesce(any_value(definitions), 0), 1) pairs, count(*) * coalesce(any_value(live), 0) live_pairs from e left join s using (repo, target_qname) group by 1, 2",
}
