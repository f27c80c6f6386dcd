"""Resolving raw references to symbols: a ranked list of candidates and one equi-join.

What a name means in its module (own symbol, import, the only symbol of that name) is looked up once per (module, name),
not per reference. Each reference then makes an array of candidate names, one for each rule and depth, with its rank;
all of them are joined to the known symbols at once and the least rank wins, so the cascade is one grouped minimum
and no rule depends on the order in which tasks run. Theta conditions are turned into equalities: suffixes of modules and
prefixes of names are exploded and joined by key. Inheritance and bindings are walked a bounded number of steps, as
their rules say; star exports to their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.session import cut, drop

# Receivers, roots that are only known at run time, and the bounds of the walks.
RECEIVERS = ("self", "cls", "this", "type")
DYNAMIC_ROOTS = ("self", "cls", "super", "type", "locals", "globals", "vars", "__class__", "this")
MAX_CHAIN = 10
MAX_BINDING_STEPS = 4


def dotted_suffixes(name: Column) -> Column:
    """Every proper dotted suffix: a.b.c gives b.c and c."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def dotted_prefixes(name: Column, whole: bool = False) -> Column:
    """Dotted prefixes, shortest first, with the name itself if `whole`."""
    parts = F.split(name, r"\.")
    n = F.size(parts) - (0 if whole else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def unique_suffix(specs: DataFrame, modules: DataFrame) -> DataFrame:
    """`repo, spec, module` for dotted specs that are the proper suffix of exactly one module of the repo."""
    ends = modules.select("repo", "module", F.explode(dotted_suffixes(F.col("module"))).alias("spec"))
    one = ends.where("spec like '%.%'").groupBy("repo", "spec").agg(F.count_distinct("module").alias("n"), F.min("module").alias("module")).where("n = 1")
    return specs.select("repo", "spec").distinct().join(one, ["repo", "spec"]).select("repo", "spec", "module")


def first_existing(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """`imports` with `target`: the first of their `candidates` that is a module of the repo, else the one module of which
    the spec is a suffix, else null."""
    rows = imports.withColumn("_row", F.monotonically_increasing_id())
    c = rows.select("_row", "repo", F.posexplode("candidates").alias("_pos", "module")).join(modules.select("repo", "module").distinct(), ["repo", "module"])
    best = c.groupBy("_row").agg(F.min_by("module", "_pos").alias("_first"))
    ends = unique_suffix(imports, modules).withColumnRenamed("module", "_suffix")
    return rows.join(best, "_row", "left").join(ends, ["repo", "spec"], "left").withColumn("target", F.coalesce("_first", "_suffix")).drop("_row", "_first", "_suffix")


def longest_prefix(names: DataFrame, known: DataFrame) -> DataFrame:
    """`repo, qname, prefix`: the longest proper dotted prefix of each name that is in `known` (repo, qname)."""
    p = names.select("repo", "qname", F.posexplode(dotted_prefixes(F.col("qname"))).alias("n", "prefix"))
    hit = p.join(known.select("repo", F.col("qname").alias("prefix")), ["repo", "prefix"])
    return hit.groupBy("repo", "qname").agg(F.max_by("prefix", "n").alias("prefix"))


def bucket(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """`texts` (repo, target_text) with `bucket`: dynamic for a receiver, in_repo where the root is the top of a module or a
    name one symbol has, else external."""
    root = F.substring_index("target_text", ".", 1)
    tops = symbols.where("kind = 'module'").select("repo", F.substring_index("qname", ".", 1).alias("root")).distinct().withColumn("_top", F.lit(True))
    names = symbols.where("kind <> 'module'").groupBy("repo", F.col("name").alias("root")).agg(F.count("*").alias("n")).where("n = 1").select("repo", "root", F.lit(True).alias("_name"))
    rows = texts.withColumn("root", root).join(tops, ["repo", "root"], "left").join(names, ["repo", "root"], "left")
    kind = F.when(F.col("root").isin(*DYNAMIC_ROOTS), "dynamic").when(F.col("_top") | F.col("_name"), "in_repo").otherwise("external")
    return rows.withColumn("bucket", kind).drop("_top", "_name")


def class_chain(bases: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """`repo, cls, ancestor, pos`: each class, its bases, theirs and so on, breadth first, `most` at the most and each
    once. `bases`: repo, cls, base, pos (the order of several bases). A step keeps one row an ancestor, the one that
    comes first, so diamonds don't multiply."""
    up = cut(bases.select("repo", F.col("cls").alias("at"), "base", F.col("pos").alias("o")).distinct(), "bases")
    level = cut(up.select("repo", F.col("at").alias("cls")).distinct().select("repo", "cls", F.col("cls").alias("ancestor"), F.array(F.lit(0)).alias("order")), "level")
    out = level
    for _ in range(most - 1):
        nxt = level.select("repo", "cls", F.col("ancestor").alias("at"), "order").join(up, ["repo", "at"]).select("repo", "cls", F.col("base").alias("ancestor"), F.concat("order", F.array("o")).alias("order"))
        nxt = nxt.join(out.select("repo", "cls", "ancestor"), ["repo", "cls", "ancestor"], "left_anti").groupBy("repo", "cls", "ancestor").agg(F.min("order").alias("order"))
        level = cut(nxt, "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    w = Window.partitionBy("repo", "cls").orderBy(F.size("order"), "order", "ancestor")
    return out.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < most).select("repo", "cls", "ancestor", "pos")


def star_closure(stars: DataFrame) -> DataFrame:
    """`repo, module, reach`: each re-exporting module, itself and all that its star exports (repo, module, target) lead to.
    A round takes one more step from the pairs that were new in the last; written each time, so that plans stay small."""
    step = cut(stars.select("repo", F.col("module").alias("reach"), F.col("target").alias("to")).distinct(), "stars")
    out, k = cut(step.select("repo", F.col("reach").alias("module")).distinct().select("repo", "module", F.col("module").alias("reach"), F.lit(0).alias("k")), "reach"), 0
    while not out.where(F.col("k") == k).isEmpty():
        more = out.where(F.col("k") == k).join(step, ["repo", "reach"]).select("repo", "module", F.col("to").alias("reach")).distinct()
        more = more.join(out, ["repo", "module", "reach"], "left_anti").withColumn("k", F.lit(k + 1))
        last, out, k = out, cut(out.unionByName(more), "reach"), k + 1
        drop(last)
    return out.drop("k")


SEP = "\x1f"


def _candidate(rank: Column | int, n: Column | int, o: Column | int, key: Column, method: str) -> Column:
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(as_int(rank).alias("rank"), as_int(n).alias("n"), as_int(o).alias("o"), key.alias("qname"), F.lit(method).alias("method"))


def _below(rank: int, base: Column, rest: Column, method: str) -> Column:
    """Candidates base plus ever fewer of the dotted `rest`, the most first; null without a base."""
    return F.when(base.isNotNull() & rest.isNotNull(), F.transform(dotted_prefixes(rest, whole=True), lambda p, k: _candidate(rank, -k, 0, F.concat(base, F.lit("."), p), method)))


def _one(condition: Column, candidate: Column) -> Column:
    return F.when(condition, F.array(candidate))


class Resolver:
    """Resolution in one repo universe. `symbols`: repo, qname, name, kind, module (of their file); `imports`: repo, module,
    local, imported, spec, target (see `first_existing`), pos; `stars`: repo, module, target. Bases are given later,
    as they are resolved themselves. References are rows (repo, id, module, source, target), id being unique in its repo."""

    def __init__(self, symbols: DataFrame, imports: DataFrame, stars: DataFrame):
        self.symbols = symbols
        self.imports = imports.where("not (local = '*' and imported = '*')")
        # each relation below takes part in several joins; written once, so that plans stay small
        self.known = cut(symbols.groupBy("repo", "qname").agg(F.max(F.col("kind") == "module").alias("is_module")), "known")
        self.modules = self.known.where("is_module").select("repo", F.col("qname").alias("module"))
        plain = symbols.where("kind <> 'module'").select("repo", "module", "name", "qname").distinct()
        self.in_module = cut(plain.groupBy("repo", "module", "name").agg(F.count("*").alias("n"), F.min("qname").alias("hit")), "in_module")
        self.unique = cut(self.in_module.groupBy("repo", "name").agg(F.sum("n").alias("n"), F.min("hit").alias("hit")).where("n = 1").select("repo", "name", "hit"), "unique")
        reach = star_closure(stars).unionByName(self.modules.select("repo", "module", F.col("module").alias("reach"))).distinct()
        seen = cut(reach.join(self.in_module.withColumnRenamed("module", "reach"), ["repo", "reach"]), "seen")
        # a name seen through stars counts if one symbol only, in every module reached, has it
        named = seen.groupBy("repo", "module", "name").agg(F.max("n").alias("most"), F.count_distinct("hit").alias("hits"), F.min("hit").alias("hit")).where("most = 1 and hits = 1").select("repo", "module", "name", "hit")
        sub = self.modules.select("repo", F.regexp_extract("module", r"^(.*)\.[^.]+$", 1).alias("m"), F.substring_index("module", ".", -1).alias("name"), F.col("module").alias("hit")).where("m <> ''").withColumnRenamed("m", "module")
        self.named_or_submodule = cut(named.unionByName(sub.join(seen.select("repo", "module", "name").distinct(), ["repo", "module", "name"], "left_anti")), "named")
        self.bound = self.imports.where("target is not null").groupBy("repo", "module", "local").agg(F.max_by(F.struct("target", "imported"), "pos").alias("i")).select("repo", "module", "local", "i.target", "i.imported")
        self.chains = None

    def with_bases(self, bases: DataFrame) -> Resolver:
        """Members are looked for on the ancestors too. `bases`: repo, cls, base, pos."""
        chain = class_chain(bases).groupBy("repo", "cls").agg(F.sort_array(F.collect_list(F.struct("pos", "ancestor"))).alias("c"))
        self.chains = cut(chain.select("repo", "cls", F.col("c.ancestor").alias("chain")), "chain")
        return self

    def _with_chain(self, rows: DataFrame, cls: str) -> DataFrame:
        """`rows` with `chain`: the class itself and its ancestors in order."""
        if self.chains is None:
            return rows.withColumn("chain", F.array(cls))
        return rows.join(self.chains.withColumnRenamed("cls", cls), ["repo", cls], "left").withColumn("chain", F.coalesce("chain", F.array(cls)))

    def import_edges(self) -> DataFrame:
        """module -> module once each (static), and module -> imported name (import in the imported module itself, else
        global): `repo, source, target, kind, method`."""
        i = self.imports.where("target is not null")
        whole = i.select("repo", F.col("module").alias("source"), "target", F.lit("imports").alias("kind"), F.lit("static").alias("method")).distinct()
        names = i.where("imported not in ('*', 'default')").select("repo", "module", F.col("target").alias("m"), F.col("imported").alias("name"))
        n = names.join(self.named_or_submodule.select("repo", F.col("module").alias("m"), "name", "hit"), ["repo", "m", "name"], "left").join(self.unique.withColumnRenamed("hit", "anywhere"), ["repo", "name"], "left")
        n = n.withColumn("target", F.coalesce("hit", "anywhere")).where("target is not null")
        at = self.symbols.groupBy("repo", F.col("qname").alias("target")).agg(F.min("module").alias("at"))
        n = n.join(at, ["repo", "target"], "left").select("repo", F.col("module").alias("source"), "target", F.lit("imports").alias("kind"), F.when(F.col("at") == F.col("m"), "import").otherwise("global").alias("method"))
        return whole.unionByName(n).distinct()

    def meanings(self, names: DataFrame) -> DataFrame:
        """For each distinct (repo, module, first) of `names` what the name means there: `own` (the one symbol of the module),
        `m, imported` (what an import binds it to), `named` (the symbol that import names), `named_any` and `any` (the
        one symbol of that name anywhere)."""
        own = self.in_module.where("n = 1").select("repo", "module", F.col("name").alias("first"), F.col("hit").alias("own"))
        bound = self.bound.select("repo", "module", F.col("local").alias("first"), F.col("target").alias("m"), "imported", F.when(~F.col("imported").isin("*", "default"), F.col("imported")).alias("what"))
        n = names.select("repo", "module", "first").distinct().join(own, ["repo", "module", "first"], "left").join(bound, ["repo", "module", "first"], "left")
        n = n.join(self.named_or_submodule.select("repo", F.col("module").alias("m"), F.col("name").alias("what"), F.col("hit").alias("named")), ["repo", "m", "what"], "left")
        n = n.join(self.unique.select("repo", F.col("name").alias("what"), F.col("hit").alias("named_any")), ["repo", "what"], "left")
        return n.join(self.unique.select("repo", F.col("name").alias("first"), F.col("hit").alias("any")), ["repo", "first"], "left")

    def _best(self, rows: DataFrame, candidates: Column) -> DataFrame:
        """`repo, id, rank, hit, method`: the least of each row's candidates that is a known symbol."""
        c = rows.select("repo", "id", F.inline(candidates)).where("qname is not null").join(self.known.select("repo", "qname"), ["repo", "qname"])
        return c.groupBy("repo", "id").agg(F.min(F.struct("rank", "n", "o", F.col("qname").alias("hit"), "method")).alias("b")).select("repo", "id", "b.rank", "b.hit", "b.method")

    def resolve(self, raw: DataFrame) -> DataFrame:
        """`repo, id, hit, method` of the references that resolve, by every rule but bindings."""
        tail_of = lambda c: F.when(F.col(c).contains("."), F.expr(f"substring({c}, instr({c}, '.') + 1)"))
        r = raw.where("target is not null and target <> ''").withColumns({"first": F.substring_index("target", ".", 1), "rest": tail_of("target"), "parent": F.when(F.col("source").contains("."), F.regexp_replace("source", r"\.[^.]*$", "")).otherwise(F.col("source"))})
        r = r.withColumns({"member": F.substring_index("rest", ".", 1), "tail": tail_of("rest"), "near": F.concat_ws(".", "parent", "first")})
        r = r.join(self.meanings(r), ["repo", "module", "first"], "left").join(self.known.select("repo", F.col("qname").alias("near"), F.lit(True).alias("is_near")), ["repo", "near"], "left")
        # receivers: the enclosing class is the parent, if that is a symbol and no module
        owners = self.known.where("not is_module").select("repo", F.col("qname").alias("parent"), F.lit(True).alias("owned"))
        r = self._with_chain(r.join(owners, ["repo", "parent"], "left"), "parent")
        # same scope, else the one symbol of the module
        local = F.when(F.col("is_near") & (F.col("near") != F.col("source")), F.col("near")).otherwise(F.col("own"))
        one, many = F.col("rest").isNull(), F.col("rest").isNotNull()
        mine, above = many & F.col("owned") & F.col("first").isin(*RECEIVERS), many & F.col("owned") & (F.col("first") == "super")
        member = F.transform("chain", lambda a, i: _candidate(5, 0, i, F.concat(a, F.lit("."), F.col("member")), "same"))
        lists = [
            _one(one, _candidate(10, 0, 0, local, "same")), _one(one, _candidate(20, 0, 0, F.col("named"), "import")), _one(one, _candidate(21, 0, 0, F.col("named_any"), "global")), _one(one, _candidate(30, 0, 0, F.col("any"), "global")),
            F.when(mine, member), F.when(above, F.slice(member, F.lit(2), F.lit(MAX_CHAIN))),
            F.when(F.col("imported") == "*", _below(40, F.col("m"), F.col("rest"), "import")), F.when(F.col("what").isNotNull(), _below(40, F.col("m"), F.concat_ws(".", "what", "rest"), "import")),
            _below(50, local, F.col("rest"), "same"), _below(60, F.col("any"), F.col("rest"), "global"),
        ]
        rules = lambda keep: F.flatten(F.array_compact(F.array(*[x for i, x in enumerate(lists) if keep(i)])))
        best = cut(self._best(r, F.when(one, rules(lambda i: i < 4)).otherwise(rules(lambda i: i >= 4))), "best")
        # a member of a member: below what the member led to, along its own chain
        deep = r.where("owned and tail is not null").where(F.col("first").isin(*RECEIVERS, "super")).select("repo", "id", "tail").join(best.where("rank = 5").select("repo", "id", F.col("hit").alias("at")), ["repo", "id"])
        deeper = self._best(self._with_chain(deep, "at"), self._along(F.lit(4), "tail", "same"))
        return best.join(deeper.select("repo", "id", F.col("hit").alias("_hit")), ["repo", "id"], "left").select("repo", "id", F.coalesce("_hit", "hit").alias("hit"), "method")

    @staticmethod
    def _along(rank: Column, rest: str, method: str) -> Column:
        """Candidates each class of `chain` plus ever fewer of `rest`, the most first, then in the order of the chain."""
        return F.flatten(F.transform("chain", lambda a, i: F.transform(dotted_prefixes(F.col(rest), whole=True), lambda p, k: _candidate(rank, -k, i, F.concat(a, F.lit("."), p), method))))

    def resolve_bound(self, raw: DataFrame, bindings: DataFrame, steps: int = MAX_BINDING_STEPS) -> DataFrame:
        """As `resolve`, with names bound to constructible symbols tried first (method attr). `bindings`: repo, module,
        owner, local, target, annotation, pos; the greatest pos of an owner and name counts. Bindings that refer to other bindings
        are followed `steps` times, or until nothing changes."""
        b = bindings.groupBy("repo", "module", "owner", "local").agg(F.max_by(F.struct("target", "annotation"), "pos").alias("v")).select("repo", "module", "owner", "local", "v.target", "v.annotation")
        b = b.where("target is not null and target <> '' and target <> local").withColumn("id", F.concat_ws(SEP, F.lit("b"), "module", "owner", "local"))
        # a function's targets are seen from the function itself, a class's from a member of it
        classes = self.symbols.where("kind = 'class'").select("repo", F.col("qname").alias("owner"), F.lit(True).alias("_class")).distinct()
        b = b.join(classes, ["repo", "owner"], "left").withColumn("source", F.when(F.col("_class"), F.concat_ws(".", "owner", F.lit("_"))).otherwise(F.col("owner"))).drop("_class")
        b = cut(b, "bindings")
        names = b.where("annotation is not null").select("repo", F.col("id").alias("bid"), "module", "source", F.posexplode(_names("annotation")).alias("k", "target")).withColumn("id", F.concat_ws(SEP, F.lit("t"), "k", "bid"))
        ask, reference = ["repo", "id", "module", "source", "target"], raw.withColumn("id", F.concat_ws(SEP, F.lit("r"), "id"))
        # references, what is bound and the types of parameters go through the rules at once
        hits = cut(self.resolve(reference.select(*ask).unionByName(b.select(*ask)).unionByName(names.select(*ask))), "hits")
        typed = hits.join(names.select("repo", "id", "bid", "k"), ["repo", "id"]).groupBy("repo", F.col("bid").alias("id")).agg(F.min_by("hit", "k").alias("_typed"))
        roots = b.join(hits.select("repo", "id", F.col("hit").alias("_base")), ["repo", "id"], "left").join(typed, ["repo", "id"], "left")
        known = cut(roots.withColumn("base", F.coalesce("_base", "_typed")).drop("_base", "_typed", "annotation").withColumn("root", F.col("base")), "roots")
        for _ in range(steps):
            more = self._bound(b, known).select("repo", "id", F.col("hit").alias("_more"))
            # dotted targets go by bindings first, as references do
            root = F.when(F.col("target").contains("."), F.coalesce("_more", "base")).otherwise(F.coalesce("base", "_more"))
            last, known = known, cut(known.withColumnRenamed("root", "_last").join(more, ["repo", "id"], "left").withColumn("root", root).withColumn("_new", ~F.col("root").eqNullSafe(F.col("_last"))).drop("_more", "_last"), "roots")
            drop(last)
            if known.where("_new").isEmpty():
                break
            known = known.drop("_new")
        bound = cut(self._bound(reference, known).select("repo", "id", "hit", "method"), "attr")
        both = bound.unionByName(hits.where(F.col("id").startswith("r" + SEP)).join(bound, ["repo", "id"], "left_anti"))
        return both.withColumn("id", F.expr("substring(id, 3)"))

    def _bound(self, raw: DataFrame, known: DataFrame) -> DataFrame:
        """References whose longest bound prefix leads to a symbol: owner is the source itself or its enclosing class."""
        r = raw.select("repo", "id", "module", "source", F.split("target", r"\.").alias("parts")).select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
        r = r.select("repo", "id", "module", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("local"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), ".").alias("rest"), F.explode(F.array_distinct(F.array("source", F.regexp_replace("source", r"\.[^.]*$", "")))).alias("owner"))
        r = self._with_chain(r.join(known.where("root is not null").select("repo", "module", "owner", "local", "root"), ["repo", "module", "owner", "local"]), "root")
        whole = F.array(_candidate(-F.col("k"), 0, 0, F.col("root"), "attr"))
        return self._best(r, F.when(F.col("rest") == "", whole).otherwise(self._along(-F.col("k"), "rest", "attr")))


def _names(annotation: str) -> Column:
    from cambium.functions.signature import annotation_candidates

    return annotation_candidates(F.col(annotation))
