"""Problem 2: full hierarchies from parent-child links, cycles told apart.

Leaves are peeled a few rounds, which removes most nodes; pointer doubling on the rest then exposes the cycles in a
number of rounds that grows with the logarithm of the height. With the cycle links cut, every component is a tree
whose Euler tour is ranked by pointer doubling. Entry and exit positions give depth and descendants by arithmetic,
and ancestors and paths by an equi-join over dyadic blocks of the positions. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.plain import blank
from cambium.session import cut, drop

SIBLING_BITS = 16  # siblings are linked in groups of at most 2**16, then group to group


def numbered(keys: DataFrame, *by: str) -> DataFrame:
    """Rows with an increasing integer `id` in the order of `by`: sorted by range, numbered per range. `by` is unique."""
    return cut(keys.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "nodes")


def _peeled(links: DataFrame, rounds: int) -> DataFrame:
    """`links` (child, parent) without what `rounds` removals of childless nodes take away."""
    core = links
    for _ in range(rounds):
        core = core.join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    return core


def cycle_members(links: DataFrame, peel_rounds: int = 2) -> DataFrame:
    """`node, least`: the nodes on cycles of `links` (child, parent; one parent a child) and the least id on theirs."""
    core = cut(_peeled(links, peel_rounds), "core")
    # jump = the ancestor 2**k steps up; nodes that run off a root drop out
    jump, before = core.select(F.col("child").alias("node"), F.col("parent").alias("to")), -1
    while True:
        heads = jump.select(F.col("node").alias("to"), F.col("to").alias("next"))
        after = cut(jump.join(heads, "to").select("node", F.col("next").alias("to")), "jump")
        image = after.agg(F.count_distinct("to")).head()[0]
        drop(jump)
        jump = after
        if image in (0, before):  # the image only shrinks; once it stops, it is exactly the cycle nodes
            break
        before = image
    ring = core.join(jump.select(F.col("to").alias("child")).distinct(), "child", "left_semi")
    walk = cut(ring.select(F.col("child").alias("node"), F.col("parent").alias("to"), F.least("child", "parent").alias("least")), "ring")
    drop(jump)
    while image:
        ahead = walk.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("least").alias("ahead"))
        joined = walk.join(ahead, "to").select("node", F.col("next").alias("to"), F.least("least", "ahead").alias("least"), (F.col("ahead") < F.col("least")).alias("moved"))
        after = cut(joined, "ring")
        moved = after.where("moved").limit(1).count()
        drop(walk)
        walk = after
        if not moved:
            break
    drop(core)
    return walk.select("node", "least")


def _successors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The Euler tour as linked lists, one per tree: `e, next, steps, sum`; node v enters at 2v and leaves at 2v + 1."""
    group = F.shiftright("child", SIBLING_BITS)
    grouped = links.withColumn("g", group)
    inside = Window.partitionBy("parent", "g").orderBy("child")
    firsts = grouped.groupBy("parent", "g").agg(F.min("child").alias("first"), F.max("child").alias("end"))
    across = firsts.select(F.col("end").alias("child"), F.lead("first").over(Window.partitionBy("parent").orderBy("g")).alias("jump"))
    sibling = grouped.withColumn("beside", F.lead("child").over(inside)).join(across, "child", "left").select(F.col("child").alias("id"), "parent", F.coalesce("beside", "jump").alias("beside"))
    eldest = links.groupBy(F.col("parent").alias("id")).agg(F.min("child").alias("eldest"))
    v = nodes.select("id").join(eldest, "id", "left").join(sibling, "id", "left")
    enter = F.struct((F.col("id") * 2).alias("e"), F.coalesce(F.col("eldest") * 2, F.col("id") * 2 + 1).alias("next"), F.lit(1).alias("sum"))
    leave = F.struct((F.col("id") * 2 + 1).alias("e"), F.coalesce(F.col("beside") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(-1).alias("sum"))
    return v.select(F.inline(F.array(enter, leave))).select("e", "next", F.when(F.col("next").isNull(), F.col("e")).alias("tail"), F.lit(1).cast("bigint").alias("steps"), F.col("sum").cast("bigint").alias("sum"))


def _ranked(tour: DataFrame, doublings: int = 2) -> DataFrame:
    """Each element with its list's tail and the count and sum from it to there, by pointer doubling. Every element
    has one predecessor at most, so no key of the joins repeats. `doublings` are joined per written table."""
    ranked = cut(tour, "tour")
    while ranked.where("next is not null").limit(1).count():
        step = ranked
        for _ in range(doublings):
            ahead = step.select(F.col("e").alias("_e"), F.col("next").alias("_next"), F.col("tail").alias("_tail"), F.col("steps").alias("_steps"), F.col("sum").alias("_sum"))
            step = step.join(ahead, F.col("next") == F.col("_e"), "left").select("e", F.col("_next").alias("next"), F.coalesce("tail", "_tail").alias("tail"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), (F.col("sum") + F.coalesce("_sum", F.lit(0))).alias("sum"))
        after = cut(step, "tour")
        drop(ranked)
        ranked = after
    return ranked


def hierarchy(links: DataFrame, scope: Column, child: Column, parent: Column) -> DataFrame:
    """One row per (scope, node) of `links`: `scope, node, root, depth, cyclic, tree, entry, exit, descendants`.

    * root, depth: the node's root and the number of links to it. A node on a cycle or leading into one is cyclic,
      has depth -1 and as root the least node (by code point) of that cycle.
    * tree, entry, exit: a is an ancestor of b exactly if they share `tree` and a.entry < b.entry < b.exit <= a.exit.
      In a cyclic component each cycle node starts a tree of its own.
    * descendants: how many nodes lie below it in its tree.

    Rows with a null or empty scope, child or parent are left out, repeated rows count once; a child with several
    parents keeps the least. No rows in, no rows out. Other columns of `links` don't matter.
    """
    pairs = links.select(scope.alias("scope"), child.alias("child"), parent.alias("parent")).where(~(blank(F.col("scope")) | blank(F.col("child")) | blank(F.col("parent"))))
    pairs = cut(pairs.groupBy("scope", "child").agg(F.min("parent").alias("parent")), "links")
    ends = pairs.select("scope", F.explode(F.array("child", "parent")).alias("node"))
    nodes = numbered(ends.distinct(), "scope", "node")
    a, b = (nodes.select("scope", F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in ("child", "parent"))
    ids = cut(pairs.join(a, ["scope", "child"]).join(b, ["scope", "parent"]).select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent")), "ids")
    rings = cycle_members(ids)
    trees = ids.join(rings.select(F.col("node").alias("child")), "child", "left_anti")
    ranked = _ranked(_successors(nodes, trees))
    # an entry's distance to the tail falls along the tour; summed from the entry on, weights give minus its depth
    end = ranked.where("e % 2 = 0").select(F.expr("e div 2").alias("id"), F.expr("tail div 2").alias("tree"), F.col("steps").alias("to_end"), (-F.col("sum")).alias("depth"))
    out = ranked.where("e % 2 = 1").select(F.expr("e div 2").alias("id"), F.col("steps").alias("out_end"))
    placed = end.join(out, "id").join(rings.select(F.col("node").alias("tree"), "least"), "tree", "left")
    names = nodes.select(F.col("id").alias("root_id"), F.col("node").alias("root"))
    return (
        nodes.join(placed, "id")
        .withColumn("root_id", F.coalesce("least", "tree"))
        .join(names, "root_id")
        .select("scope", "node", "root", F.when(F.col("least").isNotNull(), -1).otherwise(F.col("depth")).cast("bigint").alias("depth"), F.col("least").isNotNull().alias("cyclic"), "tree", (-F.col("to_end")).alias("entry"), (-F.col("out_end")).alias("exit"), F.expr("(to_end - out_end - 1) div 2").alias("descendants"))
    )


def ancestor_pairs(placed: DataFrame, levels: int = 62) -> DataFrame:
    """`tree, node, ancestor, entry`: all ancestor-descendant pairs of `hierarchy` rows, an ancestor per row.

    An interval of positions is a disjoint union of dyadic blocks, at most two a level; a position lies in one block
    of each level. So the containment test is an equality of (tree, level, block), no pairs are tried in vain, and
    each true pair is found once. 62 levels hold every position a
    number of 64 bits can give."""
    p = placed.select("tree", "node", "entry", "exit", "descendants")
    # positions count from the end: entry < exit <= -1; shifted to non-negative by taking the distance
    inner = p.select("tree", F.col("node").alias("ancestor"), F.col("entry").alias("a_entry"), (-F.col("exit") + 1).alias("lo"), (-F.col("entry")).alias("hi"), "descendants").where("descendants > 0")  # distances of the entries below it: lo <= d < hi
    low, high = "shiftright(lo + shiftleft(1L, l) - 1L, l)", "shiftright(hi, l)"
    blocks = F.expr(
        f"""flatten(transform(sequence(0, {levels}), l -> array_compact(array(
            if({low} < {high} and ({low} & 1L) = 1L, named_struct('level', l, 'block', {low}), null),
            if({low} < {high} and ({high} & 1L) = 1L, named_struct('level', l, 'block', {high} - 1L), null)))))"""
    )
    pieces = inner.select("tree", "ancestor", "a_entry", F.inline(F.array_distinct(blocks)))
    height = F.greatest(F.lit(1), F.ceil(F.log2(F.max("hi") + 1)) + 1)
    top = inner.groupBy("tree").agg(F.least(height, F.lit(levels)).cast("int").alias("top"))
    points = p.select("tree", "node", "entry", (-F.col("entry")).alias("d")).join(top, "tree").select("tree", "node", "entry", F.inline(F.expr("transform(sequence(0, top), l -> named_struct('level', l, 'block', shiftright(d, l)))")))
    return points.join(pieces, ["tree", "level", "block"]).select("tree", "node", "ancestor", "entry", "a_entry")


def paths(placed: DataFrame, separator: str = " > ") -> DataFrame:
    """`scope, node, path`: names from the root (or the cycle node the tree hangs on) to the node."""
    above = ancestor_pairs(placed).groupBy("tree", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("a_entry", "ancestor"))), lambda s: s["ancestor"]).alias("above"))
    joined = placed.select("scope", "tree", "node").join(above, ["tree", "node"], "left")
    return joined.select("scope", "node", F.concat_ws(separator, "above", "node").alias("path"))
