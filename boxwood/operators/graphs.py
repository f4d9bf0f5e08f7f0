"""Graphs: components over shared names, frequent labelled paths, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _jump(parents: DataFrame) -> DataFrame:
    """Each node's grandparent; a parent without a row of its own is a root."""
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))


def _relabel(edges: DataFrame, parents: DataFrame) -> DataFrame:
    a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
    b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    moved = edges.join(a, "a").join(b, "b").where("pa <> pb")
    return moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, component): the least node reachable, for edges (a, b) of one orderable type.

    By repeated contraction: each round every node takes the least of itself and its neighbours as
    its parent, chains of parents are shortened by pointer jumping, and edges move to the parents.
    Nothing is gathered: the minimum is a partial aggregate, and the joins read written tables, so
    that a node with very many edges is split by the adaptive skew join. Loops and rows with a null
    are dropped, repeated edges count once; an empty table gives an empty table.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent")))
        for _ in range(jumps):
            parents = materialise(_jump(parents))
        levels.append(parents)
        edges = materialise(_relabel(edges, parents))
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # The last level's parents are roots or lead to roots by that level alone.
    found = levels[-1]
    for below in reversed(levels[:-1]):
        up = found.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        found = materialise(below.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")))
    return found.select("node", F.col("parent").alias("component"))


def share_a_name(rows: DataFrame, key: str, names: str) -> DataFrame:
    """(key, component) of rows linked by a common name in their arrays: each name links all its
    rows to its least one, so a common name gives as many edges as it has rows."""
    own = rows.select(F.col(key).alias("k"), F.explode(names).alias("name")).distinct()
    first = own.groupBy("name").agg(F.min("k").alias("a"))
    found = components(own.join(first, "name").select("a", F.col("k").alias("b")))
    return rows.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def frequent_paths(vertices: DataFrame, edges: DataFrame, least: int, longest: int = 4) -> DataFrame:
    """(pattern, vertices, support) of labelled directed paths in at least ``least`` graphs.

    vertices: graph, id, label; edges: graph, src, dst, label. Longer paths grow from frequent
    ones only (a path is no commoner than its parts), one equi-join a step.
    """
    v = vertices.select("graph", "id", "label")
    step = edges.select("graph", "src", "dst", F.col("label").alias("by"))
    step = step.join(v.select("graph", F.col("id").alias("src"), F.col("label").alias("from")), ["graph", "src"]).join(v.select("graph", F.col("id").alias("dst"), F.col("label").alias("to")), ["graph", "dst"])
    step = materialise(step)
    paths = step.select("graph", F.array("src", "dst").alias("ids"), F.concat("from", F.lit(" -"), "by", F.lit("-> "), "to").alias("pattern"))
    out = None
    for n in range(2, longest + 1):
        paths = materialise(paths)
        frequent = materialise(paths.groupBy("pattern").agg(F.count_distinct("graph").alias("support")).where(F.col("support") >= least))
        found = frequent.select("pattern", F.lit(n).cast("long").alias("vertices"), "support")
        out = found if out is None else out.unionByName(found)
        if n == longest or frequent.isEmpty():
            break
        grow = paths.join(frequent.select("pattern"), "pattern", "left_semi").withColumn("src", F.element_at("ids", -1)).join(step, ["graph", "src"])
        grow = grow.where(~F.array_contains("ids", F.col("dst")))
        paths = grow.select("graph", F.concat("ids", F.array("dst")).alias("ids"), F.concat("pattern", F.lit(" -"), "by", F.lit("-> "), "to").alias("pattern"))
    return out


def closed(patterns: DataFrame) -> DataFrame:
    """Patterns without a longer one that begins or ends with them and has the same support."""
    longer = patterns.select(F.col("pattern").alias("long"), F.col("vertices").alias("n"), "support")
    head = longer.withColumn("part", F.regexp_replace("long", r" -[^>]*-> [^>]*$", ""))
    tail = longer.withColumn("part", F.regexp_replace("long", r"^.*?-> ", ""))
    covered = head.unionByName(tail).select(F.col("part").alias("pattern"), "support", (F.col("n") - 1).alias("vertices")).distinct()
    return patterns.join(covered, ["pattern", "support", "vertices"], "left_anti")


def check_hierarchy(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(check, broken): depth one below the parent, parents exist, members are in the parent too,
    siblings share no member, every node is reached from a root (none in a cycle is). nodes: id,
    parent, depth; members: id, member."""
    up = nodes.select(F.col("id").alias("parent"), F.col("depth").alias("above"))
    below = nodes.where("parent IS NOT NULL")
    missing = below.join(up, "parent", "left_anti").agg(F.count("*").alias("broken"))
    depth = below.join(up, "parent").where("depth <> above + 1").agg(F.count("*").alias("broken"))
    own = members.join(below.select("id", "parent"), "id")
    outside = own.join(members.select(F.col("id").alias("parent"), "member"), ["parent", "member"], "left_anti").agg(F.count("*").alias("broken"))
    shared = own.groupBy("parent", "member").agg(F.count_distinct("id").alias("n")).where("n > 1").agg(F.count("*").alias("broken"))
    reached = materialise(nodes.where("parent IS NULL").select("id"))
    level = reached
    while not level.isEmpty():  # one round a level of the hierarchy; what is reached isn't again
        level = materialise(below.join(level.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id").join(reached, "id", "left_anti").distinct())
        reached = materialise(reached.unionByName(level))
    lost = nodes.join(reached, "id", "left_anti").agg(F.count("*").alias("broken"))
    out = None
    for name, df in (("reachable", lost), ("parent_exists", missing), ("depth", depth), ("containment", outside), ("disjoint_siblings", shared)):
        one = df.select(F.lit(name).alias("check"), "broken")
        out = one if out is None else out.unionByName(one)
    return out
