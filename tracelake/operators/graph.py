"""Process graphs: nodes, parent edges, ancestry, activity and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..storage import written


def nodes(creates: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, diagnostics): keys created once are nodes; missing and conflicting keys are diagnosed."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    good = creates.filter(~missing)
    n = good.groupBy(*keys).agg(F.count("*").alias("n_creations"))
    single = good.join(n.filter("n_creations = 1").select(*keys), keys, "left_semi")
    conflict = n.filter("n_creations > 1").withColumn("code", F.lit("conflicting_process_creation"))
    none = creates.filter(missing).groupBy(*keys).agg(F.count("*").alias("n_creations")).withColumn("code", F.lit("missing_process_guid"))
    return single, conflict.unionByName(none)


def parent_edges(nodes_: DataFrame, id_: str, parent: str, ts: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics) of nodes and the ids of their parents.

    A parent must be observed, be another node and not be later. Cycles are then only possible between equal
    timestamps; of each, the edge of the node that comes last in order is dropped.
    """
    child = nodes_.select(F.col(id_).alias("child"), F.col(parent).alias("parent"), F.col(ts).alias("child_ts"), F.struct(ts, *order).alias("child_order"))
    known = nodes_.select(F.col(id_).alias("__p"), F.col(ts).alias("parent_ts"))
    looked = child.filter("parent is not null").join(known, F.col("parent") == F.col("__p"), "left")
    orphans = looked.filter("__p is null").select("child", "parent", F.lit("parent_not_observed").alias("code"))
    late = (F.col("parent_ts") > F.col("child_ts")) | (F.col("parent") == F.col("child"))
    wrong = looked.filter(F.col("__p").isNotNull() & late).select("child", "parent", F.lit("invalid_parent_order_or_cycle").alias("code"))
    good = looked.filter(F.col("__p").isNotNull() & ~late).select("child", "parent", "child_ts", "parent_ts", "child_order")
    tied = good.filter("child_ts = parent_ts").select("child", "parent", "child_order")
    closing = _cycle_closers(tied)
    wrong = wrong.unionByName(good.join(closing, "child", "left_semi").select("child", "parent", F.lit("invalid_parent_order_or_cycle").alias("code")))
    return good.join(closing, "child", "left_anti").select("child", "parent"), orphans.unionByName(wrong)


def _cycle_closers(edges: DataFrame) -> DataFrame:
    """The last child, in order, of each cycle of edges with one parent a child.

    Every round doubles how far up a node sees. From that far on all that is reached lies on cycles, and every node of
    a cycle has then seen the whole of it. No chain is written out: a round holds a row for each edge.
    """
    at = edges.select("child", F.col("parent").alias("far"), F.struct("child_order", "child").alias("last"))
    at = written(at.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "cycles")  # a leaf is on none
    n, length = at.count(), 1
    while length <= n:
        up = at.select(F.col("child").alias("far"), F.col("far").alias("farther"), F.col("last").alias("__last"))
        at = written(at.join(up, "far").select("child", F.col("farther").alias("far"), F.greatest("last", "__last").alias("last")), "cycles")
        length *= 2
    return at.join(at.select(F.col("far").alias("child")).distinct(), "child", "left_semi").select(F.col("last.child").alias("child")).distinct()


def _next_siblings(edges: DataFrame, cells: int = 256) -> DataFrame:
    """(parent, node, next): the children of each parent as a list; next is null for the last one. A parent's children are dealt into cells."""
    dealt = edges.withColumn("cell", F.pmod(F.xxhash64("node"), F.lit(cells)))
    firsts = dealt.groupBy("parent", "cell").agg(F.min("node").alias("first"))
    after = firsts.select("parent", "cell", F.lead("first").over(Window.partitionBy("parent").orderBy("cell")).alias("next_cell"))
    own = Window.partitionBy("parent", "cell").orderBy("node")
    listed = dealt.withColumn("__next", F.lead("node").over(own)).join(after, ["parent", "cell"])
    return listed.select("parent", "node", F.coalesce("__next", "next_cell").alias("next"))


def positions(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, enter, leave) of every node of a forest: a node is below another if its interval lies inside the other's.

    A walk around each tree comes to every node twice, downwards and upwards. Its steps form a list, and each step's place in it is
    found by pointer jumping: the links double in length every round, with a row for each step, however deep a tree is. A step
    that sees the end takes no further part, so no two steps ever ask for the same one. Edges must be without repeats and cycles.
    """
    edges = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("parent")), "edges")
    siblings = _next_siblings(edges)
    first = siblings.join(siblings.select("parent", F.col("next").alias("node")), ["parent", "node"], "left_anti").select(F.col("parent").alias("node"), F.col("node").alias("first_child"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    nodes = siblings.select("node", "parent", "next").unionByName(roots, allowMissingColumns=True)
    step = lambda node, up: F.struct(node.alias("node"), F.lit(up).alias("up"))
    down = nodes.join(first, "node", "left").select(step(F.col("node"), False).alias("step"), F.coalesce(F.when(F.col("first_child").isNotNull(), step(F.col("first_child"), False)), step(F.col("node"), True)).alias("far"))
    up = nodes.select(step(F.col("node"), True).alias("step"), F.coalesce(F.when(F.col("next").isNotNull(), step(F.col("next"), False)), F.when(F.col("parent").isNotNull(), step(F.col("parent"), True))).alias("far"))
    # The last step of a walk, upwards from its root, leads nowhere.
    walk = written(down.union(up).withColumn("length", F.when(F.col("far").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")), "walks")
    ends = walk.filter("far is null").select(F.col("step").alias("far"), F.lit(True).alias("over"))
    walk = written(walk.join(ends, "far", "left").withColumn("over", F.coalesce("over", F.col("far").isNull())), "walks")
    while not walk.filter("not over").isEmpty():
        there = walk.select(F.col("step").alias("far"), F.col("far").alias("farther"), F.col("length").alias("more"), F.col("over").alias("at_end"))
        going = walk.filter("not over").join(there, "far").select("step", F.col("farther").alias("far"), (F.col("length") + F.col("more")).alias("length"), F.col("at_end").alias("over"))
        walk = written(walk.filter("over").select("step", "far", "length", "over").unionByName(going), "walks")
    root = F.coalesce(F.col("far.node"), F.col("step.node"))
    placed = walk.groupBy(F.col("step.node").alias("node")).agg(F.first(root).alias("root"), F.max(F.when(~F.col("step.up"), -F.col("length"))).alias("enter"), F.max(F.when(F.col("step.up"), -F.col("length"))).alias("leave"))
    return placed


def below(node: str, other: str) -> Column:
    """Whether the row's ``node`` (enter and leave with that prefix) lies below its ``other``, given that the roots agree."""
    return (F.col(f"{other}enter") < F.col(f"{node}enter")) & (F.col(f"{node}leave") < F.col(f"{other}leave"))


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) of all chains of parents, however long. Each pair once, at its least depth.

    A node on a cycle is its own ancestor. Chains double in length with each round: those of exactly ``length``
    are continued by all known ones, until there are none of that length, so there is none beyond it either.
    """
    reach = written(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct(), "ancestors")
    length = 1
    while True:
        far = reach.filter(F.col("depth") == length).select("node", F.col("ancestor").alias("__via"))
        if far.isEmpty():
            return reach
        above = reach.select(F.col("node").alias("__via"), "ancestor", (F.col("depth") + length).alias("depth"))
        longer = far.join(above, "__via").select("node", "ancestor", "depth")
        reach = written(reach.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
        length *= 2


def attach(nodes_: DataFrame, activity: DataFrame, keys: list[str], node_ts: str, activity_ts: str) -> tuple[DataFrame, DataFrame]:
    """(activity with its node, activity without one): equal keys and no earlier than the node."""
    n = nodes_.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(node_ts).alias("__nts"), F.struct(*nodes_.columns).alias("node"))
    same = F.col(activity_ts) >= F.col("__nts")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    joined = activity.join(n, same, "left")
    drop = [f"__{k}" for k in keys] + ["__nts"]
    return joined.filter("node is not null").drop(*drop), joined.filter("node is null").drop(*drop, "node").withColumn("code", F.lit("unjoined_process_activity"))


def next_start(df: DataFrame, keys: list[str], ts: str, order: list[str], out: str = "next_ts") -> DataFrame:
    """Adds the timestamp at which the key's next row begins."""
    own = Window.partitionBy(*keys).orderBy(micros(F.col(ts)), *[F.col(c) for c in order])
    return df.withColumn(out, F.lead(ts).over(own))


def staged_chain(start: DataFrame, stages: list[tuple[str, DataFrame]], key: str, uid: str, ts: str, within: int) -> DataFrame:
    """start with, for each stage in turn, the first of its rows of the same key in the ``within`` seconds after the stage before.

    Stages are (name, rows); the result has <name>_uid and <name>_ts, null from the first stage that is missing.
    """
    from .joins import interval_join

    out, last, at = start, uid, ts
    for name, rows in stages:
        there = rows.select(F.col(key).alias("__k"), F.col(uid).alias("__u"), F.col(ts).alias("__ts"))
        pairs = interval_join(out.select(F.col(uid).alias("__own"), F.col(key).alias("__key"), F.col(at).alias("__at"), F.col(last).alias("__last")).filter("__at is not null"), there, [("__key", "__k")], "__at", "__ts", 0, within, F.col("__u") != F.col("__last"))
        first = pairs.groupBy("__own").agg(F.min(F.struct("__ts", "__u")).alias("__f"))
        out = out.join(first, F.col(uid) == F.col("__own"), "left").withColumn(f"{name}_uid", F.col("__f.__u")).withColumn(f"{name}_ts", F.col("__f.__ts")).drop("__own", "__f")
        last, at = f"{name}_uid", f"{name}_ts"
    return out


def missing_stages(names: list[str]) -> Column:
    """The names of the stages without a row, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"{n}_uid").isNull(), F.lit(n)) for n in names])))
