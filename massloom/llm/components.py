"""Groups of records that are linked directly or through others, by deterministic Borůvka hooking.

Each round every component takes its smallest outgoing edge, which makes trees; pointer doubling collapses them; the edges get the roots
as ends, and those within a tree or doubled go. Rounds end when no edge is left: at most the binary logarithm of the number of
components, since each round at least halves those that have an edge. Edges are ordered by smaller end, then larger end; with that
order the root of a tree, the smaller end of its mutual pair, is the tree's smallest label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import materialize


def _hooks(edges: DataFrame) -> DataFrame:
    """(label, parent) of every component with an edge; of two that chose each other the smaller is a root."""
    both = edges.select(F.col("u").alias("label"), F.col("u").alias("lo"), F.col("v").alias("hi")).unionByName(edges.select(F.col("v").alias("label"), F.col("u").alias("lo"), F.col("v").alias("hi")))
    least = both.groupBy("label").agg(F.min(F.struct("lo", "hi")).alias("edge"))
    return least.select("label", F.when(F.col("edge.lo") == F.col("label"), F.col("edge.hi")).otherwise(F.col("edge.lo")).alias("parent"))


def _doubled(pointers: DataFrame, first: bool = False) -> DataFrame:
    """Each label's grandparent as its parent, with `moved` where that made a difference."""
    up = pointers.select(F.col("label").alias("at"), F.col("parent").alias("above"))
    joined = pointers.join(up, F.col("parent") == F.col("at"))
    if first:
        mutual = F.col("above") == F.col("label")
        to = F.when(mutual, F.least("label", "parent")).otherwise(F.col("above"))
        return joined.select("label", to.alias("parent"), F.lit(True).alias("moved"))
    return joined.select("label", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))


def _roots(edges: DataFrame) -> DataFrame:
    """(label, parent) with every parent a root."""
    hooks = materialize(_hooks(edges), "hooks")
    pointers = materialize(_doubled(hooks, first=True), "pointers")
    while True:
        pointers = materialize(_doubled(_doubled(pointers)), "pointers")
        if pointers.filter("moved").isEmpty():
            return pointers.drop("moved")


def _relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    a = roots.select(F.col("label").alias("u"), F.col("parent").alias("ru"))
    b = roots.select(F.col("label").alias("v"), F.col("parent").alias("rv"))
    ends = edges.join(a, "u").join(b, "v").filter("ru != rv")
    return ends.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()


def connected_groups(nodes: DataFrame, pairs: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, group_id) for each distinct value of `node`, with the smallest value of its group.

    `pairs` links `a` and `b`; both ends have to be among the nodes. Nulls, pairs of a value with itself, repeated and reversed pairs add
    nothing. Values order by code points. Hot ends are pre-aggregated (the smallest edge is a partial minimum), and what a join of a hot end
    reads is split by adaptive execution. Each round is written to the shared folder, so lineage stays short and executors may be lost.
    """
    ends = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(ends.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        roots = _roots(edges)
        rounds.append(roots)
        edges = materialize(_relabelled(edges, roots), "edges")
    # A root of one round is a label of the next unless it was complete: composed from the last round back, each round's rows are read once.
    group: DataFrame | None = None
    for roots in reversed(rounds):
        if group is None:
            group = roots
        else:
            later = group.select(F.col("label").alias("at"), F.col("parent").alias("above"))
            group = roots.join(later, F.col("parent") == F.col("at"), "left").select("label", F.coalesce("above", "parent").alias("parent"))
    every = nodes.filter(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct()
    if group is None:
        return every.select("node", F.col("node").alias("group_id"))
    return every.join(group, F.col("node") == F.col("label"), "left").select("node", F.coalesce("parent", "node").alias("group_id"))
