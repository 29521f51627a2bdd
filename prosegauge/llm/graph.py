"""Connected components of an edge table, by contraction.

Each round hooks every node to its neighbour with the least hash, if that is less than the node's own; relabels the
edges by the hooks and drops loops and repeats; what is left has fewer nodes, and rounds end when no edge is left.  The
hash has another seed each round, so a chain loses a share of its nodes a round, in whatever order they are numbered:
the number of rounds grows with the logarithm of the longest path.  Hooks are followed back at the end.  A node's
neighbours are only ever aggregated to one of them (with partial sums first), never gathered, so a hub costs no
more than its edges.  Every round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``edges`` (a, b: long, null-free) to node and root: one node of its component, the same for all of it.  Nodes
    without edges do not appear.  ``rounds``: gets the number of rounds."""
    edges = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, seed=len(hooks): F.xxhash64(F.lit(seed), F.col(c))
        both = edges.select("a", "b").union(edges.select("b", "a")).withColumn("_h", order("b"))
        near = both.groupBy("a").agg(F.min_by("b", "_h").alias("_b"), F.min("_h").alias("_h"))
        hook = save(near.select(F.col("a").alias("node"), F.when(F.col("_h") < order("a"), F.col("_b")).otherwise(F.col("a")).alias("root")), "hooks")
        hooks.append(hook)
        moved = edges.join(hook.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(hook.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        edges = save(moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if rounds is not None:
        rounds.append(len(hooks))
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0]
    for hook in hooks[1:]:  # a root that later rounds do not know has kept its label
        later = hook.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = save(out.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "labels")
    return out
