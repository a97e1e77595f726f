"""Connected components by contraction, for the operators that link rows or templates.

Each round every node points to the smallest of itself and its neighbours, chains
of pointers are followed to their ends, and edges are rewritten to the ends; edges
inside one component vanish. A round at least halves the nodes that still have
edges, so rounds grow with the logarithm of the largest component, also for long
chains. All tables are written in the shared work folder between rounds, minima
are combined before they are shuffled, and the joins have one row a node on one
side, so a hub is split by the planner. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from loomline.session import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, the smallest node that each
    node reaches; only for nodes with an edge to another node."""
    work = _observed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                     .filter("a < b").distinct(), "edges")
    labels: DataFrame | None = None
    while work[1]:
        current = work[0]
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _follow(stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                              .select("node", F.least("node", "b").alias("component")), "parents"))
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("node").alias("component"), F.col("component").alias("to"))
            fresh = stage(labels.join(moved, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")), "labels")
            release(labels)
            labels = fresh
        left = roots.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        work = _observed(
            current.join(left, "a").join(right, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .filter("a < b").distinct(), "edges")
        release(current)
    if labels is None:
        return work[0].select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _observed(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    rows = Observation()
    written = stage(df.observe(rows, F.count(F.lit(1)).alias("n")), label)
    return written, rows.get["n"]


def _follow(pointers: DataFrame) -> DataFrame:
    """Pointers to smaller nodes, followed to their ends by doubling."""
    while True:
        onward = pointers.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = Observation()
        doubled = stage(
            pointers.join(onward, "component")
            .observe(moved, F.count_if(F.col("next") != F.col("component")).alias("n"))
            .select("node", F.col("next").alias("component")), "pointers")
        release(pointers)
        pointers = doubled
        if not moved.get["n"]:
            return pointers
