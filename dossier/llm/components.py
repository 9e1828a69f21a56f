"""Connected components of an edge table, by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, space: Workspace, limit: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches, itself included.

    Repeated edges, loops and both directions are allowed; edges with a null end are ignored; an empty table gives an empty
    table. Every pass lowers labels to those of the neighbours and then follows each label once, so paths shrink at least by half.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = space.save(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = space.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(limit):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("got")), "b").groupBy(F.col("a").alias("node")).agg(F.min("got").alias("got"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "got").alias("component"))
        lower = space.save(lower, "lowered")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = space.save(lower.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        changed = after.where("was <> component").limit(1).count()
        for old in (labels, lower):
            space.drop(old)
        labels = after
        if not changed:
            return labels.select("node", "component")
    raise RuntimeError(f"no fixed point after {limit} passes")
