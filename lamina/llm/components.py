"""Connected components of a graph held in tables: hooking to the least neighbour, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, root for every node of edges (a, b), root being the least node it is connected with; null ends are ignored.

    Every round writes its tables, so lineage stays short and a lost executor costs a task, and drops those of the round
    before. Joins run between written tables, where a hub's rows can be split over tasks; minima are combined before they
    are shuffled. The result belongs to `tables`, or without them outlives the call.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    with Tables(edges.sparkSession) as t:
        left = t.write(edges.where("a is not null and b is not null and a != b").select(least.alias("a"), most.alias("b")).distinct(), "edges")
        roots = None
        while True:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            parents = t.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents")
            while True:  # pointers only ever lead to lesser nodes, so this ends at fixed points
                up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
                jumped = t.write(parents.join(up, "parent").select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")), "jump")
                t.drop(parents)
                parents = jumped
                if jumped.where("moved").isEmpty():
                    break
            if roots is None:
                now = t.write(parents.select("node", F.col("parent").alias("root")), "roots")
            else:
                to = parents.select(F.col("node").alias("root"), "parent")
                now = t.write(roots.join(to, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
                t.drop(roots)
            roots = now
            half = left.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            full = half.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").where("pa != pb")
            rest = t.write(full.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
            t.drop(left, parents)
            left = rest
            if left.isEmpty():
                return tables.write(roots, "components") if tables else t.keep(roots, "components")
