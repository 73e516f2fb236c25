"""Hierarchies: closure tables, nearest members, group assignment, edge chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut, joined, union_all


def transitive_closure(edges: DataFrame, max_depth: int | None = None, include_self: bool = True,
                       child: str = "child", parent: str = "parent") -> DataFrame:
    """`(id, ancestor, dist)` of a DAG, `dist` being the shortest path length.

    Paths double in length each round, so a hierarchy of depth d takes log2(d) rounds. Each round is written to the
    shared folder; the loop stops when a round adds no pair.
    """
    base = (
        edges.select(F.col(child).alias("id"), F.col(parent).alias("ancestor"))
        .where("id is not null and ancestor is not null and id <> ancestor")
        .distinct().withColumn("dist", F.lit(1))
    )
    known = cut(base, "closure")
    size, reach = known.count(), 1
    while size and (max_depth is None or reach < max_depth):
        left = known.select("id", F.col("ancestor").alias("mid"), F.col("dist").alias("d1"))
        right = known.select(F.col("id").alias("mid"), "ancestor", F.col("dist").alias("d2"))
        longer = left.join(right, "mid").select("id", "ancestor", (F.col("d1") + F.col("d2")).alias("dist"))
        if max_depth is not None:
            longer = longer.where(F.col("dist") <= max_depth)
        grown = cut(
            known.unionByName(longer).where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("dist").alias("dist")),
            "closure",
        )
        new_size = grown.count()
        known, reach = grown, reach * 2
        if new_size == size:
            break
        size = new_size
    if not include_self:
        return known
    members = edges.select(F.col(child).alias("id")).union(edges.select(F.col(parent))).where("id is not null").distinct()
    return known.unionByName(members.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("dist")))


def with_self(closure: DataFrame, ids: DataFrame) -> DataFrame:
    """Closure extended by the self pairs of `ids`, for ids that have no hierarchy edge at all."""
    lone = ids.select("id").distinct().join(closure.where("dist = 0").select("id"), "id", "left_anti")
    return closure.unionByName(lone.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("dist")))


def nearest_in_set(edges: DataFrame, members: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """`(id, ancestor)`: for every member, its nearest ancestors that are members, reached through outsiders only."""
    inside = members.select(F.col("id").alias("next"), F.lit(True).alias("inside")).distinct()
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("next")).distinct().join(inside, "next", "left")
    front = members.select("id", F.col("id").alias("node")).distinct()
    hits, walked = [], None
    while True:
        hop = cut(front.join(step, "node").select("id", F.col("next").alias("node"), "inside").distinct(), "nearest")
        hits.append(hop.where("inside").select("id", F.col("node").alias("ancestor")))
        fresh = hop.where("inside is null").select("id", "node")
        if walked is not None:
            fresh = fresh.join(walked, ["id", "node"], "left_anti")
        front = cut(fresh, "nearest")
        if front.isEmpty():
            return union_all(hits).distinct()
        walked = front if walked is None else cut(walked.unionByName(front), "nearest")


def assign_groups(closure: DataFrame, roots: DataFrame, bridge_roots: DataFrame, deprecated: DataFrame | None = None,
                  bridge: str = "bridge") -> DataFrame:
    """`(id, grp, is_bridge)`: the groups whose root is an ancestor-or-self, several joined with a bar.

    `roots(root, name)`; `bridge_roots(root)`. Members under no group root that are themselves bridge roots get the
    bridge label. Deprecated ids are dropped.
    """
    named = (
        closure.join(roots.withColumnRenamed("root", "ancestor"), "ancestor")
        .groupBy("id").agg(joined(F.collect_set("name")).alias("grp"))
    )
    under = closure.join(bridge_roots.withColumnRenamed("root", "ancestor"), "ancestor").select("id").distinct()
    under = under.withColumn("is_bridge", F.lit(True))
    all_ids = named.select("id").union(bridge_roots.select(F.col("root").alias("id"))).distinct()
    out = (
        all_ids.join(named, "id", "left").join(under, "id", "left")
        .select("id", F.coalesce("grp", F.lit(bridge)).alias("grp"), F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"))
    )
    return out if deprecated is None else out.join(deprecated.select("id"), "id", "left_anti")


def ancestor_paths(pairs: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """`(id, ancestor, path)`: the shortest chain of edge ids from `id` up to `ancestor`; smallest chain on a tie.

    `edges(child, parent, edge_id)`. Only nodes that lie below the wanted ancestor are walked, one level per round.
    """
    target = pairs.select("id", "ancestor").distinct()
    below = closure.select(F.col("id").alias("node"), "ancestor", F.col("dist").alias("left"))
    up = edges.select(F.col("child").alias("node"), F.col("parent").alias("next"), "edge_id")
    front = (
        target.join(below.withColumnRenamed("node", "id"), ["id", "ancestor"])
        .select("id", "ancestor", F.col("id").alias("node"), "left", F.array().cast("array<string>").alias("path"))
    )
    done = None
    while True:
        front = cut(front, "path")
        arrived = front.where("left = 0").select("id", "ancestor", "path")
        done = arrived if done is None else done.unionByName(arrived)
        rest = front.where("left > 0")
        if rest.isEmpty():
            return done
        walked = (
            rest.withColumnRenamed("left", "was").join(up, "node")
            .select("id", "ancestor", F.col("next").alias("node"), "was", F.concat("path", F.array("edge_id")).alias("path"))
            .join(below, ["node", "ancestor"]).where("left = was - 1")
            .select("id", "ancestor", "node", "left", "path")
        )
        front = walked.groupBy("id", "ancestor", "node").agg(F.min("left").alias("left"), F.min("path").alias("path"))
