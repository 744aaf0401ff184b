"""Trees of experiments: levels, the path to the best one, and proposals that were made before.

Nodes are rows (id, parent_id). A node whose parent is null or isn't there is a root. Levels and paths are found by pointer doubling: each
round joins every node's ancestor with that one's own, so a tree of any depth takes as many rounds as its depth has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.position import with_pos
from millrace.sources.files import json_lines
from millrace.tables import cut, drop


def _links(nodes: DataFrame) -> DataFrame:
    """(id, up): each node and its parent, null for roots. Of no root at all, the smallest id is one."""
    pairs = nodes.groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    there = pairs.select(F.col("id").alias("_there"))
    links = pairs.join(there, F.col("parent_id") == F.col("_there"), "left").select("id", F.col("_there").alias("up"))
    links = cut(links, "tree-links")
    if links.where("up is null").head(1):
        return links
    least = links.agg(F.min("id").alias("_least"))  # one row
    return links.join(F.broadcast(least)).select("id", F.when(F.col("id") != F.col("_least"), F.col("up")).alias("up"))


def levels(nodes: DataFrame) -> DataFrame:
    """(id, root, depth) of nodes (id, parent_id): depth is 0 for roots. Nodes that hang on a cycle, and those on it, have no root and are left out;
    if nothing but such nodes is there, the smallest id counts as a root, and the cycle is cut before it.

    An id that is there twice has its smallest parent. Each round reads and writes one row a node; what the driver sees is how many
    are still on their way.
    """
    links = _links(nodes)
    # top: the ancestor reached so far, depth links above; over: is it a root.
    now = cut(links.select("id", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("over")), "tree-levels")
    left = now.where("not over").count()
    while left:
        above = now.select(F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("over").alias("_over"))
        moved = now.join(above, now["top"] == above["_id"])
        over, depth = F.col("over") | F.col("_over"), F.when(F.col("over"), F.col("depth")).otherwise(F.col("depth") + F.col("_depth"))
        step = cut(moved.select("id", F.when(F.col("over"), F.col("top")).otherwise(F.col("_top")).alias("top"), depth.alias("depth"), over.alias("over")), "tree-levels")
        drop(now)
        now, before, left = step, left, step.where("not over").count()
        if left == before:  # some node arrives in every round, but for those on cycles
            break
    return now.where("over").select("id", F.col("top").alias("root"), "depth")


def best_path(nodes: DataFrame) -> DataFrame:
    """(parent, child) edges from the root to the node with the least positive duration, of nodes (id, parent_id, duration); the smallest id
    among equals. On a cycle, the path ends before it comes round."""
    best = nodes.where("duration > 0").agg(F.min_by("id", F.struct("duration", "id")).alias("id")).where("id is not null")
    links = cut(nodes.groupBy("id").agg(F.min("parent_id").alias("up")), "tree-links")
    found = cut(best, "tree-path")
    jumps, n = links.where("up is not null"), found.count()
    # After k rounds the path has all ancestors up to 2^k - 1 links away.
    while n:
        reached = found.join(jumps, "id").join(links.select(F.col("id").alias("_id")), F.col("up") == F.col("_id")).select(F.col("up").alias("id"))
        step = cut(found.unionByName(reached).distinct(), "tree-path")
        before, n = n, step.count()
        drop(found)
        found = step
        if n == before:
            break
        further = jumps.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        jumps = cut(jumps.join(further, "up").select("id", F.col("_up").alias("up")), "tree-jumps")
    on = links.join(found, "id")
    return on.join(found.select(F.col("id").alias("_id")), F.col("up") == F.col("_id")).select(F.col("up").alias("parent"), F.col("id").alias("child"))


NODE_ERROR = "struct<kind:string,phase:string,message:string,retryable:boolean,details:map<string,string>,exception_type:string,job_id:string,created_at:string>"
#: A node of a log of experiments.
NODE = (
    "node_id string, name string, parent_id string, commit string, spec map<string,string>, status string, job_id string, launched_at double, result map<string,string>, "
    f"children array<string>, priority double, duration double, failure {NODE_ERROR}"
)


def read_nodes(spark, paths: list[str]) -> DataFrame:
    """The nodes of a log of JSON lines, one for each node: the last of its lines, by path and line. Missing fields are null."""
    rows = json_lines(spark, paths, NODE)
    last = rows.groupBy("node_id").agg(F.max_by(F.struct(*rows.columns), F.struct("path", "line")).alias("r"))
    return last.select("r.*").drop("path", "line").where("node_id is not null")


def new_best(nodes: DataFrame, order: str, value: Column) -> DataFrame:
    """nodes with improved: is a valid node's value above that of all valid ones before it. Nodes that failed, or have no value, are never an
    improvement. The best so far is found in blocks of the order and carried over them."""
    placed = with_pos(nodes.withColumn("_v", F.when(F.col("failure").isNull(), value.cast("double"))), [order], "_pos").withColumn("_block", F.floor(F.col("_pos") / 65536))
    tops = placed.groupBy("_block").agg(F.max("_v").alias("_top"))
    blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 65,536 nodes
    tops = tops.select("_block", F.max("_top").over(blocks).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    both = placed.withColumn("_here", F.max("_v").over(inside)).join(tops, "_block")
    best = F.greatest("_before", "_here")  # nulls are passed over
    return both.withColumn("improved", F.coalesce(F.col("_v").isNotNull() & (best.isNull() | (F.col("_v") > best)), F.lit(False))).drop("_v", "_pos", "_block", "_here", "_before")


def repeated_proposals(nodes: DataFrame, order: str, changes: str, failed: Column) -> DataFrame:
    """(node, first) for each row of nodes whose set of changes (an array, compared without order or repetition) was proposed before, by a node that
    didn't fail. Failed nodes are neither repeats nor what is repeated; null or empty sets repeat nothing."""
    sets = nodes.where(~F.coalesce(failed, F.lit(False)) & (F.size(changes) > 0)).select(F.col(order).alias("node"), F.array_sort(F.array_distinct(changes)).alias("_set"))
    first = sets.groupBy("_set").agg(F.min("node").alias("first"))
    return sets.join(first, "_set").where("node <> first").select("node", "first")
