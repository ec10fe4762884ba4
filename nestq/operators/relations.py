"""Relations lowered to joins: children are filtered, paged per parent and gathered before they meet the parent."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.sources.shared import written

#: Levels up to which recursion is one lazy plan; deeper or unbounded recursion goes on level by level until nothing new is reached.
UNROLLED = 4
#: Most levels that one job of such a recursion takes.
STRIDE = 16


def gathered(children: DataFrame, row: str = "__row") -> DataFrame:
    """(__fk, __list): the rows of each parent in the order of ``__rn``."""
    pairs = F.array_sort(F.collect_list(F.struct("__rn", row)))
    return children.groupBy("__fk").agg(F.transform(pairs, lambda x: x[row]).alias("__list"))


def attach_list(parent: DataFrame, column: str, lists: DataFrame, name: str) -> DataFrame:
    """``parent`` with an array column: never null, empty without children."""
    kind = lists.schema["__list"].dataType
    right = lists.withColumnsRenamed({"__fk": f"{name}_fk", "__list": f"{name}_list"})
    joined = parent.join(right, F.col(f"`{column}`") == F.col(f"{name}_fk"), "left")
    return joined.withColumn(name, F.coalesce(F.col(f"{name}_list"), F.array().cast(kind))).drop(f"{name}_fk", f"{name}_list")


def attach_one(parent: DataFrame, column: str, ones: DataFrame, name: str) -> DataFrame:
    """``parent`` with a struct column, null without a match. ``ones``: (__fk unique, __row)."""
    right = ones.withColumnsRenamed({"__fk": f"{name}_fk", "__row": name})
    return parent.join(right, F.col(f"`{column}`") == F.col(f"{name}_fk"), "left").drop(f"{name}_fk")


def through_bridge(bridge: DataFrame, source_key: str, target_key: str, target: DataFrame, target_column: str) -> DataFrame:
    """Target rows with the source's key in ``__fk``; a pair that the bridge repeats is repeated."""
    b = bridge.select(F.col(f"`{source_key}`").alias("__fk"), F.col(f"`{target_key}`").alias("__tk"))
    return target.join(b, F.col(f"`{target_column}`") == F.col("__tk"), "inner").drop("__tk")


def links_of(nodes: DataFrame, start: str, end: str, allowed: DataFrame | None = None) -> DataFrame:
    """(__from, __to) without nulls and self loops; ``allowed`` (__id): nodes that may be entered."""
    a, b = F.col(f"`{start}`"), F.col(f"`{end}`")
    links = nodes.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("__from"), b.alias("__to"))
    return links if allowed is None else links.join(allowed, links["__to"] == allowed["__id"], "left_semi")


def walk(spark: SparkSession, roots: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """(__fk, __id, __level): the nodes that each root reaches within ``level`` steps (0: all), and the least number of steps; roots excluded.

    ``roots``: (__fk, __id), what the root is called and the node it is. Up to UNROLLED levels the result is lazy. Beyond, each job
    takes the frontier some levels on (1, 2, 4, ... STRIDE), leaves out what was reached before and writes the rest to the shared
    folder, until a frontier is empty: so cycles end, and there is no limit on levels or rows.
    """
    start = roots.select("__fk", "__id").distinct()
    if 0 < level <= UNROLLED:
        return _unreached(_onward(start, links, 0, level), start.withColumn("__level", F.lit(0)))
    links = written(links.distinct(), "links")
    reached = [written(start.withColumn("__level", F.lit(0)), "reached")]
    frontier, depth, stride = reached[0].select("__fk", "__id"), 0, 1
    while level == 0 or depth < level:
        steps = min(stride, level - depth) if level else stride
        found = _onward(frontier, links, depth, steps)
        fresh = written(_unreached(found, functools.reduce(DataFrame.union, reached)), "reached")
        depth, stride = depth + steps, min(STRIDE, 2 * stride)
        if fresh.isEmpty():
            break
        reached.append(fresh)
        frontier = fresh.where(F.col("__level") == depth).select("__fk", "__id")
    return functools.reduce(DataFrame.union, reached).where("__level > 0")


def _onward(frontier: DataFrame, links: DataFrame, depth: int, steps: int) -> DataFrame:
    """(__fk, __id, __level): what lies 1 to ``steps`` links behind the frontier, which is ``depth`` deep."""
    out, now = [], frontier
    for k in range(1, steps + 1):
        now = now.join(links, now["__id"] == links["__from"]).select("__fk", F.col("__to").alias("__id")).distinct()
        out.append(now.withColumn("__level", F.lit(depth + k)))
    return functools.reduce(DataFrame.union, out).groupBy("__fk", "__id").agg(F.min("__level").alias("__level"))


def _unreached(found: DataFrame, before: DataFrame) -> DataFrame:
    return found.join(before.select("__fk", "__id"), ["__fk", "__id"], "left_anti").select("__fk", "__id", "__level")


def semi(parent: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """``parent`` with a boolean column: whether ``keys`` (__fk) holds the column's value."""
    right = keys.select(F.col("__fk").alias(f"{flag}_fk")).distinct().withColumn(flag, F.lit(True))
    joined = parent.join(right, F.col(f"`{column}`") == F.col(f"{flag}_fk"), "left").drop(f"{flag}_fk")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
