"""Strongly connected components of call graphs, in tables that stay linear in the number of edges.

Two things alternate until nothing changes. What nothing calls, or calls nothing, is taken away. A chain of objects that
one object calls and that call one becomes a single edge between its ends, found by pointer doubling, so chains and
rings take as many rounds as their length has binary digits. What is left is coloured: every object takes
the least name that reaches it, the object of that name and all of its colour that reach it are a component, and
edges between colours go. A coloured graph takes as many rounds as its longest shortest path; then all begins anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

_AT = ["model", "v"]


def _count(df: DataFrame) -> int:
    return df.count()


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, v, ahead, behind) of the objects on chains between others, and (model, v, component) of those on rings of such objects alone."""
    ends = edges.groupBy("model", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n_out"), F.first("b").alias("ahead")).join(
        edges.groupBy("model", F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n_in"), F.first("a").alias("behind")), _AT)
    inner = cut(ends.where("n_out = 1 AND n_in = 1").select(*_AT, "ahead", "behind"))
    jumps = inner.select(*_AT, "ahead", "behind", F.least("v", "ahead").alias("low"))
    for end in ("ahead", "behind"):
        onward = inner.select("model", F.col("v").alias(end), F.lit(True).alias("on"))
        jumps = jumps.join(onward, ["model", end], "left").withColumnRenamed("on", f"{end}_on")
    jumps, left = cut(jumps), None
    while True:
        open_ = jumps.agg(F.count_if("ahead_on").alias("ahead"), F.count_if("behind_on").alias("behind"), F.sum(F.when(F.col("ahead_on"), F.xxhash64("low") % 1_000_003)).alias("low")).first()
        if not (open_.ahead or open_.behind) or left == open_:  # only rings are left, and their least names have gone round
            break
        left = open_
        far = jumps.select("model", F.col("v").alias("at"), F.col("ahead").alias("far_ahead"), F.col("ahead_on").alias("far_ahead_on"), F.col("low").alias("far_low"), F.col("behind").alias("far_behind"), F.col("behind_on").alias("far_behind_on"))
        a, b = far.select("model", F.col("at").alias("ahead"), "far_ahead", "far_ahead_on", "far_low"), far.select("model", F.col("at").alias("behind"), "far_behind", "far_behind_on")
        step = jumps.join(a, ["model", "ahead"], "left").join(b, ["model", "behind"], "left")
        move = lambda end: F.when(F.col(f"{end}_on"), F.col(f"far_{end}")).otherwise(F.col(end)).alias(end)
        on = lambda end: F.when(F.col(f"{end}_on"), F.col(f"far_{end}_on")).alias(f"{end}_on")
        jumps = cut(step.select(*_AT, move("ahead"), move("behind"), F.when(F.col("ahead_on"), F.least("low", "far_low")).otherwise(F.col("low")).alias("low"), on("ahead"), on("behind")))
    ring = F.coalesce("ahead_on", F.lit(False))
    return jumps.where(~ring).select(*_AT, "ahead", "behind"), jumps.where(ring).select(*_AT, F.col("low").alias("component"))


def _reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(model, v, colour) of all that starts (the same columns) reach over edges (model, a, b, colour) of their colour."""
    found = frontier = cut(starts)
    parts = [found]
    while True:
        step = frontier.select("model", F.col("v").alias("a"), "colour").join(edges, ["model", "a", "colour"]).select("model", F.col("b").alias("v"), "colour").distinct()
        frontier = cut(step.join(reduce(DataFrame.unionByName, parts), ["model", "v"], "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)


def _coloured(edges: DataFrame) -> DataFrame:
    """(model, v, component) of one component of every colour, and all (model, v) with their colour."""
    nodes = edges.select("model", F.col("a").alias("v")).union(edges.select("model", F.col("b").alias("v"))).distinct()
    colour = cut(nodes.withColumn("colour", F.col("v")))
    while True:
        passed = edges.join(colour.withColumnRenamed("v", "a"), ["model", "a"]).groupBy("model", F.col("b").alias("v")).agg(F.min("colour").alias("passed"))
        new = cut(colour.join(passed, _AT, "left").select(*_AT, F.least("colour", "passed").alias("colour"), (F.col("passed") < F.col("colour")).alias("moved")))
        colour, moved = new.select(*_AT, "colour"), new.where("moved")
        if moved.isEmpty():
            return colour


def components(edges: DataFrame) -> DataFrame:
    """model, v, component (its least name) of every object that reaches itself. edges: model, a, b."""
    edges = cut(edges.select("model", "a", "b").distinct())
    alone = [edges.where("a = b").select("model", F.col("a").alias("v"))]
    held: list[DataFrame] = []  # chains, outermost last
    found: list[DataFrame] = []
    left = cut(edges.where("a <> b"))
    n = _count(left)
    while n:
        callers, called = left.select("model", F.col("a").alias("b")).distinct(), left.select("model", F.col("b").alias("a")).distinct()
        left = cut(left.join(callers, ["model", "b"], "left_semi").join(called, ["model", "a"], "left_semi").select("model", "a", "b"))
        chains, rings = _chains(left)
        found.append(rings)
        held.append(chains)
        inner = chains.select(*_AT).unionByName(rings.select(*_AT))
        kept = left.join(inner.withColumnRenamed("v", "a"), ["model", "a"], "left_anti").join(inner.withColumnRenamed("v", "b"), ["model", "b"], "left_anti").select("model", "a", "b")
        joined = cut(kept.union(chains.select("model", F.col("behind").alias("a"), F.col("ahead").alias("b"))).distinct())
        alone.append(joined.where("a = b").select("model", F.col("a").alias("v")))
        left, before = cut(joined.where("a <> b")), n
        n = _count(left)
        if n == before:  # neither ends nor chains
            colour = _coloured(left)
            back = left.join(colour.withColumnRenamed("v", "a"), ["model", "a"]).join(colour.select("model", F.col("v").alias("b"), F.col("colour").alias("other")), ["model", "b"])
            same = cut(back.where("colour = other").select("model", F.col("b").alias("a"), F.col("a").alias("b"), "colour"))  # turned round
            whole = cut(_reached(colour.where("v = colour"), same))
            found.append(whole.join(whole.groupBy("model", "colour").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), ["model", "colour"]).select("model", "v", F.col("colour").alias("component")))
            done = whole.select("model", "v")
            left = cut(same.select("model", F.col("b").alias("a"), F.col("a").alias("b")).join(done.withColumnRenamed("v", "a"), ["model", "a"], "left_anti").join(done.withColumnRenamed("v", "b"), ["model", "b"], "left_anti"))
            n = _count(left)
    whole = reduce(DataFrame.unionByName, found) if found else edges.where("false").select("model", F.col("a").alias("v"), F.col("b").alias("component"))
    single = reduce(DataFrame.unionByName, alone).distinct().join(whole.select(*_AT), _AT, "left_anti").withColumn("component", F.col("v"))
    whole = cut(whole.unionByName(single))
    for chains in reversed(held):  # a chain is in a component if both its ends are
        ends = chains.join(whole.select("model", F.col("v").alias("ahead"), F.col("component").alias("x")), ["model", "ahead"]).join(whole.select("model", F.col("v").alias("behind"), "component"), ["model", "behind"])
        whole = cut(whole.unionByName(ends.where("x = component").select(*_AT, "component")))
    least = whole.groupBy("model", "component").agg(F.min("v").alias("least"))
    return whole.join(least, ["model", "component"]).select("model", "v", F.col("least").alias("component"))
