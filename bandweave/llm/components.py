"""Connected components of a graph given by its edges, by alternating large and small stars.

Each task first leaves out edges between nodes that others of its edges connect already, so that no more edges than nodes of
a task go on. Each step is a join and a sum over the edges; between steps the edges are written, so that the plan stays short
and a lost executor costs a step at most. A node's label is the smallest node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import arrow_pass, discard, written


def spanning(up: dict[int, int], x: int, y: int) -> bool:
    """Whether x and y weren't connected yet; they are from now on. up: of each node one nearer to its tree's smallest."""

    def top(k: int) -> int:
        while (u := up.get(k, k)) != k:
            up[k] = k = up.get(u, u)
        return k

    x, y = top(x), top(y)
    up[max(x, y)] = min(x, y)
    return x != y


def forest(edges: DataFrame) -> DataFrame:
    """edges (x, y) without those that close a circle among a task's; x is the larger one."""

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        up: dict[int, int] = {}
        for p in parts:
            kept = [(max(e), min(e)) for e in zip(p["x"], p["y"]) if e[0] != e[1] and spanning(up, *e)]
            yield {"x": [e[0] for e in kept], "y": [e[1] for e in kept]}

    return arrow_pass(edges.select("x", "y"), work, "x bigint, y bigint", 10_000)


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
    down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    small = down.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return small.unionByName(least.select("x", F.col("m").alias("y"))).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct()


def components(edges: DataFrame) -> DataFrame:
    """x and label for every node of edges (x, y: bigint) but those of loops alone; repeated edges are allowed, no edges give
    no rows. A table of written()."""
    now = written(forest(edges).distinct(), "edges")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("x", "y") % 1_000_003)).first()
    before = state(now)
    while before[0]:
        last, now = now, written(_stars(now), "edges")
        discard(last)
        after = state(now)
        if after == before:  # every edge leads from a node to the smallest of its component
            break
        before = after
    labels = now.select("x", F.col("y").alias("label"))
    found = written(labels.unionByName(labels.select(F.col("label").alias("x"), "label").distinct()), "labels")
    discard(now)
    return found
