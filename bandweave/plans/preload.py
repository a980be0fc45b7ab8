"""Rows that are in the windows before a join begins. Pairs among them are, by protocol, not or not all counted.

broadcast: the shortest start of the merged order that has window rows of either side; no pair within it is counted.
handshake: the first workers * (window // workers) rows of each side, in blocks of window // workers; of pairs within
them those are left out whose blocks' numbers add up to less than workers (they lie already past each other).

Both need enough rows on both sides, else ValueError, as a window that can't be filled has no defined result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandweave.plans.spec import BandJoinSpec


def _first(df: DataFrame, n: int) -> DataFrame:
    """The n rows of least ts with their places; a bounded top-n, no sort of everything."""
    top = df.select("ts").orderBy("ts").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("ts")) - 1)


def _enough(df: DataFrame, n: int, side: str) -> None:
    if n and df.select(F.lit(1)).limit(n).count() < n:
        raise ValueError(f"{side} has fewer rows than the {n} to preload")


def broadcast_end(r: DataFrame, s: DataFrame, window: int) -> tuple[int, str] | None:
    """The last merged row (ts, side) of the start that holds window rows of each side (R before S at one ts)."""
    if not window:
        return None
    ends = [(df.select("ts").orderBy("ts").limit(window).agg(F.max("ts")).first()[0], side) for df, side in ((r, "R"), (s, "S"))]
    return max(ends)


def marked(r: DataFrame, s: DataFrame, spec: BandJoinSpec) -> tuple[DataFrame, DataFrame]:
    """Both sides with what the residual predicate needs. Timestamps are taken as unique within a side, in ts order."""
    if spec.preload == "broadcast":
        _enough(r, spec.window, "R")
        _enough(s, spec.window, "S")
        end = broadcast_end(r, s, spec.window)
        if end is None:
            return r.withColumn("_pre", F.lit(False)), s.withColumn("_pre", F.lit(False))
        ts, side = end
        return r.withColumn("_pre", F.col("ts") <= ts), s.withColumn("_pre", (F.col("ts") <= ts) if side == "S" else (F.col("ts") < ts))
    block = spec.window // spec.workers
    n = block * spec.workers
    _enough(r, n, "R")
    _enough(s, n, "S")

    def blocks(df: DataFrame) -> DataFrame:
        if not block:
            return df.withColumn("_blk", F.lit(None).cast("bigint"))
        # ends of blocks: as many numbers as there are workers
        ends = [x["ts"] for x in _first(df, n).filter((F.col("place") + 1) % block == 0).orderBy("place").collect()]
        found = F.lit(None).cast("bigint")
        for k in range(len(ends) - 1, -1, -1):
            found = F.when(F.col("ts") <= ends[k], F.lit(k).cast("bigint")).otherwise(found)
        return df.withColumn("_blk", found)

    return blocks(r), blocks(s)


def residual(spec: BandJoinSpec) -> Column:
    """Whether a pair is counted."""
    if spec.preload == "broadcast":
        return ~(F.col("r_pre") & F.col("s_pre"))
    return F.coalesce(F.col("r_blk") + F.col("s_blk") > spec.workers - 1, F.lit(True))
