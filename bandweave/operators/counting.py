"""How many pairs a band join has, without making them.

Each probe counts the rows of the other side in its rectangle of ts and key. Rows are dealt into cells of the key and, where
that isn't enough, of the time; a cell's other side lies in a wavelet matrix over the order of ts, whose levels answer all
probes at once. The work grows with the rows (times a logarithm), not with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.functions.exprs import copies, fdiv
from bandweave.plans.spec import BandJoinSpec

#: Rows that a cell is meant to have, and the most that it holds of a side before it is cut into blocks.
ROWS, MOST = 1 << 17, 1 << 20
#: From so many copied rows and candidate pairs for a row on, counting is cheaper than making pairs.
WORTH = 2000.0
#: Bounds of window and band below which no sum of two 64-bit numbers needs care beyond saturation.
WIDEST = 1 << 62


class Ranks:
    """Rows in the order of ts: counts those with positions and keys in given ranges, for many ranges at a time."""

    def __init__(self, ts: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.ts, self.keys = ts, key[order]
        left = np.empty(len(key), np.int64)
        left[order] = np.arange(len(key))
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in reversed(range(len(key).bit_length())):
            high = (left >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~high)])))
            left = np.concatenate([left[~high], left[high]])

    def below(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For each range of positions, how many keys have a rank below rank."""
        found = np.zeros(len(rank), np.int64)
        for bit, lows in self.levels:
            high, a, b = (rank >> bit & 1).astype(bool), lows[start], lows[end]
            found += np.where(high, b - a, 0)
            start, end = np.where(high, lows[-1] + start - a, a), np.where(high, lows[-1] + end - b, b)
        return found

    def near(self, ts: np.ndarray, key: np.ndarray, window: int, band: int) -> np.ndarray:
        full = np.iinfo(np.int64)
        under = lambda x, by: np.where(x < full.min + by, full.min, x - by)
        over = lambda x, by: np.where(x > full.max - by, full.max, x + by)
        start, end = np.searchsorted(self.ts, under(ts, window), "left"), np.searchsorted(self.ts, over(ts, window), "right")
        low, high = np.searchsorted(self.keys, under(key, band), "left"), np.searchsorted(self.keys, over(key, band), "right")
        return self.below(start, end, high) - self.below(start, end, low)


def countable(probes: DataFrame, others: DataFrame, spec: BandJoinSpec) -> bool:
    """Whether grouped_counts can answer: whole inputs, 64-bit keys and times, no preload."""
    whole = all(dict(df.dtypes)[c] in ("bigint", "int") for df in (probes, others) for c in ("ts", "key"))
    return whole and not (probes.isStreaming or others.isStreaming) and spec.preload is None and isinstance(spec.band, int) and max(spec.band, spec.window) < WIDEST


def grouped_counts(probes: DataFrame, others: DataFrame, spec: BandJoinSpec, group: Column) -> DataFrame:
    """of, n: pairs of probes and others by a bigint group of the probes (of their ts and key). Groups without pairs are left out.

    Both frames have ts and key; rows where either is null match nothing. A cell of more than MOST rows of a side, such as
    that of one hot key, is cut into blocks of both sides, each of which meets each.
    """
    sides = [df.select(F.col("ts").cast("bigint"), F.col("key").cast("bigint")).dropna() for df in (probes, others)]
    ends = [f(c).cast("decimal(38,0)").alias(n) for n, c, f in (("a", "ts", F.min), ("b", "ts", F.max), ("c", "key", F.min), ("d", "key", F.max))]
    span = sides[0].agg(F.count("*").alias("n"), *ends).first()
    cells = max(1, math.ceil(span["n"] / ROWS))
    reach = lambda low, high: int(high - low) + 1 if low is not None else 1
    by_key = min(cells, reach(span["c"], span["d"]) // (spec.band + 1) + 1)
    cuts = [("key", spec.band, max(spec.band + 1, -(-reach(span["c"], span["d"]) // by_key)))]
    if -(-cells // by_key) > 1:
        cuts.append(("ts", spec.window, max(spec.window + 1, -(-reach(span["a"], span["b"]) // -(-cells // by_key)))))
    one, two = sides[0].withColumn("of", group.cast("bigint")), sides[1].withColumn("of", F.lit(0).cast("bigint"))
    for c, by, width in cuts:
        width = min(width, WIDEST)
        one, two = one.withColumn(f"cell_{c}", fdiv(F.col(c), width)), two.withColumn(f"cell_{c}", F.explode(copies(F.col(c), by, width)))
    at = [f"cell_{c}" for c, _, _ in cuts]
    sizes = one.groupBy(*at).agg(F.count("*").alias("n_one")).join(two.groupBy(*at).agg(F.count("*").alias("n_two")), at)
    sizes = sizes.where(F.greatest("n_one", "n_two") > MOST).select(*at, *[F.ceil(F.col(n) / MOST).alias(p) for n, p in (("n_one", "p_one"), ("n_two", "p_two"))])

    def blocks(df: DataFrame, own: str, other: str, role: int) -> DataFrame:
        df = df.join(F.broadcast(sizes), at, "left").withColumns({p: F.coalesce(p, F.lit(1).cast("bigint")) for p in ("p_one", "p_two")})  # a row per MOST rows at most
        df = df.withColumn(own, F.pmod(F.xxhash64("ts", "key", F.monotonically_increasing_id()), F.col(own)))
        return df.withColumn(other, F.explode(F.expr(f"sequence(0L, {other} - 1)"))).select(*at, "p_one", "p_two", F.lit(role).alias("role"), "ts", "key", "of")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ranks = None, [], None
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            place = np.stack([c[n] for n in (*at, "p_one", "p_two", "role")])
            starts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                cell = tuple(place[:-1, a])
                if cell != here:
                    here, held, ranks = cell, [], None
                ts, key = c["ts"][a:b], c["key"][a:b]
                if place[-1, a] == 0:
                    held.append((ts, key))
                    continue
                if not held:
                    continue
                ranks = ranks or Ranks(*map(np.concatenate, zip(*held)))
                n = ranks.near(ts, key, spec.window, spec.band)
                of, which = np.unique(c["of"][a:b], return_inverse=True)
                total = np.zeros(len(of), np.int64)
                np.add.at(total, which, n)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(total)], names=["of", "n"])

    rows = blocks(one, "p_one", "p_two", 1).unionByName(blocks(two, "p_two", "p_one", 0))
    met = rows.repartition(*at, "p_one", "p_two").sortWithinPartitions(*at, "p_one", "p_two", "role", "ts")
    return met.mapInArrow(work, "of bigint, n bigint").groupBy("of").agg(F.sum("n").alias("n")).where("n > 0")
