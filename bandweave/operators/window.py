"""Merged order, and the state of sliding windows: what is live, oldest, expired, in range, repeated or out of order.

Questions about a moment (an arrival at some ts) are filters and sums, which Catalyst pushes into the scan. Timelines, one
answer for each arrival, are worked out in time buckets: a bucket holds what its arrivals can see, so none needs the whole
of the data in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandweave.functions.exprs import fdiv, in_range, long_lit, sat_sub


def merge_ordered(r: DataFrame | None, s: DataFrame | None) -> DataFrame:
    """Both sides as one, in the order of ts, R before S at equal ts: ts, key, value, side. One side may be missing."""
    if r is None and s is None:
        raise ValueError("one side at least is needed")
    parts = [df.select("ts", "key", "value", F.lit(name).alias("side")) for df, name in ((r, "R"), (s, "S")) if df is not None]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.orderBy("ts", "side")


def ranked(df: DataFrame, order: list[str], parts: int | None = None, to: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in an order. Rows are sorted by ranges; a range's places start behind what the ranges before hold."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    own = held.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return own.join(F.broadcast(before), "_part").withColumn(to, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_before")


def merge_positions(r: DataFrame, s: DataFrame) -> DataFrame:
    """The merged order with places from 0: pos, ts, key, value, side."""
    both = r.select("ts", "key", "value", F.lit("R").alias("side")).unionByName(s.select("ts", "key", "value", F.lit("S").alias("side")))
    return ranked(both, ["ts", "side", "key", "value"]).select("pos", "ts", "key", "value", "side")


def range_search(df: DataFrame, low: int | Column, high: int | Column) -> DataFrame:
    """Rows with low <= key <= high, in no order; none if low is above high."""
    return df.where(F.col("key").between(low, high))


def live(df: DataFrame, now: int, window: int) -> DataFrame:
    """Rows that have arrived by now and aren't expired."""
    return df.where((F.col("ts") >= sat_sub(long_lit(now), window)) & (F.col("ts") <= long_lit(now)))


def expired(df: DataFrame, now: int, window: int) -> DataFrame:
    """Rows that an arrival at now pushes out: older than now - window."""
    return df.where(F.col("ts") < sat_sub(long_lit(now), window))


def oldest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The row of least ts (of equal ones the least key and value), of everything or for each value of `by`."""
    row = F.min(F.struct("ts", "key", "value")).alias("row")
    out = df.groupBy(*by).agg(row) if by else df.agg(row).where("row is not null")
    return out.select(*(by or []), "row.ts", "row.key", "row.value")


def size(df: DataFrame) -> DataFrame:
    """n_rows and is_empty."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("is_empty", F.col("n_rows") == 0)


def window_sizes(df: DataFrame, window: int, by: str = "side") -> DataFrame:
    """For each row of each side, n_live: how many rows of its side have a ts in [ts - window, ts].

    Counts per ts are summed over time buckets of the window's width: a row sees its own bucket and the one before.
    """
    if not 0 <= window < 1 << 62:
        raise ValueError("window must be 0 or more, and below 2^62")
    counts = df.groupBy(by, "ts").agg(F.count("*").alias("_n"))
    spread = counts.withColumn("_home", fdiv(F.col("ts"), window + 1))
    seen = spread.withColumn("_b", F.explode(F.array(F.col("_home"), F.col("_home") + F.lit(1).cast("bigint"))))
    frame = Window.partitionBy(by, "_b").orderBy("ts").rangeBetween(-window, Window.currentRow)
    sizes = seen.withColumn("n_live", F.sum("_n").over(frame)).where(F.col("_b") == F.col("_home")).select(by, "ts", "n_live")
    return df.join(sizes, [by, "ts"]).select(*df.columns, "n_live")


def mean_window_sizes(df: DataFrame, window: int, by: str = "side") -> DataFrame:
    """The mean of window_sizes over a side's rows, rounded down to a whole number."""
    return window_sizes(df, window, by).groupBy(by).agg(F.expr("sum(n_live) div count(*)").alias("mean_live"))


def duplicate_keys(df: DataFrame, window: int) -> DataFrame:
    """Rows that a window of unique keys would refuse: an earlier row of the same key is at most window older.

    key, ts, earlier_ts (the latest one). Rows of one ts and key count by value."""
    order = Window.partitionBy("key").orderBy("ts", "value")
    return df.withColumn("earlier_ts", F.lag("ts").over(order)).where(in_range(F.col("earlier_ts"), F.col("ts"), window)).select("key", "ts", "earlier_ts")


def unsorted(df: DataFrame, arrival: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Rows whose value is below that of the row that arrived just before: arrival, value, previous. arrival: whole numbers.

    Arrivals are worked on in buckets of the width; a bucket's first row gets the last one before it by a join of a row per bucket.
    """
    rows = df.select(F.col(arrival).cast("bigint").alias("arrival"), F.col(value).alias("value")).withColumn("_b", fdiv(F.col("arrival"), width))
    lasts = rows.groupBy("_b").agg(F.max(F.struct("arrival", "value")).alias("last"))
    n = F.lead("_b").over(Window.orderBy("_b"))  # a row for each bucket
    carried = lasts.select(n.alias("_b"), F.col("last.value").alias("_carried")).where("_b is not null")
    order = Window.partitionBy("_b").orderBy("arrival")
    seen = rows.join(carried, "_b", "left").withColumn("previous", F.coalesce(F.lag("value").over(order), F.when(F.row_number().over(order) == 1, F.col("_carried"))))
    return seen.where(F.col("value") < F.col("previous")).select("arrival", "value", "previous")


def require_sorted(df: DataFrame, arrival: str, value: str) -> DataFrame:
    """df itself; ValueError if unsorted() finds a row."""
    if not unsorted(df, arrival, value).isEmpty():
        raise ValueError("timestamps are decreasing")
    return df


