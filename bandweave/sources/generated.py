"""Generated sides. All are ranges, made in parallel and without a shuffle where the order isn't random."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequential(spark: SparkSession, start: int = 0, end: int = 0, step: int = 1) -> DataFrame:
    """ts = key = value = start, start + step, ... below end; empty where start isn't below end."""
    if step < 1:
        raise ValueError("step must be 1 or more")
    return spark.range(start, max(start, end), step).select(F.col("id").alias("ts"), F.col("id").alias("key"), F.col("id").alias("value"))


def affine(n: int, seed: int) -> tuple[int, int]:
    """Factor and shift of a permutation of 0 .. n - 1: the factor has no divisor in common with n."""
    a = max(1, (0x9E3779B1 * (seed + 1)) % n) if n > 1 else 1
    while gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 0, (seed * 40_503 + 17) % n if n else 0


def permuted(ts: str, n: int, a: int, b: int) -> F.Column:
    """(ts * a + b) modulo n, worked out in decimals where 64 bits might not hold the product."""
    if n * max(a, 1) + b < 1 << 63:
        return F.pmod(F.col(ts) * F.lit(a).cast("bigint") + F.lit(b).cast("bigint"), F.lit(n).cast("bigint"))
    wide = T.DecimalType(38, 0)
    return ((F.col(ts).cast(wide) * F.lit(a).cast(T.DecimalType(19, 0)) + F.lit(b).cast(T.DecimalType(19, 0))) % F.lit(n).cast(T.DecimalType(19, 0))).cast("bigint")


def permutation(spark: SparkSession, end: int = 0, start: int = 0, seed: int = 0) -> DataFrame:
    """ts = start .. end - 1, keys a permutation of 0 .. end - start - 1, value = key; the seed decides, nothing is shuffled."""
    if end < start:
        raise ValueError("end must not be below start")
    n = end - start
    a, b = affine(n, seed)
    rows = spark.range(start, end).select(F.col("id").alias("ts"), (F.col("id") - F.lit(start).cast("bigint")).alias("_i"))
    return rows.select("ts", permuted("_i", n, a, b).alias("key") if n else F.lit(0).cast("bigint").alias("key")).withColumn("value", F.col("key"))


def shuffled(spark: SparkSession, end: int = 0, start: int = 0, seed: int = 0) -> DataFrame:
    """As permutation(), but in an order drawn at random: one sort of all keys."""
    from bandweave.operators.window import ranked

    if end < start:
        raise ValueError("end must not be below start")
    keys = spark.range(end - start).select(F.col("id").alias("key"), F.xxhash64("id", F.lit(seed)).alias("_r"))
    return ranked(keys, ["_r", "key"], to="_i").select((F.col("_i") + F.lit(start).cast("bigint")).alias("ts"), "key", F.col("key").alias("value"))
