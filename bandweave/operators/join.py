"""The band join and what is counted of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.operators import counting
from bandweave.plans import paths, preload
from bandweave.plans.spec import BandJoinSpec


def band_join(r: DataFrame, s: DataFrame, spec: BandJoinSpec) -> DataFrame:
    """All pairs of spec, each once: r_ts, r_key, r_value, s_ts, s_key, s_value (and worker, on the replicated path).

    r and s have columns ts, key and value; rows with a null ts or key match nothing; repeated rows make repeated pairs.
    """
    if spec.preload is not None:
        r, s = preload.marked(r, s, spec)
    joined = paths.PATHS[spec.path](paths.named(r, "r"), paths.named(s, "s"), spec)
    if spec.preload is not None:
        joined = joined.where(preload.residual(spec)).drop("r_pre", "s_pre", "r_blk", "s_blk")
    return joined


def self_join(df: DataFrame, spec: BandJoinSpec) -> DataFrame:
    """df with itself; every row meets itself too."""
    return band_join(df, df, spec)


def planned(r: DataFrame, s: DataFrame, spec: BandJoinSpec) -> tuple[BandJoinSpec, bool]:
    """spec with "auto" replaced by the cheapest path, and whether counting by rank is cheaper than that path."""
    if spec.path != "auto" or not counting.countable(r, s, spec):
        return spec, False
    cost, path = paths.cheapest(paths.named(r, "r"), paths.named(s, "s"), spec)
    return spec.but(path=path), cost > counting.WORTH


def count_pairs(r: DataFrame, s: DataFrame, spec: BandJoinSpec) -> DataFrame:
    """One row, n_pairs. Only the key and time columns are read. On path "auto" pairs are counted without being made, if there
    would be many."""
    r, s = (df.select("ts", "key", F.lit(0).alias("value")) for df in (r, s))
    spec, many = planned(r, s, spec)
    if many:
        return total(counting.grouped_counts(r, s, spec, F.lit(0)).withColumnRenamed("n", "n_pairs"))
    return band_join(r, s, spec).agg(F.count("*").alias("n_pairs"))


def worker_counts(r: DataFrame, s: DataFrame, spec: BandJoinSpec) -> DataFrame:
    """worker, n_pairs: pairs by the part that s belongs to (s.ts modulo workers); parts without pairs have 0."""
    spec, many = planned(r, s, spec)
    if many:
        found = counting.grouped_counts(s, r, spec, F.pmod("ts", F.lit(spec.workers).cast("bigint"))).withColumnRenamed("of", "worker")
    else:
        found = band_join(r, s, spec).select(F.pmod("s_ts", F.lit(spec.workers).cast("bigint")).alias("worker")).groupBy("worker").agg(F.count("*").alias("n"))
    every = r.sparkSession.range(spec.workers).select(F.col("id").alias("worker"))
    return every.join(found, "worker", "left").select("worker", F.coalesce("n", F.lit(0)).alias("n_pairs"))


def total(counts: DataFrame) -> DataFrame:
    """The sum of per-worker counts."""
    return counts.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))


def same_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """What two results differ by: pairs with how often each has them, where that isn't the same."""
    columns = one.columns
    both = one.withColumn("_n", F.lit(1)).unionByName(two.select(*columns).withColumn("_n", F.lit(-1)))
    counts = both.groupBy(*columns).agg(F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).alias("n_one"), F.sum(F.when(F.col("_n") < 0, 1).otherwise(0)).alias("n_two"))
    return counts.where("n_one <> n_two")


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that a result has more than once."""
    return pairs.groupBy(*pairs.columns).agg(F.count("*").alias("n")).where("n > 1")
