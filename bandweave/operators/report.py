"""Benchmark results as rows, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "joiner string, index string, workers int, attempt int, status string, duration_ms double, throughput double"
# The columns of a sweep's CSV file.
HEADER = ("JoinerType", "IndexType", "Workers", "Attempt", "Status", "Duration_ms", "Throughput_tuples_s")


def results(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(RESULT).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c).alias(h) for c, h in zip(df.columns, HEADER, strict=True)]).write.option("header", True).mode("overwrite").csv(path)


def summary(df: DataFrame) -> DataFrame:
    """Mean throughput of the successful attempts by joiner, index and workers, with their number."""
    return df.where("status = 'SUCCESS'").groupBy("joiner", "index", "workers").agg(F.avg("throughput").alias("mean_throughput"), F.count("*").alias("attempts"))


def parsed_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """From log lines such as 'Window 3: Join count: 42' or 'Window 3 join count: 42': worker and n_pairs."""
    pattern = r"(?i)window\s+(\d+):?\s+join count:\s+(\d+)"
    return lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).cast("bigint").alias("worker"), F.regexp_extract(line, pattern, 2).cast("bigint").alias("n_pairs"))


def parsed_sizes(lines: DataFrame, line: str = "value") -> DataFrame:
    """From log lines such as 'Window 3 index r size: 10, index s size: 12': worker, r_size and s_size."""
    pattern = r"(?i)window\s+(\d+):?\s+index r size:\s+(\d+),\s+index s size:\s+(\d+)"
    parts = [F.regexp_extract(line, pattern, k + 1).cast("bigint").alias(n) for k, n in enumerate(("worker", "r_size", "s_size"))]
    return lines.where(F.col(line).rlike(pattern)).select(*parts)


def window_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row for each worker that a log names: r_size, s_size and n_pairs, null where it has no such line; of several
    lines the largest value."""
    both = parsed_sizes(lines, line).withColumn("n_pairs", F.lit(None).cast("bigint")).unionByName(parsed_log(lines, line).select("worker", *[F.lit(None).cast("bigint").alias(n) for n in ("r_size", "s_size")], "n_pairs"))
    return both.groupBy("worker").agg(*[F.max(n).alias(n) for n in ("r_size", "s_size", "n_pairs")])


def size_lines(sizes: DataFrame) -> DataFrame:
    """worker, r_size and s_size as such lines."""
    return sizes.select(F.format_string("Window %s index r size: %s, index s size: %s", *[F.col(c).cast("string") for c in ("worker", "r_size", "s_size")]).alias("value"))


def log_lines(counts: DataFrame) -> DataFrame:
    """worker counts as such lines."""
    return counts.select(F.format_string("Window %s: Join count: %s", F.col("worker").cast("string"), F.col("n_pairs").cast("string")).alias("value"))


def throughput(label: str, seconds: float, rows: int) -> str:
    """A line with a run's name, milliseconds and rows a second."""
    return f"{label}: {seconds * 1000:.2f} ms, {rows / seconds if seconds else 0:.2f} tuples/s"
