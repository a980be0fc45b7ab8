"""Sides from delimited text and from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandweave.functions.exprs import as_side


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line (from 0, over all files in the order of their paths). Empty lines are left out and not counted.

    A line's number is its place in its block of a file and the lines of the blocks before; a row for each block is broadcast.
    """
    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where(F.length("value") > 0)
    lines = text.select("value", "file_path", "file_block_start", F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file_path", "file_block_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = blocks.withColumn("_before", F.sum("_n").over(Window.orderBy("file_path", "file_block_start")) - F.col("_n")).drop("_n")
    return lines.join(F.broadcast(before), ["file_path", "file_block_start"]).select("value", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"))


def delimited(spark: SparkSession, path: str, key_column: int, value_column: int, separator: str = "|", key_type: str = "int") -> DataFrame:
    """ts (the line's number from 0), key and value (a string) from columns counted from 1; both may be the same column.

    The key is the whole number that the column begins with. A line without the columns, or without such a number, is an error.
    """
    if key_column < 1 or value_column < 1:
        raise ValueError("columns are counted from 1")
    if len(separator) != 1:
        raise ValueError("the separator must be one character")
    parts = F.split("value", f"[{separator}]" if separator not in "^]\\[" else f"\\{separator}", -1)
    rows = numbered_lines(spark, path).select(F.col("line").alias("ts"), parts.alias("_p"))
    said = F.get("_p", F.lit(key_column - 1))
    number = F.nullif(F.regexp_extract(said, r"^\s*([+-]?\d+)", 1), F.lit(""))
    failed = F.raise_error(F.concat(F.lit("no key or value in line "), F.col("ts").cast("string")))
    return rows.select("ts", F.coalesce(number.cast(key_type), failed.cast(key_type)).alias("key"), F.coalesce(F.get("_p", F.lit(value_column - 1)), failed.cast("string")).alias("value"))


def from_table(spark: SparkSession, path: str, ts: str, key: str, value: str | None = None) -> DataFrame:
    """A side from a Parquet table; only these columns are read."""
    return as_side(spark.read.parquet(path), ts, key, value)
