"""Sources of sides (ts, key, value), by kind."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from bandweave.sources.binary_keys import binary_keys
from bandweave.sources.generated import permutation, sequential, shuffled
from bandweave.sources.tables import delimited, from_table

KINDS = {"random": permutation, "shuffled": shuffled, "sequential": sequential, "sosd": binary_keys, "tpc": delimited}


def make_source(spark: SparkSession, kind: str, **options: Any) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"source must be one of {', '.join(KINDS)}, not {kind!r}")
    return KINDS[kind](spark, **options)


__all__ = ["KINDS", "binary_keys", "delimited", "from_table", "make_source", "permutation", "sequential", "shuffled"]
