"""Keys from binary files: a count of eight bytes, then so many integers of one width, little-endian.

Read as a data source in byte ranges, one task each, through pyarrow's file systems (local paths and URIs). Unsigned keys
of 64 bits become decimals, as no integer of Spark's holds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTHS = {"uint64": "<u8", "int64": "<i8", "uint32": "<u4", "int32": "<i4"}
TYPES = {"uint64": "decimal(20,0)", "int64": "bigint", "uint32": "bigint", "int32": "int"}
HEADER = 8


def opened(path: str):  # noqa: ANN201
    from pyarrow import fs

    if "://" not in path:
        import os

        path = os.path.abspath(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Span(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        super().__init__((first, end))
        self.first, self.end = first, end


class BinaryKeysReader(DataSourceReader):
    def __init__(self, path: str, kind: str, span: int) -> None:
        self.path, self.kind, self.span = path, kind, span

    def partitions(self) -> Sequence[InputPartition]:
        with opened(self.path) as f:
            raw, size = f.read(HEADER), f.size()
        if len(raw) < HEADER:
            raise ValueError("the file has no count")
        n = int(np.frombuffer(raw, "<u8")[0])
        if HEADER + n * np.dtype(WIDTHS[self.kind]).itemsize > size:
            raise ValueError(f"the file ends before its {n} keys do")
        return [Span(k, min(n, k + self.span)) for k in range(0, n, self.span)] or [Span(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        width, step = np.dtype(WIDTHS[self.kind]).itemsize, 1 << 17
        with opened(self.path) as f:
            for first in range(partition.first, partition.end, step):  # type: ignore[attr-defined]
                end = min(partition.end, first + step)  # type: ignore[attr-defined]
                f.seek(HEADER + first * width)
                keys = pa.array(np.frombuffer(f.read((end - first) * width), WIDTHS[self.kind]))
                if self.kind == "uint64":
                    keys = keys.cast(pa.decimal128(20, 0))
                elif self.kind == "uint32":
                    keys = keys.cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, end)), keys], names=["place", "key"])


class BinaryKeysSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_keys"

    def schema(self) -> str:
        return f"place bigint, key {TYPES[self.options.get('type', 'uint64')]}"

    def reader(self, schema) -> BinaryKeysReader:  # noqa: ANN001
        return BinaryKeysReader(self.options["path"], self.options.get("type", "uint64"), int(self.options.get("span", 1 << 22)))


def binary_keys(spark: SparkSession, path: str, type: str = "uint64", size: int | None = None, seed: int | None = None, span: int = 1 << 22) -> DataFrame:  # noqa: A002
    """ts, key and value = key of the file's keys: in the file's order, or shuffled by a seed; of size keys, if it is given.

    More keys than the file has are an error. ts counts from 0."""
    from bandweave.operators.window import ranked

    if type not in WIDTHS:
        raise ValueError(f"type must be one of {', '.join(WIDTHS)}")
    spark.dataSource.register(BinaryKeysSource)
    rows = spark.read.format("binary_keys").option("path", path).option("type", type).option("span", span).load()
    with opened(path) as f:
        n = int(np.frombuffer(f.read(HEADER), "<u8")[0])
    if size is not None and size > n:
        raise ValueError(f"the file has {n} keys, not {size}")
    if seed is not None:
        rows = ranked(rows.withColumn("_r", F.xxhash64("place", F.lit(seed))), ["_r", "place"], to="_ts").select(F.col("_ts").alias("place"), "key")
    if size is not None:
        rows = rows.where(F.col("place") < size)
    return rows.select(F.col("place").alias("ts"), "key", F.col("key").alias("value"))
