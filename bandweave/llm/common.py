"""What several of these operators need: tables, shared folders, Arrow passes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Arrow batches sent to Python hold at most so many bytes, whatever the length of a text.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset (tests).

    Without it, executors on other machines would write where nobody else can read: that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder and read again: its lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever their case, one for each name."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out


def prepared(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session has a bound of its own; workers started elsewhere on this machine find the package."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str((1 << 31) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def arrow_pass(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str | T.StructType, rows: int = 2000) -> DataFrame:
    """mapInArrow over plain lists: work gets dicts of column lists (at most so many rows each) and yields such dicts."""
    prepared(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    cut = batch.slice(at, rows)
                    yield {n: cut.column(k).to_pylist() for k, n in enumerate(cut.schema.names)}

        for made in work(parts()):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def salted(df: DataFrame, n: int, name: str = "_salt") -> DataFrame:
    """df with a column from 0 to n - 1, dealt by the row's position in its task: spreads a hot key."""
    return df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))


def salt_copies(df: DataFrame, n: int, name: str = "_salt") -> DataFrame:
    """Each row of df (one per key) n times, with a column from 0 to n - 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df without columns of these names, whatever their case, and what they are called meanwhile: for steps that make
    columns of such names from a table that has some of its own."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    called = dict(zip(clash, fresh(df.select(*[f"`{c}`" for c in df.columns]), *[f"{c}_own" for c in clash])))
    return df.withColumnsRenamed(called), called
