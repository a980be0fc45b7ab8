"""The band join over two streams: watermarked, bucketed by key and time, its state bounded by the window.

Spark wants an equality between streams, which the buckets give; the time range on both event times lets it drop state
that no later row can match. It does so once a batch, and a row is held against all of its bucket's: so buckets are cut by
time too, or a batch's work would grow with the square of its rows. They are twice as wide as elsewhere, which makes four
copies of S instead of nine, as each copy is a row of state. Event time is ts in milliseconds (or microseconds) behind OFFSET, as a row at the
epoch itself would count as late before the first watermark.
"""

from __future__ import annotations

import math
import re
import tempfile
import threading
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from bandweave.plans import paths
from bandweave.plans.spec import BandJoinSpec

OFFSET_MS = 1000
UNITS = {"millis": ("timestamp_millis", 1), "micros": ("timestamp_micros", 1000)}


def shared_dir(spark: SparkSession) -> str:
    """Where executors can read what others wrote: spark.checkpoint.dir, or a local folder where it is unset and the driver
    is the only machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}").rstrip("/")


def with_event_time(df: DataFrame, unit: str = "millis", delay: str = "0 seconds") -> DataFrame:
    function, factor = UNITS[unit]
    return df.withColumn("et", F.call_function(function, F.col("ts") + F.lit(OFFSET_MS * factor).cast("bigint"))).withWatermark("et", delay)


def stream_band_join(r: DataFrame, s: DataFrame, spec: BandJoinSpec, unit: str = "millis", delay: str = "0 seconds") -> DataFrame:
    """Pairs of two streams (ts, key, value), as band_join gives them. delay: how much later than the latest row others may come."""
    if spec.preload is not None:
        raise ValueError("preloading is for joins over whole inputs")
    if r.sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy", "min") != "min":
        raise ValueError("the faster side's watermark would drop rows of the slower one: set spark.sql.streaming.multipleWatermarkPolicy to min")
    r, s = (with_event_time(df, unit, delay).select(*[F.col(c).alias(f"{n}_{c}") for c in ("ts", "key", "value", "et")]) for df, n in ((r, "r"), (s, "s")))
    wide = spec.but(key_width=spec.key_width or max(1, 2 * math.ceil(spec.band) + 1), ts_width=spec.ts_width or 2 * spec.window + 1)
    r, s = paths._ts_buckets(*paths._key_buckets(r, s, wide), wide)
    r = r.withColumnsRenamed({"_kb": "_r", "_tb": "_t"})
    width = f"interval {spec.window} {'millisecond' if unit == 'millis' else 'microsecond'}"
    span = F.expr(f"s_et >= r_et - {width} and s_et <= r_et + {width}")
    return r.join(s, (F.col("_r") == F.col("_kb")) & (F.col("_t") == F.col("_tb")) & span & paths.exact(spec)).select(*paths.OUT)


def write_replay(df: DataFrame, files: int = 4) -> str:
    """df written as Parquet files in the order of ts, so many at most, in one pass by ranges of ts; gives their folder.

    Replaying takes files in the order in which they were written, so ranges are written first and then renamed one by one.
    """
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    df.repartitionByRange(files, "ts").write.parquet(f"{out}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{out}-parts")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop.Path(out))
    names = sorted(f.getPath().getName() for f in store.listStatus(root) if f.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):  # part numbers follow the ranges
        to = hadoop.Path(f"{out}/{k:05d}-{name}")
        store.rename(hadoop.Path(f"{out}-parts/{name}"), to)
        store.setTimes(to, 1_000_000_000_000 + 1000 * k, -1)
    store.delete(root, True)
    return out


def read_replay(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_available_now(df: DataFrame, on_late: str = "drop") -> DataFrame:
    """Runs a stream over all that there is now and gives the rows it wrote. on_late: "drop", or "error" (ValueError), whichever
    batch the late rows came in."""
    if on_late not in ("drop", "error"):
        raise ValueError("on_late must be 'drop' or 'error'")
    spark, out = df.sparkSession, f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    watch = StateWatch() if on_late == "error" else None  # a query itself remembers its latest batches alone
    if watch is not None:
        spark.streams.addListener(watch)
    query = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if watch is not None:
        watch.ended.wait(60)
        spark.streams.removeListener(watch)
        if n := sum(b["late"] for b in watch.batches if b["run"] == str(query.runId)):
            raise ValueError(f"{n} rows came behind the watermark")
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


class StateWatch(StreamingQueryListener):
    """Keeps, of each batch of all queries: rows read, rows held in state, and rows dropped as late. every: of batches that
    end within so many seconds of the last kept one, late rows alone are added to it."""

    def __init__(self, every: float = 0.0) -> None:
        self.batches: list[dict[str, Any]] = []
        self.ended = threading.Event()
        self.every, self.last = every, float("-inf")

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p, now = event.progress, time.monotonic()
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        if self.batches and now - self.last < self.every and self.batches[-1]["run"] == str(p.runId):
            self.batches[-1]["late"] += late
            return
        self.last = now
        self.batches.append({"run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(o.numRowsTotal for o in p.stateOperators), "late": late})

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.ended.set()
