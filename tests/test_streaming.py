import pytest

from bandweave import BandJoinSpec
from bandweave.operators import join
from bandweave.streaming import join as streaming


def replayed(spark, df, files, per_trigger=1):
    return streaming.read_replay(spark, streaming.write_replay(df, files), df, per_trigger)


def test_stream_equals_batch(spark, side):
    r = side([(t, (t * 37) % 100) for t in range(300)])
    s = side([(t, (t * 53) % 100) for t in range(300)])
    spec = BandJoinSpec(20, 5, "key_bucket")
    watch = streaming.StateWatch()
    spark.streams.addListener(watch)
    got = streaming.run_available_now(streaming.stream_band_join(replayed(spark, r, 4), replayed(spark, s, 2), spec), on_late="error")
    spark.streams.removeListener(watch)
    assert join.same_pairs(got, join.band_join(r, s, spec)).isEmpty()
    assert got.where("r_ts = 0").count() > 0  # rows at the epoch aren't late


def test_late_rows(spark, side):
    r = side([(t, 1) for t in (0, 5000, 1, 9000)])
    folder = streaming.write_replay(side([(0, 1)]), 1)
    for rows in ([(50_000, 1)], [(60_000, 1)], [(1, 1)], [(70_000, 1)]):
        side(rows).coalesce(1).write.mode("append").parquet(folder)
    spec = BandJoinSpec(10, 0, "key_bucket")
    s = replayed(spark, side([(100_000, 1)]), 1)
    stream = lambda: streaming.stream_band_join(streaming.read_replay(spark, folder, r), replayed(spark, side([(0, 1), (50_000, 1), (60_000, 1), (70_000, 1), (80_000, 1)]), 5), spec)
    assert s.isStreaming and streaming.run_available_now(stream()).where("r_ts = 1").count() == 0
    with pytest.raises(ValueError, match="behind the watermark"):
        streaming.run_available_now(stream(), on_late="error")


def test_options(spark, side):
    with pytest.raises(ValueError):
        streaming.stream_band_join(side([]), side([]), BandJoinSpec(1, 1, preload="broadcast"))
    with pytest.raises(ValueError):
        streaming.run_available_now(side([]), on_late="x")


def test_late_rows_of_any_batch_are_seen(spark, side, monkeypatch):
    """The query remembers its last batch alone; the late row comes well before."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        r, s = ([side([(t, 1)]) for t in (0, 100_000, 150_000, late, 200_000, 300_000, 400_000)] for late in (10, 150_001))
        folders = []
        for rows in (r, s):
            parts = [streaming.write_replay(df, 1) for df in rows]
            folder = f"{parts[0]}-all"
            hadoop = spark._jvm.org.apache.hadoop.fs
            store = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
            store.mkdirs(hadoop.Path(folder))
            for k, part in enumerate(parts):
                for f in store.listStatus(hadoop.Path(part)):
                    to = hadoop.Path(f"{folder}/{k}-{f.getPath().getName()}")
                    store.rename(f.getPath(), to)
                    store.setTimes(to, 1_000_000_000_000 + 1000 * k, -1)
            folders.append(folder)
        streams = [streaming.read_replay(spark, folder, r[0]) for folder in folders]
        with pytest.raises(ValueError, match="behind the watermark"):
            streaming.run_available_now(streaming.stream_band_join(*streams, BandJoinSpec(5, 1)), on_late="error")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_the_slower_side_sets_the_watermark(spark, side):
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    try:
        with pytest.raises(ValueError, match="multipleWatermarkPolicy"):
            streaming.stream_band_join(side([]), side([]), BandJoinSpec(5, 1))
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


def test_a_hot_key_is_cut_by_time(spark, side):
    """A row that comes is held against all state of its bucket: here that were all rows of a side."""
    rows = [(t, 7) for t in range(-300, 600)]
    spec = BandJoinSpec(4, 2, "key_bucket")
    stream = streaming.stream_band_join(replayed(spark, side(rows), 2), replayed(spark, side(rows), 3), spec)
    plan = next(x for x in stream._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in x)
    assert plan.count(" = ") == 2  # of key and time buckets
    got = streaming.run_available_now(stream, on_late="error")
    assert got.count() == 900 * 9 - 4 * 5 and join.same_pairs(got, join.band_join(side(rows), side(rows), spec)).isEmpty()


@pytest.mark.parametrize("options", [{"key_width": 1}, {"ts_width": 1}, {"key_width": 50, "ts_width": 3}])
def test_widths_of_a_stream(spark, side, options):
    r, s = (side([(t, (t * p) % 40 - 20) for t in range(100)]) for p in (37, 53))
    spec = BandJoinSpec(6, 3, "key_bucket", **options)
    got = streaming.run_available_now(streaming.stream_band_join(replayed(spark, r, 2), replayed(spark, s, 2), spec), on_late="error")
    assert join.same_pairs(got, join.band_join(r, s, spec)).isEmpty()
