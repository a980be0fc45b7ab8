import random
import struct

import pytest
from pyspark.sql import functions as F

from bandweave.functions import exprs
from bandweave.operators import report, window
from bandweave.sources import binary_keys, delimited, from_table, make_source


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merge(side):
    r, s = side([(0, 1), (5, 2), (5, 3)]), side([(5, 9), (1, 8)])
    assert [(x["ts"], x["side"]) for x in window.merge_ordered(r, s).collect()] == [(0, "R"), (1, "S"), (5, "R"), (5, "R"), (5, "S")]
    assert [(x["pos"], x["ts"], x["key"]) for x in window.merge_positions(r, s).orderBy("pos").collect()] == [(0, 0, 1), (1, 1, 8), (2, 5, 2), (3, 5, 3), (4, 5, 9)]
    assert window.merge_ordered(r, None).count() == 3 and window.merge_ordered(None, s).count() == 2
    with pytest.raises(ValueError):
        window.merge_ordered(None, None)


def test_merge_of_sequences(spark):
    seq = lambda end, step=1: make_source(spark, "sequential", end=end, step=step)
    for r, s, n in ((seq(10), seq(20), 30), (seq(10), seq(20, 5), 14)):
        ts = [x["ts"] for x in window.merge_ordered(r, s).collect()]
        assert len(ts) == n and ts == sorted(ts)


def test_range_and_expiry(side):
    df = side([(0, 1), (1, 2), (2, 3), (3, 4)])
    count = lambda low, high, d=df: window.range_search(d, low, high).count()
    assert (count(1, 4), count(0, 1), count(4, 7), count(4, 1)) == (4, 1, 1, 0)
    rest = window.live(df, 3, 2)
    assert count(0, 3, rest) == 2 and rows(window.expired(df, 3, 2)) == [(0, 1, 1)]
    assert rows(window.oldest(df)) == [(0, 1, 1)] and window.oldest(df.limit(0)).isEmpty()
    assert window.size(df.limit(0)).first()["is_empty"] and window.size(df).first()["n_rows"] == 4


def test_window_sizes(spark):
    rng = random.Random(1)
    data = [(rng.randint(-30, 60), rng.choice("RS")) for _ in range(200)]
    df = spark.createDataFrame(data, "ts bigint, side string")
    for w in (0, 1, 7, 1000, 1 << 61):
        expected = sorted((t, s, sum(b == s and t - w <= a <= t for a, b in data)) for t, s in data)
        assert rows(window.window_sizes(df, w)) == expected
    means = {s: sum(n for _, b, n in expected if b == s) // sum(b == s for _, b in data) for s in "RS"}
    assert dict(rows(window.mean_window_sizes(df, 1 << 61))) == means


def test_duplicates_and_order(spark, side):
    df = side([(0, 1), (3, 1), (9, 1), (9, 2)])
    assert rows(window.duplicate_keys(df, 3)) == [(1, 3, 0)] and rows(window.duplicate_keys(df, 6)) == [(1, 3, 0), (1, 9, 3)]
    rng = random.Random(2)
    values = [rng.randint(0, 9) for _ in range(100)]
    df = spark.createDataFrame([(k - 50, v) for k, v in enumerate(values)], "arrival bigint, value bigint")
    assert rows(window.unsorted(df, "arrival", "value", 7)) == [(k - 50, b, a) for k, (a, b) in enumerate(zip(values, values[1:]), 1) if b < a]
    with pytest.raises(ValueError, match="decreasing"):
        window.require_sorted(df, "arrival", "value")
    assert window.require_sorted(df.withColumn("value", F.col("arrival")), "arrival", "value").count() == 100


def test_generated(spark):
    df = make_source(spark, "random", end=150, start=50, seed=9)
    got = df.collect()
    assert [x["ts"] for x in got] == list(range(50, 150)) and sorted(x["key"] for x in got) == list(range(100)) and all(x["key"] == x["value"] for x in got)
    got = make_source(spark, "shuffled", end=150, start=50, seed=9).collect()
    assert sorted(x["ts"] for x in got) == list(range(50, 150)) and sorted(x["key"] for x in got) == list(range(100))
    assert rows(make_source(spark, "sequential", start=2, end=9, step=3)) == [(k, k, k) for k in (2, 5, 8)]
    assert make_source(spark, "sequential", start=9, end=2).isEmpty() and make_source(spark, "random").isEmpty()
    big = make_source(spark, "random", end=4_000_000_000, start=3_999_999_990, seed=1)
    assert big.count() == 10
    for bad in ({"kind": "x"}, {"kind": "sequential", "end": 3, "step": 0}, {"kind": "random", "end": 1, "start": 2}):
        with pytest.raises(ValueError):
            make_source(spark, **bad)


def test_delimited(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0| x|\n1|ARGENTINA|1|\n2|BRAZIL|1abc|\n\n")
    path = str(tmp_path / "nation.tbl")
    assert rows(delimited(spark, path, 3, 2)) == [(0, 0, "ALGERIA"), (1, 1, "ARGENTINA"), (2, 1, "BRAZIL")]
    assert rows(delimited(spark, path, 1, 1)) == [(0, 0, "0"), (1, 1, "1"), (2, 2, "2")]
    with pytest.raises(ValueError):
        delimited(spark, path, 0, 2)
    with pytest.raises(Exception, match="no key or value"):
        delimited(spark, path, 2, 3).collect()
    many = tmp_path / "many"
    many.mkdir()
    for f in range(3):
        (many / f"part{f}").write_text("".join(f"{f * 1000 + k}|v\n" for k in range(1000)))
    assert rows(delimited(spark, str(many), 1, 2)) == [(k, k, "v") for k in range(3000)]


def test_binary_keys(spark, tmp_path):
    keys = [(1 << 64) - 1, 0, 5, 1 << 63] * 5
    path = tmp_path / "keys"
    path.write_bytes(struct.pack(f"<Q{len(keys)}Q", len(keys), *keys))
    got = sorted(binary_keys(spark, str(path), span=3).collect())
    assert [int(x["key"]) for x in got] == keys and [x["ts"] for x in got] == list(range(20))
    mixed = binary_keys(spark, str(path), size=12, seed=1)
    assert sorted(x["ts"] for x in mixed.collect()) == list(range(12)) and mixed.count() == 12
    with pytest.raises(ValueError, match="20 keys"):
        binary_keys(spark, str(path), size=21)
    (tmp_path / "k32").write_bytes(struct.pack("<Q3I", 3, 7, 8, (1 << 32) - 1))
    assert rows(binary_keys(spark, str(tmp_path / "k32"), type="uint32")) == [(0, 7, 7), (1, 8, 8), (2, (1 << 32) - 1, (1 << 32) - 1)]
    (tmp_path / "none").write_bytes(struct.pack("<Q", 0))
    assert binary_keys(spark, str(tmp_path / "none")).isEmpty()


def test_unsigned_keys_join(spark, tmp_path):
    from bandweave import BandJoinSpec
    from bandweave.operators import join

    keys = [(1 << 64) - 1, (1 << 64) - 5, 0, 3]
    (tmp_path / "k").write_bytes(struct.pack("<Q4Q", 4, *keys))
    df = binary_keys(spark, str(tmp_path / "k"))
    got = {(p["r_ts"], p["s_ts"]) for p in join.band_join(df, df, BandJoinSpec(9, 4, "nested_loop")).collect()}
    assert got == {(a, b) for a in range(4) for b in range(4) if abs(keys[a] - keys[b]) <= 4}


def test_from_table(spark, tmp_path, side):
    side([(1, 2)]).withColumn("other", F.lit(1)).write.parquet(str(tmp_path / "t"))
    assert rows(from_table(spark, str(tmp_path / "t"), "ts", "key")) == [(1, 2, 2)]


def test_expressions(spark):
    for k, w in ((-1, 5), (-5, 5), (4, 5), (2**53 + 1, 2), (-(2**63), 7), (2**63 - 1, 7)):
        df = spark.createDataFrame([(k,)], "k bigint")
        assert df.select(exprs.fdiv(F.col("k"), w)).first()[0] == k // w
    df = spark.createDataFrame([(1, 2, 3, "R")], "ts bigint, key bigint, value bigint, side string")
    assert tuple(df.select(exprs.short_text(), exprs.long_text(), exprs.full_text()).first()) == ("T(1,2,R)", "(ts=1, key=2, R)", "(ts = 1, key = 2, value = 3, R)")


def test_reports(spark, tmp_path):
    df = report.results(spark, [("a", "x", 1, 1, "SUCCESS", 1.0, 4.0), ("a", "x", 1, 2, "SUCCESS", 1.0, 6.0), ("a", "x", 1, 3, "TIMEOUT", None, None)])
    report.write_results(df, str(tmp_path / "csv"))
    again = report.read_results(spark, str(tmp_path / "csv"))
    assert rows(report.summary(again)) == [("a", "x", 1, 5.0, 2)]
    lines = spark.createDataFrame([("Window 3: Join count: 42",), ("window 4 join count: 7",), ("other",)], "value string")
    assert rows(report.parsed_log(lines)) == [(3, 42), (4, 7)]
    assert report.throughput("x", 2.0, 10) == "x: 2000.00 ms, 5.00 tuples/s"
