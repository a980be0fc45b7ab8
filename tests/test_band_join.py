import random

import pytest
from pyspark.sql import functions as F

from bandweave import BandJoinSpec
from bandweave.operators import join
from bandweave.plans import paths
from bandweave.sources import make_source

ALL = ["nested_loop", "key_bucket", "time_bucket", "grid", "quantile", "replicated", "auto"]
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def brute(r, s, w, d):
    return sorted((a, b, x, y) for a, b in r for x, y in s if abs(a - x) <= w and abs(b - y) <= d)


def pairs(df):
    return sorted((p["r_ts"], p["r_key"], p["s_ts"], p["s_key"]) for p in df.collect())


@pytest.mark.parametrize("path", ALL)
def test_paths_equal_brute_force(side, path):
    rng = random.Random(path)
    for w, d, spread in ((0, 0, 5), (3, 2, 30), (50, 7, 1000)):
        r = [(rng.randint(-20, 40), rng.randint(-spread, spread)) for _ in range(60)]
        s = [(rng.randint(-20, 40), rng.randint(-spread, spread)) for _ in range(60)]
        assert pairs(join.band_join(side(r), side(s), BandJoinSpec(w, d, path, parts=5))) == brute(r, s, w, d)


@pytest.mark.parametrize("path", ["key_bucket", "quantile", "replicated", "time_bucket"])
def test_extreme_keys(side, path):
    rows = [(0, LOW), (1, LOW + 1), (2, HIGH), (3, HIGH - 1), (4, 0), (5, -1)]
    assert pairs(join.band_join(side(rows), side(rows), BandJoinSpec(10, 3, path, parts=3))) == brute(rows, rows, 10, 3)
    wide = (1 << 63) - 1
    assert join.count_pairs(side(rows), side(rows), BandJoinSpec(10, wide, path, parts=3)).first()[0] == len(brute(rows, rows, 10, wide))


def test_extreme_times(side):
    rows = [(LOW, 1), (LOW + 2, 1), (HIGH, 1), (HIGH - 2, 1)]
    for path in ("key_bucket", "time_bucket", "nested_loop"):
        assert pairs(join.band_join(side(rows), side(rows), BandJoinSpec(2, 0, path))) == brute(rows, rows, 2, 0)


def test_bounds_are_inclusive(side):
    r, s = side([(100, 100)]), side([(104, 100), (105, 100), (100, 107), (100, 108)])
    assert [(p[2], p[3]) for p in pairs(join.band_join(r, s, BandJoinSpec(4, 7)))] == [(100, 107), (104, 100)]


def test_repeated_rows_make_repeated_pairs(side):
    assert join.count_pairs(side([(1, 5), (1, 5)]), side([(1, 5), (1, 5), (1, 6)]), BandJoinSpec(0, 0, "key_bucket")).first()[0] == 4


def test_nulls_and_empty_sides(side):
    some = side([(1, None), (None, 1), (1, 1)])
    for path in ALL:
        assert join.count_pairs(some, some, BandJoinSpec(5, 5, path, parts=2)).first()[0] == 1
        assert join.count_pairs(some, side([]), BandJoinSpec(5, 5, path, parts=2)).first()[0] == 0
        assert join.count_pairs(side([]), side([]), BandJoinSpec(5, 5, path, parts=2)).first()[0] == 0


def test_closed_form(spark):
    n, w, d = 3000, 400, 20
    seq = make_source(spark, "sequential", end=n)
    m = min(w, d)
    for path in ("key_bucket", "time_bucket", "quantile", "replicated"):
        assert join.count_pairs(seq, seq, BandJoinSpec(w, d, path)).first()[0] == n * (2 * m + 1) - m * (m + 1) == 122_580


def fixture(spark):
    from pyspark.sql import functions as F

    base = spark.range(20_000).select(F.col("id").alias("ts"))
    return [base.withColumn("key", (7919 * F.col("ts") + b) % 20_000).withColumn("value", F.col("key")) for b in (1, 77)]


def test_permutation_fixture(spark):
    r, s = fixture(spark)
    spec = BandJoinSpec(400, 200, "key_bucket", workers=8)
    assert join.count_pairs(r, s, spec).first()[0] == 334_782
    counts = {x["worker"]: x["n_pairs"] for x in join.worker_counts(r, s, spec).collect()}
    assert [counts[k] for k in range(8)] == [41853, 41844, 41849, 41848, 41844, 41852, 41847, 41845]
    assert join.total(join.worker_counts(r, s, spec.but(path="replicated"))).first()[0] == 334_782
    assert join.count_pairs(r, s, spec.but(preload="broadcast")).first()[0] == 331_553


def test_preload_formulas(side):
    rng = random.Random(4)
    n, w, d, k = 300, 40, 20, 4
    r, s = ([(t, rng.randint(0, 100)) for t in range(n)] for _ in range(2))
    every = brute(r, s, w, d)
    out = join.band_join(side(r), side(s), BandJoinSpec(w, d, "key_bucket", preload="broadcast"))
    assert pairs(out) == [p for p in every if not (p[0] < w and p[2] < w)]
    block = w // k
    out = join.band_join(side(r), side(s), BandJoinSpec(w, d, "time_bucket", preload="handshake", workers=k))
    assert pairs(out) == [p for p in every if not (p[0] < w and p[2] < w and p[0] // block + p[2] // block <= k - 1)]
    out = join.band_join(side(r), side(s), BandJoinSpec(3, d, "key_bucket", preload="handshake", workers=k))
    assert pairs(out) == brute(r, s, 3, d)  # blocks of no rows preload nothing
    with pytest.raises(ValueError, match="preload"):
        join.band_join(side(r[:10]), side(s), BandJoinSpec(w, d, preload="broadcast"))


def test_replication_without_broadcast(side):
    rng = random.Random(8)
    r, s = ([(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(80)] for _ in range(2))
    assert pairs(join.band_join(side(r), side(s), BandJoinSpec(5, 5, "replicated", broadcast_rows=3))) == brute(r, s, 5, 5)


def test_salt_and_difference(side):
    rng = random.Random(9)
    r, s = ([(rng.randint(0, 50), rng.randint(0, 9)) for _ in range(80)] for _ in range(2))
    one = join.band_join(side(r), side(s), BandJoinSpec(5, 5, "key_bucket", salt=3))
    assert join.same_pairs(one, join.band_join(side(r), side(s), BandJoinSpec(5, 5, "nested_loop"))).isEmpty()
    assert not join.same_pairs(one, one.limit(3)).isEmpty()
    assert join.duplicate_pairs(one.unionByName(one)).count() == one.distinct().count()


def test_bucketed_plans_hash(side):
    big = side([(1, 1)])
    plan = join.band_join(big, big, BandJoinSpec(5, 5, "key_bucket"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("bad", [{"window": -1}, {"band": -1}, {"workers": 0}, {"path": "x"}, {"preload": "x"}, {"parts": 0}, {"salt": 0}, {"key_width": 0}])
def test_spec_is_validated(bad):
    with pytest.raises(ValueError):
        BandJoinSpec(**{"window": 1, "band": 1, **bad})


def test_names_of_paths():
    assert BandJoinSpec(1, 1, "bplustree").path == "key_bucket" and BandJoinSpec(1, 1, "alex").path == "quantile" and set(ALL) == set(paths.PATHS)


def test_fractional_keys(spark):
    rng = random.Random(3)
    rows = [(t, rng.uniform(-5, 5)) for t in range(60)]
    df = spark.createDataFrame([(t, k, k) for t, k in rows], "ts bigint, key double, value double")
    assert pairs(join.band_join(df, df, BandJoinSpec(9, 0.5, "key_bucket"))) == brute(rows, rows, 9, 0.5)


def test_a_path_can_be_added(side):
    def by_key(r, s, spec):
        return paths.kept(r.join(s, F.abs(F.col("r_key") - F.col("s_key")) <= spec.band).where(paths.exact(spec)))

    paths.register("by_key", by_key)
    try:
        r = side([(1, 5), (2, 9)])
        assert join.band_join(r, r, BandJoinSpec(5, 1, "by_key")).count() == 2
        with pytest.raises(ValueError, match="already"):
            paths.register("by_key", by_key)
    finally:
        del paths.PATHS["by_key"]
        paths.NAMES.remove("by_key")


def test_a_nested_loop_refuses_large_inputs(spark, monkeypatch):
    monkeypatch.setattr(paths, "MOST_PAIRS", 99)
    rows = spark.range(10).select(F.col("id").alias("ts"), F.col("id").alias("key"), F.col("id").alias("value"))
    with pytest.raises(ValueError, match="another path"):
        join.band_join(rows, rows, BandJoinSpec(1, 1, "nested_loop"))


def test_auto_takes_the_grid_where_both_ranges_are_narrow(spark, monkeypatch):
    rows = spark.range(40_000).select(F.col("id").alias("ts"), (F.col("id") * 7919 % 40_000).alias("key"), F.col("id").alias("value"))
    taken = []
    for name in ("grid", "time_bucket", "key_bucket"):
        monkeypatch.setattr(paths, name, lambda r, s, spec, f=getattr(paths, name), name=name: taken.append(name) or f(r, s, spec))
    wide = {name: join.band_join(rows, rows, BandJoinSpec(w, d)).count() for name, w, d in (("grid", 100, 100), ("time_bucket", 20, 40_000), ("key_bucket", 40_000, 20))}
    assert taken == [*wide] and all(wide.values())


def test_skewed_keys_on_quantiles(side):
    import random

    rng = random.Random(3)
    r, s = ([(t, int(rng.paretovariate(0.5))) for t in range(300)] for _ in range(2))
    assert pairs(join.band_join(side(r), side(s), BandJoinSpec(200, 3, "quantile", parts=16))) == brute(r, s, 200, 3)


@pytest.mark.parametrize("rows, most", [(1 << 17, 1 << 20), (8, 16)])
def test_pairs_are_counted_without_being_made(side, monkeypatch, rows, most):
    from bandweave.operators import counting

    monkeypatch.setattr(counting, "ROWS", rows)
    monkeypatch.setattr(counting, "MOST", most)
    monkeypatch.setattr(counting, "WORTH", -1.0)
    rng, big = random.Random(5), (1 << 63) - 1
    keys = [*range(-20, 20), *[3] * 30, big, big - 2, -big - 1, -big, None]
    sides = [[(rng.choice([None, *range(60), *range(60), big, -big - 1]), rng.choice(keys)) for _ in range(n)] for n in (150, 110)]
    near = lambda a, b, by: a is not None and b is not None and abs(a - b) <= by
    for window, band in ((0, 0), (7, 2), (1000, 0), (0, 1000), (big // 4, 5)):
        pairs = [(x, y) for x in sides[0] for y in sides[1] if near(x[0], y[0], window) and near(x[1], y[1], band)]
        r, s = map(side, sides)
        spec = BandJoinSpec(window, band, workers=3)
        assert join.count_pairs(r, s, spec).first()[0] == len(pairs)
        assert dict(join.worker_counts(r, s, spec).collect()) == {w: sum(y[0] % 3 == w for _, y in pairs) for w in range(3)}
    assert join.count_pairs(side(sides[0]).limit(0), side(sides[1]), BandJoinSpec(5, 5)).first()[0] == 0


def joins(df):
    """The kinds of join in a plan."""
    import re

    return set(re.findall(r"\w+Join", df._jdf.queryExecution().executedPlan().toString()))


def known(spark, n, times, keys):
    """Rows whose number Catalyst knows, so that it broadcasts them where it may."""
    return spark.range(n).select((F.col("id") % times).alias("ts"), (F.col("id") * 7919 % keys).alias("key"), F.col("id").alias("value"))


def test_many_salted_copies_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(paths, "CHAINED", 100)
    df = known(spark, 80, 50, 60)
    rows = [(x["ts"], x["key"]) for x in df.collect()]
    spec = BandJoinSpec(5, 5, "key_bucket", salt=4, broadcast_rows=500)  # S is copied to 2 or 3 buckets of 4 parts
    for most, kind in ((500, "SortMergeJoin"), (5000, "BroadcastHashJoin")):
        out = join.band_join(df, df, spec.but(broadcast_rows=most))
        assert joins(out) == {kind} and pairs(out) == brute(rows, rows, 5, 5)


def test_the_difference_of_two_large_joins_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(paths, "CHAINED", 100)
    df = known(spark, 20_000, 20_000, 20_000)
    wide, narrow = (BandJoinSpec(200, band, broadcast_rows=10_000) for band in (100, 60))
    out = join.same_pairs(join.band_join(df, df, wide), join.band_join(df, df, narrow))
    assert joins(out) == {"SortMergeJoin"}
    slow = join.band_join(df, df, wide.but(path="nested_loop")).where("abs(r_key - s_key) > 60")
    assert out.count() == slow.count() > 0 and join.same_pairs(out.drop("n_one", "n_two"), slow).isEmpty()
    assert out.where("n_one = 1 and n_two = 0").count() == out.count()


def test_what_the_joins_of_a_difference_send_through_the_driver_is_bounded(spark):
    df = known(spark, 30_000, 30_000, 30_000)  # on the grid about 270,000 copies: below broadcast_rows, but for each of the joins
    wide, narrow = (BandJoinSpec(400, band, "grid") for band in (200, 100))
    out = join.same_pairs(join.band_join(df, df, wide), join.band_join(df, df, narrow))
    assert joins(out) == {"SortMergeJoin"}
    slow = join.band_join(df, df, wide.but(path="time_bucket")).where("abs(r_key - s_key) > 100")
    assert out.count() == slow.count() > 0 and join.same_pairs(out.drop("n_one", "n_two"), slow).isEmpty()


def test_few_rows_of_long_values_are_not_broadcast(spark):
    df = known(spark, 200, 50, 60).withColumn("value", F.repeat(F.lit("x"), 50_000))
    rows = [(x["ts"], x["key"]) for x in df.collect()]
    out = join.band_join(df, df, BandJoinSpec(5, 5, "grid"))
    assert joins(out) == {"SortMergeJoin"} and pairs(out) == brute(rows, rows, 5, 5)


def test_long_buckets_of_the_key_are_cut_by_time(side):
    rng = random.Random(12)
    cut = lambda df: "_tb" in df._jdf.queryExecution().analyzed().toString()
    few = [(t, t % 3 * 10) for t in range(6000)]  # three keys: a bucket has a third of all rows, a window 2 of them at most
    out = join.self_join(side(few), BandJoinSpec(3, 2, "key_bucket"))
    assert cut(out) and out.count() == 6000 * 3 - 6
    assert not cut(join.self_join(side(few), BandJoinSpec(6000, 2, "key_bucket")))  # all rows are in the window
    assert not cut(join.self_join(side([(t, t * 10) for t in range(6000)]), BandJoinSpec(3, 2, "key_bucket")))
    rows = [[(rng.randint(-900, 900), 0 if rng.random() < 0.9 else rng.choice([LOW, HIGH, -1, 1, 5])) for _ in range(1500)] for _ in range(2)]
    out = join.band_join(*map(side, rows), BandJoinSpec(2, 1, "key_bucket"))
    assert cut(out) and pairs(out) == brute(*rows, 2, 1)


def test_repeated_pairs_of_few_keys_are_met_within_the_window(side):
    from collections import Counter

    rows = [(t, t * 7 % 4) for t in range(4000)]
    pairs_of = join.self_join(side(rows), BandJoinSpec(5, 1, "key_bucket")).select("r_key", "s_key")
    assert "_tb" in pairs_of._jdf.queryExecution().analyzed().toString()
    near = Counter((k, rows[u][1]) for t, k in rows for u in range(max(0, t - 5), min(4000, t + 6)) if abs(k - rows[u][1]) <= 1)
    assert {(x[0], x[1]): x["n"] for x in join.duplicate_pairs(pairs_of).collect()} == near


def test_a_nested_loop_over_many_rows_goes_by_blocks_of_time(side, monkeypatch):
    monkeypatch.setattr(paths, "MOST_PAIRS", 10_000)
    monkeypatch.setattr(paths, "BLOCK", 50)
    rng = random.Random(13)
    r, s = ([(rng.choice([LOW, LOW + 1, HIGH, None, *range(-200, 200)]), rng.choice([None, LOW, *range(30)])) for _ in range(n)] for n in (300, 200))
    whole = [[x for x in rows if None not in x] for rows in (r, s)]
    for w, d in ((0, 0), (7, 2), (30, 40)):
        assert pairs(join.band_join(side(r), side(s), BandJoinSpec(w, d, "nested_loop"))) == brute(*whole, w, d)
    assert join.band_join(side([(None, 1)] * 300), side(s), BandJoinSpec(3, 1, "nested_loop")).isEmpty()
    assert pairs(join.band_join(side([(5, 1)]), side(s * 60), BandJoinSpec(3, 1, "nested_loop"))) == brute([(5, 1)], whole[1] * 60, 3, 1)
    with pytest.raises(ValueError, match="another path"):  # one time: a block of all pairs
        join.band_join(side([(5, 1)] * 300), side([(5, 1)] * 200), BandJoinSpec(3, 1, "nested_loop"))


def test_what_is_cut_by_time_isnt_copied_to_many_buckets(side, monkeypatch):
    copies, salted = [], paths._salted
    monkeypatch.setattr(paths, "_salted", lambda r, s, *rest: copies.append(s.count()) or salted(r, s, *rest))
    spec = BandJoinSpec(3, 2, "key_bucket")
    near = [(t, t * 2 % 9) for t in range(6000)]
    far = [(t + 10**12 * (t // 300), k) for t, k in near]  # in clusters: the range of the times tells little
    for rows in (near, far, [(LOW + t, k) for t, k in near], [(HIGH - t, k) for t, k in near]):
        out = join.self_join(side(rows), spec)
        met = [(a, b, x, y) for n, (a, b) in enumerate(rows) for x, y in rows[max(0, n - 3) : n + 4] if abs(a - x) <= 3 and abs(b - y) <= 2]
        assert pairs(out) == sorted(met) and copies.pop() <= 4 * len(rows)
    join.self_join(side(near), spec.but(ts_width=4))  # a width that is given stays
    assert copies.pop() > 5 * len(near)
