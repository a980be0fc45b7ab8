"""The engine's queries over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.functions import exprs
from bandweave.operators import join, report, window
from bandweave.plans.spec import BandJoinSpec
from bandweave.sources import binary_keys, delimited, generated, make_source
from bandweave.streaming import join as streaming

HOUR_US = 3_600_000_000
PAIR = "r_ts, r_key, r_value, s_ts, s_key, s_value"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sides

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def events(spark: SparkSession, sf_dir: str, kind: str, key: str = "cast(round(value * 100) as bigint)") -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.expr(MICROS).alias("ts"), F.expr(key).alias("key"), F.col("event_id").alias("value"))


def events_sql(key: str = "cast(round(value * 100) as bigint)") -> str:
    return ", ".join(f"{n} as (select epoch_us(ts) as ts, {key} as key, event_id as value from events where event_type = '{kind}')" for n, kind in (("r", "view"), ("s", "purchase")))


def orders(spark: SparkSession, sf_dir: str, key: str = "o_orderkey") -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ts"), F.expr(key).alias("key"), F.col("o_custkey").alias("value"))


def orders_sql(r: str = "o_orderkey", s: str | None = None) -> str:
    return ", ".join(f"{n} as (select o_orderkey as ts, {key} as key, o_custkey as value from orders)" for n, key in (("r", r), ("s", s or r)))


def pairs_sql(window: int, band: str, sides: str, where: str = "") -> str:
    return f"with {sides} select r.ts as r_ts, r.key as r_key, r.value as r_value, s.ts as s_ts, s.key as s_key, s.value as s_value from r, s where s.ts between r.ts - {window} and r.ts + {window} and {band}{where}"


def permuted(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    df = orders(spark, sf_dir)
    n = df.count()
    return df.select("ts", generated.permuted("ts", n, 7919, shift).alias("key"), "value")


PERM = [f"(o_orderkey * 7919 + {b}) % (select count(*) from orders)" for b in (1, 77)]
PERM_SPEC = BandJoinSpec(400, 200)
PERM_SQL = pairs_sql(400, "s.key between r.key - 200 and r.key + 200", orders_sql(*PERM))
EVENTS_SPEC = BandJoinSpec(24 * HOUR_US, 100, "key_bucket")
EVENTS_SQL = pairs_sql(24 * HOUR_US, "s.key between r.key - 100 and r.key + 100", events_sql())

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# The join


@query(EVENTS_SQL)
def band_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(events(spark, sf_dir, "view"), events(spark, sf_dir, "purchase"), EVENTS_SPEC)


@query(EVENTS_SQL)
def band_join_events_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(events(spark, sf_dir, "view"), events(spark, sf_dir, "purchase"), EVENTS_SPEC.but(path="auto"))


@query(pairs_sql(HOUR_US, "abs(r.key - s.key) <= 1.0", events_sql("value")))
def band_join_events_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(events(spark, sf_dir, "view", "value"), events(spark, sf_dir, "purchase", "value"), BandJoinSpec(HOUR_US, 1.0, "key_bucket"))


@query(pairs_sql(50, "s.key between r.key - 20 and r.key + 20", orders_sql()))
def band_join_orders_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.self_join(orders(spark, sf_dir), BandJoinSpec(50, 20))


def _path(path: str, **options: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r, s = permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77)
        return join.band_join(r, s, PERM_SPEC.but(path=path, **options)).select(*PAIR.split(", "))

    run.__name__ = f"band_join_{path}" + "_salted" * bool(options)
    query(PERM_SQL)(run)


for _name in ("nested_loop", "key_bucket", "time_bucket", "grid", "quantile", "replicated"):
    _path(_name)
_path("key_bucket", salt=4)


@query(PERM_SQL)
def band_join_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), PERM_SPEC)


@query(f"with p as ({PERM_SQL}) select w.worker, count(p.s_ts) as n_pairs from (select unnest(range(8)) as worker) w left join p on p.s_ts % 8 = w.worker group by w.worker")
def broadcast_worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.worker_counts(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), PERM_SPEC.but(path="replicated", workers=8))


@query(f"select count(*) as n_pairs from ({PERM_SQL})")
def band_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.count_pairs(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), PERM_SPEC)


@query(f"select count(*) as n_pairs from ({PERM_SQL})")
def worker_count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.total(join.worker_counts(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), PERM_SPEC.but(workers=8)))


@query(pairs_sql(2000, "r.key = s.key", orders_sql("o_custkey")))
def band_join_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.self_join(orders(spark, sf_dir, "o_custkey"), BandJoinSpec(2000, 0, "key_bucket"))


@query(pairs_sql(0, "s.key between r.key - 80 and r.key + 80", orders_sql(*PERM)))
def band_join_zero_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), BandJoinSpec(0, 80, "time_bucket"))


@query(pairs_sql(300, "s.key between r.key - 2 and r.key + 2", orders_sql("o_custkey % 500")))
def band_join_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.self_join(orders(spark, sf_dir, "o_custkey % 500"), BandJoinSpec(300, 2, "key_bucket"))



@query(
    f"with e as (select o_orderkey as ts, cast(case when o_orderkey % 2 = 0 then 9223372036854775807 - o_custkey else -9223372036854775807 + o_custkey end as bigint) as key, o_custkey as value from orders) "
    "select r.ts as r_ts, r.key as r_key, r.value as r_value, s.ts as s_ts, s.key as s_key, s.value as s_value from e r, e s "
    "where s.ts between r.ts - 200 and r.ts + 200 and abs(cast(r.key as hugeint) - cast(s.key as hugeint)) <= 300"
)
def band_join_saturating(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "case when o_orderkey % 2 = 0 then 9223372036854775807 - o_custkey else -9223372036854775807 + o_custkey end"
    return join.self_join(orders(spark, sf_dir, key), BandJoinSpec(200, 300, "key_bucket"))


_PERM_SIDES = orders_sql(*PERM)
_RANKED = "ra as (select *, row_number() over (order by ts) - 1 as i from r), sa as (select *, row_number() over (order by ts) - 1 as i from s)"
_FROM = "select r.ts as r_ts, r.key as r_key, r.value as r_value, s.ts as s_ts, s.key as s_key, s.value as s_value from ra r, sa s where s.ts between r.ts - 400 and r.ts + 400 and s.key between r.key - 200 and r.key + 200"


@query(f"with {_PERM_SIDES}, {_RANKED} {_FROM} and not (r.i < 400 and s.i < 400)")
def preload_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), PERM_SPEC.but(path="key_bucket", preload="broadcast"))


@query(f"with {_PERM_SIDES}, {_RANKED} {_FROM} and not (r.i < 400 and s.i < 400 and r.i // 100 + s.i // 100 <= 3)")
def preload_handshake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.band_join(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), PERM_SPEC.but(path="key_bucket", preload="handshake", workers=4))


@query(f"select p.*, cast(1 as bigint) as n_one, cast(0 as bigint) as n_two from ({PERM_SQL}) p where s_key not between r_key - 100 and r_key + 100")
def pair_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77)
    return join.same_pairs(join.band_join(r, s, PERM_SPEC), join.band_join(r, s, PERM_SPEC.but(band=100)))


@query(f"select r_key, s_key, count(*) as n from ({pairs_sql(300, 's.key between r.key - 2 and r.key + 2', orders_sql('o_custkey % 500'))}) group by all having count(*) > 1")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.duplicate_pairs(band_join_duplicates(spark, sf_dir).select("r_key", "s_key"))


@query(EVENTS_SQL)
def streaming_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [events(spark, sf_dir, kind) for kind in ("view", "purchase")]
    streams = [streaming.read_replay(spark, streaming.write_replay(df, 3), df) for df in sides]
    return streaming.run_available_now(streaming.stream_band_join(*streams, EVENTS_SPEC, unit="micros"))


# Sources


@query("select unnest(range(5, 1000, 7)) as ts, unnest(range(5, 1000, 7)) as key, unnest(range(5, 1000, 7)) as value")
def source_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_source(spark, "sequential", start=5, end=1000, step=7)


_A, _B = generated.affine(5000, 3)


@query(f"select i + 100 as ts, (i * {_A} + {_B}) % 5000 as key, (i * {_A} + {_B}) % 5000 as value from (select unnest(range(5000)) as i)")
def source_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_source(spark, "random", start=100, end=5100, seed=3)


@query("select cast(sum(ts) as bigint) as ts, cast(sum(key) as bigint) as keys, count(distinct key) as n_keys, count(distinct ts) as n_ts from (select unnest(range(3000)) as ts, unnest(range(3000)) as key)")
def source_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = make_source(spark, "shuffled", end=3000, seed=5)
    return rows.agg(F.sum("ts").alias("ts"), F.sum("key").alias("keys"), F.countDistinct("key").alias("n_keys"), F.countDistinct("ts").alias("n_ts"))


@query("select cast(n_nationkey as bigint) as ts, n_regionkey as key, n_name as value from nation")
def tpc_source_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{streaming.shared_dir(spark)}/nation-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    rows.select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit(""))).write.text(folder)
    return delimited(spark, folder, key_column=3, value_column=2)


@query("select cast(n_nationkey as bigint) as ts, cast(18446744073709551615 - n_nationkey as decimal(20, 0)) as key, cast(18446744073709551615 - n_nationkey as decimal(20, 0)) as value from nation")
def sosd_source_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_keys(spark, sf_dir)


def _nation_keys(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    """A file of the nations' keys as unsigned numbers, read back."""
    import numpy as np
    from pyarrow import fs

    keys = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 rows
    path = f"{streaming.shared_dir(spark)}/keys-{uuid.uuid4().hex}"
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_output_stream(inner) as f:
        f.write(np.array([len(keys), *((1 << 64) - 1 - k for k in keys)], "<u8").tobytes())
    return binary_keys(spark, path, span=10, **options)


# Merged order and windows


@query("select row_number() over (order by ts, side, key, value) - 1 as pos, ts, key, value, side from (select o_orderkey as ts, o_orderkey as key, o_custkey as value, 'R' as side from orders union all select c_custkey, c_custkey, cast(c_nationkey as bigint), 'S' from customer)")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ts"), F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("value"))
    return window.merge_positions(orders(spark, sf_dir), customers)


_SIDES_SQL = "select epoch_us(ts) as ts, event_id as value, event_type as side from events"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(MICROS).alias("ts"), F.col("event_id").alias("value"), F.col("event_type").alias("side"))


@query(f"select ts, value, side, count(*) over (partition by side order by ts range between {HOUR_US} preceding and current row) as n_live from ({_SIDES_SQL})")
def window_size_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.window_sizes(_typed(spark, sf_dir), HOUR_US)


@query(f"select side, cast(sum(n_live) // count(*) as bigint) as mean_live from (select side, count(*) over (partition by side order by ts range between {HOUR_US} preceding and current row) as n_live from ({_SIDES_SQL})) group by side")
def window_size_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.mean_window_sizes(_typed(spark, sf_dir), HOUR_US)


@query("select o_orderkey as ts, o_custkey as key, o_custkey as value from orders where o_custkey between 100 and 120")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.range_search(orders(spark, sf_dir, "o_custkey"), 100, 120)


@query("select key, ts, value from (select o_orderkey as ts, o_custkey as key, o_custkey as value, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n = 1")
def window_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir, "o_custkey")
    return window.oldest(df.withColumn("of", F.col("key")), ["of"]).select("key", "ts", "value")


@query("select o_orderkey as ts, o_custkey as key, o_custkey as value from orders where o_orderkey < 1000 - 250")
def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.expired(orders(spark, sf_dir, "o_custkey"), 1000, 250)


@query("select o_orderkey as ts, o_custkey as key, o_custkey as value from orders where o_orderkey between 750 and 1000")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.live(orders(spark, sf_dir, "o_custkey"), 1000, 250)


@query("select count(*) as n_rows, count(*) = 0 as is_empty from orders where o_orderkey between 750 and 1000")
def window_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.size(live_rows(spark, sf_dir))


@query("select key, ts, earlier_ts from (select o_custkey as key, o_orderkey as ts, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as earlier_ts from orders) where ts - earlier_ts <= 300")
def duplicate_keys_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.duplicate_keys(orders(spark, sf_dir, "o_custkey"), 300)


@query("select arrival, value, previous from (select o_orderkey as arrival, o_orderdate as value, lag(o_orderdate) over (order by o_orderkey) as previous from orders) where value < previous")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.unsorted(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", 1024)


@query("select o_orderkey as ts, o_custkey as key, o_custkey as value, 'R' as side from orders")
def side_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir, "o_custkey")
    return df.withColumn("side", F.lit("R")).unionByName(df.withColumn("side", F.lit("S"))).where(F.col("side") == "R")


# Rows as text, reports


@query("select 'T(' || o_orderkey || ',' || o_custkey || ',R)' as text from orders")
def tuple_format_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_custkey").withColumn("side", F.lit("R")).select(exprs.short_text().alias("text"))


@query("select '(ts=' || o_orderkey || ', key=' || o_custkey || ', S)' as text from orders")
def tuple_format_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_custkey").withColumn("side", F.lit("S")).select(exprs.long_text().alias("text"))


@query("select '(ts = ' || o_orderkey || ', key = ' || o_custkey || ', value = ' || o_custkey || ', UNKNOWN)' as text from orders")
def tuple_format_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_custkey").withColumn("side", F.lit(None).cast("string")).select(exprs.full_text().alias("text"))


@query(f"select 'T(' || r_ts || ',' || r_key || ',R) | T(' || s_ts || ',' || s_key || ',S)' as text from ({PERM_SQL})")
def pair_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = band_join_permutation(spark, sf_dir).withColumn("r", F.lit("R")).withColumn("s", F.lit("S"))
    return pairs.select(exprs.pair_text(exprs.short_text("r_ts", "r_key", "r"), exprs.short_text("s_ts", "s_key", "s")).alias("text"))


_RESULTS = [("broadcast", "bplustree", 4, 1, "SUCCESS", 2.0, 10.0), ("broadcast", "bplustree", 4, 2, "SUCCESS", 4.0, 20.0), ("broadcast", "list", 4, 1, "TIMEOUT", None, None), ("handshake", "alex", 8, 1, "SUCCESS", 1.0, 40.0)]


@query("select * from (values ('broadcast', 'bplustree', 4, 15.0::double, 2::bigint), ('handshake', 'alex', 8, 40.0::double, 1::bigint)) as t(joiner, \"index\", workers, mean_throughput, attempts)")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(report.results(spark, _RESULTS))


@query(ORACLE["broadcast_worker_counts"])
def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.parsed_log(report.log_lines(broadcast_worker_counts(spark, sf_dir)))


@query(f"select * from ({ORACLE['broadcast_worker_counts']}) join (select o_orderkey % 8 as worker, count(*) as s_size, (select count(*) from orders) as r_size from orders group by all) using (worker)")
def window_sizes_of_a_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = permuted(spark, sf_dir, 77)
    sizes = rows.groupBy(F.expr("pmod(ts, 8)").alias("worker")).agg(F.count("*").alias("s_size")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("r_size"))))  # one row
    lines = report.size_lines(sizes).unionByName(report.log_lines(broadcast_worker_counts(spark, sf_dir)))
    return report.window_table(lines)


_VALUES = ", ".join("(" + ", ".join(f"cast({'null' if v is None else repr(v)} as {t.split()[1]})" for v, t in zip(row, report.RESULT.replace("string", "varchar").split(", "))) + ")" for row in _RESULTS)


@query(f"select * from (values {_VALUES}) as t(" + ", ".join(f'"{c.split()[0]}"' for c in report.RESULT.split(", ")) + ")")
def results_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{streaming.shared_dir(spark)}/results-{uuid.uuid4().hex}"
    report.write_results(report.results(spark, _RESULTS), folder)
    return report.read_results(spark, folder)


@query("select 'broadcast: 1500.00 ms, ' || printf('%.2f', count(*) / 1.5) || ' tuples/s' as text from orders")
def throughput_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(report.throughput("broadcast", 1.5, table(spark, sf_dir, "orders").count()),)], "text string")


@query("select cast(25 as bigint) as n_rows, cast(sum(18446744073709551615 - n_nationkey::hugeint) as decimal(30, 0)) as keys, count(distinct n_nationkey) as n_keys, cast(300 as bigint) as ts from nation")
def sosd_source_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation_keys(spark, sf_dir, size=25, seed=9)
    return rows.agg(F.count("*").alias("n_rows"), F.sum("key").cast("decimal(30, 0)").alias("keys"), F.countDistinct("key").alias("n_keys"), F.sum("ts").alias("ts"))


@query(f"select count(*) as n_pairs from ({pairs_sql(7000, 's.key between r.key - 3000 and r.key + 3000', orders_sql(*PERM))})")
def band_join_count_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of so many pairs that they are counted by rank, from some 10,000 rows a side on."""
    return join.count_pairs(permuted(spark, sf_dir, 1), permuted(spark, sf_dir, 77), BandJoinSpec(7000, 3000))
