"""Document fingerprints: weighted term hashes vote on signed bits; permuted block tables find all within a radius.

Terms are the words of a lower-cased text and its pairs of neighbouring words, each weighted by 1 + ln(count); each of
the 128 bits is the sign of the weighted votes of the terms' hashes. Equal texts have equal fingerprints. A text without
words (null, empty, white space) has the fingerprint 0.

Whole texts count, whatever their length. Rows of equal doc_id, or none, follow each other by their compressed texts (an
order that the texts alone decide); null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import arrow_pass, fresh, prepared, salt_copies, salted, written

BITS = 128
#: Weight of a pair of words against that of a single word.
PAIR_WEIGHT = 3.0
#: Fingerprints are near if they differ in at most so many bits.
RADIUS = 6
#: Buckets that neighbours() splits, at most.
FEW_SPLIT = 100_000
SALTS = 16
#: Stands for no doc_id.
NO_ID = (1 << 63) - 1
#: Words whose hashes a worker keeps.
CACHE = 500_000
_hashes: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    kept = _hashes
    if len(kept) > CACHE:
        kept.clear()
    for w in set(words).difference(kept):
        kept[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Bits of x stirred (a public finaliser of 64-bit hashes)."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None) -> tuple[int, int]:
    """The two halves, as signed 64-bit integers."""
    words = word_hashes(text or "")
    if not len(words):
        return 0, 0
    votes = np.zeros(BITS, np.float64)
    pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:], 1)
    for terms, weight in ((words, 1.0), (pairs, PAIR_WEIGHT)):
        terms, counts = np.unique(terms, return_counts=True)
        weights = (weight * (1 + np.log(counts))).astype(np.float32)
        for at in range(0, len(terms), 1 << 15):
            some = terms[at : at + (1 << 15)]
            bits = np.unpackbits(np.stack([mixed(some, 2), mixed(some, 3)], 1).view(np.uint8), axis=1)
            w = weights[at : at + (1 << 15)]
            votes += 2.0 * (w @ bits.astype(np.float32)) - w.sum()
    half = np.packbits(votes > 0).view(">i8")
    return int(half[0]), int(half[1])


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) characters replaced by as many (or all) of what after begins with."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def hex_of(hi: str, lo: str) -> Any:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(one: str, two: str) -> Any:
    """1 less the share of differing bits, of fingerprints in columns <name>_hi and <name>_lo."""
    return F.expr(f"1 - (bit_count({one}_hi ^ {two}_hi) + bit_count({one}_lo ^ {two}_lo)) / {BITS}D")


def fingerprints(docs: DataFrame, text: str = "text", prefix: str = "fingerprint") -> DataFrame:
    """docs with the halves of their texts' fingerprints in columns <prefix>_hi and <prefix>_lo."""
    df = docs.drop(f"{prefix}_hi", f"{prefix}_lo")
    schema = df.selectExpr("*", f"0L as {prefix}_hi", f"0L as {prefix}_lo").schema

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            made = [*map(fingerprint, p[text])]
            yield p | {f"{prefix}_hi": [m[0] for m in made], f"{prefix}_lo": [m[1] for m in made]}

    return arrow_pass(df, work, schema)


CHAINED = "doc_id bigint, n_chars bigint, edited string, fp_hi bigint, fp_lo bigint, edited_hi bigint, edited_lo bigint, next_hi bigint, next_lo bigint"


def chained(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each text with the next one, by ascending doc_id (after the last: the first): n_chars, and fingerprints of the text,
    of its edited text and of the next text; edited is the edited text's SHA-256.

    Texts are dealt out once, compressed, by ranges of doc_id. A range's last text waits for the next range's first: those few are kept
    with their texts and joined by the ranges' numbers, of which the driver knows which hold rows.
    """
    import hashlib

    def made(doc_id: int | None, one: str, fp: tuple[int, int], two: str, fp_two: tuple[int, int]) -> dict[str, Any]:
        new = edited(one, two)
        fp_new = fingerprint(new)
        return dict(zip(names, (doc_id, len(one), hashlib.sha256(new.encode()).hexdigest(), *fp, *fp_new, *fp_two)))

    names = [c.split()[0] for c in CHAINED.split(", ")]
    none = dict.fromkeys([*names, "first", "last", "range"])
    schema = f"{CHAINED}, first string, last string, range int"

    def columns(rows: list[dict[str, Any]]) -> dict[str, list]:
        return {n: [r[n] for r in rows] for n in none}

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at, before, out, unpack = TaskContext.get().partitionId(), None, [], zstandard.ZstdDecompressor()
        for p in parts:
            for doc_id, z in zip(p["doc_id"], p["z"]):
                one = unpack.decompress(z).decode()
                fp = fingerprint(one)
                if before is None:
                    out.append(none | {"first": one, "range": at})
                else:
                    out.append(none | made(*before, one, fp))
                before = doc_id, one, fp
            yield columns(out)
            out = []
        if before is not None:
            yield columns([none | {"doc_id": before[0], "last": before[1], "range": at}])

    def small(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        pack = zstandard.ZstdCompressor(level=1)
        for p in parts:
            yield {"doc_id": p["doc_id"], "z": [pack.compress(x.encode()) for x in p["text"]]}

    def ends(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            rows = [made(i, one, fingerprint(one), two, fingerprint(two)) for i, one, two in zip(p["doc_id"], p["last"], p["first"])]
            yield {n: [r[n] for r in rows] for n in names}

    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = arrow_pass(rows, small, "doc_id bigint, z binary")
    done = written(arrow_pass(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "z"), work, schema, 500), "chained")
    held = sorted(r["range"] for r in done.filter("first is not null").select("range").collect())  # one number for each range
    after = spark.createDataFrame([*zip(held, [*held[1:], *held[:1]])], "range int, next int")
    lasts = done.filter("last is not null").select("doc_id", "last", "range").join(F.broadcast(after), "range")
    heads = done.filter("first is not null").select(F.col("range").alias("next"), "first")
    closed = written(arrow_pass(lasts.join(heads, "next").select("doc_id", "last", "first"), ends, CHAINED), "closed")
    return done.filter("edited is not null").select(*names).unionByName(closed)


def tables(radius: int, spare: int = 2) -> list[tuple[list[tuple[int, int]], ...]]:
    """For each table, the bit ranges (start, length) of its key: all but radius of radius + spare blocks."""
    n = radius + spare
    cuts = [k * BITS // n for k in range(n + 1)]
    return [*combinations([(a, b - a) for a, b in zip(cuts, cuts[1:])], spare)]


def masks(radius: int, spare: int = 2) -> list[tuple[int, int]]:
    """For each table, the halves of a mask that leaves its key's bits, as signed 64-bit integers."""
    whole = [sum(((1 << n) - 1) << (BITS - a - n) for a, n in blocks) for blocks in tables(radius, spare)]
    return [tuple(x - (1 << 64) if x >> 63 else x for x in (m >> 64, m & (1 << 64) - 1)) for m in whole]


def keys(radius: int, spare: int) -> Any:
    """The hashed key of columns fingerprint_hi and fingerprint_lo in each table."""
    left = lambda half, m: F.col(f"fingerprint_{half}").bitwiseAND(F.lit(m).cast("bigint"))
    return F.array(*[F.xxhash64(F.lit(k), left("hi", hi), left("lo", lo)) for k, (hi, lo) in enumerate(masks(radius, spare))])


def within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, spare: int = 2) -> DataFrame:
    """All pairs of distinct fingerprints (q_hi, q_lo) of queries and (c_hi, c_lo) of corpus that differ in at most radius
    bits, with their distance. Both frames have columns fingerprint_hi and fingerprint_lo; null ones match nothing.

    Of radius + spare blocks of bits, such a pair has spare equal ones at least: one of the tables, each of which has its
    own choice of blocks in front, brings them together. The pairs themselves are the result, so a group of alike
    fingerprints gives as many as it has: neighbours() counts them without making them.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.select("fingerprint_hi", "fingerprint_lo").dropna().distinct()
        return df.select(F.col("fingerprint_hi").alias(f"{name}_hi"), F.col("fingerprint_lo").alias(f"{name}_lo"), F.explode(keys(radius, spare)).alias("_key"))

    far = F.expr("bit_count(q_hi ^ c_hi) + bit_count(q_lo ^ c_lo)")
    return side(queries, "q").join(side(corpus, "c"), "_key").withColumn("distance", far).filter(F.col("distance") <= radius).select("q_hi", "q_lo", "c_hi", "c_lo", "distance").distinct()


def prints(docs: DataFrame, hi: str, lo: str, asked: str) -> DataFrame:
    """The distinct fingerprints of docs in columns hi and lo, as neighbours() takes them. asked: an expression that tells
    the query documents."""
    rows = docs.select(F.col(hi).alias("fingerprint_hi"), F.col(lo).alias("fingerprint_lo"), "doc_id", F.expr(asked).alias("asked")).dropna(subset=["fingerprint_hi", "fingerprint_lo"])
    return rows.groupBy("fingerprint_hi", "fingerprint_lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.bool_or("asked"), F.lit(False)).alias("asked"))


NEIGHBOURS = "fingerprint_hi bigint, fingerprint_lo bigint, n_within bigint, least_within bigint"


def neighbours(found: DataFrame, radius: int = RADIUS, spare: int = 2, split: int = 4096, held: int = 1 << 16, block: int = 1 << 20) -> DataFrame:
    """For each asked fingerprint of found: n_within, the number of documents whose fingerprints differ from it in at most
    radius bits (its own among them), and least_within, their smallest doc_id (null if none has one).

    found: distinct fingerprint_hi and fingerprint_lo with n (their documents), least (the smallest doc_id of these) and
    asked; it is read twice. Asked fingerprints meet all others of their bucket in each table, in blocks of so many pairs
    that are counted and not given out; a pair counts in the first table that brings it together. A bucket of more than
    split fingerprints is cut into parts, and its asked ones into shares of about held each: a task has one part and one
    share at a time. How large buckets are is told from every 16th fingerprint; this decides where pairs meet, not which.
    """
    first = masks(radius, spare)

    def counted(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Rows in order of key and cell, asked ones first: what these have, and the asked rows of the last cell."""
        new = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["cell"][1:] != c["cell"][:-1])]
        starts, run, ask = np.flatnonzero(new), np.cumsum(new) - 1, c["role"] == 0
        asks = np.bincount(run[ask], minlength=len(starts))
        total, least = np.zeros(len(run), np.int64), np.full(len(run), NO_ID)
        rows = np.flatnonzero(~ask & (asks[run] > 0))
        ends = np.cumsum(asks[run[rows]])
        at = 0
        while at < len(rows):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + block, "right")))
            some = rows[at:to]
            m = asks[run[some]]
            one = np.repeat(some, m)
            two = np.arange(len(one)) - np.repeat(np.cumsum(m) - m, m) + starts[run[one]]
            x, y = c["hi"][one] ^ c["hi"][two], c["lo"][one] ^ c["lo"][two]
            near = np.flatnonzero(np.bitwise_count(x.view(np.uint64)) + np.bitwise_count(y.view(np.uint64)) <= radius)
            one, two, x, y = one[near], two[near], x[near], y[near]
            meet = np.full(len(near), -1)
            for k, (hi, lo) in enumerate(first):
                meet[(meet < 0) & (((x & np.int64(hi)) | (y & np.int64(lo))) == 0)] = k
            here = (meet == c["k"][one]) & (meet == c["k"][two])
            np.add.at(total, two[here], c["n"][one[here]])
            np.minimum.at(least, two[here], c["least"][one[here]])
            at = to
        out = np.flatnonzero(total)
        open_ = np.flatnonzero(ask & (run == run[-1]))
        return {"hi": c["hi"][out], "lo": c["lo"][out], "n": total[out], "least": least[out]}, {n: v[open_] for n, v in c.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            got, kept = counted({n: np.concatenate([kept[n], v]) if kept else v for n, v in c.items()})
            yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in ("hi", "lo", "n", "least")], names=[f.split()[0] for f in NEIGHBOURS.split(", ")])

    prepared(found.sparkSession)
    some = found.filter("pmod(xxhash64(fingerprint_lo, fingerprint_hi), 16) = 0").select("asked", F.explode(keys(radius, spare)).alias("key"))
    sizes = some.groupBy("key").agg((16 * F.count("*")).alias("n_all"), (16 * F.count_if("asked")).alias("n_asked")).filter(F.col("n_all") > split)
    # At most FEW_SPLIT rows; keys beyond them have less than a FEW_SPLIT-th of all rows each.
    large = sizes.orderBy(F.desc("n_all"), "key").limit(FEW_SPLIT).select("key", F.ceil(F.col("n_all") / split).alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("n_asked") / held)).alias("shares"))
    rows = found.select("fingerprint_hi", "fingerprint_lo", "n", F.coalesce("least", F.lit(NO_ID)).alias("least"), "asked", F.posexplode(keys(radius, spare)).alias("k", "key"))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("shares", F.coalesce("shares", F.lit(1)))
    own = "pmod(xxhash64(fingerprint_hi, fingerprint_lo), {})"
    cells = (
        f"concat(transform(sequence(0L, shares - 1), x -> struct({own.format('parts')} * shares + x as cell, 1 as role)), "
        f"if(asked, transform(sequence(0L, parts - 1), x -> struct(x * shares + {own.format('shares')} as cell, 0 as role)), array()))"
    )
    rows = rows.withColumn("at", F.explode(F.expr(cells))).select("key", "at.cell", "at.role", "k", F.col("fingerprint_hi").alias("hi"), F.col("fingerprint_lo").alias("lo"), "n", "least")
    met = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "role").mapInArrow(work, NEIGHBOURS)
    return met.groupBy("fingerprint_hi", "fingerprint_lo").agg(F.sum("n_within").alias("n_within"), F.expr(f"nullif(min(least_within), {NO_ID})").alias("least_within"))


def searched(rows: DataFrame, hi: str = "fp_hi", lo: str = "fp_lo", asked: str = "doc_id % 20 = 0") -> DataFrame:
    """rows with n_within and least_within of neighbours() where asked holds, and null where it doesn't.

    rows has doc_id and is read three times. Equal fingerprints of any number are one until here; they are joined with salts.
    """
    near = neighbours(written(prints(rows, hi, lo, asked), "prints"))
    rows = rows.drop("n_within", "least_within")
    yes = F.coalesce(F.expr(asked), F.lit(False))
    salt, known, of_hi, of_lo = fresh(rows, "salt", "known", "of_hi", "of_lo")
    near = salt_copies(near.withColumnsRenamed({"fingerprint_hi": of_hi, "fingerprint_lo": of_lo}), SALTS, known)
    met = salted(rows.filter(yes), SALTS, salt).join(near, (F.col(hi) == F.col(of_hi)) & (F.col(lo) == F.col(of_lo)) & (F.col(salt) == F.col(known)), "left")
    none = F.lit(None).cast("bigint")
    return met.drop(salt, known, of_hi, of_lo).unionByName(rows.filter(~yes).withColumn("n_within", none).withColumn("least_within", none))
