"""N-gram Jaccard join by T-occurrence search, and the classes that its links make.

A document's set holds its distinct five-word shingles, as 64-bit hashes; documents of equal sets are one class, and a
class is searched for once. Two sets whose Jaccard index is 3/4 or more share so many shingles that either has most of its
own in common with other classes, and that the first n - ceil(3n/4) + 1 shingles of the larger one (the first
n - ceil(6n/7) + 1 of the smaller one), in any common order, have one in common. The search goes in four steps.

1. Of each set the first shingles by hash are dealt out, a row of many for each chunk of documents and part of the hashes,
   and it is counted how many of them another class has too. Sets with fewer than any link asks for are left out
   (`classed`). A shingle that a chunk holds more than once is known to be shared and not asked about, so that no task gets
   more of a frequent one than a row for each chunk.
2. What remains is dealt into buckets by class. Shingles are counted over all buckets (a row for each bucket that has one)
   and ordered by frequency, rare ones first; inverted lists are made of the first ones of sets of which three quarters
   are shared (`ordered`).
3. As in DivideSkip, the lists of rare shingles are short (up to SHORT classes) and merged with a heap: for each class, the
   classes of its short lists come out in order with the number of lists they are on, and are kept if the count could
   reach the required overlap. All other shingles of a set, the longer lists, aren't merged but probed by binary search in
   the whole set of what was kept. Of a long list, all classes are probed against the one that holds most shared shingles.
4. Classes that meet on long lists alone and aren't in the list's main component by then are gathered in blocks of BLOCK;
   all classes of their lists go by each block once, where occurrences on the block's inverted lists are counted (`settled`).

No list is cut, no class is dropped. Tasks hold a chunk, a bucket, a short list, one set's lists or a block at a time, whatever
the size of a group; of links, only as many as join the components are kept, so that copies aren't expanded into all pairs.

Null and empty texts and white space have no shingles: n_shingles 0, linked with nothing. A text of fewer than five words
has one shingle, the whole. Null doc_ids take part, but never name a component that has others. Repeated rows are rows
like others. Only doc_id and text are read. Hashes of different shingles or sets are taken to differ (64 bits).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import arrow_pass, discard, fresh, prepared, salt_copies, salted, written
from bandweave.llm.components import components, spanning
from bandweave.llm.shingles import hashed_words, shingled

N = 5
#: Lists of more classes than this are long; 64 at most, as lists' lengths are kept exactly up to there.
SHORT = 64
#: A chunk holds documents up to so many shingles, and a bucket about as many.
CHUNK = 1 << 20
#: Classes in a block.
BLOCK = 64
#: Up to so many doc_ids are broadcast to fetch their texts; more are joined. Up to so many pairs are broadcast.
FEW_IDS, FEW_PAIRS = 1_000_000, 400_000
SALTS = 16


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Each text's set, ascending."""
    words, bounds, _, _ = hashed_words(texts)
    return [np.unique(shingled(words[a:b], n)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def class_of(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def least(n):  # noqa: ANN001, ANN201
    """How many shingles of a set of n any link of it shares (integers or arrays)."""
    return (3 * n + 3) // 4


def occurrences(n):  # noqa: ANN001, ANN201
    """How many shared shingles are asked for among the first ones by hash, of sets of which the smaller one has n."""
    return (n + 11) // 12


def prefix(n):  # noqa: ANN001, ANN201
    """How many shingles of a set of n are looked up in the inverted lists of sets that aren't larger."""
    return n - least(n) + 1


def indexed(n):  # noqa: ANN001, ANN201
    """How many shingles of a set of n are in inverted lists for sets that aren't smaller: two of n share 6n/7 or more."""
    return n - (6 * n + 6) // 7 + 1


def required(n, m):  # noqa: ANN001, ANN201
    """The least overlap of sets of n and m shingles at a Jaccard index of 3/4."""
    return (3 * (n + m) + 6) // 7


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two ascending sets are similar enough: the smaller one's shingles are searched for in the larger one."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one) or 4 * len(one) < 3 * len(two):
        return False
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    both = int((two[at] == one).sum())
    return 100 * both >= 75 * (len(one) + len(two) - both)


def possible(count: int, n: int, m: int, i: int, j: int) -> bool:
    """Whether sets of n and m can be similar enough that share count of their first shingles, the last at places i and j."""
    return count + min(n - 1 - i, m - 1 - j) >= required(n, m)


def merged(lists: list[list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
    """(class, count, its place, own place) of everything on ascending lists of (class, its place, own place), merged with a
    heap; the places are those of the last shared shingle, the one farthest in the sets."""
    before, count, theirs, own = None, 0, 0, 0
    for cls, place, mine in heapq.merge(*lists):
        if cls != before:
            if before is not None:
                yield before, count, theirs, own
            before, count, theirs, own = cls, 0, place, mine
        count += 1
        theirs, own = max(theirs, place), max(own, mine)
    if before is not None:
        yield before, count, theirs, own


def parts_of(df: DataFrame) -> int:
    """In how many bits the parts of the hashes are numbered: more than there are shuffle partitions, 64 parts at least."""
    return max(6, (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def coded(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The part and the next 32 bits of shingles, as one number that keeps their order. Equal ones can stand for different
    shingles, which are then counted together."""
    return (tokens.view(np.uint64) + np.uint64(1 << 63)) >> np.uint64(32 - bits)


def by_part(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of ascending codes."""
    parts = (codes >> np.uint64(32)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    return ((int(parts[a]), a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a)


def _pass(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow whose work yields dicts of columns (lists, numpy or Arrow arrays); columns not given are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepared(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in work(batches):
            if size := max(map(len, rows.values()), default=0):
                arrays = [rows[f.name] if isinstance(rows.get(f.name), pa.Array) else pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(size, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def _grouped(df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """work on tables whose rows of one key are together and complete. df: sorted by key in its partitions.

    A key's rows are held by one task at once; callers see to it that there are few of any key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = batch.column(key)[batch.num_rows - 1].as_py()
            if held.column(key)[0].as_py() == last:
                continue
            column = held.column(key).to_numpy()
            cut = len(column) - int(np.argmax(column[::-1] != last))
            yield from work(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None:
            yield from work(held)

    return _pass(df, run, schema)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df with its rows of a key together, in order. By a hash of the key: a plan that deals by the key itself may be merged
    with a join's and then be read as it lies."""
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key)


QUESTIONS = "doc_id bigint, n bigint, cls bigint, known int, part int, asks binary, owners binary, classes binary, seen binary"


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and cls of each row of docs; and of each class cls, n, the smallest doc_id, the number of rows (copies), and
    whether it can have links (live)."""
    bits = parts_of(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        ids: list[int | None] = []
        sizes: list[int] = []
        classes: list[int | None] = []
        first: dict[int, int] = {}  # a class's row in this chunk
        kept: list[np.ndarray] = []

        def chunk() -> Iterator[dict[str, list]]:
            known: list[int | None] = [None] * len(ids)
            rows = {"doc_id": [*ids], "n": [*sizes], "cls": [*classes], "known": known, "part": [k % (1 << bits) for k in range(len(ids))]}
            if kept:
                own, at = np.array([*first]), [*first.values()]
                owner = np.repeat(np.arange(len(kept)), [*map(len, kept)])
                codes = coded(np.concatenate(kept), bits)
                order = np.argsort(codes, kind="stable")
                codes, owner = codes[order], owner[order]
                same = np.concatenate([[False], codes[1:] == codes[:-1]])
                many = same | np.concatenate([same[1:], [False]])
                counts = np.bincount(owner[many], minlength=len(kept))
                for k, c in zip(at, counts.tolist()):
                    known[k] = c
                n = np.array([sizes[k] for k in at])
                asks = ~many & (counts < occurrences(least(n)))[owner]
                seen = codes[~asks & ~same]
                there = {part: [None, None, None, seen[a:b].astype(np.uint32).tobytes()] for part, a, b in by_part(seen)}
                codes, owner = codes[asks], owner[asks]
                for part, a, b in by_part(codes):
                    who, which = np.unique(owner[a:b], return_inverse=True)
                    there.setdefault(part, [None] * 4)[:3] = codes[a:b].astype(np.uint32).tobytes(), which.astype(np.uint16).tobytes(), own[who].tobytes()
                yield {"part": [*there], **dict(zip(("asks", "owners", "classes", "seen"), zip(*there.values())))}
            yield rows
            for x in (ids, sizes, classes, first, kept):
                x.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                cut = batch.slice(at, 100)
                for i, s in zip(cut.column("doc_id").to_pylist(), shingle_sets(cut.column("text").to_pylist())):
                    c = class_of(s)
                    if c is not None and c not in first:
                        first[c] = len(ids)
                        kept.append(s[: len(s) - least(len(s)) + occurrences(len(s))])
                        held += len(kept[-1])
                    ids.append(i)
                    sizes.append(len(s))
                    classes.append(c)
                    if held >= CHUNK or len(ids) >= 65_000:
                        held = 0
                        yield from chunk()
        if ids:
            yield from chunk()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            there = batch.filter(pc.is_valid(batch.column("n")))
            yield {n: there.column(n) for n in ("doc_id", "n", "cls", "known")}
            there = batch.filter(pc.is_null(batch.column("n")))
            for part, *row in zip(*(there.column(n).to_pylist() for n in ("part", "asks", "owners", "classes", "seen"))):
                parts.setdefault(part, []).append(tuple(row))
        found = []
        for rows in parts.values():
            seen = np.concatenate([np.frombuffer(r[3] or b"", np.uint32) for r in rows])
            codes = np.concatenate([np.frombuffer(r[0] or b"", np.uint32) for r in rows])
            if len(codes):
                own = np.concatenate([np.frombuffer(r[2], np.int64)[np.frombuffer(r[1], np.uint16)] for r in rows if r[0]])
                order = np.lexsort((own, codes))
                codes, own = codes[order], own[order]
                once = np.concatenate([[True], (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])])
                codes, own = codes[once], own[once]  # copies in several chunks ask once
                same = np.concatenate([[False], codes[1:] == codes[:-1]])
                found.append(own[same | np.concatenate([same[1:], [False]]) | np.isin(codes, seen)])
        if found:
            cls, add = np.unique(np.concatenate(found), return_counts=True)
            yield {"cls": cls, "shared": add}

    questions = _pass(docs.select("doc_id", "text"), ask, QUESTIONS).repartition("part")
    told = written(_pass(questions, answer, "doc_id bigint, n bigint, cls bigint, known int, shared bigint"), "told")
    enough = "coalesce(max(known), 0) + coalesce(sum(shared), 0) >= ((3 * max(n) + 3) div 4 + 11) div 12 as live"
    per_class = told.filter("cls is not null").groupBy("cls").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("n").alias("copies"), F.expr(enough))
    return told.filter("n is not null").select("doc_id", "n", "cls"), written(per_class, "classes")


def fetched(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """cls and set (binary, ascending 64-bit integers) of live classes, made anew from a text of each; and in how many buckets
    they go. Rows may be there more than once."""
    wanted = classes.filter("live")
    many, without, shingles = wanted.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1)), F.sum("n")).first()
    some = wanted.filter("doc_id is not null").select("doc_id", F.col("cls").alias("of"))
    rows = docs.select("doc_id", "text").filter("doc_id is not null").join(F.broadcast(some) if many <= FEW_IDS else some, "doc_id")

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            kept = [(c, s.tobytes()) for s, of in zip(shingle_sets(p["text"]), p["of"]) if (c := class_of(s)) is not None and of in (None, c)]
            yield {"cls": [c for c, _ in kept], "set": [s for _, s in kept]}

    made = arrow_pass(rows, work, "cls bigint, set binary", 100)
    if without:  # classes none of whose documents has an id
        rows = docs.select("doc_id", "text").filter("doc_id is null").withColumn("of", F.lit(None).cast("long"))
        made = made.unionByName(arrow_pass(rows, work, "cls bigint, set binary", 100).join(wanted.filter("doc_id is null").select("cls"), "cls", "left_semi"))
    return made, -(-(shingles or 0) // CHUNK) or 1


def graded(counts: np.ndarray) -> np.ndarray:
    """The lengths of lists in 8 bits: exactly up to 64, by eighths of a power of two beyond."""
    return np.where(counts <= 64, counts, np.minimum(255, 65 + 8 * np.log2(np.maximum(counts, 64) / 64))).astype(np.uint8)


HELD = "bucket bigint, cls bigint, set binary, part int, codes binary, counts binary"
INDEX = "token bigint, cls bigint, n bigint, shared bigint, place bigint, grade int"


def ordered(made: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """From rows of cls and set: a table that has each once (and other rows without set), and the INDEX of its first shingles by
    frequency, without those that no other class has. shared: how many of the set's shingles others have; place: the
    shingle's in the set in that order; grade: how many classes have the shingle, as of graded."""
    bits = parts_of(made)

    def held(t: pa.Table) -> Iterator[dict[str, list]]:
        bucket, cls, sets = t.column("bucket").to_numpy(), t.column("cls").to_numpy(), t.column("set").to_pylist()
        for b in np.unique(bucket).tolist():
            own, at = np.unique(cls[bucket == b], return_index=True)
            mine = [sets[k] for k in (np.flatnonzero(bucket == b)[at]).tolist()]
            for k in range(0, len(mine), 200):
                yield {"bucket": [b] * len(mine[k : k + 200]), "cls": own[k : k + 200], "set": mine[k : k + 200]}
            codes, counts = np.unique(coded(np.frombuffer(b"".join(mine), np.int64), bits), return_counts=True)
            rows = [(part, codes[i:j].astype(np.uint32).tobytes(), counts[i:j].astype(np.uint32).tobytes()) for part, i, j in by_part(codes)]
            yield {"bucket": [b] * len(rows), **dict(zip(("part", "codes", "counts"), map(list, zip(*rows))))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(n).to_pylist() for n in ("part", "bucket", "codes", "counts"))):
                parts.setdefault(part, []).append(tuple(row))
        while parts:
            part, rows = parts.popitem()
            codes = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
            counts = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
            whole, which = np.unique(codes, return_inverse=True)
            grades = graded(np.bincount(which, counts, len(whole)).astype(np.int64))[which]
            at = 0
            out: dict[str, list] = {"bucket": [], "part": [], "codes": [], "counts": []}
            for b, raw, _ in rows:
                mine = slice(at, at := at + len(raw) // 4)
                more = grades[mine] > 1
                for name, x in (("bucket", b), ("part", part), ("codes", codes[mine][more].tobytes()), ("counts", grades[mine][more].tobytes())):
                    out[name].append(x)
            yield out

    def index(t: pa.Table) -> Iterator[dict[str, list]]:
        t = t.sort_by("bucket")
        bucket = t.column("bucket").to_numpy()
        for b in np.unique(bucket).tolist():
            a, z = np.searchsorted(bucket, [b, b + 1]).tolist()
            cls, raw, part, codes, grades = (t.column(n).slice(a, z - a).to_pylist() for n in ("cls", "set", "part", "codes", "counts"))
            told = [k for k in range(z - a) if part[k] is not None]
            keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(codes[k], np.uint32).astype(np.uint64) + np.uint64(part[k] << 32) for k in told)])
            known = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(grades[k], np.uint8) for k in told)])
            order = np.argsort(keys)
            keys, known = np.append(keys[order], np.uint64((1 << 64) - 1)), np.append(known[order], np.uint8(1))
            sets = [k for k in range(z - a) if raw[k] is not None]
            own, n = np.array([cls[k] for k in sets], np.int64), np.array([len(raw[k]) // 8 for k in sets], np.int64)
            token, owner = np.frombuffer(b"".join(raw[k] for k in sets), np.int64), np.repeat(np.arange(len(sets)), n)
            mine = coded(token, bits)
            at = np.searchsorted(keys, mine)
            grade = np.where(keys[at] == mine, known[at], np.uint8(1))
            shared = np.bincount(owner[grade > 1], minlength=len(sets))
            few = (shared >= least(n))[owner] & (grade > 1)  # sets that can have links, and what they share
            token, owner, grade = token[few], owner[few], grade[few]
            order = np.lexsort((token, grade, owner))
            token, owner, grade = token[order], owner[order], grade[order]
            starts = np.searchsorted(owner, np.arange(len(sets)))
            place = np.arange(len(token)) - starts[owner] + (n - shared)[owner]  # what no other class has comes first
            few = place < prefix(n)[owner]
            token, owner, grade, place = token[few], owner[few], grade[few], place[few]
            yield {"token": token, "cls": own[owner], "n": n[owner], "shared": shared[owner], "place": place, "grade": grade}

    rows = dealt(made.withColumn("bucket", F.pmod(F.xxhash64("cls"), F.lit(buckets))), "bucket")
    sets = written(_grouped(rows, "bucket", held, HELD), "sets")
    answers = _pass(sets.filter("part is not null").select("bucket", "part", "codes", "counts").repartition("part"), count, HELD)
    both = sets.filter("set is not null").unionByName(answers)
    return sets, written(_grouped(dealt(both, "bucket"), "bucket", index, INDEX), "index")


LISTED = "x bigint, n bigint, place bigint, others array<bigint>, sizes array<bigint>, places array<bigint>"


def lists(t: pa.Table) -> Iterator[dict[str, list]]:
    """From INDEX rows by shingle: for each class the classes on that list that aren't larger, in order, with sizes and places."""
    columns = [t.column(n).to_numpy() for n in ("token", "cls", "n", "shared", "place")]
    order = np.lexsort((columns[1], columns[2], columns[0]))  # on each list smaller sets first
    token, cls, n, shared, place = (c[order] for c in columns)
    found = []
    few, step = np.arange(len(token) - 1), 1
    while len(few):
        few = few[few + step < len(token)]
        few = few[token[few] == token[few + step]]
        y, x = few, few + step
        could = (place[y] < indexed(n[y])) & (4 * n[y] >= 3 * n[x]) & (required(n[x], n[y]) <= np.minimum(shared[x], shared[y])) & (cls[x] != cls[y])
        found.append((x[could], y[could]))
        step += 1
    if not found:
        return
    x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((cls[y], x))
    x, y = x[order], y[order]
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(x)).astype(np.int32))
    arrays = {name: pa.ListArray.from_arrays(offsets, pa.array(values[y])) for name, values in (("others", cls), ("sizes", n), ("places", place))}
    yield {"x": cls[x[starts]], "n": n[x[starts]], "place": place[x[starts]], **arrays}


def merge(t: pa.Table) -> Iterator[dict[str, list]]:
    """From LISTED rows by class: the pairs to probe."""
    rows = [*zip(*(t.column(n).to_pylist() for n in ("x", "n", "place", "others", "sizes", "places")))]
    out: dict[str, list] = {"x": [], "y": []}
    k = 0
    while k < len(rows):
        x, n = rows[k][:2]
        short, size = [], {}
        while k < len(rows) and rows[k][0] == x:
            _, _, place, others, sizes, places = rows[k]
            short.append([(y, p, place) for y, p in zip(others, places)])
            size.update(zip(others, sizes))
            k += 1
        for y, count, theirs, own in merged(short):
            if possible(count, n, size[y], own, theirs):
                out["x"].append(x)
                out["y"].append(y)
    yield out


def candidates(index: DataFrame) -> DataFrame:
    """Pairs (x, y) to probe: from short lists what the merge keeps, from long ones all with the class that shares most."""
    listed = _grouped(dealt(index.filter(F.col("grade") <= SHORT), "token"), "token", lists, LISTED)
    short = _grouped(dealt(listed, "x"), "x", merge, "x bigint, y bigint")
    long = index.filter(F.col("grade") > SHORT).select("token", "cls", "n", "shared")
    heads = long.groupBy("token").agg(F.min(F.struct((1 - F.col("shared") / F.col("n")).alias("own"), "cls", "n", "shared")).alias("h"))
    both = salted(long, SALTS).join(salt_copies(heads, SALTS), ["token", "_salt"])
    could = "cls <> h.cls and 4 * least(n, h.n) >= 3 * greatest(n, h.n) and (3 * (n + h.n) + 6) div 7 <= least(shared, h.shared)"
    return short.unionByName(both.filter(could).select(F.greatest("cls", "h.cls").alias("x"), F.least("cls", "h.cls").alias("y")).distinct())


def probed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (x, y) of classes whose sets are similar enough. pairs: a table; of few, only sets they name are dealt out."""

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            good = [(x, y) for x, y, a, b in zip(p["x"], p["y"], p["a"], p["b"]) if linked(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))]
            yield {"x": [g[0] for g in good], "y": [g[1] for g in good]}

    one, two = sets.select(F.col("cls").alias("x"), F.col("set").alias("a")), sets.select(F.col("cls").alias("y"), F.col("set").alias("b"))
    if pairs.count() <= FEW_PAIRS:
        rows = one.join(F.broadcast(pairs), "x").join(two.join(F.broadcast(pairs.select("y").distinct()), "y", "left_semi"), "y")
    else:
        rows = pairs.join(one, "x").join(two, "y")
    return arrow_pass(rows.select("x", "y", "a", "b"), work, "x bigint, y bigint", 500)


def still_open(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of long lists whose classes have more than one label, that may yet be linked with another one there: token, cls,
    label, n, shared, low and high (the sizes it could be linked with), and rest: not of the list's main label."""
    long = index.filter(F.col("grade") > SHORT).select("token", "cls", "n", "shared")
    rows = written(long.join(labels.select(F.col("x").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "long")
    per_label = rows.groupBy("token", "label").agg(F.count("*").alias("many"), F.min("n").alias("a"), F.max("n").alias("z"))
    per_list = per_label.groupBy("token").agg(F.max(F.struct("many", "label")).alias("main"), F.count("*").alias("labels"), F.min("a").alias("a"), F.max("z").alias("z")).filter("labels > 1")
    both = salted(rows, SALTS).join(salt_copies(per_list, SALTS), ["token", "_salt"])
    both = both.withColumn("low", F.expr("(3 * n + 3) div 4")).withColumn("high", F.expr("least(4 * n div 3, 7 * shared div 3 - n)"))
    return both.filter("low <= z and high >= a").select("token", "cls", "label", "n", "low", "high", (F.col("label") != F.col("main.label")).alias("rest"))


def settled(index: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Edges (x, y) between the labels of classes that meet on long lists alone; None if none is open."""
    rows = written(still_open(index, labels), "open")
    rest = rows.filter("rest")
    if rest.isEmpty():
        return None
    # Each class of the rest goes to one block, with others of its first list.
    first = rest.groupBy("cls").agg(F.min("token").alias("list"))
    blocks = first.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    number = F.xxhash64("list", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    named = written(first.join(blocks, "list").select("cls", number.alias("block")), "blocks")
    asked = salted(rest, SALTS).join(salt_copies(named, SALTS), ["cls", "_salt"])
    asked = asked.groupBy("token", "block").agg(F.min("low").alias("from"), F.max("high").alias("to"), F.min("n").alias("a"), F.max("n").alias("z"), F.min("label").alias("one"), F.max("label").alias("other"))
    met = salted(rows, SALTS).alias("r").join(salt_copies(asked, SALTS).alias("a"), F.expr("r.token = a.token and r._salt = a._salt and r.n between a.from and a.to and a.z >= r.low and a.a <= r.high and not (a.one = r.label and a.other = r.label)"))
    met = met.select("a.block", F.col("r.cls").alias("cls"), F.col("r.label").alias("label")).distinct()
    own = rest.select("cls", "label").distinct().join(named, "cls").select("block", "cls", "label")
    kinds = salt_copies(own.withColumn("kind", F.lit(0)), SALTS).unionByName(salted(met.withColumn("kind", F.lit(1)), SALTS))
    full = kinds.join(sets.filter("set is not null").select("cls", "set"), "cls")
    full = full.repartition("block", "_salt").sortWithinPartitions("block", "_salt", "kind")

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        now, tokens, held, ready = None, np.zeros(0, np.int64), [], False
        for batch in batches:
            out: dict[str, list] = {"x": [], "y": []}
            for block, salt, kind, label, raw in zip(*(batch.column(n).to_pylist() for n in ("block", "_salt", "kind", "label", "set"))):
                if (block, salt) != now:
                    now, held, ready, joined_up = (block, salt), [], False, {}
                s = np.frombuffer(raw, np.int64)
                if kind == 0:
                    held.append((label, s))
                    continue
                if not ready:  # the block's inverted lists, one behind the other
                    ready = True
                    flat, owner, sizes = np.concatenate([h[1] for h in held]), np.repeat(np.arange(len(held)), [len(h[1]) for h in held]), np.array([len(h[1]) for h in held])
                    order = np.argsort(flat, kind="stable")
                    tokens, starts = np.unique(flat[order], return_index=True)
                    owner, ends = owner[order], np.append(starts[1:], len(flat))
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                at = at[tokens[at] == s]
                lengths = ends[at] - starts[at]
                spots = np.repeat(starts[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                both = np.bincount(owner[spots], minlength=len(held))
                for k in np.flatnonzero(100 * both >= 75 * (sizes + len(s) - both)).tolist():
                    if held[k][0] != label and spanning(joined_up, held[k][0], label):
                        out["x"].append(held[k][0])
                        out["y"].append(label)
            yield out

    return written(_pass(full.select("block", "_salt", "kind", "label", "set"), occur, "x bigint, y bigint").distinct(), "edges")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls and component_id (the smallest doc_id reachable by links, itself included) of every row."""
    known, classes = classed(docs)
    sets, index = ordered(*fetched(docs, classes))
    pairs = written(candidates(index), "pairs")
    links = written(probed(pairs, sets.filter("set is not null")), "links")
    labels = components(links)
    if (more := settled(index, sets, labels)) is not None:
        labels = components(labels.select("x", F.col("label").alias("y")).unionByName(more))
    discard(sets, index, pairs, links)

    names = labels.join(classes, labels["x"] == classes["cls"]).select("cls", "label", "doc_id")
    least_of = names.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = salted(names, SALTS).join(salt_copies(least_of, SALTS), ["label", "_salt"]).select("cls", "component_id")
    alone = classes.filter("copies > 1").join(labels.select(F.col("x").alias("cls")), "cls", "left_anti").select("cls", F.col("doc_id").alias("component_id"))
    whole = salt_copies(named.unionByName(alone).withColumn("named", F.lit(True)), SALTS).alias("c")
    rows = salted(known, SALTS).alias("d").join(whole, F.expr("d.cls = c.cls and d._salt = c._salt"), "left")
    return rows.select("d.doc_id", F.col("d.n").alias("n_shingles"), "d.cls", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("d.doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component stays, that of its smallest doc_id (null only where no other has one); rows without
    shingles all stay. Other columns are kept, whatever their names. Of rows alike in doc_id and set, any one stays.

    What goes is sent to the texts where it is few (FEW_IDS), and joined with them beyond that.
    """
    rows = written(joined(docs), "joined").filter("cls is not null")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")
    groups = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("cls")).alias("own")).agg(F.min(best).alias("best"))
    keepers = groups.select(F.col("best.doc_id").alias("doc_id"), F.col("best.cls").alias("cls"), F.lit(True).alias("keeper"))
    pairs = rows.groupBy("doc_id", "cls").agg(F.count("*").alias("n")).alias("p")
    told = pairs.join(keepers.alias("k"), F.expr("p.doc_id <=> k.doc_id and p.cls = k.cls"), "left").select("p.doc_id", "p.cls", "n", "keeper")
    odd = written(told.filter("keeper is null or n > 1"), "odd")
    if not (n := odd.count()):
        return docs
    own, one, of, kept = fresh(docs, "cls", "id", "of", "keeper")
    schema = docs.selectExpr("*", f"cast(null as bigint) as `{own}`").schema

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            yield p | {own: [*map(class_of, shingle_sets(p["text"]))]}

    known = arrow_pass(docs, work, schema, 500)
    side = odd.select(F.col("doc_id").alias(one), F.col("cls").alias(of), F.col("keeper").alias(kept))
    marked = known.join(F.broadcast(side) if n <= FEW_IDS else side, F.expr(f"doc_id <=> `{one}` and `{own}` = `{of}`"), "left")
    single = marked.filter(f"`{of}` is null").select(*docs.columns)
    if odd.filter("keeper").isEmpty():
        return single
    return single.unionByName(marked.filter(f"`{kept}`").dropDuplicates(["doc_id", own]).select(*docs.columns))
