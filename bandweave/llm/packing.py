"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

A document's ids are cut into full sequences and a rest. Only the histogram of rest lengths, one count for each length
up to the sequence length, reaches the driver. There, lengths are placed longest first, each into the packs with most
room; packs that look alike are one entry with a count. Room that is left of MIN_HOLE ids or more is then filled by
cutting pieces of the emptiest packs. The plan maps ranks within a length to sequences, and joins back to the pieces by
length and rank. The plan's size depends on the sequence length, not on the number of documents.

A rank is the piece's number within its length in its task, plus what the tasks before hold of that length: no length
is ever gathered in one task, so that copies of one text may be any share of the rows.

Null and empty texts: a document of the end id alone. Null doc_ids and repeated rows: documents like others. An empty
table gives no pieces. Further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandweave.llm.bpe import codec
from bandweave.llm.common import arrow_pass, written

SEQUENCE, END_ID = 2048, 1
#: Room of fewer ids than this stays as padding rather than being filled by cutting a piece.
MIN_HOLE = 16
#: Up to so many cut pieces (of some 60 bytes) are broadcast to fetch their ids.
FEW = 100_000

Run = tuple[int, int, int]


def pack_histogram(histogram: dict[int, int], size: int = SEQUENCE, min_hole: int = MIN_HOLE) -> list[tuple[int, int, int, int, int, int, int]]:
    """The plan as rows (length, rank_from, rank_to, start, part, sequence_from, offset).

    The piece of a length whose rank lies in [rank_from, rank_to) has its ids from start on, part of them, at offset in
    sequence sequence_from + rank - rank_from. Lengths must lie in 1 .. size.
    """
    # Shortest pack first: packs by room, as [room, count, ((length, rank_from), ...)]; a heap gives the most room.
    plan_packs: list[tuple[int, int, tuple[Run, ...]]] = []
    open_packs: list[tuple[int, int, int, tuple[Run, ...]]] = []  # (-room, tie, count, slots)
    tie = 0
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        if not 1 <= length <= size:
            raise ValueError(f"a length of {length} doesn't fit {size}")
        left, rank = histogram[length], 0
        while left:
            if not open_packs or -open_packs[0][0] < length:  # new packs, with as many pieces of this length as fit
                each = min(left, size // length)
                n = left // each
                made = tuple((length, rank + j * n, j * length) for j in range(each))
                tie += 1
                if size - each * length:
                    heapq.heappush(open_packs, (each * length - size, tie, n, made))
                else:
                    plan_packs.append((0, n, made))
                left -= n * each
                rank += n * each
                continue
            room, _, count, slots = heapq.heappop(open_packs)
            room = -room
            k = min(left, count)
            if k < count:  # the rest of these packs stays as it is; it starts k sequences later
                tie += 1
                heapq.heappush(open_packs, (-room, tie, count - k, tuple((a, b + k, c) for a, b, c in slots)))
            made = (*slots, (length, rank, size - room))
            tie += 1
            if room > length:
                heapq.heappush(open_packs, (-(room - length), tie, k, made))
            else:
                plan_packs.append((0, k, made))
            left -= k
            rank += k
    packs = sorted([*plan_packs, *((-r, n, slots) for r, _, n, slots in open_packs)], key=lambda p: p[0])
    # Fill holes: pieces of the emptiest packs move, cut where they must, into the room of the fullest that have some.
    rows, sequence = [], 0
    holes: list[list[int]] = []  # room, sequence_from, count
    kept = []
    room_left = sum(r * n for r, n, _ in packs if r >= min_hole)
    donors: list[list[int]] = []  # length, rank_from, count
    while packs and packs[-1][0] >= min_hole:
        room, n, slots = packs[-1]
        # so many of these packs can go that their ids fit what room the others have
        gone = min(n, room_left // (size + 1))
        if gone <= 0:
            break
        packs.pop()
        room_left -= gone * size
        donors += [[length, rank + n - gone, gone] for length, rank, _ in slots]
        if gone < n:
            packs.append((room, n - gone, slots))
            break
    for room, n, slots in packs:
        for length, rank, offset in slots:
            rows.append((length, rank, rank + n, 0, length, sequence, offset))
        kept.append((room, sequence, n))
        sequence += n
    holes = [[room, at, n] for room, at, n in kept if room >= min_hole]
    holes.sort(key=lambda h: h[0])
    todo = sorted(((length, rank, n, 0) for length, rank, n in donors), key=lambda d: d[0])
    while todo:
        length, rank, n, start = todo.pop()  # the longest rest
        rest = length - start
        if not holes:  # what is left gets packs of its own
            rows.append((length, rank, rank + n, start, rest, sequence, 0))
            if size - rest >= min_hole:
                holes.append([size - rest, sequence, n])
            sequence += n
            continue
        room, at, count = holes.pop()  # the largest hole
        k, part = min(n, count), min(rest, room)
        rows.append((length, rank, rank + k, start, part, at, size - room))
        if count > k:
            holes.append([room, at + k, count - k])
        if room - part >= min_hole:
            holes.append([room - part, at, k])
        holes.sort(key=lambda h: h[0])
        if n > k:
            todo.append((length, rank + k, n - k, start))
        if part < rest:
            todo.append((length, rank, k, start + part))
        todo.sort(key=lambda d: d[0] - d[3])
    return rows


def cut(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (binary: little-endian unsigned 32-bit), task and number.

    number counts the pieces of that length that the task made before.
    """

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        seen: dict[int, int] = {}
        for p in parts:
            out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "doc_tokens", "ids", "task", "number")}
            for doc_id, task, ids in zip(p["doc_id"], p["task"], codec(path).encode(p[text])):
                raw = ids.tobytes() + end_id.to_bytes(4, "little")
                for at in range(0, len(raw), 4 * size):
                    piece = raw[at : at + 4 * size]
                    n = len(piece) // 4
                    number = seen[n] = seen.get(n, -1) + 1
                    for name, x in (("doc_id", doc_id), ("start", at // 4), ("length", n), ("doc_tokens", len(raw) // 4), ("ids", piece), ("task", task), ("number", number)):
                        out[name].append(x)
            yield out

    return arrow_pass(docs.select("doc_id", text, F.spark_partition_id().alias("task")), work, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, task int, number bigint", 500)


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, text: str = "text", derive: dict[str, Column] | None = None) -> DataFrame:
    """Packed pieces: doc_id, start, length, doc_tokens, sequence_id, offset, and ids, or in place of ids the columns that
    derive makes of a piece (such as a digest) before anything is shuffled."""
    derive = derive if derive is not None else {"ids": F.col("ids")}
    names = [n for n in derive if n != "ids"]
    pieces = written(cut(docs, path, size, end_id, text).select("*", *[derive[n].alias(n) for n in names]), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to size
    rows = pack_histogram(histogram, size)
    plan = pieces.sparkSession.createDataFrame(rows, "length bigint, rank_from bigint, rank_to bigint, part_start bigint, part bigint, sequence_from bigint, offset bigint")
    key = ["task", "length", "number"]
    ranked = pieces.drop("ids").join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("number"))
    # The plan is broadcast: at most a few rows for each length and pattern, however many documents there are.
    on = (F.col("r.length") == F.col("p.of_length")) & (F.col("r.rank") >= F.col("p.rank_from")) & (F.col("r.rank") < F.col("p.rank_to"))
    placed = ranked.alias("r").join(F.broadcast(plan.withColumnRenamed("length", "of_length").alias("p")), on).select("r.*", "p.part_start", "p.part", "p.offset", (F.col("p.sequence_from") + F.col("r.rank") - F.col("p.rank_from")).alias("sequence_id"))
    out = lambda df: df.select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), F.col("part").alias("length"), "doc_tokens", *derive, "sequence_id", "offset")
    if "ids" in derive:
        whole, partial = None, placed.drop(*names)
    else:
        whole, partial = out(placed.filter("part = length")), placed.filter("part < length").drop(*names)
    # Ids are fetched for what the plan cuts alone, whose number the plan tells: few are sent to the ids, many are joined with them.
    few = sum(to - frm for length, frm, to, _, part, _, _ in rows if part < length) <= FEW and whole is not None
    cuts = (F.broadcast(partial) if few else partial).join(pieces.select(*key, "ids"), key).withColumn("ids", F.expr("substring(ids, cast(part_start * 4 + 1 as int), cast(part * 4 as int))"))
    cuts = out(cuts.select("*", *[derive[n].alias(n) for n in names]))
    return cuts if whole is None else whole.unionByName(cuts)
