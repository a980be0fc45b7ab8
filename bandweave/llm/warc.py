"""WARC archives: each record is a gzip member; an index of file, offset, length, URL and digest comes first, and records
are read back by byte ranges, sorted and coalesced.

Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the largest page_id is written as response and
the others as revisits of it; rows that tie on that page_id are responses all. Smaller payloads are responses. Null html
is an empty payload, a null URL leaves out its header, a null page_id is never referred to (a group of such rows alone is
written as responses). An empty table gives no file and an empty index. Further columns are ignored.

A writing task names its file by chance and tells its index rows; the index is kept as a table, so a task that ran twice
leaves a file that no index names. Files are opened by URI with pyarrow's file systems, in the shared folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import arrow_pass, salt_copies, salted, shared_dir, written

LEAST_REVISIT = 1000
SALTS = 16
#: Ranges that lie no further apart are read as one, up to so many bytes; a task reads parts of files of SPAN bytes.
GAP, MOST_READ, SPAN = 64 << 10, 8 << 20, 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest (hex SHA-1), record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "utf-8")))
    large = rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("_keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = salted(rows, SALTS).alias("r").join(salt_copies(large, SALTS).alias("k"), (F.col("r.payload_digest") == F.col("k._digest")) & (F.col("r._salt") == F.col("k._salt")), "left")
    again = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper")) & (F.col("payload_bytes") >= least)
    return found.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_keeper")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(row: dict[str, Any], date: str = DATE) -> bytes:
    """One record, not compressed. row: what planned() gives."""
    kind, payload = row["record_type"], (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", date)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    head += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", row["payload_bytes"])]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"]))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(payload))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> dict[str, Any]:
    """A record's page_id, url, record_type, refers_to, payload (None for revisits), payload_bytes and payload_digest.

    The digest and length of a response are those of the payload read; the digest must be the one that the header states.
    """
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    page = lambda s: None if s is None or s == record_id(None) else int(s[len("<urn:page:") : -1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To"))}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": stated}
    payload = block.partition(b"\r\n\r\n")[2]
    if (digest := hashlib.sha1(payload).hexdigest()) != stated:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one whose digest its header states")
    return out | {"payload": payload.decode(), "payload_bytes": len(payload), "payload_digest": digest}


def packed(raw: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes archives of all rows into folder (default: a new one in the shared folder) and gives the index, one row per record."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    names = [c.split()[0] for c in INDEX.split(", ")]

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        from pyarrow import fs

        out = None
        for p in parts:
            rows = [dict(zip(p, x)) for x in zip(*p.values())]
            if out is None and rows:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
            made: dict[str, list] = {n: [] for n in names}
            for row in rows:
                raw = packed(record(row))
                out.write(raw)
                for n in names:
                    made[n].append({"file": f"{folder}/{name}", "offset": at, "length": len(raw)}.get(n, row.get(n)))
                at += len(raw)
            yield made
        if out is not None:
            out.close()

    return written(arrow_pass(planned(pages, least), work, INDEX, 500), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> list[tuple[int, int, int]]:
    """(start, end, how many) of reads that cover ascending ranges (offset, length) in turn."""
    reads: list[list[int]] = []
    for offset, length in ranges:
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], offset + length)
            reads[-1][2] += 1
        else:
            reads.append([offset, offset + length, 1])
    return [tuple(r) for r in reads]  # type: ignore[misc]


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload string, payload_bytes bigint, payload_digest string"


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the given index rows name, as parsed() gives them; payload is null if not asked for."""
    index = index.select("file", "offset", "length")
    # A number of tasks by the archives' bytes: left to the planner, it would follow the index, which is a hundred times smaller.
    held = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    spread = index.repartition(max(1, -(-held // SPAN)), "file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    names = [c.split()[0] for c in RECORD.split(", ")]

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        from pyarrow import fs

        name = source = None
        for p in parts:
            made: dict[str, list] = {n: [] for n in names}
            rows, k = [*zip(p["file"], p["offset"], p["length"])], 0
            while k < len(rows):
                end = next((j for j in range(k, len(rows)) if rows[j][0] != rows[k][0]), len(rows))
                if rows[k][0] != name:
                    if source is not None:
                        source.close()
                    name = rows[k][0]
                    store, path = fs.FileSystem.from_uri(name)
                    source = store.open_input_file(path)
                for start, stop, n in coalesced([(o, x) for _, o, x in rows[k:end]]):
                    source.seek(start)
                    raw = source.read(stop - start)
                    for _, offset, length in rows[k : k + n]:
                        found = parsed(zlib.decompress(raw[offset - start : offset - start + length], 31))
                        for field in names:
                            made[field].append(found[field] if payloads or field != "payload" else None)
                    k += n
            yield made
        if source is not None:
            source.close()

    return arrow_pass(spread, work, RECORD, 2000)


def resolved(records: DataFrame) -> DataFrame:
    """records with the payloads of revisits filled in from the responses they refer to (one of them, where page_ids repeat)."""
    kept = records.filter("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.first("payload").alias("_payload"))
    kept = salt_copies(kept.join(records.filter("refers_to is not null").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi"), SALTS)
    kept = kept.select(F.col("page_id").alias("refers_to"), "payload_digest", "_payload", "_salt")
    return salted(records, SALTS).join(kept, ["refers_to", "payload_digest", "_salt"], "left").withColumn("payload", F.coalesce("payload", "_payload")).select(*records.columns)


# The same decisions over whole payloads, without the archives.
ORACLE = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, cast(octet_length(encode(t)) as bigint) as payload_bytes, sha1(t) as payload_digest from p),
k as (select *, case when payload_bytes >= {LEAST_REVISIT} then max(page_id) over (partition by payload_digest, payload_bytes >= {LEAST_REVISIT}) end as keeper from d)
select page_id, payload_bytes, payload_digest,
  case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
  case when keeper is not null and page_id is distinct from keeper then keeper end as refers_to
from k"""
