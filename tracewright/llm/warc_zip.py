"""WARC records in ZIP archives: writing them, reading their directories, and range-reading records without extraction.

Writing: payloads' digests are grouped to find each payload's first page; pages meet that by their own ids, so a hot
payload is no hot key; then every task packs its records, each a gzip member, into stored members of archives of
a bounded size, with an index member. Reading: archives are opened at their end; the end records (ZIP64's where the
classic fields overflow), the central directory and the local headers locate the stored members; index lines become rows,
and records are read by ranges of bytes, a few megabytes at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

# Signatures and layouts of the ZIP format (APPNOTE), and what marks an overflow.
_RECORDS = {
    "local header": (b"PK\x03\x04", "version:H flags:H method:H time:H date:H crc:I packed:I size:I name:H extra:H"),
    "directory entry": (
        b"PK\x01\x02",
        "made:H version:H flags:H method:H time:H date:H crc:I packed:I size:I name:H extra:H note:H disk:H inner:H outer:I offset:I"
    ),
    "end record": (b"PK\x05\x06", "disk:H first:H here:H entries:H length:I start:I note:H"),
    "ZIP64 locator": (b"PK\x06\x07", "disk:I at:Q disks:I"),
    "ZIP64 end record": (b"PK\x06\x06", "rest:Q made:H version:H disk:I first:I here:Q entries:Q length:Q start:Q"),
}
_FULL16, _FULL32, _ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1
INDEX, RECORDS = "indexes/index.cdxj", "archive/data.warc.gz"


# --- ZIP directories -------------------------------------------------------------------------------------------


class Record:
    """One kind of fixed-size record: where its fields lie, after its signature."""

    def __init__(self, kind: str):
        self.kind, (self.signature, fields) = kind, _RECORDS[kind]
        self.names = [f.split(":")[0] for f in fields.split()]
        self.layout = struct.Struct("<4s" + "".join(f.split(":")[1] for f in fields.split()))
        self.size = self.layout.size

    def parse(self, data: bytes, at: int = 0) -> dict:
        if len(data) - at < self.size or data[at : at + 4] != self.signature:
            raise ValueError(f"no {self.kind} where one should be")
        return dict(zip(self.names, self.layout.unpack_from(data, at)[1:], strict=True))


_LOCAL, _ENTRY, _END, _LOCATOR, _END64 = map(Record, _RECORDS)


def _range(f, start: int, n: int) -> bytes:
    f.seek(start)
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the archive ends early")
    return data


def _part(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("a record ends early")
    return data[at : at + n]


def extra_fields(extra: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each extra field; a few bytes that hold no whole header may follow."""
    at = 0
    while len(extra) - at >= 4:
        kind, n = struct.unpack_from("<HH", extra, at)
        yield kind, _part(extra, at + 4, n)
        at += 4 + n


def widened(entry: dict, extra: bytes) -> dict:
    """A directory entry with its overflowed sizes and offset: the ZIP64 extra field holds just those, in this order."""
    over = [x for x in ("size", "packed", "offset") if entry[x] == _FULL32]
    wide = next((data for kind, data in extra_fields(extra) if kind == _ZIP64_FIELD), None)
    if not over or wide is None:
        return entry
    return entry | dict(zip(over, struct.unpack(f"<{len(over)}Q", _part(wide, 0, 8 * len(over))), strict=True))


def _end_of(f: BinaryIO, size: int) -> dict:
    """The end record: the last one whose note reaches just to the archive's end (a note may hold the signature, too); ZIP64's where fields overflow."""
    tail_at = max(0, size - _END.size - _FULL16)
    tail = _range(f, tail_at, size - tail_at)
    places = [m.start() for m in re.finditer(re.escape(_END.signature), tail) if len(tail) - m.start() >= _END.size]
    at = next((p for p in reversed(places) if p + _END.size + _END.parse(tail, p)["note"] == len(tail)), None)
    if at is None:
        raise ValueError("no end of central directory")
    end = _END.parse(tail, at)
    if end["entries"] != _FULL16 and _FULL32 not in (end["length"], end["start"]):
        return end
    before = tail_at + at - _LOCATOR.size
    if before < 0 or (found := _range(f, before, _LOCATOR.size))[:4] != _LOCATOR.signature:
        return end
    return _END64.parse(_range(f, _LOCATOR.parse(found)["at"], _END64.size))


def directory(f: BinaryIO, size: int) -> list[dict]:
    """Name, offset of the local header, sizes and method of each member, from the archive's end. Anything cut short is a ValueError."""
    end = _end_of(f, size)
    data, members, at = _range(f, end["start"], end["length"]), [], 0
    for _ in range(end["entries"]):
        entry = _ENTRY.parse(data, at)
        at += _ENTRY.size
        name, extra, note = (entry[x] for x in ("name", "extra", "note"))
        wide = widened(entry, _part(data, at + name, extra))
        members.append(
            {
                "name": _part(data, at, name).decode(),
                "method": wide["method"],
                "packed": wide["packed"],
                "size": wide["size"],
                "offset": wide["offset"]
            }
        )
        at += name + extra + note
    return members


def member_start(f: BinaryIO, member: dict) -> int:
    """Where a stored member's bytes begin: its local header may differ in length from the directory's entry."""
    if member["method"] != 0:
        raise ValueError(f"{member['name']} is compressed; only stored members can be read by ranges")
    head = _LOCAL.parse(_range(f, member["offset"], _LOCAL.size))
    return member["offset"] + _LOCAL.size + head["name"] + head["extra"]


# --- WARC records ----------------------------------------------------------------------------------------------


#: What a header's line cannot hold: white space and control characters; they are percent-encoded.
_UNSAFE = re.compile("[\\s\x00-\x1f\x7f]")


def record(page_id, url: str, payload: bytes | None, length: int, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit (without one) that refers to another page's response."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}",
    ]
    if url:
        lines.insert(3, "WARC-Target-URI: " + _UNSAFE.sub(lambda m: quote(m.group()), url))
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"
        ]
    return gzip.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> dict:
    """A record's fields: its type, ids, digest, and the payload's length and bytes (None for a revisit)."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    ident = lambda x: int(x[12:-1]) if x and x[12:-1] else None
    kind = fields["WARC-Type"]
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "record_type": kind,
        "refers_to": ident(fields.get("WARC-Refers-To")),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": length,
        "payload": payload if kind == "response" else None
    }


# --- Spark jobs ------------------------------------------------------------------------------------------------

_ARCHIVES = "path string, size long, n_records long"


def find_revisits(pages: DataFrame, least: int) -> DataFrame:
    """pages with `first`, the least page_id of an equal payload of at least `least` bytes, or null where this row is it.

    Digests are grouped without payloads, and rows meet their revisits by page_id and digest: a payload of many copies
    is no key of any row that carries it. Revisits lose their payload.
    """
    light = pages.where((F.col("n") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    held = light.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("copies")
    ).where(F.col("copies") > 1).select("digest", "first")
    revisits = light.join(held, "digest").where(F.col("page_id") != F.col("first")).select(
        F.col("page_id").alias("own_id"), F.col("digest").alias("own"), "first"
    )
    found = pages.join(revisits, (F.col("page_id") == F.col("own_id")) & (F.col("digest") == F.col("own")), "left").drop("own_id", "own")
    return found.withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")))


def write_archives(pages: DataFrame, least: int = 100, archive_bytes: int = 64 << 20, folder: str | None = None) -> DataFrame:
    """Writes page_id, url, html as archives; returns their manifest (a written table, so that only finished attempts' archives count).

    A null html is the empty payload. A null page_id is always a response. Of rows with one page_id and equal payloads
    all are responses if that id is the least. An empty table gives no archives. Payloads are whole; one longer than
    archive_bytes is an archive by itself. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or common.new_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("n", F.length("payload")).withColumn("digest", F.sha2("payload", 256))

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        out = zipped = member = None
        lines, at = [], 0

        def close():
            nonlocal out, zipped, member, lines, at
            member.close()
            zipped.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
            n = len(lines)
            zipped.close()
            out.close()
            name = f"{part:06d}-{seq:06d}-{attempt}.wacz"
            size = store.get_file_info(f"{root}/{name}").size
            out, lines, at = None, [], 0
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "n_records": [n]})

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{root}/{part:06d}-{seq:06d}-{attempt}.wacz")
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = zipped.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
                data = record(r["page_id"], r["url"] or "", r["payload"], r["n"], r["digest"], r["first"])
                member.write(data)
                lines.append(json.dumps({"id": r["page_id"], "offset": at, "length": len(data), "member": RECORDS}))
                at += len(data)
                if at >= archive_bytes:
                    yield close()
                    seq += 1
        if out is not None:
            yield close()

    return common.written(
        find_revisits(rows, least).select("page_id", "url", "payload", "n", "digest", "first").mapInArrow(run, _ARCHIVES), "warc-manifest"
    )


def locate(manifest: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """path, start, n, lengths: neighbouring records of an archive as one range to read, from its directory and index."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for uri, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    members = {m["name"]: m for m in directory(f, size)}
                    first = {name: member_start(f, m) for name, m in members.items()}
                    lines = _range(f, first[INDEX], members[INDEX]["size"]).decode().splitlines()
                chunk, begin, n, out = [], 0, 0, []
                for x in map(json.loads, lines):
                    if chunk and (first[x["member"]] + x["offset"] != begin + n or n + x["length"] > chunk_bytes):
                        out.append((uri, begin, n, chunk))
                        chunk, n = [], 0
                    if not chunk:
                        begin = first[x["member"]] + x["offset"]
                    chunk.append(x["length"])
                    n += x["length"]
                if chunk:
                    out.append((uri, begin, n, chunk))
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [o[0] for o in out],
                        "start": [o[1] for o in out],
                        "n": [o[2] for o in out],
                        "lengths": pa.array([o[3] for o in out], pa.list_(pa.int64()))
                    }
                )

    parts = common.partitions(manifest.sparkSession)
    return manifest.select("path", "size").repartition(parts, "path").mapInArrow(
        run, "path string, start long, n long, lengths array<long>"
    )


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record (and the payload, if asked for).

    A response's digest is computed anew from the bytes that were read; one that differs from the record's is an error.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for uri, start, n, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "n", "lengths")), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    data = _range(f, start, n)
                rows, at = [], 0
                for k in lengths:
                    r = parse_record(data[at : at + k])
                    at += k
                    if r["payload"] is not None and hashlib.sha256(r["payload"]).hexdigest() != r["payload_digest"]:
                        raise ValueError(f"page {r['page_id']}: the payload does not match its digest")
                    rows.append(r if payloads else {x: r[x] for x in r if x != "payload"})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64())
        ] + [("payload", pa.binary())] * payloads
    )
    ranges = locate(manifest).repartition(common.partitions(manifest.sparkSession), "path", "start")
    return ranges.mapInArrow(
        run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    )


SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
