"""WARC archives: written one gzip member per record, and read back by byte ranges.

Writing: payload digests are counted first; only digests that occur more than once are joined back to the
pages, spread over salts so that a payload that many pages share does not meet in one task. Each task writes
archive files of its own and lists them in a manifest; a file whose task was repeated is in no manifest and is not read.

Reading: every archive is cut into ranges by size. A task looks for the gzip magic from its range's begin,
takes a candidate as a member only if it inflates to a WARC header, owns the records that start
inside the range, and reads on past the end for the last of them. So any file can be read by any number of tasks.

Files are opened through pyarrow's file systems, which take the URI of the shared folder as it is.

Defined results. Null payload is empty. Of equal payloads of at least `min_revisit_bytes`, the record with the smallest id is the response
and the others are revisits; rows that share that smallest id are all responses. A null id is greater than
any id; where all ids of a payload are null, all are responses. No rows: no archive, no records.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Size at which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Size of a reader's range.
RANGE_BYTES = 4 << 20
#: Bytes of archives that a task reads, about, where there are more than a few ranges for each core.
TASK_BYTES = 1 << 28
#: Salts of a digest that occurs more than once.
SALTS = 16
#: Bytes that are read from a file at once.
READ_BYTES = 1 << 20

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, target string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def marked(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is set for revisits."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    often = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1 AND least IS NOT NULL")
    salted = often.select("digest", "least", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    refers = F.when(~F.col("least").eqNullSafe(F.col("id")), F.col("least"))
    return rows.join(salted, ["digest", "salt"], "left").select("id", "url", "payload", refers.alias("refers_to"))


def record_name(record_id) -> str:
    return f"<urn:page:{'none' if record_id is None else record_id}>"


def member(record_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(record_id)}",
            # a target is one line
            f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns the manifest (path, bytes, records), itself a written table."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write_rows(batches):
        out, path, done, count = None, "", 0, 0
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        listed: list[tuple[str, int, int]] = []
        for batch in batches:
            for record_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                if out is None:
                    path, done, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{top}/{path}", compression=None)  # else it would pack by the name
                data = member(record_id, url, payload, refers_to)
                out.write(data)
                done, count = done + len(data), count + 1
                if done >= archive_bytes:
                    out.close()
                    listed.append((path, done, count))
                    out = None
        if out is not None:
            out.close()
            listed.append((path, done, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in listed], pa.string()), pa.array([x[1] for x in listed], pa.int64()), pa.array([x[2] for x in listed], pa.int64())], ["path", "bytes", "records"])

    rows = marked(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes)
    return written(rows.mapInArrow(write_rows, "path string, bytes bigint, records bigint"), "warc-manifest")


class Window:
    """A file's bytes from a moving place on, read as asked for."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def get(self, begin: int, length: int) -> bytes:
        """Bytes from begin on, fewer at the end of the file."""
        length = min(length, self.size - begin)
        if begin < self.at or begin + length > self.at + len(self.data):
            self.source.seek(begin)
            self.at, self.data = begin, self.source.read(min(max(length, READ_BYTES), self.size - begin))
        return self.data[begin - self.at : begin - self.at + length]

    def find(self, magic: bytes, begin: int, end: int) -> int:
        """The first place in [begin, end) where magic starts, or -1."""
        while begin < end:
            data = self.get(begin, min(READ_BYTES, end - begin + len(magic) - 1))
            at = data.find(magic)
            if at >= 0:
                return begin + at if begin + at < end else -1
            begin += max(1, len(data) - len(magic) + 1)
        return -1


def inflate(window: Window, begin: int, enough: int | None = None) -> tuple[bytes, int] | None:
    """What the member at `begin` holds (or its first bytes) and where it ends; None if it is no whole member."""
    unpack, out, at = zlib.decompressobj(31), [], begin
    try:
        while not unpack.eof:
            data = window.get(at, 1 << 16)
            if not data:
                return None
            out.append(unpack.decompress(data) if enough is None else unpack.decompress(data, enough))
            at += len(data)
            if enough is not None:
                return b"".join(out), begin
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def parsed(data: bytes) -> tuple | None:
    """A row of RECORDS, or None if the bytes are no record or its payload is not the one its digest names."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    h = headers(head)
    if not h.get("content-length", "").isdigit() or len(rest) < int(h["content-length"]) or "warc-type" not in h:
        return None
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "revisit":
        length, payload = int(headers(http).get("content-length", 0)), None
    else:
        length = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {h.get('warc-record-id')} does not have its digest")
    return h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h["warc-type"], h.get("warc-refers-to"), digest, length, payload


def owned(window: Window, begin: int, end: int) -> Iterator[tuple]:
    """The records that start in [begin, end). Members follow one another; the magic is looked for where none follows."""
    at = begin
    while (at := window.find(MAGIC, at, end)) >= 0:
        first = inflate(window, at, 8)
        whole = inflate(window, at) if first and first[0].startswith(b"WARC/1.") else None
        row = parsed(whole[0]) if whole else None
        # a member that was found by its magic alone must be followed by another or by the end
        if row is None or (whole[1] < window.size and window.get(whole[1], 3) != MAGIC):
            at += 1
            continue
        yield row
        at = whole[1]


def read(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """RECORDS of the archives in the manifest (path, bytes)."""

    def read_ranges(batches):
        for batch in batches:
            for path, size, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "begin"))):
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    rows, held = [], 0
                    for row in owned(Window(source, size), begin, min(size, begin + range_bytes)):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held > READ_BYTES:
                            yield records(rows)
                            rows, held = [], 0
                    yield records(rows)

    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin"))
    # a given number of tasks, as the rows that name the ranges are too short to be told apart by their size
    total, count = ranges.agg(F.count("*")).first()[0] * range_bytes, ranges.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total // range_bytes, max(4 * count, total // TASK_BYTES)))
    return ranges.repartition(tasks, F.col("path"), F.col("begin")).mapInArrow(read_ranges, RECORDS)


def records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("target", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])


def number_of(name: str):
    """The page id in a record's name; null for none."""
    return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("bigint")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes the pages, reads the archives back, and returns a row per record."""
    back = read(write(pages, **how))
    return back.select(number_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number_of("refers_to").alias("refers_to"))
