"""WARC archives: written with an index, read by coalesced byte ranges of selected records.

Each record is a gzip member of its own, so any record can be read alone.  The
index (offset, length, URL and payload digest of each record) is a table; a
reader filters it first, sorts what is left by file and offset, and fetches
neighbouring records in one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import RangeReader, hot_keys, joined, workspace, write_file, written

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records with at most this many unread bytes between them are fetched in one read of at most READ bytes.
GAP, READ = 64 << 10, 8 << 20
#: A reading task gets the records of about so many bytes, in stretches of a file of as many.
STRIDE = 16 << 20
INDEX = "page_id long, path string, offset long, length long, url string, payload_digest string, record_type string"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> tuple[bytes, str, str]:
    """(record, payload digest, type): a response with its payload, or a revisit of another page's response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if page_id == response_id else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response_id}>"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        "\r\n",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n", digest, kind


def parse(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record; a damaged record raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("cut WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload digest differs")
    return {"fields": fields, "http": told, "payload": payload, "digest": digest}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def responses(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with response_id: the smallest page_id with an equal payload.

    The join that finds it moves ids and digests only, and those of frequent payloads not even that.  Rows with payloads of
    fewer than ``least`` bytes, and rows without page_id, are responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("_digest"))
    slim = written(rows.filter(F.octet_length("html") >= least).select("page_id", "_digest"), folder, "digests")
    first = slim.groupBy("_digest").agg(F.min("page_id").alias("response_id"))
    picked = joined(slim, first, "_digest", hot_keys(slim, "_digest", folder, "frequent")).filter("page_id <> response_id").select("page_id", "_digest", "response_id").distinct()
    return rows.join(picked, ["page_id", "_digest"], "left").select("page_id", "url", "html", F.coalesce("response_id", "page_id").alias("response_id"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 6) -> DataFrame:
    """Write ``pages`` as archives ``pages-NNNNN.warc.gz``, a file for each task, and return the index.

    Null html is an empty payload.  Each row makes one record; rows that share
    page_id and html are alike.  Columns besides page_id, url, html aren't read."""

    def run(parts):
        import pyarrow as pa

        no = TaskContext.get().partitionId()
        path = f"{folder}/pages-{no:06d}.warc.gz"
        rows: list[tuple] = []

        def chunks() -> Iterator[bytes]:
            info = b"software: carteel\r\nformat: WARC File Format 1.1\r\n"
            lead = _gzip(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{no}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level)
            offset = len(lead)
            yield lead
            for batch in chain([first], parts):
                yield from some(batch, offset)
                offset = rows[-1][2] + rows[-1][3]

        def some(batch, offset: int) -> Iterator[bytes]:
            for page_id, url, html, response_id in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data, digest, kind = record(page_id, url, html.encode("utf-8", "surrogatepass"), response_id)
                packed = _gzip(data, level)
                rows.append((page_id, path, offset, len(packed), url, digest, kind))
                offset += len(packed)
                yield packed

        parts = (b for b in parts if b.num_rows)
        first = next(parts, None)
        if first is None:
            return
        write_file(path, chunks())
        for i in range(0, len(rows), 10_000):
            columns = list(zip(*rows[i : i + 10_000], strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return written(responses(pages, folder, least).mapInArrow(run, INDEX), folder, "index")


def ranges(wanted: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads for (offset, length) in ascending order: (offset, length, the records inside)."""
    held: list[tuple[int, int]] = []
    for offset, length in wanted:
        if held and (offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
            yield held[0][0], held[-1][0] + held[-1][1] - held[0][0], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1] - held[0][0], held


def read_archives(index: DataFrame, where: Column | None = None, with_payload: bool = False) -> DataFrame:
    """The records that ``where`` selects of the index: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url (and payload).  Of a revisit, digest and size are those of the whole payload it stands for."""
    schema = ROWS + (", payload binary" if with_payload else "")

    def run(parts):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in parts:
            rows: list[tuple] = []
            paths, at = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            begin = 0
            while begin < len(paths):
                stop = begin
                while stop < len(paths) and paths[stop] == paths[begin]:
                    stop += 1
                with RangeReader(paths[begin]) as file:
                    for offset, length, held in ranges(at[begin:stop]):
                        data = file.read(offset, length)
                        for o, n in held:
                            got = parse(zlib.decompress(data[o - offset : o - offset + n], 31))
                            f = got["fields"]
                            row = (_page(f["warc-record-id"]), int(got["http"]["content-length"]), got["digest"], f["warc-type"], _page(f.get("warc-refers-to")), f.get("warc-target-uri"))
                            rows.append((*row, got["payload"])[: len(names)])
                            if with_payload and len(rows) >= 500:
                                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
                                rows = []
                begin = stop
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    picked = (index if where is None else index.filter(where)).select("path", "offset", "length")
    # a row of the index stands for kilobytes of archive, so the number of tasks follows the bytes to read, not those of the rows
    tasks = -(-(picked.agg(F.sum("length")).first()[0] or 0) // STRIDE) + 1
    spread = picked.repartition(tasks, "path", F.floor(F.col("offset") / STRIDE))
    return spread.sortWithinPartitions("path", "offset").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages and read all records back; see ``write_archives`` and ``read_archives``."""
    return read_archives(write_archives(pages, workspace(pages.sparkSession, "warc"), least))
