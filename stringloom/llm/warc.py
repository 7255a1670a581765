"""WARC archives, index first: write records and where they lie, read selected ones by merged byte ranges.

A record is a gzip member of its own. The index has file, offset, length, URL and digest of every record,
so a reader picks records from the index alone and reads sorted, merged ranges of the files.

Of records with equal payloads, the one with the smallest ``page_id`` is a response; the others are
revisits that have the headers only. Payloads below ``least`` bytes are always responses. A null html is
an empty payload and a null URL an empty one; control characters and blanks of a URL are percent-encoded
in the archive. Rows repeated with their id are all responses. A null ``page_id`` is never referred to.
Empty tables give no files. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import arrow_rows, new_folder, open_folder, stage, width

LEAST = 0
FILE_BYTES = 1 << 30
GAP, READ = 64 << 10, 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_INDEX = "page_id bigint, url string, file string, at bigint, bytes bigint, digest string, type string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def format_record(page_id: int | None, url: str, payload: bytes, date: str, first: int | None) -> bytes:
    """One record, compressed; ``first`` is the page it revisits, or null for a response."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace")).decode("utf-8", "replace")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP message (keys in lower case) and its body."""
    plain = zlib.decompress(packed, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    own = _headers(lines)
    size = int(own["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, body = rest[:size].partition(b"\r\n\r\n")
    return own, _headers(http.decode().split("\r\n")[1:]), body


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(name: str | None) -> int | None:
    page = (name or "")[len("<urn:x-page:") : -1]
    return int(page) if page not in ("", "null") else None


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least: int = LEAST, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row of ``pages`` and return the index, itself written.

    A task names its files by itself alone, and only files in the index count, so a task may run twice.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                        text.alias("html"), F.sha1(text).alias("digest"))
    # Sizes and the first page of each digest come from narrow rows; the pages are shuffled once.
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    whole = (F.octet_length("html") < least) | F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(first, "digest").select("page_id", "url", "html", F.when(~whole, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        out, file, at = None, "", 0
        for batch, payloads in arrow_rows(batches, "html"):
            index = []
            for page, target, first_page, payload in zip(
                    *(batch.column(i).to_pylist() for i in (0, 1, 3)), payloads, strict=True):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{file}", compression=None)
                record = format_record(page, target, payload, date, first_page)
                out.write(record)
                index.append((page, target, file, at, len(record), payload_digest(payload),
                              "response" if first_page is None else "revisit"))
                at += len(record)
            names = ["page_id", "url", "file", "at", "bytes", "digest", "type"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return stage(rows.mapInArrow(run, _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``index``: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Ranges of a file are read in order; those at most ``GAP`` apart become one read of at most ``READ``
    bytes (or one record). A response whose payload does not match its digest raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for ranges in merged(batch.select(["file", "at", "bytes"]).to_pylist()):
                start = ranges[0]["at"]
                with system.open_input_file(f"{path}/{ranges[0]['file']}") as source:
                    held = source.read_at(ranges[-1]["at"] + ranges[-1]["bytes"] - start, start)
                yield _rows([held[r["at"] - start : r["at"] - start + r["bytes"]] for r in ranges], payloads)

    zones = F.floor(F.col("at") / (8 * READ))
    dealt = index.select("file", "at", "bytes", zones.alias("zone")).repartition(
        max(width(index.sparkSession), 1), "file", "zone").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                                 "record_type string, refers_to bigint, payload binary")


def merged(rows: list[dict]) -> Iterator[list[dict]]:
    """Sorted ranges in runs that are read at once."""
    run: list[dict] = []
    for row in rows:
        end = run[-1]["at"] + run[-1]["bytes"] if run else 0
        if run and (row["file"] != run[0]["file"] or row["at"] - end > GAP or row["at"] + row["bytes"] - run[0]["at"] > READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _rows(records: list[bytes], payloads: bool) -> pa.RecordBatch:
    out = []
    for record in records:
        own, http, body = parse_record(record)
        digest = own["warc-payload-digest"].removeprefix("sha1:")
        response = own["warc-type"] == "response"
        if response and payload_digest(body) != digest:
            raise ValueError(f"payload of {own['warc-record-id']} does not match its digest")
        out.append((_page(own["warc-record-id"]), own["warc-target-uri"], int(http["content-length"]), digest,
                    own["warc-type"], _page(own.get("warc-refers-to")), body if response and payloads else None))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, str]:
    """Write ``pages`` to a new folder: the index and the folder."""
    folder = new_folder(pages.sparkSession, "warc")
    return write_archives(pages, folder, least=least), folder
