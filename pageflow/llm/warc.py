"""WARC archives with an index: record positions first, payloads by coalesced reads.

Writers store records in gzip members and note file, offset, length, URL and
digest of each.  A reader selects in the index, sorts what it wants by
position, merges neighbours into ranges and fetches each range once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.sources.shared import staged

INDEX = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long,"
    " file string, offset long, length long"
)


@dataclass(frozen=True)
class WarcSettings:
    #: Payloads of fewer bytes are always stored in full.
    min_dedup_bytes: int = 0
    #: A task starts another file beyond so many bytes.
    file_bytes: int = 256 << 20
    #: Records of one span of a file are read by one task,
    span_bytes: int = 16 << 20
    #: in ranges of at most so many bytes,
    range_bytes: int = 4 << 20
    #: which bridge gaps of at most so many bytes.
    gap_bytes: int = 64 << 10
    level: int = 1


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str | None) -> str:
    """A header's value: line breaks cannot be stored in one."""
    return (value or "").replace("\r", " ").replace("\n", " ")


def _record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has no payload but states its digest and size."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {_line(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(html)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    else:
        body += html
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def originals(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Rows (page_id, sha, refers_to) of the pages whose payload another, larger page_id stores.

    Only page_id, digest and size move; counting combines before the shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    marks = pages.select("page_id", _sha(F.col("html")).alias("sha"), F.octet_length(payload).alias("bytes"))
    marks = staged(marks.where(F.col("bytes") >= settings.min_dedup_bytes), "digests")
    largest = (
        marks.groupBy("sha", "bytes")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "bytes", "refers_to")
    )
    found = marks.join(largest, ["sha", "bytes"]).where("page_id <> refers_to")
    return found.select("page_id", "sha", "refers_to").distinct()


def _sha(html: Column) -> Column:
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def write_archives(pages: DataFrame, folder: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Write all pages (page_id, url, html) as WARC files into ``folder``; returns the stored index.

    A null html is an empty payload, a null url an empty address; a null page_id
    never revisits.  Repeated rows with the same page_id keep a record
    each.  Every attempt of a task writes files of its own, and the index names
    those of the attempt that counted, so lost executors leave no gap.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, position = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or position >= settings.file_bytes:
                    if out is not None:
                        out.close()
                    file, position = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = open_output(file)
                payload = (html or "").encode()
                digest = payload_digest(payload)
                packer = zlib.compressobj(settings.level, zlib.DEFLATED, 31)
                record = _record(page_id, url, payload, digest, refers_to, refers_to is not None)
                data = packer.compress(record) + packer.flush()
                out.write(data)
                kind = "response" if refers_to is None else "revisit"
                rows.append((page_id, url, kind, refers_to, digest, len(payload), file, position, len(data)))
                position += len(data)
            yield _batch(rows)
        if out is not None:
            out.close()

    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    )
    revisits = originals(narrow, settings)
    decided = narrow.withColumn("sha", _sha(F.col("html"))).join(revisits, ["page_id", "sha"], "left")
    decided = decided.select("page_id", "url", "html", "refers_to")
    return staged(decided.mapInArrow(write, INDEX), "warc-index")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    names, kinds = zip(*(f.split() for f in INDEX.split(",")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names)
    )


def open_output(uri: str):
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system.open_input_file(path)


def ranges(rows: Iterator[tuple[str, int, int]], settings: WarcSettings) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Merge sorted (file, offset, length) into (file, begin, end, records) reads."""
    file, begin, end, members = "", 0, 0, []
    for name, offset, length in rows:
        near = members and name == file and offset - end <= settings.gap_bytes
        if not (near and offset + length - begin <= settings.range_bytes):
            if members:
                yield file, begin, end, members
            file, begin, members = name, offset, []
        members.append((offset, length))
        end = offset + length
    if members:
        yield file, begin, end, members


def read_records(index: DataFrame, settings: WarcSettings = WarcSettings(), payloads: bool = False) -> DataFrame:
    """Rows of the selected index entries as their records state them.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).
    A response's size and digest are taken anew from its payload and must
    equal its headers, else the read fails.
    """
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            *([("payload", pa.binary())] if payloads else []),
        ]
    )

    def parsed(data: bytes) -> tuple:
        headers, payload = parse_record(zlib.decompress(data, 31))
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(headers["X-Payload-Length"])
        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError(f"damaged record of {headers['WARC-Target-URI']}")
        number = [int(headers[h]) if h in headers else None for h in ("X-Page-ID", "X-Refers-To-Page")]
        row = (number[0], headers["WARC-Target-URI"], size, digest, kind, number[1])
        return (*row, payload) if payloads else row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        source, name = None, ""
        for file, begin, end, members in ranges(wanted, settings):
            if file != name:
                if source is not None:
                    source.close()
                source, name = open_input(file), file
            source.seek(begin)
            data = source.read(end - begin)
            rows = [parsed(data[o - begin : o - begin + n]) for o, n in members]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if source is not None:
            source.close()

    span = F.floor(F.col("offset") / settings.span_bytes)
    # tasks by the bytes to read, which the few bytes of index rows do not show
    tasks = max(1, (index.agg(F.sum("length")).first()[0] or 0) // settings.span_bytes)
    placed = index.select("file", "offset", "length").repartition(tasks, F.col("file"), span)
    placed = placed.sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, fields + (", payload binary" if payloads else ""))
