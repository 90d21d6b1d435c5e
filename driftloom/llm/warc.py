"""WARC archives, index first.

`write_archive` writes one gzip member per record and returns an index row for each: file, offset, length,
URL and digest. The index, not the folder, says what the archive holds, so files of lost or repeated task
attempts are never read. `read_records` takes any selection of index rows, sorts it by file and offset and
turns neighbouring records into one byte-range read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header only and says how long its payload is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date,
        "WARC-Target-URI": url and "".join(url.splitlines()), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id,
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit), checked against the record's own lengths and digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = http.decode().rpartition("Content-Length: ")[2]
    if fields["WARC-Type"] == "response" and (len(payload) != int(fields["payload_bytes"]) or "sha1:" + digest32(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError("payload differs from its digest")
    return fields, payload


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z",
                  id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as WARC files to `folder` (default: a new one in the shared folder) and returns the index.

    Of records with equal payloads (by SHA-1 and length) of at least min_revisit_bytes, those with the largest
    id are responses and the others revisits of it; repeated rows of that id are all responses. Null payload is
    empty; a null id ranks below all ids; a null URL has no WARC-Target-URI.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    # Written as a table, so that the join below has a plain exchange on either side, which AQE splits where a payload is hot.
    keep = cut(rows.groupBy("sha", "n").agg(F.max("page_id").alias("keep_id")), "warc-keep")
    rows = rows.join(keep, ["sha", "n"]).select("page_id", "url", "html", "keep_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, name, out, at, n_files = TaskContext.get(), "", None, 0, 0
        for batch in batches:
            index = []
            for page_id, url, html, keep_id in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n_files:04d}.warc.gz", 0
                    out, n_files = store.open_output_stream(f"{base}/{name}", compression=None), n_files + 1
                payload = html.encode()
                digest, revisit = digest32(payload), page_id != keep_id and len(payload) >= min_revisit_bytes
                member = _member(_record(page_id, url, payload, digest, keep_id, revisit, date))
                out.write(member)
                index.append((page_id, url, digest, "revisit" if revisit else "response", keep_id if revisit else None, f"{folder}/{name}", at, len(member)))
                at += len(member)
            columns = list(zip(*index)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=["page_id", "url", "payload_digest", "record_type", "refers_to", "file", "offset", "length"])
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, max_gap: int = 1 << 16, max_read: int = 8 << 20, task_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    """The records of the given index rows: page_id, url, record_type, payload_digest, payload_bytes, refers_to
    and, if asked for, payload (null for a revisit).

    Ranges of one file that lie at most max_gap bytes apart are read together, up to max_read bytes at once. Tasks
    get ranges of the index that stand for about task_bytes each; the index itself is too small to split by."""
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // task_bytes
    picked = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payload
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * payload

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if run and (file != run[0][0] or offset - run[-1][1] - run[-1][2] > max_gap or offset + length - run[0][1] > max_read):
                    yield run
                    run = []
                run.append((file, offset, length))
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, source = None, None
        for run in runs(batches):
            file, first, _ = run[0]
            if file != open_name:
                if source is not None:
                    source.close()
                store, path = fs.FileSystem.from_uri(file)
                open_name, source = file, store.open_input_file(path)
            data = source.read_at(run[-1][1] + run[-1][2] - first, first)
            rows = []
            for _, offset, length in run:
                head, body = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
                number = {k: int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")}
                row = (number["X-Page-ID"], head.get("WARC-Target-URI"), head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["payload_bytes"]), number["X-Refers-To-Page-ID"])
                rows.append(row + ((body if head["WARC-Type"] == "response" else None,) if payload else ()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
        if source is not None:
            source.close()

    return picked.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payload)


def op7_warc_index(spark, sf_dir: str) -> DataFrame:
    """All pages; a null html is an empty payload."""
    index = write_archive(table(spark, sf_dir, "pages"))
    return read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS keep, sha1(html) AS h FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::BIGINT) AS parts FROM k)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM g
"""
