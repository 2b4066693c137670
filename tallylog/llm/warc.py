"""WARC archives: written one gzip member per record, read back as a stream.

Writing: a page becomes a `response` record that carries an HTTP head and the page's bytes, or,
when a record with an equal payload carries them already, a `revisit` record with the HTTP head
alone. Each record is a gzip member of its own. Archives are files in a folder that all executors
share; a task rolls over to a next file when one is full. Files are named by partition and number
and put in place by a rename, so a repeated task leaves the same files.

Reading: a task goes through its archives in blocks of 64 KB, inflates one member after the other
and frames header and block by Content-Length; block and payload digests are computed on the way
and compared with the recorded ones. Memory is bounded by one record.

Null html is an empty payload. Rows with null ids, repeated ids or null urls are written like all
others; a null page_id comes back as null and is the smallest among equal payloads, a null url
comes back empty. Rows equal in page_id, url and payload count as one page: each of them is a
response. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import fresh_folder, split_join

#: Payloads shorter than this are always written whole.
MIN_REVISIT_BYTES = 1000
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BLOCK = 64 << 10
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

RECORDS = (
    "archive string, record_offset long, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary, digests_ok boolean"
)
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Each page with what its record has to be: row (page_id, url, html), digest, n_bytes,
    record_type and refers_to.

    Groups of equal payloads are summed up to one row per payload before the join, and the join's
    large side is split by Spark where one payload has many pages.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    ).select("*", F.sha1("html").alias("digest"), F.length("html").cast("long").alias("n_bytes"))
    # the largest id carries the payload; of rows that share it, one (told apart by its url)
    order = F.struct(F.col("page_id"), F.col("url"))
    first = (
        rows.where(F.col("n_bytes") >= min_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.max(order).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    joined = split_join(rows, first, ["digest", "n_bytes"], "left")
    again = F.col("copies").isNotNull() & ~order.eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        # a revisit does not carry its payload
        F.when(again, F.lit(None)).otherwise(F.col("html")).alias("html"),
        "digest",
        "n_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.page_id")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def encode_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, kind: str, refers_to: int | None
) -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    block = head.encode() + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", record_id(refers_to)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(text.encode() + block + b"\r\n\r\n") + deflate.flush()


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records as archives below `folder`; returns the list of archives.

    The list (archive, n_records, n_bytes) is a table in the folder, written in the same run as
    the archives: a task that is lost writes both again, under the same names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = open_folder(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        out, number, n_records, n_bytes = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out, number, n_records, n_bytes
            out.close()
            name = f"part-{part:05d}-{number:05d}.warc.gz"
            place = f"{root}/archives/{name}"
            if store.get_file_info(place).type != fs.FileType.NotFound:  # an earlier try's
                store.delete_file(place)
            store.move(f"{root}/archives/.{name}-{attempt}", place)
            row = pa.RecordBatch.from_pydict(
                {"archive": [name], "n_records": [n_records], "n_bytes": [n_bytes]}
            )
            out, number, n_records, n_bytes = None, number + 1, 0, 0
            return row

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, html, digest, size, kind, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    out = store.open_output_stream(
                        f"{root}/archives/.part-{part:05d}-{number:05d}.warc.gz-{attempt}",
                        compression=None,
                    )
                member = encode_record(page_id, url, html or b"", digest, size, kind, refers_to)
                out.write(member)
                n_records, n_bytes = n_records + 1, n_bytes + len(member)
                if n_bytes >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    listed = planned.mapInArrow(write, "archive string, n_records long, n_bytes long")
    listed.write.mode("overwrite").parquet(f"{folder}/list")
    return planned.sparkSession.read.parquet(f"{folder}/list")


def members(source: io.RawIOBase, block: int = READ_BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member of a stream, read block by block."""
    offset, data = 0, source.read(block)
    while data:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(inflate.decompress(data))
            if inflate.eof:
                used += len(data) - len(inflate.unused_data)
                data = inflate.unused_data
                break
            used += len(data)
            data = source.read(block)
            if not data:
                raise ValueError(f"the gzip member at {offset} is cut short")
        yield offset, b"".join(parts)
        offset += used
        data = data or source.read(block)


def fields_of(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and lower-case fields of a header."""
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(data: bytes) -> dict:
    """The record in one member, framed by Content-Length, with its digests compared."""
    end = data.index(b"\r\n\r\n") + 4
    version, fields = fields_of(data[: end - 4])
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    length = int(fields["content-length"])
    block = data[end : end + length]
    if len(block) != length or data[end + length :] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    start = block.index(b"\r\n\r\n") + 4
    _, http = fields_of(block[: start - 4])
    payload, kind = block[start:], fields["warc-type"]
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    ok = hashlib.sha1(block).hexdigest() == fields["warc-block-digest"].removeprefix("sha1:")
    digest = stated
    if kind == "response":  # a revisit has no payload of its own
        digest = hashlib.sha1(payload).hexdigest()
        ok = ok and digest == stated and len(payload) == int(http["content-length"])
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "record_type": kind,
        "refers_to": page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
        "digests_ok": ok,
    }


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """All records of the listed archives, in the columns of RECORDS. Digests of responses are those
    of the payload that was read.

    A record whose bytes do not frame ends the job with an error, and so does one whose digests
    differ from what its header says; unless `strict`, the latter has digests_ok false.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])
        store, root = open_folder(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/archives/{archive}", compression=None) as source:
                    for offset, data in members(source):
                        row = parse_record(data) | {"archive": archive, "record_offset": offset}
                        if strict and not row["digests_ok"]:
                            raise ValueError(f"{archive}: the digests of the record at {offset} do not fit it")
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # one row per archive: dealt out evenly, so that tasks have archives rather than list files
    spark = archives.sparkSession
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(spread).mapInArrow(read, RECORDS).select(names)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages as archives into `folder` (a new one in the shared folder unless given) and
    return the records read back."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, min_bytes), folder), folder)
