"""WARC archives: writing with revisit records, an index, and byte-range reads.

``write_archives`` writes one record per row, each a gzip member of its own, and returns
the index: file, offset, length, URL and digest of every record. Of rows whose payloads
are equal and of at least ``min_revisit_bytes`` bytes, that with the smallest id is a
response and the others are revisits that refer to it. ``read_records`` takes any part of
the index, sorts it by file and offset, merges neighbouring byte ranges into single reads
and parses and verifies the records.

An archive is named by the task attempt that wrote it, and the index names only archives
of attempts that were committed, so a task that runs again leaves no wrong record behind.

Archives are read and written by Arrow's file systems. The folder's URI is resolved by Hadoop
first (a view to the store behind it, s3a to s3); a store that Arrow can't open is refused
before any work.

Defined results: a null payload is empty and a record of 0 bytes like any other; a null URL
writes no target header; ids may hold any characters and are percent-encoded in their headers; a row with a null id is a response; of equal payloads the smallest id
is the response, and repeated rows of it are all responses; payloads are archived whole, of any
length, a record at a time; an empty table gives an empty index and no records; other columns
are not archived, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, utf8_buffer
from docloom.store import shared_folder

#: Size at which a task begins another archive; gap and size up to which ranges are read together.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 1 << 30, 1 << 16, 8 << 20
#: Bytes of an archive that one reading task takes.
SPAN_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "file string, offset bigint, length bigint, url string, payload_digest string, id string, record_type string, refers_to string"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(row_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{row_id}:{digest}'.encode()).digest())}>"


def _quoted(row_id: str) -> str:
    """An id as one line of visible ASCII characters."""
    return urllib.parse.quote(row_id, safe=string.punctuation.replace("%", ""))


def build_record(row_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(row_id, digest), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if row_id is not None:
        fields["X-Row-Id"] = _quoted(row_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Row": _quoted(refers_to)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def _own(quoted: str | None) -> str | None:
    return None if quoted is None else urllib.parse.unquote(quoted)


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """(header fields, length of the full payload, payload or b"" for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


def _store(spark: SparkSession, path: str) -> str:
    """The URI by which Arrow opens the folder of a Hadoop path; an error if it has no file system for it."""
    from pyarrow import fs

    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    uri = re.sub(r"^s3[an]:", "s3:", store.resolvePath(folder).toString())
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    try:
        fs.FileSystem.from_uri(uri)
    except Exception as e:
        raise ValueError(f"archives can't be kept in {path}: Arrow has no file system for {uri}") from e
    return uri


def _roles(df: DataFrame, id_col: str, payload_col: str, min_bytes: int, scratch: Scratch) -> DataFrame:
    """(id, digest, refers_to) of the rows that are revisits."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = scratch.write(df.where(F.col(id_col).isNotNull() & (F.octet_length(payload) >= min_bytes)).select(F.col(id_col).alias("id"), F.unhex(F.sha1(payload)).alias("digest")), "digests")
    heads = rows.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(heads, "digest").where("id <> refers_to").distinct()


def write_archives(df: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives below path and returns their index, which is written beside them."""
    spark = df.sparkSession
    uri = _store(spark, path)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        out, name, at, count = None, None, 0, 0
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                ids, urls, refers = (part.column(i).to_pylist() for i in (0, 1, 3))
                raw, offsets = utf8_buffer(part.column(2))
                data = raw.tobytes()
                rows: list[list] = [[] for _ in range(8)]
                for i, (row_id, url, to) in enumerate(zip(ids, urls, refers, strict=True)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, count = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{count}.warc.gz", 0, count + 1
                        out = store.open_output_stream(name, compression=None)
                    body = data[offsets[i] : offsets[i + 1]]
                    digest = digest32(hashlib.sha1(body).digest())
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = packer.compress(build_record(row_id, url, body, digest, to)) + packer.flush()
                    out.write(packed)
                    for column, value in zip(rows, (name.removeprefix(f"{root}/"), at, len(packed), url, digest, row_id, "response" if to is None else "revisit", to), strict=True):
                        column.append(value)
                    at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (1, 2) else pa.string()) for k, c in enumerate(rows)], ["file", "offset", "length", "url", "payload_digest", "id", "record_type", "refers_to"])
        if out is not None:
            out.close()

    with Scratch(spark, "warc") as scratch:
        roles = _roles(df.select(F.col(id_col), F.col(payload_col).cast("string").alias(payload_col)), id_col, payload_col, min_revisit_bytes, scratch)
        rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
        marked = rows.join(roles, ["id", "digest"], "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
        marked.mapInArrow(write, _INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def read_records(index: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records of an index, or of any part of it: id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if wanted, payload (null for a revisit).

    Byte ranges are dealt out by about SPAN_BYTES of an archive; their number follows the bytes
    that the index names, not the size of the index.
    """
    uri = _store(index.sparkSession, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            i = 0
            while i < len(places):
                j, (name, begin, size) = i + 1, places[i]
                end = begin + size
                while j < len(places) and places[j][0] == name and 0 <= places[j][1] - end <= GAP_BYTES and places[j][1] + places[j][2] - begin <= READ_BYTES:
                    end = places[j][1] + places[j][2]
                    j += 1
                with store.open_input_file(f"{root}/{name}") as f:
                    data = f.read_at(end - begin, begin)
                rows: list[list] = [[] for _ in range(7)]
                for _, at, size in places[i:j]:
                    fields, n, body = parse_record(zlib.decompress(data[at - begin : at - begin + size], 31))
                    digest, full = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                    if full and (len(body) != n or digest32(hashlib.sha1(body).digest()) != digest):
                        raise ValueError(f"damaged record at {at} of {name}")
                    for column, value in zip(rows, (_own(fields.get("X-Row-Id")), fields.get("WARC-Target-URI"), fields["WARC-Type"], _own(fields.get("X-Refers-To-Row")), n, digest, body if full else None), strict=True):
                        column.append(value)
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
                names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
                keep = 7 if payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:keep], kinds, strict=False)], names[:keep])
                i = j

    schema = "id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payload
    span = F.floor(F.col("offset") / SPAN_BYTES)
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // SPAN_BYTES)
    return index.select("file", "offset", "length").repartition(int(tasks), "file", span).sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def archive_dir(spark) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_folder(spark)}/docloom-warc-{uuid.uuid4().hex}"
