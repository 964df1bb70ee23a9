"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

Pages are first written as whole-file gzip streams, as crawlers that compress afterwards
leave them. The normaliser inflates each such file once, rewrites every record as a gzip
member of its own and puts an offset index beside the file, so a reader can take any record
by one seek. Files live in a folder that driver and executors share; a task's files get
names of their own and only those of finished tasks are listed, so a task may run again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import SLICE_ROWS, shared_dir, written

#: A monolithic file is closed after so many bytes of records.
FILE_BYTES = 128 << 20
DATE = "1970-01-01T00:00:00Z"
_FILES = pa.schema([("name", pa.string())])
_PAGE = "<urn:page:{}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: {_PAGE.format(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}")
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_PAGE.format(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(stream: BinaryIO) -> tuple[dict[str, str], bytes, bytes] | None:
    """(headers in lower case, block, the record's bytes) of the next record; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    raw, headers = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    n = int(headers["content-length"])
    block = stream.read(n)
    if len(block) < n:
        raise ValueError("a WARC record is cut short")
    return headers, block, b"".join(raw) + b"\r\n" + block + b"\r\n\r\n"


def normalise_file(source: BinaryIO, target: BinaryIO) -> list[dict]:
    """Inflates ``source`` once and writes every record as its own member; returns the index, in file order."""
    index, at = [], 0
    with gzip.GzipFile(fileobj=source) as inflated, io.BufferedReader(inflated, 1 << 20) as stream:
        while (found := read_record(stream)) is not None:
            headers, _, raw = found
            member = gzip.compress(raw, 6, mtime=0)
            target.write(member)
            index.append({"offset": at, "length": len(member), "type": headers["warc-type"], "id": headers.get("warc-record-id"), "digest": headers.get("warc-payload-digest")})
            at += len(member)
    return index


def _page(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", text or "")
    return int(m[1]) if m else None


def parse(member: bytes) -> dict:
    """The page of one member: payload (None for a revisit), its size and digest, type and reference."""
    headers, block, _ = read_record(io.BytesIO(zlib.decompress(member, 31)))
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    size = int(re.search(rb"(?mi)^content-length:\s*([0-9]+)", head)[1]) if revisit else len(payload)
    digest = headers["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload)
    if not revisit and digest != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"the payload of {headers.get('warc-record-id')} does not match its digest")
    return {
        "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to")),
    }


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least ``min_bytes`` all but the least page_id refer to it.

    Payloads are equal when their SHA-256 is. Only digests are grouped; groups of one are
    left out, and the rest meets the pages from a written table, so that a group's many
    pages can be split at runtime, or the table broadcast if its size allows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.sha2("payload", 256))
    keys = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = written(keys.filter("n > 1").select("key", "first"), "warc_repeated")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return rows.join(repeated, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_monolithic(rows: DataFrame, home: str) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) as whole-file gzip streams; returns the file names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(home)
        names, out, stream, size = [], None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for r in batch.slice(at, SLICE_ROWS).to_pylist():
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        stream = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
                        out, size = gzip.GzipFile(fileobj=stream, mode="wb", compresslevel=1, mtime=0), 0
                    data = record(r["page_id"], r["url"], r["payload"], r["refers_to"])
                    out.write(data)
                    size += len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        stream.close()
                        out = None
        if out is not None:
            out.close()
            stream.close()
        if names:
            yield pa.RecordBatch.from_pylist([{"name": n} for n in names], schema=_FILES)

    _make(rows, home)
    return written(rows.mapInArrow(run, "name string"), "warc_files")


def _make(df: DataFrame, home: str) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)


def _dealt(files: DataFrame) -> DataFrame:
    """A file a task: ranges of as many names as there are files; hashes would put several names into one."""
    return files.repartitionByRange(max(1, files.count()), "name")


def normalise(files: DataFrame, source: str, home: str) -> DataFrame:
    """Rewrites the named files of ``source`` into ``home``, with ``<name>.idx`` beside each; returns the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (_, old) = FileSystem.from_uri(home), FileSystem.from_uri(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(f"{old}/{name}", compression=None) as a, fs.open_output_stream(f"{root}/{new}", compression=None) as b:
                    index = normalise_file(a, b)
                with fs.open_output_stream(f"{root}/{new}.idx", compression=None) as f:
                    f.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pylist([{"name": new}], schema=_FILES)

    _make(files, home)
    return written(_dealt(files).mapInArrow(run, "name string"), "warc_members")


def read_archives(files: DataFrame, home: str) -> DataFrame:
    """Every record of the named files, each by its offset: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(home)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(f"{root}/{name}") as f:
                    for at in range(0, len(index), SLICE_ROWS):
                        pages = []
                        for x in index[at : at + SLICE_ROWS]:
                            f.seek(x["offset"])
                            pages.append(parse(f.read(x["length"])))
                        yield pa.RecordBatch.from_pylist(pages, schema=schema)

    ddl = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _dealt(files).mapInArrow(run, ddl)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages, normalises the files and reads them back: a row per page, as ``read_archives``.

    A null html is an empty payload; a null url is left out and a null page_id comes back
    null (it is never referred to unless its whole group has no id, then all are responses).
    Rows with the least id of a group are responses, several if the id is repeated. An empty
    table gives no files and no rows; further columns of ``pages`` are ignored.
    """
    home = f"{shared_dir(pages.sparkSession)}/flightlake/warc-{uuid.uuid4().hex}"
    files = write_monolithic(with_references(pages, min_bytes), f"{home}/monolithic")
    return read_archives(normalise(files, f"{home}/monolithic", f"{home}/members"), f"{home}/members")
