"""WARC archives: a writer with revisit records and a sequential reader.

`plan` decides natively which row answers and which rows only revisit it: one partial aggregation
by payload digest and a join that AQE can split, whatever the number of copies. `write` turns every
record into a gzip member of its own; a task rolls its files at `roll_bytes` and reports those it
finished. File names are unique to the attempt and the report is checkpointed, so a lost executor
or a second attempt leaves at most files that nobody reads. `read` walks the reported files in
order: chunks go through an incremental zlib stream, a record is framed by its Content-Length, its
gzip member must end with it, and block and payload digests are verified.

Files are opened through pyarrow.fs by the URI of the folder (file, hdfs, s3, gs), so the folder has
to be one that all executors reach; the query takes the one named in spark.checkpoint.dir. A task
holds one record at a time besides the chunk.

Defined results: a null payload is empty; a null URL gives a record without target; control
characters in a URL are percent-encoded; a null id is read back as null; rows with equal ids are
records of their own, and all rows with the largest id of a payload answer; other columns are not
archived; an empty table gives an empty result; a damaged or truncated file raises an error that
names it and the offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import settle, slices, table
from lociframe.session import checkpoint_root

CHUNK = 1 << 16
LEAST_BYTES = 1000
# fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-row:"


def plan(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """id, url, payload, digest and refers_to: the id of the row that answers for an equal payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = rows.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = rows.where(F.octet_length("payload") >= least)
    heads = long.groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(heads, "digest", "left")
    refers = F.when(F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head")), F.col("head"))
    return marked.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def _name(value: object) -> str:
    return f"<{NAME}{'' if value is None else urllib.parse.quote(str(value), safe='')}>"


def _sha1(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def member(kind: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    head = [f"{VERSION}", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def record(ident: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str, level: int) -> bytes:
    fields = [("WARC-Record-ID", _name(ident)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", _sha1(digest)), ("Content-Type", "application/http;msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        return member("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))], block, level)
    return member("response", fields, block + payload, level)


def write(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write the planned rows below `folder`; path, records and bytes of every finished file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, done = None, "", [0, 0]

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [done[0]], "bytes": [done[1]]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in slices(batches, "payload"):
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, done = store.open_output_stream(f"{base}/{path}", compression=None), [0, 0]
                    info = member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", path), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                    out.write(info)
                    done[1] = len(info)
                made = record(*row, date, level)
                out.write(made)
                done[0] += 1
                done[1] += len(made)
                if done[1] >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return planned.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


class Damaged(ValueError):
    """A file that breaks the format."""


def records(stream, where: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields (names in lower case) and block of every record of a file, in order."""
    offset, ahead = 0, b""
    while True:
        ahead = ahead or stream.read(CHUNK)
        if not ahead:
            return
        z, text, fields, need, start = zlib.decompressobj(wbits=31), bytearray(), None, None, offset
        try:
            while not z.eof:
                if not ahead:
                    ahead = stream.read(CHUNK)
                    if not ahead:
                        raise Damaged("the file ends inside a record")
                text += z.decompress(ahead)
                offset += len(ahead) - len(z.unused_data)
                ahead = z.unused_data
                if fields is None and (at := text.find(b"\r\n\r\n")) >= 0:
                    first, *lines = bytes(text[:at]).decode("utf-8").split("\r\n")
                    if not first.startswith("WARC/"):
                        raise Damaged("a record does not begin with its version")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
                    need = int(fields["content-length"])
                    del text[: at + 4]
                if need is not None and len(text) > need + 4:
                    raise Damaged("a record is longer than its Content-Length")
            if need is None or len(text) != need + 4 or text[need:] != b"\r\n\r\n":
                raise Damaged("a record does not end where its Content-Length says")
        except (zlib.error, KeyError, ValueError) as error:
            raise Damaged(f"{where}, record at byte {start}: {error}") from error
        yield start, fields, bytes(memoryview(text)[:need])


def _hex(value: str | None) -> str | None:
    return base64.b32decode(value.partition(":")[2]).hex() if value else None


def _ident(value: str | None) -> str | None:
    return urllib.parse.unquote(value.strip("<>").removeprefix(NAME)) or None if value else None


def read(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of the files named in the column `path`, below `folder`; files of one partition in turn.

    id and refers_to come as text. payload_bytes and payload_digest are those of the whole payload,
    for revisits as their headers state them; digest_ok tells whether all stated digests hold.
    """
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for offset, fields, block in records(stream, path):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                        stated = _hex(fields.get("warc-payload-digest"))
                        found = hashlib.sha1(body).hexdigest() if kind == "response" else stated
                        ok = _hex(fields.get("warc-block-digest")) == hashlib.sha1(block).hexdigest() and found == stated and (kind == "revisit" or size == len(body))
                        rows.append((path, offset, _ident(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _ident(fields.get("warc-refers-to")), size, found, ok, body if payload else None))
                        held += len(body) if payload else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path").mapInArrow(run, "path string, offset long, id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    files = settle(write(plan(table(spark, sf_dir, "pages")), folder))
    found = read(files, folder, payload=False)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "digest_ok")


ORACLE_SQL = {"op6_warc": f"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND head <> page_id THEN head END AS refers_to, true AS digest_ok
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)"""}

QUERIES = {"op6_warc": op6_warc}
