"""WARC archives: a writer that gives each record its own gzip member, and a sequential reader that verifies digests.

Of records with equal payloads of REVISIT_BYTES or more, the one with the smallest page id is a response and the others
are revisits that refer to it and hold no payload; shorter payloads are always responses. Every task writes archives of
its own into the shared folder and reports them only when they are closed; the report is a table in that folder, so an
archive of a task that was lost or ran twice is never read. The reader decompresses member by member with zlib as bytes
come in, frames each record by its Content-Length, and checks block and payload digests; a record that doesn't hold what
it says raises ValueError.

Null html is an empty payload, a null url is left out. Rows that repeat the smallest id of their payload are responses
too; a row without id is a response. An empty table makes no archive and gives no rows; payloads are read whole, however
long, and a task holds one record and a bounded batch of rows. Other columns pass unread. Archives are opened with pyarrow's file systems, so the
shared folder must be a local mount or a store that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_columns, schema_of, shared_path, table

REVISIT_BYTES, SALTS = 100, 64
#: An archive is closed, and another begun, once it has so many bytes; a read takes CHUNK bytes.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 16
#: Tasks that read, at most; rows and payload bytes that a reading task holds.
TASKS, YIELD_ROWS, YIELD_BYTES = 100_000, 1024, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_PAGE}{refers_to}>"), ("WARC-Profile", PROFILE)]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(read, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of each gzip member of a stream; read(n) gives up to n bytes, b"" at the end."""
    left = b""
    while True:
        data = left or read(chunk)
        if not data:
            return
        unpack, parts, left = zlib.decompressobj(31), [], b""
        while True:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                left = unpack.unused_data
                break
            data = read(chunk)
            if not data:
                raise ValueError("the archive ends inside a gzip member")
        yield b"".join(parts)


def headers(data: bytes) -> dict[str, str]:
    """Named fields, with names in lower case; a line that begins with white space goes on the line before."""
    out: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record that a member holds, framed by its Content-Length and verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = headers(head)
    length = int(fields.get("content-length", "-1"))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: its length isn't {length}")
    block = rest[:length]
    verify(fields.get("warc-block-digest"), block, fields)
    return fields, block


def verify(said: str | None, data: bytes, fields: dict[str, str]) -> None:
    if said:
        how, _, digest = said.partition(":")
        if hashlib.new(how.replace("-", ""), data).hexdigest() != digest.lower():
            raise ValueError(f"record {fields.get('warc-record-id')}: digest mismatch")


def page_of(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(_PAGE)
    return int(value) if value.lstrip("-").isdigit() else None


def open_store(uri: str):
    """pyarrow's file system for a folder or file, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and refers_to. Only payload digests that occur more than once are joined, each
    in SALTS copies, so that a payload which a third of all pages share is spread."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(first, ["digest", "salt"], "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for each page; gives (path, records, bytes) of the archives, as a table in the shared folder."""
    folder = shared_path(pages.sparkSession, "warc")

    def make():
        from pyspark import TaskContext

        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        now: dict = {}
        done: list[tuple] = []

        def close():
            if now:
                now["file"].close()
                done.append((f"{folder}/{now['name']}", now["records"], now["bytes"]))
                now.clear()

        def f(page_id, url, html, refers_to):
            for i, u, h, r in zip(page_id, url, html, refers_to, strict=True):
                if not now:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    now.update(name=name, file=store.open_output_stream(f"{base}/{name}"), records=0, bytes=0)
                data = record(i, u, h.encode("utf-8", "surrogatepass"), r)
                now["file"].write(data)
                now["records"] += 1
                now["bytes"] += len(data)
                if now["bytes"] >= archive_bytes:
                    close()

        def last():
            close()
            return [list(map(list, zip(*done, strict=True)))] if done else []

        f.close = last
        return f

    return table(map_columns(with_references(pages), "path string, records long, bytes long", make), "warc-index")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def records(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Fields, HTTP fields and body of each record of an archive, one after the other, verified."""
    store, inner = open_store(path)
    with store.open_input_stream(inner) as stream:
        for member in members(stream.read):
            fields, block = parse(member)
            head, _, body = block.partition(b"\r\n\r\n")
            if fields.get("warc-type") == "response":
                verify(fields.get("warc-payload-digest"), body, fields)
            yield fields, headers(head), body


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row for each record of the archives listed in column path; with payload, the response's html as well.

    Each archive is a task of its own, up to TASKS; rows leave it as they are read, YIELD_ROWS or YIELD_BYTES at a time."""
    ddl = SCHEMA + (", payload binary" if payload else "")
    schema = to_arrow_schema(schema_of(ddl))

    def run(batches):
        rows, held = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for fields, http, body in records(path):
                    kind = fields.get("warc-type")
                    row = (page_of(fields.get("warc-record-id")), int(http.get("content-length", len(body))), fields.get("warc-payload-digest", "").partition(":")[2], kind, page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"))
                    rows.append((*row, body if kind == "response" else None) if payload else row)
                    held += len(body) if payload else 0
                    if len(rows) >= YIELD_ROWS or held >= YIELD_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    tasks = min(TASKS, max(1, archives.count()))
    return archives.select("path").repartition(tasks).mapInArrow(run, schema_of(ddl))


def resolved(read_: DataFrame) -> DataFrame:
    """read()'s rows with the payload of each revisit, taken from the response that it refers to if that has the same digest,
    and `found`, which is false where there is none. Responses that are referred to are copied SALTS times, so that one
    which a third of all rows refer to is spread."""
    salted = read_.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    wanted = read_.where("refers_to IS NOT NULL").select("refers_to", "payload_digest").distinct()
    given = read_.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("_payload")).join(wanted, ["refers_to", "payload_digest"], "left_semi")
    given = given.dropDuplicates(["refers_to", "payload_digest"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = salted.join(given, ["refers_to", "payload_digest", "_salt"], "left")
    return both.select(*(c for c in read_.columns if c != "payload"), F.coalesce("payload", "_payload").alias("payload"), F.coalesce("payload", "_payload").isNotNull().alias("found"))
