"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

A monolithic archive is one gzip stream over all records, which can only be read from its start. The normaliser inflates
such a stream once, writes every record as a gzip member of its own and, beside the archive, an index of the members'
offsets. Files live in the shared folder; a task writes under a name of its own attempt and only names that come back in
its rows count, so a repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, batches, ddl, emit, shared_dir, table

#: Equal payloads from this size on are stored once.
LEAST_BYTES = 1000
#: An archive is closed once it holds so many bytes of records.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that leaves it out; both give the full payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    target = (url or "").replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def take_record(data: bytes | bytearray) -> int:
    """Length of the record that data begins with, or 0 if it isn't whole yet."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return 0
    for line in bytes(data[:end]).split(b"\r\n"):
        if line[:15].lower() == b"content-length:":
            n = end + 4 + int(line[15:]) + 4
            return n if n <= len(data) else 0
    raise ValueError("a record without Content-Length")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip file of one or many members, in one pass; holds a record and a chunk at most."""
    gz, held = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            held += gz.decompress(chunk, CHUNK)
            chunk = gz.unconsumed_tail
            if gz.eof:
                chunk, gz = gz.unused_data, zlib.decompressobj(31)
            while n := take_record(held):
                yield bytes(held[:n])
                del held[:n]
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise(source: Iterator[bytes], sink, index) -> int:
    """Rewrites records as members of their own into sink; writes a JSON line (offset, length, type, page) for each into index."""
    at = 0
    for data in source:
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = gz.compress(data) + gz.flush()
        fields = headers(data)
        index.write(json.dumps({"offset": at, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}).encode() + b"\n")
        sink.write(member)
        at += len(member)
    return at


def headers(data: bytes) -> dict[str, str]:
    lines = data[: data.index(b"\r\n\r\n")].decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a response's are taken from its payload."""
    top = data.index(b"\r\n\r\n") + 4
    fields, block = headers(data), data[top:-4]
    cut = block.index(b"\r\n\r\n") + 4
    number = lambda s: None if s is None or s[10:-1] == "None" else int(s[10:-1])  # noqa: E731  <urn:page:N>
    size, digest = int(headers(block)["content-length"]), fields["warc-payload-digest"][5:]
    if fields["warc-type"] == "response":
        payload = block[cut:]
        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))


def decide(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with digest, refers_to and revisit: of equal payloads from LEAST_BYTES on the largest page_id responds."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("digest", F.sha1("html"))
    large = p.select("page_id", "digest", F.length("html").alias("size")).where(F.col("size") >= LEAST_BYTES)
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("f_digest"), F.col("size").alias("f_size"), "first")
    first = table(first, "first")
    joined = p.join(first, (F.col("digest") == F.col("f_digest")) & (F.length("html") == F.col("f_size")), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"), (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Writes decided pages into monolithic archives under uri; returns (path), a row for each archive."""
    out = batches({"path": pa.string()})

    def run(it: Batches) -> Batches:
        fs, top = store(uri)
        fs.create_dir(top)
        sink, gz, size, paths = None, None, 0, []

        def close():
            sink.write(gz.flush())
            sink.close()

        for b in it:
            for row in b.to_pylist():
                if sink is None:
                    paths.append(f"{uri}/{uuid.uuid4().hex}.warc.gz")
                    sink, gz, size = fs.open_output_stream(f"{top}/{paths[-1].rsplit('/', 1)[1]}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                data = record(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"], row["revisit"])
                sink.write(gz.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        if paths:
            yield emit(out, paths)

    return pages.mapInArrow(run, ddl(out))


def normalise_archives(archives: DataFrame, uri: str) -> DataFrame:
    """(path) of gzip archives -> (path, index): each rewritten with a member for each record, and its offset index."""
    out = batches({"path": pa.string(), "index": pa.string()})

    def run(it: Batches) -> Batches:
        for b in it:
            done = []
            for path in b.column("path").to_pylist():
                (fs, at), (to, top), name = store(path), store(uri), uuid.uuid4().hex
                to.create_dir(top)
                with fs.open_input_stream(at, compression=None) as f, to.open_output_stream(f"{top}/{name}.warc.gz", compression=None) as sink, to.open_output_stream(f"{top}/{name}.idx", compression=None) as index:
                    normalise(inflate(iter(lambda: f.read(CHUNK), b"")), sink, index)
                done.append((f"{uri}/{name}.warc.gz", f"{uri}/{name}.idx"))
            if done:
                yield emit(out, *map(list, zip(*done)))

    return archives.mapInArrow(run, ddl(out))


def read_archives(archives: DataFrame) -> DataFrame:
    """(path, index) -> page_id, payload_bytes, payload_digest, record_type, refers_to: each record by its offset, its member alone."""
    out = batches({"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()})

    def run(it: Batches) -> Batches:
        for b in it:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist()):
                (fs, at), (ifs, iat) = store(path), store(index)
                with ifs.open_input_stream(iat, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(at) as f:
                    for i in range(0, len(entries), 1000):
                        rows = []
                        for e in entries[i : i + 1000]:
                            f.seek(e["offset"])
                            rows.append(read_record(zlib.decompress(f.read(e["length"]), 31)))
                        yield emit(out, *map(list, zip(*rows)))

    return archives.mapInArrow(run, ddl(out))


def archive_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes, normalises and reads back. Returns (records, archives).

    Input: page_id, url, html; other columns are ignored. Null html is an empty payload, a null url an empty target; a null
    page_id stays null. Payloads under LEAST_BYTES are responses all. Rows that repeat are records of their own, and those
    that share the largest page_id of equal payloads all respond. Empty in: no archive, no record.
    """
    uri = f"{shared_dir(pages.sparkSession)}/folioscan/warc-{uuid.uuid4().hex}"
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    uri = uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    raw = table(write_archives(decide(pages), f"{uri}/raw"), "archives")
    done = table(normalise_archives(raw.repartition(max(1, raw.rdd.getNumPartitions())), f"{uri}/members"), "members")
    return read_archives(done), done
