"""WARC archives: one gzip member per record, and a sequential reader.

write() gives each page a record. Of pages with equal payloads of at least `least_bytes`, the one with
the smallest page_id is a response and the others are revisits that refer to it; smaller payloads are
always responses. Only digests are grouped (partial aggregation); the pages then join the repeated
digests, a join whose hot keys Spark can split. Every task streams its records into one archive.

read() decompresses members one after another with an incremental zlib object, frames records by
Content-Length and checks block and payload digests; memory is bounded by the largest record.

Null html is an empty payload; a null page_id stays null and never is the referred one; null URLs are
left out. Rows repeated with the smallest page_id are all responses, and so no tie is left to decide. An empty table
gives no archives. Other columns than key, url and html are left out, whatever their names. The page_id stands in a
header of this module's own (X-Page-ID), so records of other archives have a null one. A page of n bytes takes about
three times as much in a task that writes or reads it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, new_file, shared_dir, store

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ROWS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, as a gzip member of its own."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    head = END.join([VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None)])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + END + END + block + END + END) + packer.flush()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives under folder; their manifest: archive, n_records."""
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= least_bytes)
    repeated = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = materialise(repeated, "warc-repeated")
    rows = rows.join(repeated, "payload_digest", "left").withColumn("refers_to", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with new_file(archive) as out:
            for batch in chain([first], batches):
                for page_id, page_url, text, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                    out.write(record(page_id, page_url, text.encode("utf-8", "surrogatepass"), digest, refers_to, date))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n], pa.int64())], ["archive", "n_records"])

    return materialise(rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "archive string, n_records bigint"), "warc-manifest")


def members(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one by one."""
    raw = b""
    while True:
        raw = raw or stream.read(size)
        if not raw:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not raw and not (raw := stream.read(size)):
                raise ValueError("the archive ends inside a record")
            parts.append(unpacker.decompress(raw))
            raw = unpacker.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, framed by Content-Length; digests are checked."""
    head, gap, rest = member.partition(END + END)
    version, *lines = head.split(END)
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    length = int(headers["content-length"])
    block = rest[:length]
    if rest[length:] != END + END:
        raise ValueError("Content-Length doesn't frame the block")
    wanted = headers.get("warc-block-digest")
    if wanted and wanted != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block digest differs")
    return headers, block


def describe(headers: dict[str, str], block: bytes) -> dict:
    number = lambda k: int(headers[k]) if k in headers else None
    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
    if kind == "response":
        payload = block.partition(END + END)[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != number("x-payload-length"):
            raise ValueError("the payload digest differs")
    return {"page_id": number("x-page-id"), "url": headers.get("warc-target-uri"), "payload_bytes": number("x-payload-length"), "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id")}


def read(manifest: DataFrame, contents: bool = False) -> DataFrame:
    """A row per record of the archives in column `archive`; contents=True adds the payload (null for revisits)."""
    schema = ROWS + ", payload binary" * contents
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, path = store(archive)
                with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    rows, size = [], 0
                    for member in members(stream):
                        headers, block = parse(member)
                        rows.append(describe(headers, block))
                        if contents:
                            rows[-1]["payload"] = block.partition(END + END)[2] if rows[-1]["record_type"] == "response" else None
                        size += 200 + len(block) * contents
                        if size > 1 << 22:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    yield _batch(rows, names)

    n = manifest.count()
    return manifest.select("archive").repartitionByRange(max(n, 1), "archive").mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    return read(write(pages, shared_dir(pages.sparkSession, "warc")))
