"""WARC: archives written and read as a chunked record table.

A payload travels as rows (record, chunk number, bytes), so no Python worker holds more than one chunk of it: the writer
streams the rows of a record into one gzip member, the reader streams a member back into rows, and both carry the SHA-1
of a payload from chunk to chunk and compare it with the record's header at its last chunk.

Records of equal payloads (SHA-256 and length) of at least `least_bytes`: the one with the smallest page_id is a response,
the others revisit it and have no payload of their own. Owners are found on digests alone (partial minimum, then a join of
rows without payloads, which Spark splits if one payload is hot); the pages themselves are shuffled once, by page_id.

Archives go to the shared folder, one file or more for each task, each attempt under a name of its own; only the names
that successful tasks return are read, so a lost executor leaves nothing wrong behind. The folder may be local to a shared
mount or in any store that pyarrow's file systems open.

Defined cases: null html is an empty payload; a null url is left out, control characters and spaces in one are escaped;
repeated rows with the smallest page_id are all responses; a null page_id never owns a payload unless no other row has it;
an archive that ends within a record, or has another number of records than `write` said, is an error; an empty table gives
an empty result; other columns, whatever their names, are ignored. A payload itself is one value of the JVM's, as the table
read has it; it is cut there into one chunk after another, and no Python worker holds more than one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import _arrow_schema, cut, open_store, shared_dir

CHUNK = 1 << 20
ID = "urn:x-page:"
EMPTY = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def record_table(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, payload_bytes, sha1, refers_to, chunk_no, last, chunk: the chunks of a record adjoin, in order."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload").cast("long")
    meta = rows.select("page_id", size.alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    owners = meta.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("owner"))
    refers = meta.join(owners, ["digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("owner"))).select(F.col("page_id").alias("own"), "digest", F.col("owner").alias("refers_to")).distinct()
    # a page_id may come with several payloads
    joined = rows.join(refers, rows.page_id.eqNullSafe(refers.own) & (F.sha2("payload", 256) == refers.digest), "left")
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    final = F.greatest(F.ceil(F.octet_length(kept) / chunk).cast("int") - 1, F.lit(0))
    parts = joined.select("page_id", "url", size.alias("payload_bytes"), F.sha1("payload").alias("sha1"), "refers_to", kept.alias("kept"), final.alias("final"))
    numbered = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("final"))).alias("chunk_no"))  # numbers first: only one chunk is cut at a time
    return numbered.select("page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no", F.substring("kept", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"), (F.col("chunk_no") == F.col("final")).alias("last"))


def header(page_id: int | None, url: str | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """The record's header and the head of its HTTP block."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}"] if url is not None else []
    lines += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block) + (size if refers_to is None else 0)}"]
    return "\r\n".join([*lines, "", block]).encode()


def write(records: DataFrame, roll_bytes: int = 1 << 30, level: int = 4) -> DataFrame:
    """path, n_records of the archives that the chunks of `record_table` were written to; written once, when called."""
    spark: SparkSession = records.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        name = out = gz = sha = None
        n, at = 0, 0
        for b in batches:
            for r in _rows(b):
                if out is None:
                    name, n, at = f"{uuid.uuid4()}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                if r["chunk_no"] == 0:
                    gz, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(gz.compress(header(r["page_id"], r["url"], r["payload_bytes"], r["sha1"], r["refers_to"])))
                sha.update(r["chunk"])
                out.write(gz.compress(r["chunk"]))
                at += len(r["chunk"])
                if r["last"]:
                    if r["refers_to"] is None and sha.hexdigest() != r["sha1"]:
                        raise ValueError("a payload's chunks do not make its digest")
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    n += 1
                    if at >= roll_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]}, schema=schema)
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]}, schema=schema)

    files = cut(records.mapInArrow(run, "path string, n_records long"))
    return files.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), "n_records")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


@dataclass
class Member:
    """Parses one record out of decompressed pieces: header, HTTP head, then payload chunks of `size` bytes at most."""

    size: int
    held: bytearray = field(default_factory=bytearray)
    warc: dict[str, str] | None = None
    http: dict[str, str] | None = None
    left: int = 0
    number: int = 0
    sha: object = field(default_factory=hashlib.sha1)

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        if self.warc is None and (end := self.held.find(b"\r\n\r\n")) >= 0:
            self.warc = _fields(self.held[:end])
            self.left = int(self.warc["content-length"])
            del self.held[: end + 4]
        if self.warc is not None and self.http is None and (end := self.held.find(b"\r\n\r\n")) >= 0:
            self.http = _fields(self.held[:end])
            self.left -= end + 4
            del self.held[: end + 4]
        while self.http is not None and self.left and len(self.held) >= min(self.left, self.size):
            n = min(self.left, self.size)
            part = bytes(self.held[:n])
            del self.held[:n]
            self.left -= n
            self.sha.update(part)
            yield part


def _fields(head: bytes | bytearray) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    value = (name or "").strip("<>").removeprefix(ID)
    return int(value) if value not in ("", "null") else None


READ = "page_id long, record_type string, refers_to long, url string, chunk_no long, last boolean, chunk binary, payload_bytes long, payload_digest string"


def read(files: DataFrame, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """READ: chunk rows of the records in the archives; payload_bytes and payload_digest stand in a record's last row. Without
    payloads, the last rows alone. A file is read by one task, in pieces of `chunk` bytes."""
    arrow = _arrow_schema(files.sparkSession, READ)

    def members(path: str) -> Iterator[dict]:
        store, at = open_store(path)
        with store.open_input_stream(at, compression=None, buffer_size=chunk) as f:
            gz, member, data, begun = zlib.decompressobj(31), Member(chunk), b"", False
            while True:
                data = data or f.read(chunk)
                if not data:
                    break
                piece, begun = gz.decompress(data, chunk), True
                data = gz.unconsumed_tail
                for part in member.feed(piece):
                    if with_payload and member.left:
                        yield {"chunk": part, "member": member}
                    elif not member.left:
                        yield {"chunk": part, "member": member, "last": True}
                if gz.eof:
                    if member.number == 0 and int(member.http["content-length"]) * (member.warc["warc-type"] == "response") == 0:
                        yield {"chunk": b"", "member": member, "last": True}
                    data, gz, member, begun = gz.unused_data, zlib.decompressobj(31), Member(chunk), False
            if begun:
                raise ValueError(f"{path}: ends within a record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n_records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size, found = [], 0, 0
                for x in members(path):
                    m, last = x["member"], x.get("last", False)
                    kind, digest = m.warc["warc-type"], m.warc["warc-payload-digest"].removeprefix("sha1:")
                    if last and kind == "response" and base64.b32encode(m.sha.digest()).decode() != digest:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append({"page_id": _page(m.warc["warc-record-id"]), "record_type": kind, "refers_to": _page(m.warc.get("warc-refers-to")), "url": m.warc.get("warc-target-uri"), "chunk_no": m.number, "last": last, "chunk": x["chunk"] if with_payload else None, "payload_bytes": int(m.http["content-length"]) if last else None, "payload_digest": digest if last else None})
                    m.number += 1
                    found += last
                    size += len(x["chunk"]) * with_payload
                    if len(rows) >= 1000 or size >= 4 * chunk:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if n_records is not None and found != n_records:
                    raise ValueError(f"{path}: {found} records instead of {n_records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    paths = files.select("path", "n_records" if "n_records" in files.columns else F.lit(None).cast("long").alias("n_records"))
    return paths.repartition(max(1, min(paths.count(), 10_000)), "path").mapInArrow(run, READ)
