"""WARC archives: a writer and a sequential reader.

Archives are gzip files with one member per record. The reader inflates a member piece by piece
with zlib, finds the end of each payload by Content-Length, and checks block and payload digests as the bytes
pass. Archives lie in the shared folder (or any folder all executors reach), one file per write task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.llm.common import Kept, cut, ready, scratch

#: Payloads under this many bytes are always stored.
MIN_REVISIT_BYTES = 100
#: A digest held by more than this share of the rows is joined by broadcast; at most 1 / HOT_SHARE digests are.
HOT_SHARE = 1e-3
#: An archive is closed, and the next one begun, beyond this many compressed bytes.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is cut short, badly framed, or whose digest is wrong."""


def _store(path: str):
    """(filesystem or None for local files, path): a folder that every executor reaches."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return None, unquote(at.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _create(path: str):
    where, p = _store(path)
    if where is None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        return open(p, "wb")
    where.create_dir(os.path.dirname(p), recursive=True)
    return where.open_output_stream(p)


def _open(path: str):
    where, p = _store(path)
    return open(p, "rb") if where is None else where.open_input_stream(p, compression=None)


def _move(source: str, target: str) -> None:
    where, s = _store(source)
    t = _store(target)[1]
    os.replace(s, t) if where is None else where.move(s, t)


def _sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(kind: str, rid: str, uri: str, payload: bytes, digest: str, length: int, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member that holds one record. A revisit has an empty block and says what payload it stands for."""
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{rid}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response" if kind == "revisit" else "Content-Type: text/html",
        f"WARC-Block-Digest: {_sha(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    version: str
    headers: dict[str, str]
    offset: int
    length: int = 0  # of the block
    block_sha256: str = ""
    block: bytes | None = None
    problems: list[str] = field(default_factory=list)


class _Member:
    """Inflated bytes of one gzip member after another, never more than a chunk at a time."""

    def __init__(self, raw):
        self.raw, self.pending, self.at = raw, b"", 0

    def begin(self) -> bool:
        """At the start of a member; False at the end of the file."""
        if not self.pending:
            self.pending = self.raw.read(CHUNK)
        self.start, self.z, self.out = self.at, zlib.decompressobj(31), b""
        return bool(self.pending)

    def _fill(self) -> bool:
        while not self.z.eof:
            if not self.pending:
                self.pending = self.raw.read(CHUNK)
                if not self.pending:
                    raise WarcError(f"the member at {self.start} is cut short")
            before = len(self.pending)
            try:
                got = self.z.decompress(self.pending, CHUNK)
            except zlib.error as e:
                raise WarcError(f"the member at {self.start} is not gzip: {e}") from e
            self.pending = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += before - len(self.pending)
            if got:
                self.out += got
                return True
        return False

    def line(self, most: int = 1 << 16) -> bytes:
        while (end := self.out.find(b"\r\n")) < 0:
            if len(self.out) > most or not self._fill():
                raise WarcError(f"a header line of the record at {self.start} has no end")
        found, self.out = self.out[:end], self.out[end + 2 :]
        return found

    def some(self, most: int) -> bytes:
        if not self.out and not self._fill():
            return b""
        found, self.out = self.out[:most], self.out[most:]
        return found


def read_records(raw, keep_block: bool = False, strict: bool = True) -> Iterator[Record]:
    """Records of one archive, in file order, with bounded memory (unless blocks are kept).

    Raises WarcError at a record that is cut short or badly framed. A wrong digest raises too, or is
    listed in ``problems`` when ``strict`` is off. An empty file has no records.
    """
    m = _Member(raw)
    while m.begin():
        version = m.line().decode("ascii", "replace")
        if not version.startswith("WARC/"):
            raise WarcError(f"no WARC version at {m.start}")
        headers: dict[str, str] = {}
        while line := m.line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise WarcError(f"a header without a colon at {m.start}")
            headers[name.strip().lower()] = value.strip()
        found = Record(version, headers, m.start)
        if not headers.get("content-length", "").isdigit():
            raise WarcError(f"no Content-Length at {m.start}")
        rest, sha, kept = int(headers["content-length"]), hashlib.sha256(), io.BytesIO()
        found.length = rest
        while rest:
            part = m.some(rest)
            if not part:
                raise WarcError(f"the block at {m.start} is {rest} bytes short")
            sha.update(part)
            rest -= len(part)
            if keep_block:
                kept.write(part)
        tail = b""
        while part := m.some(CHUNK):
            tail = (tail + part)[:5]
        if tail != b"\r\n\r\n":
            raise WarcError(f"the record at {m.start} does not end where Content-Length says")
        found.block_sha256 = sha.hexdigest()
        found.block = kept.getvalue() if keep_block else None
        checks = ["warc-block-digest"] + ["warc-payload-digest"] * (headers.get("warc-type") == "response" and headers.get("content-type", "").startswith("text/"))
        for name in checks:
            if name in headers and not _same_digest(headers[name], sha.hexdigest()):
                found.problems.append(f"{name} is wrong at {m.start}")
        if strict and found.problems:
            raise WarcError("; ".join(found.problems))
        yield found


def _same_digest(said: str, hexdigest: str) -> bool:
    """sha256 in hex or base32; other algorithms are not judged."""
    kind, _, value = said.partition(":")
    return kind.lower() != "sha256" or value.lower() == hexdigest or value.rstrip("=").upper() == base64.b32encode(bytes.fromhex(hexdigest)).decode().rstrip("=")


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, payload_bytes and refers_to (the page that stores an equal payload, null: this one does)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    large = rows.where((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    firsts = cut(large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    most = pages.count() * HOT_SHARE
    hot = F.broadcast(firsts.where(F.col("n") > most).select("payload_digest", F.col("first").alias("hot_first")))
    rest = firsts.where(F.col("n") <= most).select("payload_digest", "first")
    found = rows.join(hot, "payload_digest", "left")
    settled = found.where("hot_first is not null").withColumn("first", F.col("hot_first"))
    other = found.where("hot_first is null").join(rest, "payload_digest", "left")
    both = settled.drop("hot_first").unionByName(other.drop("hot_first"))
    stored = (F.col("payload_bytes") < MIN_REVISIT_BYTES) | F.col("first").isNull() | F.col("page_id").isNull() | (F.col("first") == F.col("page_id"))
    return both.withColumn("refers_to", F.when(~stored, F.col("first"))).drop("first")


def write_warc(planned: DataFrame, folder: str) -> DataFrame:
    """Write a record for every row of ``plan_records``; returns a row (path, records, bytes) per archive.

    A file gets its final name only when it is complete, under a name of its own attempt, and only
    files of attempts that Spark committed are in the result: a lost executor leaves no half archive in it.
    """

    def write(batches):
        part, n, out, name, size, paths = TaskContext.get().partitionId(), 0, None, "", 0, []
        for b in batches:
            cols = b.to_pydict()
            for i, pid in enumerate(cols["page_id"]):
                if out is None:
                    name = f"{folder}/part-{part:06d}-{len(paths):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = _create(name + ".open"), 0, 0
                uri = (cols["url"][i] or "").translate({10: "%0A", 13: "%0D"})
                refers = cols["refers_to"][i]
                payload = (cols["html"][i] or "").encode("utf-8") if refers is None else b""
                size += out.write(record("response" if refers is None else "revisit", "null" if pid is None else str(pid), uri, payload, cols["payload_digest"][i], cols["payload_bytes"][i], refers)) or 0
                n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    _move(name + ".open", name)
                    paths.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            _move(name + ".open", name)
            paths.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in paths], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return planned.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def read_warc(archives: DataFrame, keep_block: bool = False) -> DataFrame:
    """A row for every record of the archives named in ``archives.path``, each read sequentially in one task."""

    def number(said: str | None) -> int | None:
        value = (said or "").strip("<>").rpartition(":")[2]
        return int(value) if value.lstrip("-").isdigit() else None

    def read(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_bytes", "target_uri", "archive", "offset", "block"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                held = 0
                with _open(path) as raw:
                    for r in read_records(raw, keep_block):
                        h = r.headers
                        rows.append((number(h.get("warc-record-id")), int(h["x-payload-length"]), h.get("warc-payload-digest", "").rpartition(":")[2], h.get("warc-type"), number(h.get("warc-refers-to")), r.length, h.get("warc-target-uri"), path, r.offset, r.block))
                        held += r.length * keep_block
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    files = max(1, archives.count())
    dealt = archives.select("path").repartition(min(files, 10_000))
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, block_bytes long, target_uri string, archive string, offset long, block binary")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC and read the archives back.

    Of records with equal payloads of at least MIN_REVISIT_BYTES bytes, the one with the smallest
    page_id is a response, the others are revisits of it; a repeated row with that same page_id is a
    response as well. Null html is an empty payload, a null url an empty target, a null page_id is
    always a response and comes back as null. An empty table gives an empty result. Further columns are ignored.
    """
    spark = ready(pages.sparkSession)
    archives = Kept(spark, write_warc(plan_records(pages), folder or scratch(spark, "warc")), "archives")
    return read_warc(archives.df)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
