"""WARC archives of web pages: a distributed writer, and a sequential reader with one gzip member for each record.

Records of equal payloads of at least SHORTEST bytes are stored once: the largest page_id has the response, the others
are revisit records that name it. A revisit keeps the HTTP head, whose Content-Length still says how long the payload
was. The reader takes an archive in pieces of PIECE bytes, inflates member after member, frames blocks by their
content length, and holds every response against its digest while it streams; a wrong digest or frame raises WarcError.

Archives lie in the folder that ``spark.checkpoint.dir`` names and are opened through pyarrow's file systems, so
executors see each other's. A task writes to a name of its own and renames it when it is whole; a task that is run
again writes its archive again.

Defined results: a null html is an empty payload; a row without page_id is a response that nothing refers to (so its
equals don't either); rows that repeat a response's page_id and payload are responses too. Control characters and spaces
in a URL are percent-encoded; a null URL is ``urn:none``. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, fresh_path, text_of, written

#: Payloads of so many bytes are stored once.
SHORTEST = 1000
PIECE = 1 << 16
#: Revisits that are sent to the executors, and the share of pages (1 in so many) from which on a digest counts as frequent.
SENT_REVISITS, OFTEN = 300_000, 1000
#: A record's head is no longer.
HEAD = 1 << 20
#: Records in one archive at most.
RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that isn't what it says."""


@dataclass
class Record:
    """Fields of the WARC head (lower-case names), the HTTP head, and the payload with its digest as read."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes
    sha1: str


def _id(page: int | None) -> str:
    return f"<urn:page:{'none:' + uuid4().hex if page is None else page}>"


def _page(record_id: str | None) -> int | None:
    tail = (record_id or "").strip("<>").removeprefix("urn:page:")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record_bytes(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of another page's."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'urn:none' if url is None else quote(url, safe='%/:=&?~#+!$,;@()*[]|^`{}<>' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
        *([] if refers_to is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Inflated:
    """The members of a gzip stream, one at a time."""

    def __init__(self, source: BinaryIO, piece: int = PIECE):
        self.source, self.piece, self.raw = source, piece, b""
        self.member = None
        self.out = bytearray()

    def next_member(self) -> bool:
        """Begins the next member; False at the end of the archive."""
        self.raw = self.raw or self.source.read(self.piece)
        self.member, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def _more(self) -> bool:
        if self.member.eof:
            return False
        self.raw = self.raw or self.source.read(self.piece)
        if not self.raw:
            raise WarcError("the archive ends within a record")
        try:
            self.out += self.member.decompress(self.raw, self.piece)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if seen > HEAD or not self._more():
                raise WarcError("a head without an end")
        head = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.out and not self._more():
                raise WarcError("a record is shorter than its length")
            got = bytes(self.out[:n])
            del self.out[: len(got)]
            n -= len(got)
            if got:
                yield got

    def rest(self) -> bytes:
        while self._more():
            pass
        return bytes(self.out)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(source: BinaryIO, piece: int = PIECE) -> Iterator[Record]:
    """The records of an archive in order; each block is checked against its length and its digests."""
    stream = _Inflated(source, piece)
    while stream.next_member():
        version, fields = _fields(stream.until(b"\r\n\r\n"))
        if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise WarcError("not a WARC record")
        block, own, parts, head = hashlib.sha1(), hashlib.sha1(), [], bytearray()
        http = None
        for got in stream.take(int(fields["content-length"])):
            block.update(got)
            if http is None:
                head += got
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    if len(head) > HEAD:
                        raise WarcError("a head without an end")
                    continue
                http, got = _fields(bytes(head[:end]))[1], bytes(head[end + 4 :])
            own.update(got)
            parts.append(got)
        if stream.rest() != b"\r\n\r\n":
            raise WarcError("a record goes on after its length")
        told = lambda d: "sha1:" + b32encode(d.digest()).decode()
        if fields.get("warc-block-digest", told(block)) != told(block):
            raise WarcError(f"the block of {fields.get('warc-record-id')} isn't that of its digest")
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", told(own)) != told(own):
            raise WarcError(f"the payload of {fields.get('warc-record-id')} isn't that of its digest")
        yield Record(fields, http or {}, b"".join(parts), own.hexdigest())


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out, n, k, names = None, 0, 0, []

        def close() -> None:
            out.close()
            store.move(names[-1][0], names[-1][1])

        for b in batches:
            for page, url, html, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or n >= RECORDS:
                    if out is not None:
                        close()
                    name = f"{root}/{part:06d}-{k:05d}.warc.gz"
                    names.append((f"{name}.{uuid4().hex}", name))
                    out, n, k = store.open_output_stream(names[-1][0], compression=None), 0, k + 1
                out.write(record_bytes(page, url, html.encode(), to))
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name.rpartition('/')[2]}" for _, name in names]}, pa.schema([("archive", pa.string())]))

    return run


def write_archives(pages: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Writes all pages; archive, a row for each file."""
    spark = pages.sparkSession
    bound_batches(spark)
    html = text_of("html")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    again = _revisits(p.select("page_id", "n", "digest"), shortest)
    n = again.count()
    # Only revisits have a row, and a row takes about 100 bytes; beyond the bound pages meet theirs by a shuffle.
    both = p.join(F.broadcast(again) if n <= SENT_REVISITS else again, (p["page_id"] == again["again"]) & (p["digest"] == again["d"]), "left")
    archives = written(both.select("page_id", "url", "html", F.col("first").alias("refers_to")).mapInArrow(_writer(fresh_path(spark, "warc")), "archive string"), "archives")
    forget(again)
    return archives


def _revisits(ids: DataFrame, shortest: int) -> DataFrame:
    """again, d, first: the page and digest of each revisit, and the page it refers to; written.

    Only ids and digests are shuffled. A digest that more than one in OFTEN pages has is one of fewer than OFTEN, so these
    are sent to all and their pages stay where they are; no other has more pages than that in its task."""
    ids = written(ids.where(F.col("n") >= shortest).select("page_id", "digest"), "digests")
    first = ids.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
    first = written(first.select(F.col("digest").alias("d"), "first", "copies"), "repeated")
    hot = F.col("copies") > F.lit(ids.count() // OFTEN)
    often, rarely = first.where(hot).drop("copies"), first.where(~hot).drop("copies")
    mine = ids["digest"] == F.col("d")
    found = ids.join(F.broadcast(often), mine).union(ids.join(rarely, mine))
    again = written(found.where("page_id <> first").select(F.col("page_id").alias("again"), "d", "first").distinct(), "revisits")
    forget(ids, first)
    return again


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _READ.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for r in records(source):
                        digest = b32_to_hex(r.fields["warc-payload-digest"])
                        rows.append((_page(r.fields.get("warc-record-id")), int(r.http.get("content-length", len(r.payload))), digest, r.fields["warc-type"], _page(r.fields.get("warc-refers-to")), r.fields.get("warc-target-uri"), r.payload if payloads else None))
                        held += len(r.payload) if payloads else 100
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return run


def b32_to_hex(digest: str) -> str:
    return b32decode(digest.partition(":")[2]).hex()


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (of a revisit empty; null unless asked for)."""
    n = max(1, archives.count())
    return archives.select("archive").repartition(min(n, 10_000), "archive").mapInArrow(_read(payloads), _READ)
