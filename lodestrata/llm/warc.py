"""WARC archives: a writer with revisit records, and a salvage reader (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, partitions, work_folder

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 20
#: The date of records whose page brings none.
DATE = "1970-01-01T00:00:00Z"
#: Bytes of the payloads' digests that repeat, up to which they are broadcast to the pages; more meet them in a join that deals pages by digest.
BROADCAST_BYTES = 32 << 20


def record(kind: str, record_id: str, payload: bytes, headers: dict[str, str]) -> bytes:
    """One WARC/1.1 record, not compressed; the block is an HTTP response, without its body in a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": DATE, **headers, "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    # A line break within a value would begin another header.
    lines = "".join(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class _Bad(Exception):
    pass


@dataclass
class SalvageReader:
    """Records of an archive (gzip members or plain, mixed if need be), and the byte ranges that could not be read, as a stream.

    Every record is checked: framing, lengths, the gzip checksum, block and payload digests.  After a failed check the bytes from its
    start are quarantined up to the next gzip magic or version line at which a whole record passes; reading goes on there.
    `most` bounds a record's size as decoded, so that a damaged length or a bomb costs no more memory.
    """

    read: Callable[[int], bytes]
    most: int = 1 << 30
    _buffer: bytearray = field(default_factory=bytearray)
    _base: int = 0
    _over: bool = field(default=False)

    def _need(self, n: int) -> bool:
        """Have n bytes buffered, if the archive has them."""
        while len(self._buffer) < n and not self._over:
            more = self.read(max(_STEP, n - len(self._buffer)))
            self._over = not more
            self._buffer += more
        return len(self._buffer) >= n

    def _member(self, at: int) -> tuple[bytes, int]:
        z, out, i, size = zlib.decompressobj(31), [], at, 0
        while not z.eof:
            if not self._need(i + 1):
                raise _Bad("truncated member")
            piece = bytes(self._buffer[i : i + _STEP])
            try:
                got = z.decompress(piece, self.most - size + 1)
            except zlib.error as e:
                raise _Bad(f"gzip: {e}") from None
            size += len(got)
            if size > self.most or z.unconsumed_tail:
                raise _Bad("record too large")
            out.append(got)
            i += len(piece) - len(z.unused_data)
        return b"".join(out), i

    def _plain(self, at: int) -> tuple[bytes, int]:
        i = -1
        while i < 0:
            i = self._buffer.find(b"\r\n\r\n", at)
            if i < 0 and (len(self._buffer) - at > 1 << 20 or not self._need(len(self._buffer) + 1)):
                raise _Bad("no end of headers")
        m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", self._buffer[at : i + 2])
        if not m or int(m[1]) > self.most:
            raise _Bad("no valid length")
        end = i + 4 + int(m[1]) + 4
        if not self._need(end):
            raise _Bad("truncated record")
        return bytes(self._buffer[at:end]), end

    @staticmethod
    def _parse(data: bytes, start: int, end: int) -> Record:
        head, found, rest = data.partition(b"\r\n\r\n")
        if not found or not head.startswith(VERSION):
            raise _Bad("no version line")
        headers: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise _Bad("malformed header")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
            raise _Bad("length mismatch")
        block = rest[:-4]
        if (d := headers.get("warc-block-digest", "")) and not _digest_ok(d, block):
            raise _Bad("block digest mismatch")
        http = headers.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if headers.get("warc-type") != "revisit" and (d := headers.get("warc-payload-digest", "")) and not _digest_ok(d, payload):
            raise _Bad("payload digest mismatch")
        return Record(start, end, headers, payload)

    def _at(self, at: int) -> Record:
        self._need(at + 7)
        if self._buffer[at : at + 3] == GZIP:
            data, end = self._member(at)
        elif self._buffer[at : at + 7] == VERSION:
            data, end = self._plain(at)
        else:
            raise _Bad("neither a member nor a version line")
        return self._parse(data, self._base + at, self._base + end)

    def _drop(self, n: int) -> None:
        del self._buffer[:n]
        self._base += n

    def __iter__(self) -> Iterator[Record | Gap]:
        offset = 0  # within the buffer; dropped by steps
        while self._need(offset + 1):
            try:
                got = self._at(offset)
            except _Bad as why:
                begin, got = self._base + offset, None
                reason = str(why)
                offset += 1
                while got is None:
                    places = [i for m in (GZIP, VERSION) if (i := self._buffer.find(m, offset)) >= 0]
                    if not places:
                        keep = max(offset, len(self._buffer) - 6)  # a mark may lie across the end
                        self._drop(keep)
                        offset = 0
                        if not self._need(len(self._buffer) + 1):
                            break
                        continue
                    try:
                        offset = min(places)
                        got = self._at(offset)
                    except _Bad:
                        offset += 1
                yield Gap(begin, got.start if got else self._base + len(self._buffer), reason)
                if got is None:
                    return
            yield got
            offset = got.end - self._base
            if offset > _STEP:
                self._drop(offset)
                offset = 0


def _digest_ok(said: str, data: bytes) -> bool:
    name, _, value = said.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    d = hashlib.new(name.lower(), data).digest()
    return value.lower() == d.hex() or value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=")


def record_id(page, url, digest: str) -> str:
    """The same for the same page, so that a repeated task writes the same archive."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url} {digest}"))


def with_revisits(pages: DataFrame, least: int = 100, payload: str = "html", page_id: str = "page_id", url: str = "url", date: str | None = None) -> DataFrame:
    """(page_id, url, date, body, digest, refers_to, refers_url): the least page id with an equal payload of `least` bytes or more and its URL, null for that page."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    when = F.col(date).cast("timestamp") if date else F.lit(None).cast("timestamp")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), when.alias("date"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    # The least page of each payload that repeats, summed before the shuffle: only ids, URLs and digests are dealt by payload.
    own = F.min(F.struct(F.col("page_id").alias("first"), F.col("url").alias("refers_url")))
    first = rows.filter(F.octet_length("body") >= least).filter("page_id IS NOT NULL").groupBy("digest").agg(own.alias("x"), F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"))
    alone = rows.filter(F.octet_length("body") >= least).filter("page_id IS NULL").select("digest").distinct()
    first = checkpoint(first.join(alone.withColumn("other", F.lit(True)), "digest", "left").filter((F.col("last") > F.col("x.first")) | F.col("other")).select("digest", "x.*"))
    size = first.agg(F.sum(F.lit(96) + F.coalesce(F.octet_length("refers_url"), F.lit(0)))).first()[0] or 0
    both = rows.join(F.broadcast(first) if size <= BROADCAST_BYTES else first, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return both.select("page_id", "url", "date", "body", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("refers_url")).alias("refers_url"))


def write_archives(rows: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Write each partition of with_revisits() as an archive in folder; (path, records, bytes) of each.

    A task writes under a name of its attempt and moves the file into place when whole: a repeated or speculative task replaces it by the same.
    """

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}.warc" + ".gz" * compress
        draft, n, size = f"{base}/.{name}.{context.taskAttemptId()}", 0, 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for page, url, date, body, digest, refers, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "date", "body", "digest", "refers_to", "refers_url"))):
                    headers = {"WARC-Payload-Digest": f"sha256:{digest}"}
                    headers |= {"WARC-Date": date.strftime("%Y-%m-%dT%H:%M:%SZ")} if date is not None else {}
                    headers |= {"WARC-Target-URI": url} if url is not None else {}
                    headers |= {"X-Page-Id": str(page)} if page is not None else {}
                    kind = "response" if refers is None else "revisit"
                    if refers is not None:
                        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{record_id(refers, refers_url, digest)}>", "X-Refers-To-Page-Id": str(refers), "X-Payload-Length": str(len(body))}
                    data = record(kind, record_id(page, url, digest), body, headers)
                    size += out.write(data := gzip_member(data) if compress else data) or len(data)
                    n += 1
        store.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read_archives(paths: DataFrame) -> DataFrame:
    """Every record and quarantined gap of the archives in column path: path, start, end, headers, payload, gap (why; null for records).

    Gaps are logged beside the archive as well: <path>.gaps.jsonl, a line each. Where the table says how many records an archive has (column records)
    and no gap tells where the missing ones were, another number raises.
    """
    counted = "records" in paths.columns
    paths = paths.select("path", F.col("records").cast("long").alias("records") if counted else F.lit(None).cast("long").alias("records"))

    def run(batches):
        from pyspark import TaskContext

        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                store, name = pafs.FileSystem.from_uri(path)
                n, gaps = 0, []
                with store.open_input_stream(name, compression=None) as f:
                    held, size = [], 0
                    for x in SalvageReader(f.read):
                        gap = isinstance(x, Gap)
                        n += not gap
                        if gap:
                            gaps.append(json.dumps({"start": x.start, "end": x.end, "reason": x.reason}) + "\n")
                        held.append((path, x.start, x.end, None if gap else list(x.headers.items()), None if gap else bytes(x.payload), x.reason if gap else None))
                        size += 0 if gap else len(x.payload)
                        if size > 8 << 20 or len(held) >= 5000:
                            yield batch_of(held)
                            held, size = [], 0
                    yield batch_of(held)
                if gaps:
                    draft = f"{name}.gaps.{TaskContext.get().taskAttemptId()}"
                    with store.open_output_stream(draft, compression=None) as log:
                        log.write("".join(gaps).encode())
                    store.move(draft, f"{name}.gaps.jsonl")
                elif records is not None and n != records:
                    raise ValueError(f"{path} has {n} records of {records}")

    kinds = [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("gap", pa.string())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])

    return paths.mapInArrow(run, "path string, start long, end long, headers map<string,string>, payload binary, gap string")


def archive_and_read(pages: DataFrame, least: int = 100, payload: str = "html", page_id: str = "page_id", url: str = "url", date: str | None = None, folder: str | None = None) -> DataFrame:
    """Write a WARC record per page, then read the archives back; a row per record read: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Archives are kept in `folder` (by default a new one in the shared checkpoint folder), with a log of what could not be read. Null payloads are empty, null ids
    and URLs have no header and come back as null (a page without id revisits, but is never referred to); rows of one id with equal payloads are
    each a response if that id is the least. Ids are whole numbers. Without `date` (a column) records carry DATE. No pages: no rows; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or work_folder(spark, "warc")
    folder = folder if re.match(r"\w+:", folder) else f"file://{folder}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    # checkpoint() runs the write once and keeps the manifest: a row for each archive
    written = checkpoint(write_archives(with_revisits(pages, least, payload, page_id, url, date), folder))
    rows = read_archives(written.select("path", "records").repartition(max(partitions(spark), 2 * spark.sparkContext.defaultParallelism)))
    head = lambda name: F.element_at("headers", name)
    # read back: of a revisit, what its headers say of the payload
    revisit = head("warc-type") == "revisit"
    return rows.filter("gap IS NULL").select(
        head("x-page-id").cast("long").alias("page_id"),
        F.when(revisit, head("x-payload-length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(head("warc-payload-digest"), "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        head("warc-type").alias("record_type"),
        head("x-refers-to-page-id").try_cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
