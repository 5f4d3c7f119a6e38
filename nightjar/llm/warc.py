"""WARC archives (operator 11): one gzip member per record, read back sequentially.

**Writing.** Each task streams its pages into ``.warc.gz`` files of the shared folder, a record
a page and a gzip member a record; a file is closed once it holds ``FILE_BYTES``. Of pages with
equal payloads (by SHA-1 and length) the one with the largest key is a ``response`` with the
payload, the others are ``revisit`` records that refer to it: Spark finds the payloads that
occur more than once, and only those are joined back, by broadcast while their table is small,
else by a join whose hot keys Spark splits. A file's name holds its task attempt, and the
manifest, a Parquet table that Spark commits, names the files of the attempts that counted;
what a lost executor left behind is named by none and never read.

**Reading.** A task streams a file through zlib in pieces of ``PIECE`` bytes and frames records
by their ``Content-Length``, so it holds one piece, or one record where the payload is asked
for. A record has to end where its member ends. Each block and payload is hashed on the way
and compared with the record's digests; the member's own checksum is zlib's.

Defined results: null html counts as an empty payload; empty payloads are equal to each other;
a null url has no ``WARC-Target-URI`` and reads as null, control characters and spaces of a
url are percent-encoded and stay so; null keys are written as such, and refer to the largest
key of their payload if there is one; rows that repeat key and payload are alike, so with the
largest key all of them are responses; payloads under ``least`` bytes are always responses; texts
of any length are one record; an empty table writes no file and reads as an empty table. A
damaged file raises ``ValueError`` with the file and the record's number. Extra columns are
not stored.
"""
from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import common

FILE_BYTES = 1 << 30        # compressed bytes after which a task opens another file
PIECE = 1 << 16             # bytes read, and bytes decompressed, at a time
HEAD_BYTES = 1 << 20        # a record's header is no longer
LEVEL = 6
MANIFEST = "file string, records long, bytes long"
FIELDS = "record_type string, key long, url string, payload_bytes long, payload_digest string, refers_to long, " \
         "file string, record long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def open_file(uri: str, how: str):
    """A stream of a file on any store that Arrow knows; plain paths and ``file:`` are local."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))
    if how == "r":
        return store.open_input_stream(path, compression=None)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + sha1(block)), ("Content-Length", str(len(block)))]
    out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return b"".join((out.compress(text.encode()), out.compress(block), out.compress(b"\r\n\r\n"), out.flush()))


def record_id(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def page_record(key, url, payload: bytes, refers_to, date: str) -> bytes:
    fields = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        safe = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass"))
        fields.append(("WARC-Target-URI", safe.decode("utf-8", "surrogatepass")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + sha1(payload))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))], http)


def repeats(pages: DataFrame, least: int) -> DataFrame:
    """``(digest, size, keep)`` of the payloads that occur more than once; ``keep`` is the
    largest key. Digests are counted in each task first, so a frequent one costs a row a task."""
    return pages.where(F.col("size") >= least).groupBy("digest", "size") \
        .agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keep IS NOT NULL") \
        .select("digest", "size", "keep")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
          date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages; gives the manifest ``(file, records, bytes)``, read back from the folder."""
    spark = pages.sparkSession
    date = date or f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}"
    payload = common.text_of(html).cast("binary")
    hashed = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                          payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"),
                          F.octet_length(payload).alias("size"))
    same = common.materialise(repeats(hashed.select("key", "digest", "size"), least), "repeats")
    refers = F.when(F.col("key").isNull() | (F.col("key") < F.col("keep")), F.col("keep"))
    ready = hashed.join(same, ["digest", "size"], "left").select("key", "url", "payload", refers.alias("refers"))

    def run(batches):
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, done, n, size = None, [], 0, 0

        def close():
            nonlocal out
            out.close()
            done.append((out_name, n, size))
            out = None

        try:
            for b in batches:
                for key, url, data, refers in zip(*[b.column(i).to_pylist() for i in range(4)]):
                    if out is None:
                        out_name = f"{name}-{len(done):03d}.warc.gz"
                        out, n = open_file(out_name, "w"), 0
                        info = record("warcinfo", [("WARC-Record-ID", "<urn:file:%s>" % out_name.rsplit("/", 1)[1]),
                                                   ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                                      b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        size = len(info)
                    data = page_record(key, url, data, refers, date)
                    out.write(data)
                    size += len(data)
                    n += 1
                    if size >= file_bytes:
                        close()
            if out is not None:
                close()
        finally:
            if out is not None:             # the task failed; no manifest names the file
                out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    ready.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``file`` of all ``.warc.gz`` files of a folder that has no manifest; none is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder) \
        .select(F.col("path").alias("file"))


class Members:
    """The decompressed bytes of a gzip stream, member by member, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""
        self.zip, self.held = None, b""     # the open member; its bytes that are not taken yet

    def next(self) -> bool:
        """Opens the next member, if there is one."""
        self.rest = self.rest or self.stream.read(PIECE)
        self.zip, self.held = zlib.decompressobj(31), b""
        return bool(self.rest)

    def piece(self) -> bytes:
        """Bytes of the open member; none at its end, where its checksum has been compared."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.zip.eof:
            self.rest = self.rest or self.stream.read(PIECE)
            if not self.rest:
                raise ValueError("the file ends within a record")
            out = self.zip.decompress(self.rest, PIECE)
            self.rest = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if out:
                return out
        return b""

    def head(self) -> list[str]:
        """The lines up to an empty line."""
        data = b""
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = self.piece()
            if not more or len(data) > HEAD_BYTES:
                raise ValueError("a header has no end")
            data += more
        self.held = data[end + 4:] + self.held
        return data[:end].decode("utf-8", "surrogatepass").split("\r\n")

    def body(self, n: int):
        """The next ``n`` bytes, in pieces."""
        while n:
            data = self.piece()
            if not data:
                raise ValueError("a record is shorter than its Content-Length")
            if len(data) > n:
                data, self.held = data[:n], data[n:] + self.held
            n -= len(data)
            yield data

    def end(self) -> None:
        tail = b""
        while (more := self.piece()) and len(tail) <= 4:
            tail += more
        if tail != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its member ends")


def _fields(lines: list[str]) -> dict[str, str]:
    parts = (line.partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in parts}


def _page_of(record_id: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _checked(kind: str, said: str | None, digest) -> str:
    """The digest in base32; it must be the one that the record says, if it says one in SHA-1."""
    real = base64.b32encode(digest.digest()).decode()
    if said and said.lower().startswith("sha1:") and said[5:].upper() != real:
        raise ValueError(f"the {kind} doesn't match its digest")
    return real


def records(stream, payload: bool):
    """``(kind, key, url, bytes, digest, refers_to, payload)`` of each record of a stream."""
    members = Members(stream)
    while members.next():
        lines = members.head()
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = _fields(lines[1:])
        kind, left = head.get("warc-type"), int(head["content-length"])
        block, whole, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        if "application/http" in head.get("content-type", ""):
            # the block is an HTTP message: its header, and the payload unless this is a revisit
            data = b""
            pieces = members.body(left)
            while b"\r\n\r\n" not in data:
                more = next(pieces, b"")
                if not more or len(data) > HEAD_BYTES:
                    raise ValueError("an HTTP header has no end")
                block.update(more)
                data += more
            http, _, first = data.partition(b"\r\n\r\n")
        else:
            pieces, http, first = members.body(left), b"", b""
        for part in _chain(first, pieces, block):
            whole.update(part)
            size += len(part)
            if payload:
                kept.append(part)
        _checked("block", head.get("warc-block-digest"), block)
        members.end()
        if kind == "revisit":
            digest = (head.get("warc-payload-digest") or "sha1:")[5:].upper() or None
            size = int(_fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", 0))
        else:
            digest = _checked("payload", head.get("warc-payload-digest"), whole)
        yield (kind, _page_of(head.get("warc-record-id")), head.get("warc-target-uri"), size, digest,
               _page_of(head.get("warc-refers-to")), b"".join(kept) if payload and kind != "revisit" else None)


def _chain(first: bytes, pieces, block):
    """``first``, then the pieces, which the block's hash takes in as they pass."""
    yield first
    for data in pieces:
        block.update(data)
        yield data


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the archives in the column ``file`` but their ``warcinfo``: ``FIELDS``.
    The payload of a revisit is null (see ``resolve``); all are with ``payload=False``."""
    kinds = [common.arrow_type(f.dataType) for f in _schema()]
    names = [f.name for f in _schema()]

    def run(batches):
        held, size = [], 0
        for b in batches:
            for file in b.column(0).to_pylist():
                n = -1
                with open_file(file, "r") as stream:
                    try:
                        for n, (kind, key, url, length, digest, refers, data) in enumerate(records(stream, payload)):
                            if kind == "warcinfo":
                                continue
                            held.append((kind, key, url, length, digest, refers, file, n, data))
                            size += 1 + len(data or b"") // 4096
                            if size >= 4096:
                                yield _batch(held, kinds, names)
                                held, size = [], 0
                    except (ValueError, KeyError, zlib.error) as e:
                        raise ValueError(f"{file}, record {n + 1}: {e}") from e
        if held:
            yield _batch(held, kinds, names)

    return files.select("file").mapInArrow(run, FIELDS)


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(FIELDS)


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def resolve(found: DataFrame) -> DataFrame:
    """Records with the payload of each revisit taken from the response that it refers to; null
    if none has its key and digest. Equal responses of one key count once."""
    whole = found.where("record_type <> 'revisit'").groupBy(F.col("key").alias("refers_to"), "payload_digest") \
        .agg(F.first("payload").alias("whole"))
    return found.join(whole, ["refers_to", "payload_digest"], "left") \
        .select(*[F.coalesce("payload", "whole").alias(c) if c == "payload" else c for c in found.columns])


def op11_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write(common.table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read(manifest, payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the table: base32 digits are five bits each of the digest.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)),
    'string_agg', '') AS payload_digest FROM h),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM d GROUP BY ALL)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN d.page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id < keep THEN keep END AS refers_to
FROM d JOIN k ON d.payload_digest = k.payload_digest AND d.payload_bytes = k.payload_bytes
"""
