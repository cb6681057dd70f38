"""WARC archives as a PySpark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

The writer puts one gzip member for each record, with its length in the member's
header, into files of bounded size, under names of their own for each task attempt,
and lists the committed files in a manifest; what a lost executor leaves behind
isn't listed and is never read. The reader plans partitions by file: those of the
manifest, or all `.warc` and `.warc.gz` files where there is none. It takes filters
on the record type and on header columns and parses the headers first. A record
that a filter drops, or whose payload isn't asked for (option payload=false), is
passed over by its member's length, without inflating its payload; where a member
doesn't tell its length it is inflated and thrown away.

Archives of other writers: names of header fields may be in any case and their
values folded. A block is read as HTTP if its Content-Type says so; its payload is
then the body, with a chunked body's frames taken off, else the payload is the whole
block. Revisits have no payload; theirs and the payload length are null where
nothing tells them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, Not, WriterCommitMessage

MANIFEST = "_manifest.json"
READ_SCHEMA = "record_type string, record_id string, target_uri string, record_date string, refers_to_id string, payload_digest string, payload_length long, payload binary"
WRITE_COLUMNS = ("record_id", "target_uri", "record_date", "refers_to_id", "payload")
#: Reader columns that a header field alone decides.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "record_date": "warc-date", "refers_to_id": "warc-refers-to", "payload_digest": "warc-payload-digest"}
CHUNK, STEP = 1 << 20, 16 << 10
#: Bytes inflated of a member before its headers have been looked at.
HEAD = 2 << 10
#: A gzip header with the extra field `sl`: lengths of the member and of what it holds.
GZIP = struct.Struct("<4sIBBH2sHII")
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value stands on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record_id: str, uri: str | None, date: str, refers_to: str | None, payload: bytes) -> bytes:
    """A response, or a revisit if it refers to one: a revisit has the HTTP header with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_field(record_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_field(uri)}")
    if refers_to:
        head += [f"WARC-Refers-To: {_field(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member that tells its own length; longer ones than 4 GB tell none."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    length = GZIP.size + len(body) + 8
    if max(length, len(data)) >> 32:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()
    head = GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, length, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Stream:
    """Bytes of a file of gzip members, or of a plain one, read in pieces, with skipping."""

    def __init__(self, raw):
        #: data[at:] are bytes of the file that are not inflated yet, `read` is where they end; buf[got:] is inflated.
        self.raw, self.data, self.at, self.read = raw, b"", 0, 0
        self.buf, self.got, self.z, self.end, self.plain = b"", 0, None, None, None

    def _fill(self) -> bool:
        if self.at == len(self.data):
            self.data, self.at = self.raw.read(CHUNK), 0
            self.read += len(self.data)
        return self.at < len(self.data)

    def _more(self) -> bool:
        while self._fill():
            most = STEP
            if self.z is None or self.z.eof:
                if len(self.data) - self.at < GZIP.size:
                    rest = self.raw.read(CHUNK)
                    self.data, self.at, self.read = self.data[self.at :] + rest, 0, self.read + len(rest)
                if self.plain is None:
                    self.plain = self.data[self.at : self.at + 2] != b"\x1f\x8b"
                if self.plain:
                    out, self.at = self.data[self.at :], len(self.data)
                    self.buf, self.got = self.buf[self.got :] + out, 0
                    return True
                self.z, self.end, most = zlib.decompressobj(31), None, HEAD
                if len(self.data) - self.at >= GZIP.size:
                    head = GZIP.unpack_from(self.data, self.at)
                    if head[0][3] & 4 and head[5:7] == (b"sl", 8):
                        self.end = self.read - len(self.data) + self.at + head[7]
            part = self.data[self.at : self.at + STEP]
            out = self.z.decompress(part, most)
            self.at += len(part) - len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
            if out:
                self.buf, self.got = self.buf[self.got :] + out, 0
                return True
        if self.z is not None and not self.z.eof:
            raise OSError("the archive ends within a record")
        return False

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """The bytes before the next `mark`, which is passed over. None at the end, or if there is none in the next `most` bytes."""
        seen = 0
        while True:
            i = self.buf.find(mark, self.got + max(0, seen - len(mark)))
            if i >= 0 and (most is None or i + len(mark) - self.got <= most):
                out, self.got = self.buf[self.got : i], i + len(mark)
                return out
            seen = len(self.buf) - self.got
            if most is not None and (i >= 0 or seen >= most):
                return None
            if not self._more():
                if self.buf[self.got :].strip():
                    raise OSError("the archive ends within a header")
                return None

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if self.got == len(self.buf) and not self._more():
                raise OSError("the archive ends within a block")
            piece = self.buf[self.got : self.got + n]
            parts.append(piece)
            self.got += len(piece)
            n -= len(piece)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Passes over the n bytes that are left of a record, which is the last of its member if that tells its length."""
        if self.end is not None:
            now = self.read - len(self.data) + self.at
            if self.end > self.read:
                self.raw.seek(self.end)
                self.data, self.at, self.read = b"", 0, self.end
            else:
                self.at += self.end - now
            self.buf, self.got, self.z, self.end = b"", 0, None, None
            return
        while n:
            if self.got == len(self.buf) and not self._more():
                raise OSError("the archive ends within a block")
            step = min(n, len(self.buf) - self.got)
            self.got += step
            n -= step


def _headers(raw: bytes) -> dict[str, str]:
    """Fields by their names in lower case; a line that starts with a blank goes on with the one before."""
    lines = raw.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}


def _unchunked(body: bytes) -> bytes:
    """A chunked body without its frames; one that isn't framed as it says stays as it is."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            n = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or line + 2 + n > len(body):
            return body
        if not n:
            return b"".join(parts)
        parts.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2


def read_records(raw, wanted, payload: bool, verify: bool) -> Iterator[tuple]:
    """The records of a stream as tuples of READ_SCHEMA; `wanted` sees the header alone."""
    s = _Stream(raw)
    while (head := s.until(b"\r\n\r\n")) is not None:
        if not (head := head.lstrip(b"\r\n")):
            continue  # the end of the record before
        h = _headers(head)
        rest = int(h["content-length"])
        if not wanted(h):
            s.skip(rest)
            continue
        revisit, http = h.get("warc-type") == "revisit", {}
        if h.get("content-type", "").lower().startswith("application/http") and (raw_http := s.until(b"\r\n\r\n", rest)) is not None:
            http, rest = _headers(raw_http), rest - len(raw_http) - 4
        digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        body, length = None, rest
        if revisit:
            told = http.get("content-length", "")
            length = int(told) if told.isdecimal() else None
            s.skip(rest)
        elif (chunked := http.get("transfer-encoding", "").lower() == "chunked") or payload or verify:
            body = s.take(rest)
            body = _unchunked(body) if chunked else body
            length = len(body)
            told = http.get("content-length", "")
            if verify and (not chunked and told.isdecimal() and length != int(told) or digest and len(digest) == 32 and sha1_base32(body) != digest.upper()):
                raise ValueError(f"the payload of {h.get('warc-record-id')} doesn't have its header's length and digest")
        else:
            s.skip(rest)
        yield (*(h.get(FIELDS[c]) for c in ("record_type", "record_id", "target_uri", "record_date", "refers_to_id")), digest, length, body if payload else None)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _test(filters) -> callable:
    """A predicate on a parsed header from pushed filters: (field, values, negated)."""

    def wanted(h: dict) -> bool:
        for name, values, negated in filters:
            v = h.get(FIELDS[name])
            if name == "payload_digest" and v is not None:
                v = v.removeprefix("sha1:")
            if v is None or (values is not None and (v in values) == negated):
                return False
        return True

    return wanted


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list[tuple] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            negated = isinstance(f, Not)
            g = f.child if negated else f
            name = g.attribute[0] if isinstance(g, EqualTo | In | IsNotNull) and len(g.attribute) == 1 else None
            if name not in FIELDS:
                yield f
            elif isinstance(g, EqualTo):
                self.filters.append((name, {g.value}, negated))
            elif isinstance(g, In):
                self.filters.append((name, set(g.value), negated))
            elif negated:
                yield f
            else:
                self.filters.append((name, None, False))

    def partitions(self):
        where, root = place(self.path)
        if where.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
            alone = where.get_file_info(root).type == fs.FileType.File
            names = [root] if alone else sorted(x.path for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith((".warc", ".warc.gz")))
            return [_File(x) for x in names] or [_File("")]
        with where.open_input_stream(f"{root}/{MANIFEST}") as f:
            names = json.loads(f.read())
        return [_File(f"{root}/{x}") for x in names] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        where, _ = place(self.path)
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])
        rows, held = [], 0

        def batch():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        with where.open_input_file(partition.path) as raw:
            for r in read_records(raw, _test(self.filters), self.payload, self.verify):
                rows.append(r)
                held += len(r[-1] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("maxFileBytes", 128 << 20))
        self.level = int(options.get("level", 1))

    def write(self, iterator):
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS]
                for row in zip(*columns, strict=True):
                    rid, uri, date, refers, payload = (x.as_py() for x in row)
                    data = gzip_member(encode_record(rid, uri, date, refers, payload or b""), self.level)
                    if out is None or size + len(data) > self.most:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = where.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Files(names)

    def commit(self, messages):
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        if not self.overwrite and where.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with where.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read()) + names
        with where.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        where, root = place(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                where.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row; of equal payloads of at least `least_bytes` the one with the smallest id is the response that the others revisit.

    A null payload counts as an empty one. Rows that repeat the smallest id are
    all responses; a row with a null id revisits, unless all ids of its payload
    are null. Record ids are `urn:page:<id>`. Payloads are shuffled once, by
    digest; equal ones beyond a partition's size are split by Spark's skew join,
    as the side with one row for each digest is small there.
    """
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.select("digest", "id").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    records = rows.join(first, "digest", "left").select(urn("id").alias("record_id"), "target_uri", F.lit(date).alias("record_date"), F.when(refers, urn("first")).alias("refers_to_id"), "payload")
    register(pages.sparkSession)
    records.write.format("warc").mode("overwrite").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()


def page_digests(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive that write_pages made."""
    return archive.select(
        F.substring_index("record_id", ":", -1).try_cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.substring_index("refers_to_id", ":", -1).try_cast("long").alias("refers_to"),
    )
