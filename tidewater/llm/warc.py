"""WARC archives as a PySpark data source.

Records are written as gzip members of their own, each with the `sl` extra field that tells
its two lengths, so a reader steps over a member without inflating it. Archives of others
need not have it: their members are inflated in a stream, and what is not wanted is passed
over piece by piece. Reading plans partitions of whole files, takes over predicates on
record type and headers, parses a record's headers first, and decodes payloads only of
records that pass.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringStartsWith, WriterCommitMessage

from tidewater.llm.common import materialize, shared_path

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
INPUT = "record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
MANIFEST, OWN = "_MANIFEST-", "tidewater-"
#: Bytes after which a writer begins a new file and to which a reader fills a partition.
FILE_BYTES, PARTITION_BYTES = 128 << 20, 32 << 20
_FIXED = struct.Struct("<4sLBBH2sHLL")  # magic and flags, time, two bytes, extra length, field name and length, two lengths
_HEAD = b"\x1f\x8b\x08\x04"
_FIRST = 1024  # bytes of a member that are inflated to find its headers
_READ, _BATCH = 1 << 16, 4 << 20
_BLANK = re.compile(rb"\r?\n\r?\n")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow reaches; file:/x and file:///x are the same."""
    if not re.match(r"\w+:/", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


#: White space at the ends of a header, and characters of a URL that are written as %XX: all that some reader may take for the end of a line.
_BLANKS, _CONTROLS = " \t\r", re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]")


def member(data: bytes) -> bytes:
    """data as one gzip member with the skip lengths of the WARC annex on compression."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = _FIXED.size + len(body) + 8
    return _FIXED.pack(_HEAD, 0, 0, 255, 12, b"sl", 8, size, len(data)) + body + struct.pack("<LL", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _joined(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + _CONTROLS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _joined([*head, "Content-Type: application/http; msgtype=response"], http + (payload or b"" if kind == "response" else b""))


def info(name: str, date: str) -> bytes:
    """The record that opens a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _joined(head, b"software: tidewater\r\nformat: WARC File Format 1.1\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write files of their own; only those of tasks that ended well get into the commit's manifest.

    Every commit adds a manifest, so an append keeps what is there. Each appears by a rename.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        if overwrite:
            raise ValueError("archives are only appended to; write to a new path instead of overwriting")
        self.path = options["path"]
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        done, out, size, name = [], None, 0, ""
        for b in iterator:
            for row in b.to_pylist():
                if out is None:
                    name, size = f"{OWN}{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member(info(name, self.date)))
                kind = "revisit" if row["refers_to"] is not None else "response"
                data = member(record(kind, row["record_id"], row["target_uri"], self.date, row["payload_digest"], row["payload_bytes"], row["payload"], row["refers_to"]))
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        name = f"{MANIFEST}{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{path}/.{name}") as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())
        store.move(f"{path}/.{name}", f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                store.delete_file(f"{path}/{name}")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class _Stream:
    """Plain bytes of an archive from a place on: those of the file, or those of all its gzip members."""

    def __init__(self, f, at: int, packed: bool):
        self.f, self.packed, self.z, self.rest, self.held = f, packed, None, b"", bytearray()
        f.seek(at)

    def _more(self) -> bool:
        if not self.packed:
            data = self.f.read(_READ)
            self.held += data
            return bool(data)
        if not self.rest:
            self.rest = self.f.read(_READ)
            if not self.rest:
                return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(self.rest, _BATCH)
        self.rest = self.z.unconsumed_tail
        if self.z.eof:
            self.rest, self.z = self.z.unused_data + self.rest, None
        return True

    def until_blank_line(self) -> bytes | None:
        """Headers up to an empty line, without it; None at the end of the archive."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[: len(self.held) - len(self.held.lstrip(b"\r\n"))]
            if (m := _BLANK.search(self.held)) is not None:
                head = bytes(self.held[: m.start()])
                del self.held[: m.end()]
                return head
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends within the headers of a record")
                return None

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        """Step over n bytes and hold none of them; a plain file is not read there."""
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.packed:
                self.f.seek(n, 1)
                return
            if not self._more():
                raise ValueError("an archive ends within a record")
        del self.held[:n]


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines end with CRLF or LF alone, and such that begin with white space go on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        if line[:1] in (" ", "\t"):
            if name:
                out[name] += " " + line.strip(_BLANKS)
        else:
            name, _, value = line.partition(":")
            name = name.strip(_BLANKS).lower()
            out[name] = value.strip(_BLANKS)
    return out


class _Head:
    """What a record's own headers say."""

    def __init__(self, head: bytes):
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {head[:40]!r}")
        f = _fields(head)
        bare = lambda k: f[k].strip("<>") if k in f else None
        digest = f.get("warc-payload-digest")
        self.block = int(f["content-length"])
        self.http = f.get("content-type", "").lower().startswith("application/http")
        self.row = {
            "record_id": bare("warc-record-id"), "record_type": f.get("warc-type", "").lower(), "target_uri": bare("warc-target-uri"), "warc_date": f.get("warc-date"),
            "refers_to": bare("warc-refers-to"), "payload_digest": digest.removeprefix("sha1:") if digest else None, "payload_bytes": self.block, "payload": None,
        }

    def with_http(self, http: bytes, taken: int) -> None:
        """Take the HTTP headers, of `taken` bytes with their end, off the payload; a revisit tells its length there."""
        if self.row["record_type"] == "revisit":
            told = _fields(http).get("content-length", "")
            self.row["payload_bytes"] = int(told) if told.isdigit() else None
        else:
            self.row["payload_bytes"] = self.block - taken


class WarcReader(DataSourceReader):
    """Options: path; payload=false leaves payloads null; verify=true compares each payload with its SHA-1 digest.

    Reads plain archives and such of gzip members, with skip lengths or without. In a folder
    all files named *.warc and *.warc.gz count, but of those that WarcWriter wrote only what
    a manifest lists. The payload of a record that is no HTTP message is its block.
    """

    #: Columns that are known before a payload is decoded.
    HEADERS = ("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_bytes")

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "false").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        names = {EqualTo: "=", In: "in", IsNotNull: "there", StringContains: "has", StringStartsWith: "starts"}
        for f in filters:
            kind, column = names.get(type(f)), f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if kind and column in self.HEADERS:
                self.tests.append((kind, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = filesystem(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [Files([(path, store.get_file_info(path).size)])]
        inside = [x for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.File]
        files = [(x.path, x.size) for x in inside if x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith((".", "_", OWN))]
        for x in inside:
            if x.base_name.startswith(MANIFEST):
                with store.open_input_stream(x.path) as f:
                    files += [(f"{path}/{name}", n) for name, n in json.loads(f.read())]
        out: list[Files] = []
        size = self.partition_bytes
        for name, n in sorted(files):
            if size >= self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].files.append((name, n))
            size += n
        return out or [Files([])]

    def _wanted(self, row: dict, columns: tuple[str, ...]) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if column in columns and (x is None or not (kind == "there" or kind == "=" and x == value or kind == "in" and x in value or kind == "has" and value in x or kind == "starts" and x.startswith(value))):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        kinds = {c.split()[0]: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")}
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

        for name, _ in partition.files:
            with store.open_input_file(name) as f:
                for row in self._records(f):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= _BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    def _records(self, f) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            first = f.read(_FIRST)
            size = _skip_length(first)
            if size is None:  # no skip lengths: the rest is read as a stream
                yield from self._streamed(_Stream(f, at, first[:2] == b"\x1f\x8b"))
                return
            if (row := self._member(f, first, size)) is not None:
                yield row
            at += size

    def _member(self, f, first: bytes, size: int) -> dict | None:
        """The record of a member with skip lengths: inflated as far as its headers, and further only if it is wanted."""
        z = zlib.decompressobj(-15)
        body = memoryview(first)[_FIXED.size : size - 8]
        got, read = z.decompress(body), _FIXED.size + len(body)

        def until(start: int):
            nonlocal got, read
            while (m := _BLANK.search(got, start)) is None and read < size - 8:
                more = f.read(min(_FIRST, size - 8 - read))
                read += len(more)
                got += z.decompress(more)
            return m

        m = until(0)
        if m is None:
            raise ValueError("a member of an archive holds no record")
        head, at = _Head(got[: m.start()]), m.end()
        if not self._wanted(head.row, _FIRST_HEADERS):
            return None
        if head.http and (h := until(at)) is not None:
            head.with_http(got[at : h.start()], h.end() - at)
            at = h.end()
        if not self._wanted(head.row, ("payload_bytes",)):
            return None
        if head.row["record_type"] != "revisit" and (self.payload or self.verify):
            rest = got[at:] + z.decompress(f.read(size - 8 - read)) + z.flush()
            self._take(head.row, rest[: head.row["payload_bytes"]])
        return head.row

    def _streamed(self, s: _Stream) -> Iterator[dict]:
        while (text := s.until_blank_line()) is not None:
            head = _Head(text)
            if not self._wanted(head.row, _FIRST_HEADERS):
                s.skip(head.block)
                continue
            block = s.read(head.block)
            if head.http and (h := _BLANK.search(block)) is not None:
                head.with_http(block[: h.start()], h.end())
                block = block[h.end() :]
            if not self._wanted(head.row, ("payload_bytes",)):
                continue
            if head.row["record_type"] != "revisit" and (self.payload or self.verify):
                self._take(head.row, block)
            yield head.row

    def _take(self, row: dict, payload: bytes) -> None:
        told = row["payload_digest"]
        if self.verify and (len(payload) != row["payload_bytes"] or told and re.fullmatch("[A-Z2-7]{32}", told) and base32_sha1(payload) != told):
            raise ValueError(f"the payload of {row['record_id']} does not have its digest")
        row["payload"] = payload if self.payload else None


_FIRST_HEADERS = tuple(c for c in WarcReader.HEADERS if c != "payload_bytes")


def _skip_length(first: bytes) -> int | None:
    """The length of a gzip member whose first extra field gives skip lengths, or None."""
    if len(first) < _FIXED.size:
        return None
    magic, _, _, _, extra, field, length, size, _ = _FIXED.unpack_from(first)
    return size if magic == _HEAD and extra == 12 and field == b"sl" and length == 8 and size > _FIXED.size + 8 else None


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The rows to write: equal payloads are kept once, other pages refer to that one.

    Of pages with equal payloads of at least `min_bytes` bytes the smallest id is the
    response. The smallest id of a digest is found by partial sums per task. Only digests of
    several pages are joined back: a small table of them is broadcast below Spark's size
    limit, and beyond it the join is a plain one whose large keys Spark can split.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), html.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    n = F.octet_length("payload").cast("long")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))) & (n >= min_bytes)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return rows.join(materialize(first, "repeated-payloads"), "sha", "left").select(
        urn(F.col("page_id")).alias("record_id"), "target_uri", F.when(again, urn(F.col("first"))).alias("refers_to"),
        _base32("sha").alias("payload_digest"), n.alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"),
    )


def _base32(sha: str):
    """Base 32 of 20 bytes by arithmetic: four groups of 40 bits, eight letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.hex(F.substring(sha, 5 * i + 1, 5)), 16, 10).cast("long") for i in range(4)]
    return F.concat(*(F.substring(F.lit(letters), (F.shiftright(g, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for g in groups for j in range(8)))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    register(pages.sparkSession)
    records(pages, **columns).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives.

    The predicate on the record type is pushed to the reader, which passes over other
    records; payloads are compared with their digests on the way. A null html is an empty payload,
    and empty payloads are equal like others. Rows that repeat the smallest page_id of a
    payload are responses as well; a null page_id counts as larger than any. Extra columns
    are ignored, and an empty table gives archives without records.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, **columns)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS long)")
    return read_archives(spark, path, payload="false", verify="true").where("record_type in ('response', 'revisit')").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
