"""A WARC source and sink for Spark (format "warc"), and archives with revisit records.

Records are gzip members with the `sl` extra field, which holds the member's compressed length: a reader takes a
record's headers from the first bytes of the member and, unless it wants the payload, seeks to the next one without
inflating the rest. Archives without that field, and archives without compression, are read too.

Options of a reader: `payload` (false: never decode payloads), `header:<Name>` (only records whose header has that
value). Predicates on record_type, record_id, target_uri, refers_to and payload_digest are pushed down where
spark.sql.python.filterPushdown.enabled is set. A partition is a run of files up to `partition_bytes`.

Scale: files are listed on the driver, read and written by tasks through pyarrow's file systems, one record at a
time. A writer's task writes under _temporary; the commit moves its file, so lost or repeated attempts leave nothing.
Duplicates are found by grouped minima of digests and joined back by digest; AQE splits a hot digest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ._shared import Workspace, tune

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, headers map<string,string>, file string, offset long"
#: Header names, and the profile of revisits with an identical payload.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
HEAD = 4096
#: Payloads shorter than this are never revisits.
LEAST = 100


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


def member(record: bytes) -> bytes:
    """One gzip member; its extra field `sl` holds the compressed and the plain length."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body), len(record) & 0xFFFFFFFF) if len(body) < 1 << 32 else b""
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, length: int) -> bytes:
    """A response or revisit record of an HTTP response; a revisit's block ends after the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> dict[str, str] | None:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    out = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip()] = value.strip()
    return out


class Members:
    """The records of an archive as (offset, headers, read), where read() gives the block and isn't called for free."""

    def __init__(self, file) -> None:
        self.file = file
        self.inflated = 0  # bytes that were decoded, for tests

    def __iter__(self) -> Iterator[tuple]:
        size, at = self.file.size(), 0
        while at < size:
            self.file.seek(at)
            start = self.file.read(HEAD)
            if start[:2] == b"\x1f\x8b":
                at = yield from self._gzip(at, start)
            elif not start.strip(b"\r\n"):
                return
            else:
                at = yield from self._plain(at, start)

    def _gzip(self, at: int, start: bytes) -> Iterator[tuple]:
        flags, skip, length = start[3], 10, None
        if flags & 4:
            extra = struct.unpack_from("<H", start, 10)[0]
            fields = start[12 : 12 + extra]
            skip = 12 + extra
            while len(fields) >= 4:
                n = struct.unpack_from("<H", fields, 2)[0]
                if fields[:2] == b"sl" and n == 8:
                    length = struct.unpack_from("<I", fields, 4)[0]
                fields = fields[4 + n :]
        for flag in (8, 16):  # file name, comment
            if flags & flag:
                skip = start.index(b"\0", skip) + 1
        skip += 2 if flags & 2 else 0
        inflate = zlib.decompressobj(-15)
        plain = inflate.decompress(start[skip:], HEAD)
        headers, read = parse_headers(plain), len(start)
        while headers is None:
            more = inflate.unconsumed_tail or self.file.read(HEAD)
            read += 0 if inflate.unconsumed_tail else len(more)
            if not more:
                raise ValueError(f"no end of headers in the record at {at}")
            plain += inflate.decompress(more, HEAD)
            headers = parse_headers(plain)
        self.inflated += len(plain)
        ended: list[int] = []

        def block() -> bytes:
            out, position = [plain], at + read
            self.file.seek(position)
            todo = inflate.unconsumed_tail
            while not inflate.eof:
                if not todo:
                    todo = self.file.read(min(1 << 20, max(HEAD, at + skip + length - position)) if length else 1 << 16)
                    position += len(todo)
                    if not todo:
                        raise ValueError(f"the record at {at} is cut off")
                out.append(inflate.decompress(todo))
                todo = inflate.unconsumed_tail
            ended.append(position - len(inflate.unused_data))
            data = b"".join(out)
            self.inflated += len(data) - len(plain)
            begin = data.index(b"\r\n\r\n") + 4
            return data[begin : begin + int(headers.get("Content-Length", 0))]

        yield at, headers, block
        if length is not None:
            return at + skip + length + 8
        if not ended:
            block()
        return ended[0] + 8

    def _plain(self, at: int, start: bytes) -> Iterator[tuple]:
        lead = len(start) - len(start.lstrip(b"\r\n"))
        data = start
        while (headers := parse_headers(data[lead:])) is None:
            more = self.file.read(HEAD)
            if not more:
                raise ValueError(f"no end of headers in the record at {at}")
            data += more
        begin = at + lead + data[lead:].index(b"\r\n\r\n") + 4
        length = int(headers.get("Content-Length", 0))

        def block() -> bytes:
            self.file.seek(begin)
            self.inflated += length
            return self.file.read(length)

        yield at + lead, headers, block
        return begin + length + 4


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set[str]] = {k[7:].lower(): {v} for k, v in options.items() if k.startswith("header:")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = HEADERS[column].lower()
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (column == "record_type" and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[Files]:
        fs, path = filesystem(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pa.fs.FileType.Directory else [fs.get_file_info(path)]
        files = sorted((f.path, f.size) for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path.removeprefix(path).split("/")))
        out: list[list[str]] = []
        held = self.size
        for name, size in files:
            if held + size > self.size and (held or not out):
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for at, headers, block in Members(file):
                    lower = {k.lower(): v for k, v in headers.items()}
                    if any(lower.get(name) not in values for name, values in self.wanted.items()):
                        continue
                    rows.append(self.row(path, at, headers, lower, block))
                    held += len(rows[-1][6] or b"")
                    if len(rows) >= 500 or held > 16 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def row(self, path: str, at: int, headers: dict, lower: dict, block) -> tuple:
        payload, length = None, None
        if self.payload:
            data = block()
            if lower.get("content-type", "").startswith("application/http"):
                end = data.find(b"\r\n\r\n") + 4
                http = parse_headers(data[:end]) or {}
                length = int(http.get("Content-Length", len(data) - end))
                payload = None if lower.get("warc-type") == "revisit" else data[end:]
            else:
                payload, length = data, len(data)
        return (*(lower.get(HEADERS[c].lower()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")), length, payload, list(headers.items()), path, at)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()]
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "payload", "headers", "file", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class Writer(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, payload, payload_digest, refers_to, payload_length."""

    def __init__(self, options: dict) -> None:
        self.path, self.compressed = options["path"], options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed, None
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{path}/_temporary", recursive=True)
                    out = fs.open_output_stream(f"{path}/_temporary/{name}", compression=None)
                data = record(r["record_type"], r["record_id"], r["target_uri"], r["payload"] or b"", r["payload_digest"], r["refers_to"], r["payload_length"])
                out.write(member(data) if self.compressed else data)
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written]) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{path}/_temporary/{m.name}", f"{path}/{m.name}")
        if fs.get_file_info(f"{path}/_temporary").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary")

    def abort(self, messages: list[Written]) -> None:
        fs, path = filesystem(self.path)
        if fs.get_file_info(f"{path}/_temporary").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """A record for each row of pages(page_id, url, html): of rows with equal payloads of LEAST bytes or more, those with
    the smallest page_id are responses and the others revisits of it. A null html is empty. Rows whose page_id is null
    are responses if no row with a page_id has their payload. Repeated rows are a record each."""
    register(spark)
    tune(spark)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_length"))
    firsts = rows.where(F.col("payload_length") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    out = rows.join(firsts, "payload_digest", "left").select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        "payload_length",
    )
    out.write.format("warc").mode("append").save(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a WARC archive and read back: page_id, payload_bytes, payload_digest, record_type, refers_to for each
    record. A null html is empty; repeated rows are a record each."""
    path = Workspace(spark, "op3").path("archive")
    write_archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    read = spark.read.format("warc").load(path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as bigint)")
    whole = F.col("record_type") == "response"
    return read.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        F.when(~whole, number("refers_to")).alias("refers_to"),
    )


ORACLE = f"""
    with p as (select page_id, coalesce(html, '') as h from pages),
    f as (select *, min(page_id) over (partition by h) as first from p)
    select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest,
        case when strlen(h) >= {LEAST} and page_id <> first then 'revisit' else 'response' end as record_type,
        case when strlen(h) >= {LEAST} and page_id <> first then first end as refers_to
    from f"""
