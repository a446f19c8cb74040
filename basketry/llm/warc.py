"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans one partition a file (members of a gzip archive can't be found without reading
it), takes filters on the record type and on headers, parses a record's header block first,
and keeps and decodes the payload only of records that pass, and only if the payload is
asked for.  Files may be compressed by record or plain; names of headers may have any case.  Writing makes one archive a task and names the complete ones in a manifest when the
job commits, so that what failed or repeated attempts leave behind is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

MANIFEST = "_manifest.json"
#: Records with shorter payloads are never written as revisits.
LEAST_REVISIT = 100
#: The columns and the header each comes from; payload is the block.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
    "date": "WARC-Date",
    "profile": "WARC-Profile",
}
#: Of a revisit record whose payload is that of another (fixed value).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length string, date string, profile string, payload binary"
CHUNK = 1 << 16


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def record(headers: dict[str, str], payload: bytes, level: int = 4) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode()
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head + payload + b"\r\n\r\n") + squeeze.flush()


class Bytes:
    """The bytes of an archive file, inflated if it is compressed, read piece by piece."""

    def __init__(self, stream):
        self.stream = stream
        self.held = b""
        self.raw = stream.read(CHUNK)
        self.inflate = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Hold another piece; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
            if not self.raw:
                if self.inflate is not None and not self.inflate.eof:
                    raise ValueError("a record is cut short")
                return False
            if self.inflate is None:
                part, self.raw = self.raw, b""
            else:
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                part = self.inflate.decompress(self.raw)
                self.raw = self.inflate.unused_data
            if part:
                self.held += part
                return True

    def block(self) -> bytes | None:
        """The header block that comes next, without the blank line behind it; None at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("a record has no header block")
                return None
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes, if they are to be kept; else they are passed over piece by piece."""
        kept = []
        while n:
            if not self.held and not self.more():
                raise ValueError("a record is cut short")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                kept.append(part)
        return b"".join(kept) if keep else None


def records(stream, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (by lower-case name) and payload of the records that wanted(headers) lets pass.

    A record is inflated as far as its header block; the payload of a record that isn't wanted, or if payloads
    aren't, is passed over without being kept.
    """
    source = Bytes(stream)
    while (head := source.block()) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        passes = wanted(headers)
        payload = source.take(int(headers["content-length"]), passes and with_payload)
        source.take(4, False)
        if passes:
            yield headers, payload


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true") == "true"
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and isinstance(f.value, str):
                self.equal.append((HEADERS[name], (f.value,)))
            elif name in HEADERS and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.equal.append((HEADERS[name], tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.equal.append((HEADERS[name], ()))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, root = _at(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Archive(self.path)]
        manifest = f"{root}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())
        else:
            names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith((".warc.gz", ".warc")))
        return [Archive(f"{self.path.rstrip('/')}/{n}") for n in names]

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        if partition is None:  # no archive at all
            return

        def wanted(h: dict[str, str]) -> bool:
            return all(k.lower() in h and (not values or h[k.lower()] in values) for k, values in self.equal)

        fs, path = _at(partition.path)
        with fs.open_input_stream(path, compression=None) as stream:
            for headers, payload in records(stream, wanted, self.with_payload):
                yield (*(headers.get(h.lower()) for h in HEADERS.values()), payload)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows: Iterator[T.Row]) -> Written:
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for row in rows:
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            got = row.asDict()
            out.write(record({h: got.get(c) for c, h in HEADERS.items()}, bytes(got.get("payload") or b"")))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    """format("warc"): option payload=false leaves payloads out of the read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def record_uri(key: Column) -> Column:
    """The record's id for a key, which may be of any type; that of a null key stands for null."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def key_of(uri: Column, kind: str) -> Column:
    return F.nullif(F.url_decode(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1)), F.lit("")).cast(kind)


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row to archives below path.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, that with the smallest key is the
    response and the others are revisits of it, without payload; shorter payloads are all responses.
    Null bodies are empty payloads; rows of equal key and payload are each written (if the key is
    that of the response, all of them as responses); null keys come last.  Every record has the date given.
    Only digests go through the aggregation that finds the smallest key; payloads are exchanged once,
    in a join that Spark can split where one digest is frequent.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(body), F.lit("")).alias("b"))
    rows = rows.withColumn("d", F.sha2("b", 256)).withColumn("n", F.octet_length("b").cast("long"))
    first = rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("d", "first")
    joined = rows.join(first, "d", "left")
    again = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    out = joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        record_uri(F.col("k")).alias("record_id"),
        F.regexp_replace("u", r"[\r\n]", " ").alias("target_uri"),
        F.concat(F.lit("sha256:"), "d").alias("payload_digest"),
        F.when(again, record_uri(F.col("first"))).alias("refers_to"),
        F.col("n").cast("string").alias("payload_length"),
        F.lit(date).alias("date"),
        F.when(again, SAME_PAYLOAD).alias("profile"),
        F.when(~again, F.col("b").cast("binary")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the payload read; a revisit's are what its headers
    say of the payload that it stands for.
    """
    register(spark)
    found = spark.read.format("warc").load(path)
    held = F.col("record_type") == "response"
    return found.select(
        key_of(F.col("record_id"), key_type).alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length").cast("long")).alias("payload_bytes"),
        F.when(held, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        key_of(F.col("refers_to"), key_type).alias("refers_to"),
    )
