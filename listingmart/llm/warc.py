"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc").mode("append")``.

Reading. The driver lists the files and gathers them to partitions of about ``partition_bytes``. Equality, membership,
prefix and null tests on the columns that come from record headers are pushed down. A record's header is parsed first;
where it fails them, or where the wanted schema has no payload, the rest of the record is skipped by seeking. Files
ending in .gz are read through a decompressor.

Writing. Every task writes files of about ``file_bytes`` into a folder of its own attempt, and the driver moves those
of the tasks that succeeded; what a lost or repeated attempt left behind never shows. The path may be any that
pyarrow opens (file, hdfs, s3, gs), but must be visible to driver and executors.

A record's block is an HTTP header and the payload. A revisit record has the header alone, with the length of the
payload it stands for.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from listingmart.llm.common import attach, need, scratch, stored

# Columns and the header fields they come from (fixed names of the format).
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", payload_length bigint, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
# Smaller payloads are always written in full.
LEAST_REVISIT = 1000


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(paths)
        self.paths = paths


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("Archives are added to a folder; write with mode('append').")
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        unknown = [c for c in schema.names if c not in FIELDS and c not in ("payload_length", "payload")]
        if unknown:
            raise ValueError(f"No such columns: {', '.join(unknown)}")
        self.columns = list(schema.names)
        self.path = options["path"]
        self.size = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the tests on header columns; Spark applies the others itself."""
        for f in filters:
            known = isinstance(f, EqualTo | In | IsNull | IsNotNull | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in FIELDS
            if known:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        system, path = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        groups: list[list[str]] = []
        held = self.size
        for f in files:
            if held + f.size > self.size and held:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def wanted(self, header: dict[str, str]) -> bool:
        for f in self.tests:
            value = header.get(FIELDS[f.attribute[0]].lower())
            if isinstance(f, IsNull):
                ok = value is None
            elif value is None:
                ok = False
            elif isinstance(f, EqualTo):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value in f.value
            else:
                ok = isinstance(f, IsNotNull) or value.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, held = [], 0
        system, _ = _opened(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                for row in self.records(raw, path.endswith(".gz")):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, raw: pa.NativeFile, packed: bool) -> Iterator[dict]:
        stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 18)
        header_only = {c: FIELDS[c] for c in self.columns if c in FIELDS}
        block_too = "payload" in self.columns or "payload_length" in self.columns
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"Not a WARC record: {line[:80]!r}")
            header = _header(stream)
            left = int(header["content-length"])
            if self.wanted(header):
                row: dict = {c: header.get(name.lower()) for c, name in header_only.items()}
                if block_too:
                    length = None
                    if header.get("content-type", "").lower().startswith("application/http"):
                        before = stream.tell()
                        stream.readline(left)
                        length = _header(stream, left - (stream.tell() - before)).get("content-length", "")
                        left -= stream.tell() - before
                    if "payload_length" in self.columns:
                        row["payload_length"] = int(length) if length and length.isdecimal() else left
                    if "payload" in self.columns:
                        row["payload"] = stream.read(left)
                        left = 0
                yield row
            stream.seek(left + 4, io.SEEK_CUR)


def _header(stream: io.BufferedIOBase, most: int = 1 << 62) -> dict[str, str]:
    """Fields up to the empty line, under their names in lower case; of at most ``most`` bytes. Bytes that are no UTF-8
    count as Latin-1."""
    found = {}
    while most > 0 and (line := stream.readline(min(most, 1 << 30))) not in (b"\r\n", b"\n", b""):
        most -= len(line)
        try:
            text = line.decode()
        except UnicodeDecodeError:
            text = line.decode("latin-1")
        name, _, value = text.partition(":")
        found[name.strip().lower()] = value.strip(" \t\r\n")
    return found


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Takes record_type, record_id, target_uri, refers_to, payload_digest, payload_length and payload (string or binary)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex[:12]
        self.size = int(options.get("file_bytes", 16 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _opened(self.path)
        own = f"{folder}/_{self.job}/{uuid.uuid4().hex}"
        paths: list[str] = []
        out, held = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or held >= self.size:
                    if out is not None:
                        out.close()
                    else:
                        system.create_dir(own)
                    paths.append(f"{own}/{uuid.uuid4().hex}.warc")
                    out, held = system.open_output_stream(paths[-1]), 0
                record = _record(row)
                out.write(record)
                held += len(record)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages: list[Written]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder)
        for k, path in enumerate(p for m in messages if m for p in m.paths):
            system.move(path, f"{folder}/{self.job}-{k:06d}.warc")
        self._forget(system, folder)

    def abort(self, messages: list[Written]) -> None:
        self._forget(*_opened(self.path))

    def _forget(self, system: fs.FileSystem, folder: str) -> None:
        left = f"{folder}/_{self.job}"
        if system.get_file_info(left).type == fs.FileType.Directory:
            system.delete_dir(left)


def _record(row: dict) -> bytes:
    payload = row["payload"]
    raw = b"" if payload is None else payload.encode() if isinstance(payload, str) else payload
    full = row["record_type"] != "revisit"
    length = len(raw) if full else row["payload_length"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (raw if full else b"")
    fields = {FIELDS[c]: row.get(c) for c in ("record_type", "record_id", "target_uri")} | {"WARC-Date": DATE} | {FIELDS[c]: row.get(c) for c in ("payload_digest", "refers_to")}
    if not full:
        fields["WARC-Profile"] = PROFILE
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


ID = "urn:listingmart:page:"


def archive(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as records; a payload seen in full elsewhere becomes a revisit.

    Of equal payloads (by SHA-1) of at least 1000 bytes the row with the largest page_id is the response. Null html is
    an empty payload. Rows that repeat the largest page_id are all responses. A null page_id is larger than none. Line
    ends in an address are percent-encoded; a null address is left out. Other columns are not archived.
    """
    need(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_length", F.octet_length("payload").cast("bigint"))
    long = rows.filter(F.col("payload_length") >= LEAST_REVISIT)
    copies = stored(long.groupBy("payload_digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keep IS NOT NULL").select("payload_digest", "keep"))
    joined = attach(rows, copies, ["payload_digest"], "left", "page_id")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")) & (F.col("payload_length") >= LEAST_REVISIT)
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    records = joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.replace(F.replace(F.trim("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("target_uri"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        F.when(again, name("keep")).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def page_of(column: str) -> Column:
    return F.nullif(F.regexp_extract(column, r":page:([^>]*)>", 1), F.lit(""))


def read_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archived pages, payloads read where they are."""
    full = spark.read.format("warc").schema("record_type string, record_id string, payload binary").load(path).filter(F.col("record_type") == "response")
    again = spark.read.format("warc").schema("record_type string, record_id string, payload_digest string, refers_to string, payload_length bigint").load(path).filter(F.col("record_type") == "revisit")
    one = full.select(page_of("record_id").cast(kind).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    two = again.select(page_of("record_id").cast(kind).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page_of("refers_to").cast(kind).alias("refers_to"))
    return one.unionByName(two)


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    register(spark)
    path = scratch(spark)
    archive(pages, path)
    return read_pages(spark, path, pages.schema["page_id"].dataType.simpleString())
