"""WARC archives as a Spark data source: read with pushed-down filters, write."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from cohortkit.llm.text import salt, whole

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
# Columns that are headers as they stand, and so can be tested before the block is read.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
}
MANIFEST = "_files.json"
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
READ = 1 << 20
HEAD = 2048
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


# --- files ------------------------------------------------------------------


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system a URI or a path names: local, HDFS or an object store."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


def _archives(path: str) -> list[tuple[str, int]]:
    """Archive files of a folder with their sizes: those of its manifest, if it has one."""
    store, folder = _store(path)
    info = store.get_file_info(folder)
    if info.type == pafs.FileType.File:
        return [(folder, info.size)]
    manifest = f"{folder}/{MANIFEST}"
    found = store.get_file_info(pafs.FileSelector(folder, recursive=True))
    if any(x.path == manifest for x in found):
        with store.open_input_stream(manifest) as f:
            names = set(json.loads(f.read()))
        found = [x for x in found if x.base_name in names]
    return sorted((x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz")))


class _Window:
    """Reads at any place of a file through one buffer."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, READ))
        return self.data[at - self.at : at - self.at + n]


# --- records ----------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items()]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + _END + block + _END


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field ``sl`` has its lengths, so that readers can skip it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 24 + len(body) + 8
    extra = struct.pack("<HccHII", 12, b"s", b"l", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    if max(size, len(raw)) >= 1 << 32:  # the field holds 32 bits
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + _tail(raw)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + _tail(raw)


def _tail(raw: bytes) -> bytes:
    return struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _page_record(row: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers only."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    size = row["payload_bytes"] if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}"
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": row.get("date") or DATE,
        "WARC-Target-URI": quote(row["target_uri"] or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "Content-Type": "application/http;msgtype=response",
    }
    if revisit:
        headers |= {"WARC-Refers-To": f"<{row['refers_to']}>", "WARC-Profile": REVISIT}
    return record(headers, http.encode() + _END + (b"" if revisit else payload))


def _parse(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on the last."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(file, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and the block if asked for, of the records that are wanted.

    ``wanted`` sees a record's headers before any more of it is read, and says
    None (leave it out), False (headers only) or True (block too). What is not
    needed is skipped by its length: that of the gzip member, where it says
    so, or that of the block, where the file is not compressed. Else it is
    inflated piece by piece and dropped.
    """
    window, at = _Window(file), 0
    while at < window.size:
        compressed = window.read(at, min(2, window.size)) == b"\x1f\x8b"
        headers, block, at = (_gzip_record if compressed else _plain_record)(window, at, wanted)
        if headers:
            yield headers, block


def _gzip_record(window: _Window, at: int, wanted):
    start = window.read(at, 24)
    says = len(start) == 24 and start[3] == 4 and start[12:14] == b"sl"
    length = struct.unpack("<I", start[16:20])[0] if says else 0
    inflate, read, head = zlib.decompressobj(31), at, b""
    while _END not in head and not inflate.eof and read < window.size:
        piece = window.read(read, min(HEAD, window.size - read))
        read += len(piece)
        head += inflate.decompress(piece)
    head, _, begun = head.partition(_END)
    headers = _parse(head)
    need = wanted(headers)
    if not need and length:
        return (None if need is None else headers), None, at + length
    parts = [begun]
    while not inflate.eof and read < window.size:
        piece = window.read(read, min(READ, window.size - read))
        read += len(piece)
        more = inflate.decompress(piece)
        if need:
            parts.append(more)
    if not inflate.eof:
        raise ValueError("the archive ends inside a record")
    block = b"".join(parts)[: int(headers["content-length"])] if need else None
    return (None if need is None else headers), block, read - len(inflate.unused_data)


def _plain_record(window: _Window, at: int, wanted):
    head, size = b"", HEAD
    while _END not in head and len(head) < window.size - at:
        head = window.read(at, min(size, window.size - at))
        size *= 2
    head = head.partition(_END)[0]
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _parse(head)
    begin, length = at + len(head) + 4, int(headers["content-length"])
    need = wanted(headers)
    block = window.read(begin, length) if need else None
    return (None if need is None else headers), block, begin + length + 4


# --- data source ------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes tests of header columns: equal, one of, begins with, not null."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "begins", IsNotNull: "there"}
        for f in filters:
            column = f.attribute[0] if type(f) in kinds and len(f.attribute) == 1 else None
            if column in HEADERS:
                self.tests.append((kinds[type(f)], column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files together up to ``FILE_BYTES``; a larger one alone."""
        groups: list[list[str]] = []
        room = 0
        for name, size in _archives(self.path):
            if not groups or size > room:
                groups.append([])
                room = FILE_BYTES
            groups[-1].append(name)
            room -= size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, size = [], 0
        for name in partition.files:
            with store.open_input_file(name) as file:
                for headers, block in records(file, self._wanted):
                    rows.append(self._row(headers, block))
                    size += 200 + len(block or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _wanted(self, headers: dict[str, str]) -> bool | None:
        for kind, column, value in self.tests:
            has = _header(headers, column)
            passes = has is not None and {
                "is": lambda: has == value,  # noqa: B023
                "in": lambda: has in value,  # noqa: B023
                "begins": lambda: has.startswith(value),  # noqa: B023
                "there": lambda: True,
            }[kind]()
            if not passes:
                return None
        return not {"payload", "payload_bytes", "payload_digest"}.isdisjoint(self.names)

    def _row(self, headers: dict[str, str], block: bytes | None) -> dict:
        row = {c: _header(headers, c) for c in HEADERS}
        if block is None:
            return row
        said = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http, _, payload = block.partition(_END)
        if not headers.get("content-type", "").startswith("application/http"):
            http, payload = b"", block
        if row["record_type"] == "revisit":
            size = _parse(http).get("content-length")
            return row | {"payload_bytes": size and int(size), "payload_digest": said, "payload": None}
        found = digest(payload)
        if said not in (None, found):
            raise ValueError(f"{row['record_id']}: the payload does not have its digest")
        return row | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload}

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        arrays = [pa.array([r.get(c) for r in rows], types.get(c, pa.string())) for c in self.names]
        return pa.RecordBatch.from_arrays(arrays, self.names)


def _header(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column].lower())
    return value.removeprefix("<").removesuffix(">") if value is not None else None


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Files of this attempt, under names of its own; only a commit makes them count."""
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                    out.write(member(_info(names[-1])))
                out.write(member(_page_record(batch.slice(k, 1).to_pylist()[0])))
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        names = sorted(n for m in messages if m for n in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        for name in (n for m in messages if m for n in m.files):
            store.delete_file(f"{folder}/{name}")


def _info(name: str) -> bytes:
    headers = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": f"<urn:file:{name}>",
        "WARC-Date": DATE,
        "WARC-Filename": name,
        "Content-Type": "application/warc-fields",
    }
    return record(headers, b"format: WARC File Format 1.1\r\n")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``.

    Reading: one row per record, with the columns of ``SCHEMA`` or those of
    them that the reader is given as schema; without payload columns no block
    is read. Filters on header columns reach the files where
    ``spark.sql.python.filterPushdown.enabled`` is set. A response's bytes and
    digest are those of its payload, and a digest that doesn't fit its header
    is an error; those of a revisit are as its headers say.

    Writing: columns ``record_id``, ``record_type``, ``target_uri``,
    ``payload``, ``payload_bytes``, ``payload_digest``, ``refers_to``; one gzip
    member per record, files of about ``file_bytes``. The path is a new
    folder, a URI of any store pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of a folder of archives, or of one; only the named columns."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns is not None:
        kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write_warc(records_: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    records_.sparkSession.dataSource.register(WarcSource)
    records_.write.format("warc").option("file_bytes", file_bytes).mode("append").save(path)


# --- pages ------------------------------------------------------------------

SALTS = 64


def page_records(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least: int = 0,
) -> DataFrame:
    """A record per page: of equal payloads the largest id is the response, others revisit it.

    Payloads are UTF-8, a null one empty; those of fewer than ``least`` bytes
    are all responses. Equal means equal SHA-1 and length. Rows that repeat
    the response's id as well are responses too; a null id is lower than any
    other, and pages with one are told apart by nothing. No rows give no
    rows; other columns are not read.

    Groups are summed up per task before their shuffle, and their members meet
    them by hash and a salt of the id, so a page that a third of all rows
    repeat is dealt out.
    """
    payload = whole(pages[payload_column]).cast("binary")
    rows = pages.select(
        pages[id_column].alias("id"),
        pages[url_column].alias("target_uri"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.unhex(F.sha1(payload)).alias("sha1"),
        salt(pages[id_column], SALTS).alias("salt"),
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("salt"))
    first = rows.groupBy("sha1", "payload_bytes").agg(
        F.max("id").alias("first"), F.bit_or(bit).alias("salts")
    )
    dealt = first.select(
        "sha1",
        "payload_bytes",
        "first",
        F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1
            )
        ).alias("salt"),
    )
    revisits = (F.col("payload_bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.join(dealt, ["sha1", "payload_bytes", "salt"]).select(
        urn("id").alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(~revisits, F.col("payload")).alias("payload"),
        "payload_bytes",
        base32("sha1").alias("payload_digest"),
        F.when(revisits, urn("first")).alias("refers_to"),
    )


def base32(sha1: str):
    """Base32 of 20 bytes: each 5 hexadecimal digits are 4 letters."""
    digits = F.hex(sha1)
    letters = []
    for k in range(8):
        number = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), place, F.lit(1)))
    return F.concat(*letters)
