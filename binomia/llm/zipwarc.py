"""WARC records in ZIP packages: directories parsed by hand, records read by range, nothing extracted.

A package is a ZIP of stored members: `archive/data.warc.gz` (one gzip member a record),
`indexes/index.cdxj` (a line a record with offset and length in the archive) and `datapackage.json`.
`Package` reads the end record, the ZIP64 end record and extra fields where sizes or offsets overflow,
the central directory and a member's local header through a range function, so a package of any size
is read in pieces: the directory, the index, then a record at a time.

Cases: a null payload is the empty one; payloads under `least` bytes are never revisits; equal payloads go
to the row with the smallest id; rows of a null id are always responses; repeated ids with equal payload are
all responses; a null url is left out of the record; an empty table gives no package; a record whose digest
differs, or a package whose directory is damaged, raises ZipError. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import table_path, written

ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
LEAST = 100
SALT = 16
PACKAGE_BYTES = 4 << 20
_LOCAL = struct.Struct("<IHHHHHIIIHH")
_CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
_END = struct.Struct("<IHHHHIIH")
_END64 = struct.Struct("<IQHHIIQQQQ")
_LOCATOR = struct.Struct("<IIQI")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


class ZipError(ValueError):
    """The package is damaged or of an unknown form."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    local: int


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members. zip64: sizes and offsets go to ZIP64 fields, as in a package beyond 4 GB."""
    out, central = bytearray(), bytearray()
    for name, body in members:
        raw, at, crc, n = name.encode(), len(out), zlib.crc32(body), len(body)
        wide = zip64 or n >= _FULL32 or at >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        n32 = _FULL32 if wide else n
        out += _LOCAL.pack(0x04034B50, 45 if wide else 20, 0x800, 0, 0, 33, crc, n32, n32, len(raw), len(extra)) + raw + extra + body
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += _CENTRAL.pack(0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, n32, n32, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if wide else at) + raw + extra
    at, n, size = len(out), len(members), len(central)
    out += central
    if zip64 or n >= _FULL16 or at >= _FULL32:
        out += _END64.pack(0x06064B50, 44, 45, 45, 0, 0, n, n, size, at) + _LOCATOR.pack(0x07064B50, 0, at + size, 1)
        n, size, at = _FULL16, _FULL32, _FULL32
    return bytes(out + _END.pack(0x06054B50, 0, 0, n, n, size, at, 0))


class Package:
    """A ZIP read by ranges. fetch(start, length) gives bytes of the package of the given size."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int) -> None:
        self.fetch, self.size = fetch, size
        self.members = {m.name: m for m in self._directory()}

    @classmethod
    def of_bytes(cls, body: bytes) -> Package:
        return cls(lambda start, n: body[start : start + n], len(body))

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - _END.size - _FULL16)
        tail = self.fetch(tail_at, self.size - tail_at)
        k = tail.rfind(b"PK\5\6")
        while k >= 0 and (len(tail) - k < _END.size or k + _END.size + _END.unpack_from(tail, k)[7] != len(tail)):
            k = tail.rfind(b"PK\5\6", 0, k)
        if k < 0:
            raise ZipError("no end record")
        _, _, _, _, count, size, at, _ = _END.unpack_from(tail, k)
        if count == _FULL16 or size == _FULL32 or at == _FULL32:
            where = tail_at + k - _LOCATOR.size
            mark, _, end64, _ = _LOCATOR.unpack(self.fetch(where, _LOCATOR.size)) if where >= 0 else (0, 0, 0, 0)
            if mark != 0x07064B50:
                raise ZipError("no ZIP64 locator")
            mark, _, _, _, _, _, _, count, size, at = _END64.unpack(self.fetch(end64, _END64.size))
            if mark != 0x06064B50:
                raise ZipError("no ZIP64 end record")
        body, pos = self.fetch(at, size), 0
        for _ in range(count):
            if len(body) - pos < _CENTRAL.size:
                raise ZipError("the directory is cut short")
            mark, _, _, _, method, _, _, crc, packed, full, n, x, c, _, _, _, local = _CENTRAL.unpack_from(body, pos)
            if mark != 0x02014B50:
                raise ZipError("no directory entry")
            pos += _CENTRAL.size
            name, extra = body[pos : pos + n].decode(), body[pos + n : pos + n + x]
            pos += n + x + c
            e = 0
            while e + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                    full = next(wide) if full == _FULL32 else full
                    packed = next(wide) if packed == _FULL32 else packed
                    local = next(wide) if local == _FULL32 else local
                e += 4 + length
            yield Member(name, method, crc, packed, full, local)

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin; the local header's own name and extra lengths count."""
        m = self.members.get(name)
        if m is None or m.method:
            raise ZipError(f"no stored member {name}")
        head = _LOCAL.unpack(self.fetch(m.local, _LOCAL.size))
        if head[0] != 0x04034B50:
            raise ZipError(f"no local header of {name}")
        return m.local + _LOCAL.size + head[9] + head[10]

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ZipError(f"range beyond {name}")
        return self.fetch(self.start(name) + offset, length)

    def whole(self, name: str) -> bytes:
        m = self.members.get(name) or Member(name, 1, 0, 0, 0, 0)
        body = self.fetch(self.start(name), m.size)
        if zlib.crc32(body) != m.crc:
            raise ZipError(f"checksum of {name}")
        return body


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: a response with the payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; the digest is that of the payload read, and must be the one named."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ZipError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    own = lambda key: int(v) if (v := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != named):
        raise ZipError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    return {"page_id": own("WARC-Record-ID"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": named, "refers_to": own("WARC-Refers-To")}


def build(rows: list[tuple[int | None, str | None, bytes, int, str, int | None]], zip64: bool = False) -> bytes:
    """A package of records."""
    body, lines = bytearray(), []
    for row in rows:
        page_id, url, _, _, digest, refers_to = row
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = deflate.compress(record(*row)) + deflate.flush()
        about = {"url": url, "digest": f"sha256:{digest}", "mime": "text/html" if refers_to is None else "warc/revisit", "offset": len(body), "length": len(packed), "filename": "data.warc.gz"}
        lines.append(f"{quote(url or '-', safe=':/')} 20240101000000 {json.dumps(about)}")
        body += packed
    index = "".join(f"{x}\n" for x in sorted(lines)).encode()
    about = json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": len(body)}, {"path": INDEX, "bytes": len(index)}]})
    return write_zip([(ARCHIVE, bytes(body)), (INDEX, index), (ABOUT, about.encode())], zip64)


def read(package: Package) -> Iterator[dict]:
    """Every record that the index names, each by a range of the archive member."""
    start, limit = package.start(ARCHIVE), package.members[ARCHIVE].size
    for line in package.whole(INDEX).decode().splitlines():
        about = json.loads(line.split(" ", 2)[2])
        if about["offset"] + about["length"] > limit:
            raise ZipError("the index points beyond the archive")
        yield parse(zlib.decompress(package.fetch(start + about["offset"], about["length"]), 31)) | {"offset": about["offset"], "length": about["length"]}


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): rows, with the first row of equal payload where that is another."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    known = rows.select("page_id", "size", "digest").where((F.col("size") >= least) & F.col("page_id").isNotNull())
    copies = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))  # a payload may be that of a third of all rows
    later = salted.join(copies, ["digest", "salt"]).where("page_id <> refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    return rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def filled(batches: Iterator[pa.RecordBatch], package_bytes: int, zip64: bool) -> Iterator[tuple[int, bytes]]:
    """(records, package) of rows in turn, about package_bytes of payload each."""
    rows, held = [], 0
    for b in batches:
        for start in range(0, b.num_rows, 64):
            for row in zip(*(c.to_pylist() for c in b.slice(start, 64).columns), strict=True):
                rows.append(row)
                held += len(row[2] or b"") + 500
                if held >= package_bytes:
                    yield len(rows), build(rows, zip64)
                    rows, held = [], 0
    if rows:
        yield len(rows), build(rows, zip64)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder or file is in, local or not, and its path there."""
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """(records, path, bytes): packages written as files to a folder that all executors share. A task that runs again writes files of other names, and only the last's are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, body in filled(batches, package_bytes, zip64):
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            system, at = file_system(path)
            system.create_dir(at.rsplit("/", 1)[0])
            with system.open_output_stream(at) as out:
                out.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([path]), pa.array([len(body)], pa.int64())], names=["records", "path", "bytes"])

    return records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "records long, path string, bytes long")


READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def read_packages(packages: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """A row a record of package files. Of a file its end, its directory, its index and each record are read by range; it is never held as a whole, whatever its size."""
    schema = READ if with_payload else READ.remove(READ.get_field_index("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = file_system(path)
                with system.open_input_file(at) as held:
                    some = []
                    for row in read(Package(lambda start, n, held=held: held.read_at(n, start), held.size())):
                        some.append({n: row[n] for n in schema.names})
                        if len(some) == 512:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some = []
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema)

    body = ", payload binary" if with_payload else ""
    return packages.select(path_col).mapInArrow(run, f"page_id long, record_type string{body}, payload_bytes long, payload_digest string, refers_to long, offset long, length long")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages written as package files to the shared folder, with ZIP64 directories as large packages have them, and read back from there by ranges."""
    spark = pages.sparkSession
    packages = written(write_packages(mark_revisits(pages, least), table_path(spark, "wacz"), zip64=True), "packages")
    parts = max(spark.sparkContext.defaultParallelism, packages.count() // 8)
    return read_packages(packages.repartition(parts, "path"), with_payload=False)
