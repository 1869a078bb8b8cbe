"""WARC records in ZIP packages: a writer, and a reader that works by range reads.

A package holds archives (``*.warc`` or ``*.warc.gz``, records compressed one
by one) and indexes (``*.cdx*``: CDXJ lines of key, timestamp and a JSON object
with offset, length and file name). The reader finds the end record and the
central directory, their ZIP64 forms included, takes the place of the stored
members from the local headers, and reads single records by range; no archive
is extracted. Without an index the archive is read through, a range at a time.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release_shuffles, shared_path, table

#: Payloads from this size on are stored once; bytes of records after which an archive is closed, and of a range.
LEAST_SHARED, ARCHIVE_BYTES, RANGE = 100, 16 << 20, 1 << 20
#: The members of the packages written here, and the time that records get where a table has none.
DATA, INDEX, DATE = "archive/data.warc.gz", "indexes/index.cdxj", "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64, _AT64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


@dataclass(frozen=True)
class Member:
    """``method``: 0 if stored, 8 if deflated; ``size`` as it is in the file."""

    name: str
    start: int
    size: int
    crc: int
    method: int = 0


class RangeFile:
    """Reads by (offset, length) from any file system that pyarrow knows; ``read_bytes`` counts them."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self._file, self.read_bytes = fs.open_input_file(inner), 0
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        self.read_bytes += length
        return self._file.read_at(length, offset)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def directory(file: RangeFile) -> dict[str, Member]:
    """The members of a ZIP or ZIP64 file by name; folders and encrypted members are left out."""
    tail_at = max(0, file.size - 65_557)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(_END)
    if end < 0 or len(tail) - end < 22:
        raise ValueError("not a ZIP file: no end record")
    entries, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if entries == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        if end < 20 or tail[end - 20 : end - 16] != _AT64:
            raise ValueError("ZIP64 locator is missing")
        record = file.read(struct.unpack("<Q", tail[end - 12 : end - 4])[0], 56)
        if record[:4] != _END64:
            raise ValueError("ZIP64 end record is missing")
        entries, size, at = struct.unpack("<QQQ", record[32:56])
    listing, p, members = file.read(at, size), 0, {}
    for _ in range(entries):
        if listing[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack("<HH", listing[p + 8 : p + 12])
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack("<IIIHHH", listing[p + 16 : p + 34])
        local = struct.unpack("<I", listing[p + 42 : p + 46])[0]
        name = listing[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[p + 46 + n_name : p + 46 + n_name + n_extra]
        full, packed, local = _zip64(extra, full, packed, local)
        p += 46 + n_name + n_extra + n_comment
        if flags & 1 or name.endswith("/"):
            continue
        head = file.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        members[name] = Member(name, local + 30 + sum(struct.unpack("<HH", head[26:30])), packed, crc, method)
    return members


def _zip64(extra: bytes, *values: int) -> list[int]:
    """The size, packed size and offset, from the ZIP64 field where the directory says 0xFFFFFFFF."""
    out, p = list(values), 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[p : p + 4])
        if kind == 1:
            q = p + 4
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    out[i] = struct.unpack("<Q", extra[q : q + 8])[0]
                    q += 8
        p += 4 + n
    return out


def record(headers: dict[str, str], payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


class Headers(dict):
    """Names in any case; of a name's repeated lines the last counts."""

    def __init__(self, lines: Iterable[str]):
        super().__init__()
        name = None
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                self[name] += " " + line.strip()  # a folded line
            elif ":" in line:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                self[name] = value.strip()

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def parse_record(data: bytes) -> tuple[Headers, bytes]:
    """Headers and payload of one record; ValueError where it isn't whole. The HTTP headers of a response are no payload."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = Headers(lines[1:])
    length = headers.get("Content-Length") or ""
    if not length.isdigit():
        raise ValueError("the record has no length")
    if len(rest) < int(length):
        raise ValueError("the record is cut off")
    payload = rest[: int(length)]
    if (headers.get("Content-Type") or "").replace(" ", "").startswith("application/http") and b"\r\n\r\n" in payload:
        payload = payload.partition(b"\r\n\r\n")[2]
    return headers, payload


def sort_key(url: str) -> str:
    """The URL with its host's labels turned round, as indexes sort by it; white space is escaped."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        key = f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else url
    except ValueError:
        key = url
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key) or "-"


def package(records: Iterable[tuple[Headers | dict[str, str], bytes]]) -> bytes:
    """A ZIP file with the records (their headers, to index them, and bytes) and their index, both members stored."""
    data, lines = io.BytesIO(), []
    for headers, rec in records:
        start = data.tell()
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        data.write(packer.compress(rec) + packer.flush())
        url = headers.get("WARC-Target-URI") or ""
        stamp = "".join(c for c in headers["WARC-Date"] if c.isdigit())[:14]
        entry = {"url": url, "digest": headers.get("WARC-Payload-Digest"), "length": str(data.tell() - start), "offset": str(start), "filename": DATA.rsplit("/", 1)[1]}
        lines.append(f"{sort_key(url)} {stamp} {json.dumps(entry)}\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as f:
            f.write(data.getbuffer())
        z.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(lines)))
    return out.getvalue()


def _index_lines(file: RangeFile, member: Member) -> Iterator[str]:
    raw = file.read(member.start, member.size)
    if member.method == 8:
        raw = zlib.decompress(raw, -15)
    while raw[:2] == b"\x1f\x8b":  # one or several gzip members
        out = b""
        while raw:
            d = zlib.decompressobj(31)
            out, raw = out + d.decompress(raw), d.unused_data
        raw = out
    yield from raw.decode("utf-8", "replace").splitlines()


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def _walk(file: RangeFile, archive: Member) -> Iterator[bytes]:
    """Records of an archive that no index names, one after the other."""
    at, end = archive.start, archive.start + archive.size
    packed = file.read(at, min(2, archive.size)) == b"\x1f\x8b"
    held, d, out = b"", zlib.decompressobj(31), b""
    while at < end or held:
        if at < end:
            part = file.read(at, min(RANGE, end - at))
            held, at = held + part, at + len(part)
        if packed:
            while held:
                out += d.decompress(held)
                held = d.unused_data if d.eof else b""
                if d.eof:
                    yield out
                    d, out = zlib.decompressobj(31), b""
        else:
            while True:
                head, gap, rest = held.partition(b"\r\n\r\n")
                n = Headers(head.decode("utf-8", "replace").split("\r\n")).get("Content-Length") if gap else None
                whole = len(head) + 8 + int(n) if n is not None and n.isdigit() else None
                if whole is None or len(held) < whole and at < end:
                    break
                yield held[:whole]
                held = held[whole:]
            if at >= end:
                if held.strip():
                    raise ValueError("the last record is cut off")
                held = b""
    if out:
        raise ValueError("the last record is cut off")


def read_archive(path: str) -> Iterator[tuple[Headers, bytes]]:
    """Headers and payload of every record: each one of the indexes by its own range, then all of archives that no index names."""
    file = RangeFile(path)
    members = directory(file)
    archives = {n: m for n, m in members.items() if n.lower().endswith((".warc", ".warc.gz"))}
    for n, m in archives.items():
        if m.method:
            raise ValueError(f"{n} is compressed in the package; only stored archives can be read by range")
    by_base = {n.rsplit("/", 1)[-1]: m for n, m in archives.items()}
    done, seen = set(), set()
    for n, m in members.items():
        if ".cdx" not in n.lower().rsplit("/", 1)[-1]:
            continue
        for line in _index_lines(file, m):
            at = line.find("{")
            if at < 0:
                continue
            entry = json.loads(line[at:])
            base = str(entry.get("filename", "")).rsplit("/", 1)[-1]
            archive = by_base.get(base) or (next(iter(archives.values())) if len(archives) == 1 else None)
            if archive is None:
                raise ValueError(f"{n} names {base or 'no archive'}, which the package doesn't hold")
            place = archive.name, int(entry["offset"])
            done.add(archive.name)
            if place not in seen:
                seen.add(place)
                yield parse_record(_inflate(file.read(archive.start + place[1], int(entry["length"]))))
    for n, m in archives.items():
        if n not in done:
            for raw in _walk(file, m):
                yield parse_record(raw)


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Writes every row as a record and returns ``(path, records)`` of the archives, all of them written.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the row of the least
    (id, URL) holds the payload, null ids last; the others are revisit records.
    Fully repeated rows are told apart by number only. Smaller payloads are
    always written. A null payload is empty, a null URL gives no target. What
    is decided depends on the rows' content alone, so it is the same however
    often and in whatever order they are read. Archives of tasks that were run
    again are left aside: only those which the table names count.
    """
    rows = pages.select(
        F.col(f"`{id}`").cast("string").alias("page"), F.col(f"`{id}`").alias("rank"), F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    same = ["digest", "page", "url"]
    shared = rows.where(F.col("bytes") >= LEAST_SHARED)
    counts = shared.groupBy(*same, "bytes").agg(F.min("rank").alias("rank"), F.count("*").alias("many"))
    mine = F.struct(F.col("page").isNull().alias("no_page"), "rank", F.col("url").isNull().alias("no_url"), "url", "page")
    firsts = materialise(counts.groupBy("digest").agg(F.min(mine).alias("first")).select("digest", F.col("first.page").alias("first"), F.col("first.url").alias("first_url")), "firsts")
    is_first = F.col("page").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    names = ["page", "url", "payload", "bytes", "digest", "revisit", "refers_to"]
    none = F.lit(None).cast("string").alias("refers_to")
    small = rows.where(F.col("bytes") < LEAST_SHARED).select("page", "url", "payload", "bytes", "digest", F.lit(False).alias("revisit"), none)
    on = ["digest", "_p", "_np", "_u", "_nu"]  # null-safe, and the same for grouping and joining, so payloads are dealt out once
    plain = lambda page, url: ("digest", F.coalesce(page, F.lit("")).alias("_p"), F.col(page).isNull().alias("_np"), F.coalesce(url, F.lit("")).alias("_u"), F.col(url).isNull().alias("_nu"))
    held = shared.select(*plain("page", "url"), "payload").groupBy(*on).agg(F.first("payload").alias("payload"))  # a repeated row's payload leaves a task once
    held = held.join(firsts.select(*plain("first", "first_url")), on).select(
        F.when(~F.col("_np"), F.col("_p")).alias("page"), F.when(~F.col("_nu"), F.col("_u")).alias("url"), "payload",
        F.octet_length("payload").cast("long").alias("bytes"), "digest", F.lit(False).alias("revisit"), none,
    )
    rest = counts.join(firsts, "digest").withColumn("many", F.col("many") - F.when(is_first, 1).otherwise(0)).where("many > 0")
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(many - 1) div 65536")))).withColumn(
        "each", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(65536).cast("long"), F.col("many") - F.col("part") * 65536))))
    again = rest.select("page", "url", F.lit(None).cast("binary").alias("payload"), "bytes", "digest", F.lit(True).alias("revisit"), F.col("first").alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[dict[str, str], bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            fs, inner = open_fs(path)
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(inner) as f:
                f.write(package(pending))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(pending)])], ["path", "records"])

        for batch in batches:
            for page, target, payload, n, digest, revisit, refers in zip(*(batch.column(c).to_pylist() for c in names)):
                own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"  # of the one response with this payload
                headers = {
                    "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if revisit or n < LEAST_SHARED else own,
                    "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{digest}",
                }
                if target is not None:
                    headers["WARC-Target-URI"] = target.replace("\r", "%0D").replace("\n", "%0A")
                if page is not None:
                    headers["X-Page-ID"] = json.dumps(page)
                if revisit:
                    headers |= {"WARC-Refers-To": own, "WARC-Profile": REVISIT, "X-Payload-Length": str(n)}
                    if refers is not None:
                        headers["X-Refers-To-Page"] = json.dumps(refers)
                else:
                    headers["Content-Type"] = "text/html; charset=utf-8"
                rec = record(headers, payload or b"")
                pending.append((headers, rec))
                size += len(rec)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    pending, size = [], 0
        if pending:
            yield close()

    roles = small.select(names).unionByName(held.select(names)).unionByName(again.select(names))
    return materialise(roles.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """What the records say: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    A response's size and digest are taken from the payload that was read, and
    the digest is held against the header's; a revisit's are its headers'.
    Packages of other writers have no page ids (null) and may lack digests.
    """
    ddl = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda said: None if said is None else json.loads(said)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for headers, payload in read_archive(path):
                    said, kind, size = headers.get("WARC-Payload-Digest"), headers.get("WARC-Type"), len(payload)
                    if kind == "revisit":
                        size, digest = int(headers.get("X-Payload-Length") or 0), (said or "").removeprefix("sha256:") or None
                    else:
                        digest = hashlib.sha256(payload).hexdigest()
                        if (said or "").startswith("sha256:") and said != f"sha256:{digest}":
                            raise ValueError(f"{path}: the payload of {headers.get('WARC-Record-ID')} isn't what was written")
                    rows.append((page(headers.get("X-Page-ID")), headers.get("WARC-Target-URI"), size, digest, kind, page(headers.get("X-Refers-To-Page"))))
                    if len(rows) == 8_192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    parts = max(1, archives.count())
    read = archives.select("path").repartition(parts, "path").mapInArrow(run, ddl)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    release_shuffles(spark)
    return read_archives(archives).drop("url")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
