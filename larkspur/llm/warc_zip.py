"""WARC in ZIP packages: records written to stored archive members, read back by byte ranges.

A package is a ZIP file with stored members: archive/data.warc.gz, WARC records as one gzip member
each, and indexes/index.cdxj, a line a record: its key, its time, and JSON with url, status, digest,
length, offset and filename. The reader parses the end of the central directory (ZIP64 where it is),
the central directory and the members' local headers itself. It opens every index under indexes/
(.cdxj or .cdx, .gz too) and from them each record of any stored archive/*.warc or *.warc.gz by its
own byte range; nothing is extracted. Payloads are checked against their digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import block_count, drop, file_system, hash_of, lean, materialize, release, put, scratch, text_bytes

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
WHEN = "2024-01-01T00:00:00Z"
#: The fields of a plain index line, where its first line doesn't name them.
CDX = "N b a m s k r M S V g"
#: A digest is frequent if over one in FREQUENT of the rows that repeat have it; there are fewer such digests than that.
FREQUENT = 10_000


class Ranges:
    """Byte ranges of a file in any store pyarrow knows."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, size: int) -> bytes:
        if start < 0 or start + size > self.size:
            raise ValueError("range outside the file")
        return self.file.read_at(size, start)


class Bytes(Ranges):
    def __init__(self, data: bytes):
        self.file, self.size = pa.BufferReader(data), len(data)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def members(f: Ranges) -> dict[str, Member]:
    """The central directory, by name."""
    tail = f.read(max(0, f.size - 65_557), min(f.size, 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = f.size - len(tail) + at
    if (0xFFFF == count or 0xFFFFFFFF in (size, start)) and end >= 20 and (locator := f.read(end - 20, 20))[:4] == b"PK\x06\x07":
        record = f.read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack("<QQQ", record[32:56])
    data, at, out = f.read(start, size), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
        packed, full = struct.unpack("<II", data[at + 20 : at + 28])
        n, extra, comment = struct.unpack("<HHH", data[at + 28 : at + 34])
        (header,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields, x = data[at + 46 + n : at + 46 + n + extra], 0
        while x + 4 <= len(fields):
            tag, length = struct.unpack("<HH", fields[x : x + 4])
            if tag == 1:
                wide = list(struct.unpack(f"<{length // 8}Q", fields[x + 4 : x + 4 + length // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF and wide else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
                header = wide.pop(0) if header == 0xFFFFFFFF and wide else header
            x += 4 + length
        out[name] = Member(name, method, full, packed, header)
        at += 46 + n + extra + comment
    return out


def member_start(f: Ranges, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is not stored")
    head = f.read(m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return m.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, name: str = "") -> bytes:
    """A response or revisit record as one gzip member; a revisit has no payload but its size and digest.

    Without a page_id the record is named by `name` alone.
    """
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    urn = f"urn:page:{page_id}" if page_id is not None else f"urn:unnamed:{name}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {WHEN}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _line(url: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")


def surt(url: str) -> str:
    """An index key: the host's labels in reverse order, then the path, lower case, without spaces."""
    host, _, path = url.partition("://")[2].lower().partition("/")
    return (",".join(reversed(host.split("."))) + ")/" + path).replace(" ", "%20")


def package(records: list[tuple[str, str, bool, bytes]]) -> bytes:
    """A package of records, each with its url, digest and whether it is a revisit; the index is in order of its keys."""
    out, at, lines = io.BytesIO(), 0, []
    stamp = "".join(c for c in WHEN if c.isdigit())
    for url, digest, revisit, data in records:
        mime = "warc/revisit" if revisit else "text/html"
        lines.append(f"{surt(url)} {stamp} " + json.dumps({"url": url, "mime": mime, "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(at), "filename": ARCHIVE.rpartition("/")[2]}))
        at += len(data)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((ARCHIVE, b"".join(r[3] for r in records)), (INDEX, "".join(x + "\n" for x in sorted(lines)).encode())):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str
    kind: str
    digest: str
    payload_bytes: int
    payload: bytes | None
    refers_to: int | None


def _page(urn: str | None) -> int | None:
    """The page of a record's name, if it is named by one."""
    found = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(found) if found.lstrip("-").isdigit() else None


def read_record(data: bytes) -> Record:
    """One record, as a gzip member or plain; a response's payload must have its digest."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return Record(_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, size, payload if kind == "response" else None, _page(fields.get("WARC-Refers-To")))


def index_lines(name: str, data: bytes) -> Iterator[tuple[str, int, int, str | None]]:
    """(archive file, offset, length, digest) of the records that an index lists."""
    text = (zlib.decompress(data, 31) if name.endswith(".gz") else data).decode()
    letters = CDX.split()
    for line in text.splitlines():
        if not line.strip() or line.startswith("!"):
            continue
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif "{" in line and "cdxj" in name:
            x = json.loads(line[line.index("{") :])
            yield x["filename"], int(x["offset"]), int(x["length"]), x.get("digest")
        else:
            x = dict(zip(letters, line.split(" "), strict=True))
            yield x["g"], int(x["V"]), int(x["S"]), x.get("k")


def read_package(f: Ranges) -> Iterator[Record]:
    """The records by the indexes, one range each, in the order of the archives. An index's digests must be the records'."""
    found = members(f)
    wanted: set[tuple[str, int, int, str | None]] = set()
    for name, m in found.items():
        if name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            wanted.update(index_lines(name, f.read(member_start(f, m), m.size)))
    starts: dict[str, int] = {}
    for file, offset, length, digest in sorted(wanted, key=lambda x: x[:3]):
        name = file if file in found else f"archive/{file}"
        if name not in found or not name.removesuffix(".gz").endswith(".warc"):
            raise ValueError(f"no archive {file}")
        if offset < 0 or offset + length > found[name].size:
            raise ValueError("record outside the archive")
        if name not in starts:
            starts[name] = member_start(f, found[name])
        r = read_record(f.read(starts[name] + offset, length))
        if digest not in (None, "-") and digest.removeprefix("sha1:") != r.digest:
            raise ValueError("index and record differ in their digests")
        yield r


def _revisits(ids: DataFrame, again: DataFrame, most: float) -> DataFrame:
    """(at, page, sha1, last) of the pages that revisit another; digests of over `most` rows are broadcast."""
    frequent, other = F.broadcast(again.filter(F.col("n") > most)), again.filter(F.col("n") <= most)
    same = F.col("sha1") == F.col("same")
    found = ids.join(frequent, same)
    if other.take(1):
        found = found.unionByName(ids.join(F.broadcast(frequent.select("same")), same, "left_anti").join(other, same))
    return found.filter("page is null or page < last").select(F.col("part").alias("at"), "page", "sha1", "last").distinct()


def write_packages(pages: DataFrame, folder: str | None = None, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", part_bytes: int = 8 << 20) -> DataFrame:
    """Write the packages to the folder and return (part, path, records) of each.

    A null html is an empty payload. Of payloads of `least` bytes or more that are equal by SHA-1
    the record with the largest page_id is the response, and rows that repeat it are responses too;
    the others revisit it. A row with a null page_id gets a name of its own: it revisits the largest
    page_id of its payload, or is a response where there is none. An empty table gives no package.
    Other columns are ignored. Packages are dealt by a hash of page, url and payload, so neither a
    repeated nor a null page_id fills one, but whole copies of a row do share it.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    n_parts = block_count(text_bytes(pages, html), part_bytes)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    part = F.pmod(F.xxhash64(*(hash_of(c) for c in ("page_id", "url", "digest"))), F.lit(n_parts)).cast("int").alias("part")
    ids = rows.filter(F.octet_length("html") >= least).select(F.col("page_id").alias("page"), F.col("digest").alias("sha1"), part)
    ids, at_ids = materialize(ids, "digests")
    again = ids.groupBy("sha1").agg(F.max("page").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null")
    again, at_again = materialize(again.select(F.col("sha1").alias("same"), "last", "n"), "repeats")
    # Only ids and digests meet by digest; payloads are shuffled once, to their package. A frequent digest
    # doesn't go to one task: those few are sent to all of them.
    revisits = _revisits(ids, again, (again.agg(F.sum("n")).first()[0] or 0) / FREQUENT)

    def write(key: tuple[pa.Scalar, ...], t: pa.Table, revisits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "path": pa.array([], pa.string()), "records": pa.array([], pa.int64())})
        refers = {(p, d): r for p, d, r in zip(*(revisits.column(n).to_pylist() for n in ("page", "sha1", "last")), strict=True)}
        t = t.sort_by([("page_id", "ascending"), ("url", "ascending"), ("digest", "ascending")])
        records = []
        for i, (p, u, d, h) in enumerate(zip(*(t.column(n) for n in ("page_id", "url", "digest", "html")), strict=True)):
            page, digest = p.as_py(), d.as_py()
            to = refers.get((page, digest))
            records.append((_line(u.as_py()), base32_sha1(digest), to is not None, record(page, u.as_py(), base32_sha1(digest), h.as_py().encode(), to, f"{key[0].as_py()}-{i}")))
        path = f"{folder}/part-{key[0].as_py():06d}.wacz"
        put(path, package(records))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "path": pa.array([path]), "records": pa.array([len(records)], pa.int64())})

    payloads = rows.select(part, "page_id", "url", "digest", "html").repartition(n_parts, "part")
    written = payloads.groupBy("part").cogroup(revisits.repartition(n_parts, "at").groupBy("at")).applyInArrow(lean(write), "part int, path string, records long")
    out = materialize(written, "packages")[0]
    drop(pages.sparkSession, at_ids, at_again)
    return out


def read_packages(written: DataFrame, spread: int | None = None) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, html) of all records; html is null for revisits.

    A record without a page has a null page_id. No packages give an empty table.
    """

    def read(batches):
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                for r in read_package(Ranges(path)):
                    rows.append((r.page_id, r.url, r.kind, r.digest, r.payload_bytes, r.refers_to, None if r.payload is None else r.payload.decode()))
                    if len(rows) == 500:
                        yield pa.record_batch({n: pa.array([x[i] for x in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
                        rows = []
                yield pa.record_batch({n: pa.array([x[i] for x in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
        release()

    spread = spread or written.sparkSession.sparkContext.defaultParallelism * 4
    return written.repartition(spread, "part").mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string")


def op10(pages: DataFrame) -> DataFrame:
    """What `read_packages` finds of each row of pages after `write_packages`; odd rows are as there."""
    return read_packages(write_packages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same. Base 32 takes five bits of the SHA-1 at a time.
OP10_SQL = """
WITH rows AS (
    SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS sha FROM pages
), last AS (
    SELECT sha, max(page_id) AS last FROM rows GROUP BY sha
)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(rows.sha || '0', 5 * i // 4 + 1, 3))::BIGINT >> (12 - 5 - 5 * i % 4)) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN last.last IS NULL OR page_id = last.last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS NULL OR page_id < last.last THEN last.last END AS refers_to
FROM rows JOIN last ON rows.sha = last.sha
"""
