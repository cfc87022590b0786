"""WARC archives inside ZIP packages: written by tasks, read back by byte ranges.

A package is a ZIP file of stored (not compressed) members: `archive/data.warc.gz`, with one
gzip member per record, and `indexes/index.cdxj`, one line per record with its range. A reader
finds the end record (ZIP64 where there is one), walks the central directory, takes a member's
place from its local header, and reads records straight out of the package; nothing is unpacked.

Payloads that repeat become revisit records that name the first response. Which ones repeat is
found with the Bloom filter of exact deduplication, so only possibly repeated pages shuffle.
A task writes its packages under names of its own and returns them as rows; the stored table of
those rows decides what counts, so a repeated or lost task leaves no half-written archive behind.
Files are opened through `pyarrow.fs`, by the URI of the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, scratch_path, stored
from .exact_dedup import possibly_repeated

#: A payload shorter than this is never worth a revisit record.
LEAST_REVISIT = 100
#: A package is closed when its WARC member has so many bytes, so index and directory stay small.
PACKAGE_BYTES = 256 << 20
#: Records and bytes of one range read, at most (but for a single larger record), and bytes that a reading task takes, about.
RANGE_RECORDS, RANGE_BYTES = 256, 4 << 20
TASK_BYTES = 16 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


# ------------------------------------------------------------------ ZIP reading


def _tail(f, size: int) -> tuple[int, int, int]:
    """(entries, size, offset) of the central directory."""
    n = min(size, 22 + 0xFFFF)
    f.seek(size - n)
    tail = f.read(n)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end record: not a ZIP package")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
        end = size - n + at
        f.seek(end - 20)
        mark, _, place, _ = struct.unpack("<4sIQI", f.read(20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator before the end record")
        f.seek(place)
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, length, offset


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Of an open package: member name to (offset of its bytes, length). Only stored members can be read by range."""
    entries, length, offset = _tail(f, size)
    f.seek(offset)
    directory, at, out = f.read(length), 0, {}
    for _ in range(entries):
        mark, method, packed, plain, n_name, n_extra, n_comment, header = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, at)
        if mark != b"PK\x01\x02":
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                wide, j = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4)), 0
                if plain == 0xFFFFFFFF:
                    plain, j = wide[j], j + 1
                if packed == 0xFFFFFFFF:
                    packed, j = wide[j], j + 1
                if header == 0xFFFFFFFF:
                    header = wide[j]
            k += 4 + n
        if method != 0:
            raise ValueError(f"member {name} is compressed")
        f.seek(header)
        local = f.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name_local, n_extra_local = struct.unpack_from("<HH", local, 26)
        out[name] = (header + 30 + n_name_local + n_extra_local, packed)
        at += 46 + n_name + n_extra + n_comment
    return out


# ------------------------------------------------------------------ WARC records


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8") + block + b"\r\n\r\n") + pack.flush()


def parse_record(body: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one gzip member."""
    plain = zlib.decompress(body, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where the index points")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC record of another length than it states")
    return fields, rest[:n]


def record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{copy}')}>"


class Package:
    """A ZIP package that is being written record by record."""

    def __init__(self, path: str):
        self.path = path
        store, where = fs.FileSystem.from_uri(path)
        store.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(where)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.warc = self.zip.open(WARC_MEMBER, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, url: str, kind: str, body: bytes) -> None:
        self.warc.write(body)
        self.lines.append(f"{url} {DATE} " + json.dumps({"offset": self.at, "length": len(body), "type": kind}))
        self.at += len(body)

    def close(self) -> tuple[str, int, int]:
        self.warc.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as f:
            f.write("".join(x + "\n" for x in sorted(self.lines)).encode("utf-8"))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.at


def _write(folder: str):
    """Of Arrow batches (page_id, url, html, digest, copy, first_id, revisits): packages, one row each."""

    def records(batches) -> Iterator[tuple[str, str, bytes]]:
        for b in batches:
            for page_id, url, html, digest, copy, first_id, revisits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = (html or "").encode("utf-8")
                target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"
                kind = "revisit" if revisits else "response"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
                fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if page_id is not None:
                    fields.append(("X-Page-Id", str(page_id)))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if kind == "revisit":
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_id, digest, 1))]
                    yield target, kind, _record(fields, http)
                else:
                    yield target, kind, _record(fields, http + payload)

    def run(batches):
        package = None
        for url, kind, body in records(batches):
            package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
            package.add(url, kind, body)
            if package.at >= PACKAGE_BYTES:
                yield _row(package.close())
                package = None
        if package:
            yield _row(package.close())

    return run


def _row(found: tuple[str, int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), found, strict=True))])


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into packages in `folder`; a stored table (path, records, bytes) of the packages.

    Of rows with equal payloads of LEAST_REVISIT bytes or more the one with the smallest page_id (then url) is the
    response, null ids last; the others revisit it. Of rows that repeat page_id, url and payload exactly one can be the
    response. Null html counts as empty. Empty table: no packages.
    """
    pages = only(df, page_id=F.col(f"`{id_col}`").cast("long"), url=F.col(f"`{url_col}`").cast("string"), html=F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    long_enough = F.octet_length("html") >= LEAST_REVISIT
    maybe = possibly_repeated(pages.filter(long_enough).select("digest"), "digest", pages.sparkSession)
    tested = pages.withColumn("maybe", long_enough & maybe(F.col("digest")))
    alone = tested.filter(~F.col("maybe")).select("page_id", "url", "html", "digest", F.lit(1).alias("copy"), F.lit(None).cast("long").alias("first_id"), F.lit(False).alias("revisits"))
    # equal rows are counted before the shuffle; a group's first row is joined by its digest alone
    same = stored(tested.filter("maybe").groupBy("digest", "page_id", "url").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n")), "same")
    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    firsts = stored(same.groupBy("digest").agg(F.min(order).alias("first")).withColumn("first_id", F.col("first.page_id")), "firsts")
    decided = same.join(firsts, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    is_first = F.struct(F.col("page_id").isNull(), "page_id", "url").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    decided = decided.withColumn("revisits", ~F.coalesce(is_first, F.lit(False))).withColumn("copy", F.when(is_first, 1).otherwise(F.col("copy") + 1))
    rows = alone.unionByName(decided.select(alone.columns))
    return stored(rows.mapInArrow(_write(folder), "path string, records long, bytes long"), "packages")


def _runs(lines: list[dict]) -> Iterator[list[dict]]:
    """Index lines cut into ranges."""
    part, size = [], 0
    for x in lines:
        if part and (len(part) == RANGE_RECORDS or size + x["length"] > RANGE_BYTES):
            yield part
            part, size = [], 0
        part.append(x)
        size += x["length"]
    if part:
        yield part


def _ranges(batches):
    """Of Arrow batches of package paths: runs of records as (path, offset, length, lengths of the records)."""
    for b in batches:
        for path in b.column(0).to_pylist():
            store, where = fs.FileSystem.from_uri(path)
            with store.open_input_file(where) as f:
                found = members(f, f.size())
                at, n = found[INDEX_MEMBER]
                f.seek(at)
                lines = [json.loads(x[x.index(b"{") :]) for x in f.read(n).splitlines()]
            base = found[WARC_MEMBER][0]
            lines.sort(key=lambda x: x["offset"])
            for part in _runs(lines):
                begin, end = part[0]["offset"], part[-1]["offset"] + part[-1]["length"]
                yield pa.RecordBatch.from_pylist([{"path": path, "offset": base + begin, "length": end - begin, "lengths": [x["length"] for x in part]}])


RECORD_SCHEMA = "page_id long, url string, record_type string, record_id string, refers_to_id string, digest string, payload binary"


def _read(batches):
    for b in batches:
        for path, offset, length, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
            store, where = fs.FileSystem.from_uri(path)
            with store.open_input_file(where) as f:
                f.seek(offset)
                data = f.read(length)
            rows, at = [], 0
            for n in lengths:
                fields, block = parse_record(data[at : at + n])
                at += n
                payload = block.partition(b"\r\n\r\n")[2]
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: payload of {fields['warc-record-id']} doesn't match its digest")
                page = fields.get("x-page-id")
                rows.append((int(page) if page else None, fields["warc-target-uri"], fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), digest, payload))
            names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
            types = [pa.int64(), *[pa.string()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(packages: DataFrame) -> DataFrame:
    """Every record of the packages: page_id, url, record_type, record_id, refers_to_id, digest, payload (empty for revisits).

    A package's index is cut into ranges, and the ranges are dealt out to as many tasks as their bytes ask for
    (the ranges themselves are tiny rows, so their own size says nothing), so a large package is read by many tasks.
    """
    ranges = stored(packages.select("path").mapInArrow(_ranges, "path string, offset long, length long, lengths array<long>"), "ranges")
    size = ranges.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    cores = packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size.n, max(cores, -(-(size.bytes or 0) // TASK_BYTES))))
    return ranges.repartition(tasks, "path", "offset").mapInArrow(_read, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), the figures of a revisit from the response it names."""
    brief = stored(records.select("page_id", "record_type", "record_id", "refers_to_id", "digest", F.octet_length("payload").cast("long").alias("n")), "records")
    response = brief.filter(F.col("record_type") == "response")
    revisit = brief.filter(F.col("record_type") == "revisit")
    target = response.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("n").alias("full"))
    linked = revisit.join(target, "refers_to_id", "left")
    return response.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        linked.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    packages = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    return resolve_revisits(read_archives(packages))


OP5_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
     q as (select *, min(page_id) over (partition by d) as f from p)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> f then f end as refers_to
from q
"""
