"""Operator 6, WARC: a legacy ARC converter, and the writer and reader of both formats.

`arc_to_warc` reads an ARC archive of version 1 or 2. Its first record names the version and the fields of the header
lines of the others; a header's last field declares the length of what follows. The version block becomes a warcinfo
record, each other record a WARC record with what ARC doesn't have: a record id (a UUID of name and payload), a date from
the 14 digits, a type, and SHA-1 digests of block and payload in base 32. Content that begins with an HTTP status line
is a response whose payload is what follows the HTTP headers; other content of an http address is a response without
headers, and of any other address (dns, ftp) a resource. An archive of gzip members, one a record, is read like a plain
one.

`archive_pages` puts pages through it: each task writes its rows as an ARC archive, converts it and writes a WARC file
of gzip members under a draft name that is renamed, so a task can run again. Of records with equal payloads of at least
`least` bytes, the one with the largest page_id is the response; the others become revisits that refer to it. Which
payloads are repeated is found from digests alone; that table is broadcast while its counted size is small and joined
by a shuffle beyond that.

Null or empty html: a response of 0 bytes. Null url: '-'. Very long payloads: whole; a payload is held in memory by one
task. Ties: rows that share the largest page_id of a payload are all responses. Null page_id: a response, never referred
to unless all page_ids are null. Repeated rows: each is a record. Empty table: no archive, no rows. Extra columns are
ignored; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 1000
#: The header fields of the two versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "20000101000000"


def arc_record(version: int, fields: dict[str, str], payload: bytes) -> bytes:
    """One record; fields that aren't given are '-'."""
    values = fields | {"Archive-length": str(len(payload))}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode() + payload + b"\n"


def arc_head(version: int, name: str) -> bytes:
    """The version block, the first record of an archive."""
    block = f"{version} 0 lumenquarry\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Filename": name}
    return arc_record(version, line, block)


def read_arc(f, head: Callable[[str, bytes], None] = lambda line, block: None) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the content of each record after the version block, which `head` is told of."""
    start = f.read(2)
    f.seek(-len(start), io.SEEK_CUR)
    if start == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    first = f.readline().rstrip(b"\r\n").decode("utf-8", "replace")
    if not first.startswith("filedesc:"):
        raise ValueError("an ARC archive starts with a filedesc: line")
    head(first, whole := f.read(int(first.rsplit(" ", 1)[1])))
    block = whole.decode("utf-8", "replace").split("\n")
    version = int(block[0].split()[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    names = block[1].split() or list(ARC_FIELDS[version])
    while line := f.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"a header line has {len(values)} of {len(names)} fields: {line[:200]!r}")
        header = dict(zip(names, values, strict=True))
        size = int(header[names[-1]])
        payload = f.read(size)
        if len(payload) != size:
            raise ValueError(f"a record of {size} bytes ends after {len(payload)}")
        yield header, payload


def record_id(name: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name} {digest}')}>"


def warc_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A gzip member with one record."""
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_payload(content: bytes) -> bytes | None:
    """What follows the HTTP headers; None where content doesn't begin with a status line."""
    if not content.startswith(b"HTTP/"):
        return None
    ends = [(at, n) for sep, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (at := content.find(sep)) >= 0]
    at, n = min(ends, default=(len(content), 0))
    return content[at + n :]


def arc_to_warc(archive, refers=lambda header, digest: None, info: bool = True) -> Iterator[bytes]:
    """The WARC records of an ARC archive. refers: (Filename, address, date) of the record that this one repeats, or None.

    The first is the warcinfo record, unless info is False.
    """
    told: list[bytes] = []

    def head(line: str, block: bytes) -> None:
        name = line.split(" ")[0].removeprefix("filedesc://")
        date = line.split(" ")[2]
        fields = f"software: lumenquarry\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\narc-version-block: {block.decode('utf-8', 'replace').split(chr(10))[0]}\r\n".encode()
        headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, base32(block)), "WARC-Date": warc_date(date), "WARC-Filename": name, "WARC-Block-Digest": f"sha1:{base32(fields)}", "Content-Type": "application/warc-fields"}
        told.append(warc_record(headers, fields))

    for header, content in read_arc(archive, head):
        if told and info:
            yield told.pop()
        payload = http_payload(content)
        http = payload is not None
        payload = content if payload is None else payload
        digest = base32(payload)
        name = header.get("Filename", "-")
        first = refers(header, digest)
        web = http or header["URL"].lower().startswith(("http:", "https:", "/", "-")) or ":" not in header["URL"].split("/")[0]
        headers = {
            "WARC-Type": "revisit" if first else "response" if web else "resource",
            "WARC-Record-ID": record_id(name, digest),
            "WARC-Date": warc_date(header["Archive-date"]),
            "WARC-Target-URI": header["URL"],
            "WARC-IP-Address": header["IP-address"],
            "WARC-Payload-Digest": f"sha1:{digest}",
            "Content-Type": "application/http; msgtype=response" if http else header["Content-type"],
            "X-Archive-Name": name,
            "X-Payload-Length": str(len(payload)),
        }
        block = content
        if first:
            headers |= {
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": record_id(first[0], digest),
                "WARC-Refers-To-Target-URI": first[1],
                "WARC-Refers-To-Date": warc_date(first[2]),
                "X-Refers-To-Name": first[0],
            }
            block = content[: len(content) - len(payload)]
        yield warc_record(headers | {"WARC-Block-Digest": f"sha1:{digest if block is payload else base32(block)}"}, block)
    if told and info:
        yield told.pop()


def read_warc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:40]!r}")
        headers = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[k] = v
        yield headers, f.read(int(headers["Content-Length"]))


def address(url: str | None) -> str:
    return quote(url or "-", safe=":/?#[]@!$&'()*+,;=%")


def payload_of(html) -> F.Column:
    return F.coalesce(html, F.lit(""))


def archive_pages(pages: DataFrame, path: str, least: int = LEAST, version: int = 2) -> list[str]:
    """Writes the pages as WARC files; gives the files' names."""
    spark = pages.sparkSession
    common.arrow_batches(spark)
    pages = pages.select("page_id", "url", payload_of(F.col("html")).alias("html"))
    digests = pages.where(F.octet_length("html") >= least).select("page_id", "url", F.sha1("html").alias("_digest"))
    repeated = common.cut(digests.groupBy("_digest").agg(F.max("page_id").alias("first"), F.max(F.struct("page_id", "url"))["url"].alias("first_url"), F.count("*").alias("n")).where("n > 1").select("_digest", "first", "first_url"))
    keyed = pages.withColumn("_digest", F.when(F.octet_length("html") >= least, F.sha1("html")))
    rows = common.small_or_shuffled(keyed, repeated, "_digest", "left", repeated.count(), 256).drop("_digest")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n = 0

        def members() -> Iterator[bytes]:
            nonlocal n
            for b in batches:
                first_of: list[tuple[str, str, str] | None] = []
                archive = io.BytesIO()
                archive.write(arc_head(version, f"part-{part}.arc"))
                for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    name = "null" if page_id is None else str(page_id)
                    archive.write(arc_record(version, {"URL": address(url), "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200", "Filename": name}, html.encode()))
                    first_of.append(None if first is None or page_id is None or page_id == first else (str(first), address(first_url), DATE))
                archive.seek(0)
                told = iter(first_of)
                for member in arc_to_warc(archive, lambda header, digest, told=told: next(told), info=False):
                    n += 1
                    yield member

        size = common.write_file(name := f"{path}/part-{part:06d}.warc.gz", members())
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

    return sorted(r[0] for r in rows.select("page_id", "url", "html", "first", "first_url").mapInArrow(put, "path string, records long, bytes long").where("records > 0").collect())


def read_pages(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row for each record of WARC files that archive_pages wrote."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "block_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = common.filesystem(path)
                rows: list[tuple] = []
                with fs.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for h, block in read_warc(f):
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind, size = h["WARC-Type"], int(h["X-Payload-Length"])
                        if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                            raise ValueError(f"{path}: the record of {h['X-Archive-Name']} is damaged")
                        page = None if h["X-Archive-Name"] == "null" else int(h["X-Archive-Name"])
                        first = h.get("X-Refers-To-Name")
                        rows.append((page, size, digest, kind, None if first is None else int(first), h["WARC-Target-URI"], len(block)))
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, block_bytes long")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive_pages(common.table(spark, sf_dir, "pages"), common.new_folder(spark, "warc"))
    return read_pages(spark, files).drop("url", "block_bytes")


OP6_SQL = f"""
with p as (select page_id, coalesce(html, '') t from pages),
m as (select sha1(t) d, max(page_id) first_, count(*) n from p where strlen(t) >= {LEAST} group by 1)
select page_id, strlen(t)::bigint payload_bytes, sha1(t) payload_digest,
    case when n > 1 and page_id < first_ and strlen(t) >= {LEAST} then 'revisit' else 'response' end record_type,
    case when n > 1 and page_id < first_ and strlen(t) >= {LEAST} then first_ end refers_to
from p left join m on sha1(t) = d
"""
