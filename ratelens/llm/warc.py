"""Legacy archives: ARC files (versions 1 and 2) and their conversion to WARC.

An ARC file begins with a ``filedesc`` record whose body names the version and the fields of all later
header lines; every record states its length. The converter reads those lines, and synthesises what
WARC asks for: record ids, ISO timestamps, record types, block and payload digests, and ``revisit``
records for payloads seen before.

Archives are written by the executors through a file system that all of them share, under the name of
the task attempt. Only the manifest that Spark commits says which files count, so files of lost or
repeated attempts are never read. Records are streamed; a task holds one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import materialize, new_path, split_join, table

ROLL_BYTES, ROLL_RECORDS = 16_000_000, 20_000
LEVEL = 1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CAPTURED = "20240101000000"
#: The header fields of both ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str, mode: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


class _Roller:
    """Writes gzip members to files that end after enough bytes or records."""

    def __init__(self, folder: str, suffix: str, begin) -> None:
        task = TaskContext.get()
        self._stem, self._suffix, self._begin = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", suffix, begin
        self._file, self._number, self.done = None, 0, []

    def add(self, record: bytes) -> None:
        if self._file is None:
            path = f"{self._stem}-{self._number:05d}{self._suffix}"
            self._file, self._path, self._size, self._count = _open(path, "w"), path, 0, 0
            self._number += 1
            self._put(self._begin(path.rpartition("/")[2]))
        self._put(record)
        self._count += 1
        if self._size >= ROLL_BYTES or self._count >= ROLL_RECORDS:
            self.close()

    def _put(self, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        self._file.write(member)
        self._size += len(record)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self.done.append((self._path, self._count))
            self._file = None


def _manifest(roller: _Roller) -> pa.RecordBatch:
    roller.close()
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in roller.done], pa.string()), pa.array([n for _, n in roller.done], pa.int64())], ["path", "n"])


def _filedesc(version: int):
    def begin(name: str) -> bytes:
        body = f"{version} 0 ratelens\n{FIELDS[version]}\n".encode()
        tail = "" if version == 1 else f" 200 - - 0 {name}"
        return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain{tail} {len(body)}\n".encode() + body + b"\n"

    return begin


def _safe_url(url: str | None) -> str:
    """A url without white space or control characters, as header lines are split at spaces."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), own)


def _arc_writer(folder: str, version: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, ".arc.gz", _filedesc(version))
        for batch in batches:
            for page, url, html in zip(*(c for c in batch.columns), strict=True):
                payload = html.as_py() or b""
                block = _http(page.as_py(), payload) + payload
                tail = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - 0 -"
                line = f"{_safe_url(url.as_py())} 0.0.0.0 {CAPTURED} text/html{tail} {len(block)}\n"
                roller.add(line.encode("utf-8", "surrogatepass") + block + b"\n")
        yield _manifest(roller)

    return write


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes

    @property
    def split(self) -> tuple[bytes, bytes]:
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return head, payload

    @property
    def page_id(self) -> int | None:
        found = re.search(rb"\r\nX-Page-Id: (-?\d+)", self.split[0])
        return int(found[1]) if found else None


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC stream, the filedesc left out; offset counts uncompressed bytes.

    Header lines are read by the field names that the file itself declares. A record that is shorter
    than it declares, or a line with too few fields, raises ValueError.
    """
    names: list[str] | None = None
    at = 0
    while line := stream.readline():
        if line == b"\n":
            at += 1
            continue
        begin, text = at, line.decode("utf-8", "surrogatepass").rstrip("\n")
        parts = text.split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in ARC header line at {begin}")
        block = stream.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"ARC record at {begin} is cut off")
        at += len(line) + len(block)
        if names is None:
            first, second = block.decode().split("\n")[:2]
            if first[:1] not in {"1", "2"} or second != FIELDS[int(first[0])]:
                raise ValueError(f"unknown ARC version: {first}")
            names = second.split(" ")
            continue
        if len(parts) != len(names):
            raise ValueError(f"ARC header line at {begin} has {len(parts)} fields; its version has {len(names)}")
        yield ArcRecord(begin, dict(zip(names, parts, strict=True)), block)


def _records(path: str) -> Iterator[ArcRecord]:
    with _open(path, "r") as raw, gzip.open(raw) as stream:
        yield from read_arc(io.BufferedReader(stream, 1 << 20))


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for r in _records(path):
                payload = r.split[1]
                rows.append((path, r.offset, r.page_id, sha1_base32(payload), len(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "offset", "page_id", "digest", "bytes"])


def record_id(path: str, offset: int) -> str:
    """The same record of the same archive always gets the same id."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, path.rpartition('/')[2] + '#' + str(offset))}>"


def iso_date(arc_date: str) -> str:
    """Fourteen (or fewer, in old files) digits as a WARC timestamp."""
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines)
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _warcinfo(name: str) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", iso_date(CAPTURED)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(headers, b"software: ratelens\r\nformat: WARC File Format 1.1\r\n")


def convert_record(path: str, r: ArcRecord, first: tuple[str, int] | None) -> bytes:
    """The WARC record; ``first`` is the place of the equal payload that it revisits."""
    head, payload = r.split
    headers = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_id(path, r.offset)),
        ("WARC-Date", iso_date(r.fields["Archive-date"])),
        ("WARC-Target-URI", r.fields["URL"]),
        ("WARC-IP-Address", r.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first)), ("WARC-Truncated", "length")]
    return warc_record(headers, head + b"\r\n\r\n" + (b"" if first else payload))


def _converter(folder: str):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, ".warc.gz", _warcinfo)
        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                firsts = {x["offset"]: (x["to_path"], x["to_offset"]) for x in revisits}
                for r in _records(path):
                    roller.add(convert_record(path, r, firsts.get(r.offset)))
        yield _manifest(roller)

    return convert


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"damaged block of {headers['warc-record-id']}")
        yield headers, block


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "url"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            with _open(path, "r") as raw, gzip.open(raw) as stream:
                for h, block in read_warc(io.BufferedReader(stream, 1 << 20)):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and digest != sha1_base32(payload):
                        raise ValueError(f"damaged payload of {h['warc-record-id']}")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    rows.append((h["warc-record-id"], h["warc-type"], int(page[1]) if page else None, size, digest, h.get("warc-refers-to"), h["warc-target-uri"]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _dealt(manifest: DataFrame) -> DataFrame:
    """Archives over enough tasks to use all cores, one path at a time."""
    n = manifest.count()
    return manifest.repartition(max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism)), "path") if n else manifest


def write_arc(pages: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """Writes ``page_id, url, html`` as ARC files and returns their manifest (path, n)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"))
    return materialize(rows.mapInArrow(_arc_writer(folder, version), "path string, n long"), "arcs").select("path", "n")


def arc_to_warc(arcs: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Converts ARC files (a manifest with a ``path`` column) and returns the manifest of WARC files.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page id
    (then path and offset) becomes a response, the others revisit it.
    """
    records = materialize(_dealt(arcs.select("path")).mapInArrow(_digester, "path string, offset long, page_id long, digest string, bytes long"), "records")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset")
    firsts = records.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min(place).alias("first"))
    # All empty pages share a digest; so may a third of the others.
    joined = split_join(records, materialize(firsts, "firsts"), ["digest", "bytes"], records.count())
    revisits = joined.where((F.col("path") != F.col("first.path")) | (F.col("offset") != F.col("first.offset")))
    entry = F.struct("offset", F.col("first.path").alias("to_path"), F.col("first.offset").alias("to_offset"))
    by_archive = revisits.groupBy("path").agg(F.collect_list(entry).alias("revisits"))  # at most ROLL_RECORDS each
    plan = arcs.select("path").join(by_archive, "path", "left")
    kind = "array<struct<offset:bigint,to_path:string,to_offset:bigint>>"
    plan = plan.select("path", F.coalesce("revisits", F.array().cast(kind)).alias("revisits"))
    return materialize(_dealt(plan).mapInArrow(_converter(folder), "path string, n long"), "warcs").select("path", "n")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """All response and revisit records of a manifest, digests verified; refers_to is a page id."""
    schema = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, url string"
    found = materialize(_dealt(warcs.select("path")).mapInArrow(_reader, schema), "readback")
    targets = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = found.where("record_type = 'revisit'")
    asked = targets.join(materialize(revisits.select("refers_to_id").distinct(), "asked"), "refers_to_id", "left_semi")
    revisits = split_join(revisits, materialize(asked, "targets"), ["refers_to_id"], found.count(), "left")
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to version-1 ARC files, those to WARC files, and these read back.

    Null html is an empty payload; a null or blank url is written as ``-``; rows without a page id
    keep a null one; repeated ids are records of their own; an empty table gives no archives. Payloads of any length are
    written whole, one in memory at a time; other columns are ignored.
    """
    arcs = write_arc(table(spark, sf_dir, "pages"), new_path(spark, "arc"))
    warcs = arc_to_warc(arcs, new_path(spark, "warc"))
    return read_warcs(warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, upper(sha1(h)) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": OP7_SQL}
