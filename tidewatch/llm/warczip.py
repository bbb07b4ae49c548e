"""WARC archives packaged in ZIP files: written by Spark tasks, read back by range.

Writing (:func:`write_archives`). The smallest page_id of each payload digest is found with a
partial aggregation; pages meet it by digest, and each task writes its rows as archives of about
``archive_bytes``: a ZIP file that stores (does not compress) one member of gzip records,
``archive/data.warc.gz``, and one index member, ``indexes/index.jsonl``. A name holds the task
attempt, and only what committed attempts report enters the manifest, so a lost executor leaves
at most unlisted files.

Reading (:func:`read_archives`). A task opens an archive by URI, finds the end-of-directory record
(and the ZIP64 locator and record, if there) at its tail, parses the central directory, reads the
index member and then each record by its byte range. Nothing is extracted, only stored members
are read, and every payload is checked against its digest.

Of records with equal payloads of at least ``least_shared`` bytes, that with the smallest page_id
is ``response`` and the others are ``revisit``; smaller payloads are all ``response``. Null html is an
empty payload. A null page_id comes after all others; repeated rows are told apart by a row number,
so exactly one record of a payload is the response. A null url has no target header. An empty
table writes no archive and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored

ARCHIVE_BYTES = 64 << 20
LEAST_SHARED = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
MANIFEST = "archive string, bytes long, records long"


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])


def record_bytes(page_id, url, kind: str, refers_to, digest: str, size: int, payload: bytes) -> bytes:
    body = b"" if kind == "revisit" else payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size)),
            ("Content-Length", str(len(body)))]
    if url is not None:
        head.append(("WARC-Target-URI", json.dumps(url)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    cut = raw.index(b"\r\n\r\n")
    first, *lines = raw[:cut].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    body = raw[cut + 4:cut + 4 + int(head["Content-Length"])]
    url = head.get("WARC-Target-URI")
    return {"page_id": number(head["WARC-Record-ID"]), "url": None if url is None else json.loads(url),
            "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")),
            "payload_digest": head["WARC-Payload-Digest"].split(":", 1)[1],
            "payload_bytes": int(head["WARC-Payload-Length"]), "payload": None if head["WARC-Type"] == "revisit" else body}


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, root = _filesystem(folder)
        data, index, made = io.BytesIO(), [], 0

        def close():
            nonlocal data, index, made
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:
                with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                    member.write(data.getbuffer())
                with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                    member.write("\n".join(json.dumps(x) for x in index).encode())
            name = f"{stem}-{made:04d}.wacz"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(packed.getbuffer())
            row = pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([packed.tell()], pa.int64()),
                                   pa.array([len(index)], pa.int64())], ["archive", "bytes", "records"])
            data, index, made = io.BytesIO(), [], made + 1
            return row

        for b in batches:
            cols = [b.column(i) for i in range(7)]
            for k in range(len(b)):
                page, url, kind, refers, digest, size, payload = (c[k].as_py() for c in cols)
                raw = _gzip(record_bytes(page, url, kind, refers, digest, size, payload))
                index.append({"offset": data.tell(), "length": len(raw)})
                data.write(raw)
                if data.tell() >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES,
                   least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write ``pages`` and return the manifest (archive, bytes, records), itself a stored table."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn(
        "payload_bytes", F.octet_length("payload").cast("long"))
    # nulls last: a struct that begins with "is null"
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")
    first = rows.filter(F.col("payload_bytes") >= least_shared).groupBy("payload_digest").agg(F.min(rank).alias("first"))
    mine = rows.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid"))
    records = mine.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                          F.when(revisit, F.col("first.page_id")).alias("refers_to"), "payload_digest", "payload_bytes",
                          F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    return stored(records.mapInArrow(_writer(folder, archive_bytes), MANIFEST), "warc-manifest")


class ZipRanges:
    """Central directory of a ZIP file, through a ``read(offset, length)`` function."""

    TAIL = 22 + 65_535 + 20

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        tail_at = max(0, size - self.TAIL)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature's bytes may stand in a comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start) or tail[max(0, at - 20):at][:4] == b"PK\x06\x07":
            magic, _, far, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
            if magic != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = read(far, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, at = read(start, length), 0
        for _ in range(count):
            if raw[at:at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, n, extra, note = struct.unpack_from("<IIHHH", raw, at + 20)
            local, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            x, end = at + 46 + n, at + 46 + n + extra
            while x + 4 <= end:  # the ZIP64 field holds only those values that do not fit
                tag, size_ = struct.unpack_from("<HH", raw, x)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{size_ // 8}Q", raw, x + 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                x += 4 + size_
            self.members[name] = (method, local, packed)
            at = end + note

    def stored_at(self, name: str) -> tuple[int, int]:
        """(first byte, length) of a stored member's data."""
        method, local, length = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + extra, length


def archive_records(uri: str) -> Iterator[dict]:
    """The records of one archive, each read by its byte range."""
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        read = lambda at, n: f.read_at(n, at)
        z = ZipRanges(read, f.size())
        start, length = z.stored_at(DATA)
        at, n = z.stored_at(INDEX)
        for line in read(at, n).decode().splitlines():
            x = json.loads(line)
            if x["offset"] + x["length"] > length:
                raise ValueError("index points past its member")
            rec = parse_record(zlib.decompress(read(start + x["offset"], x["length"]), 31))
            if rec["payload"] is not None and hashlib.sha256(rec["payload"]).hexdigest() != rec["payload_digest"]:
                raise ValueError(f"payload of page {rec['page_id']} does not match its digest")
            yield rec


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_RECORD_TYPE)
    for b in batches:
        for uri in b.column(0).to_pylist():
            rows, size = [], 0
            for rec in archive_records(uri):
                rows.append(rec)
                size += len(rec["payload"] or b"") + 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _record_type():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                         T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
                         T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
                         T.StructField("payload", T.BinaryType())])


_RECORD_TYPE = _record_type()


def read_archives(manifest: DataFrame, archive_col: str = "archive") -> DataFrame:
    """All records of the listed archives: page_id, url, record_type, refers_to, payload_digest,
    payload_bytes (both of the full payload), payload (null for a revisit)."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select(archive_col).repartition(n, archive_col).mapInArrow(_reader, _RECORD_TYPE)
