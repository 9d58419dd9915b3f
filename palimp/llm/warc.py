"""WARC files of gzip members, written and read in parallel.

Writing: pages with equal payloads are written once; the others are revisit records that refer to it. Each task writes one file to the shared store under a name of its own, and a manifest row
is what makes the file count, so a repeated task leaves no double. Reading: files are cut into byte ranges of any size. A task looks for gzip magic in its range, takes a place for a member if its
bytes decode to a WARC header, and owns the records that start in the range; it reads on beyond the end of its range to finish the last one. After a member, the next place is known.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_dir, written

#: Payloads of fewer bytes are never revisits; bytes of a range; level of compression; bytes that are read at once, and that are decoded at once in search of a header's end; tasks of a read at most.
SMALLEST, SPLIT, LEVEL, READ, PROBE, TASKS = 100, 8 << 20, 4, 1 << 18, 1 << 12, 50_000
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, size long, records long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it: local files, HDFS, S3, Google and Azure stores; s3a and s3n, as Spark calls them, are S3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record_id(x: int | None) -> str:
    return f"<urn:page:{'' if x is None else x}>"


def id_of_record(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. The block of a revisit has the HTTP header only, with the length of the payload it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for r in batch.slice(i, 64).to_pylist():
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = build_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["first"], r["revisit"], date)
                    out.write(member)
                    size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": size, "records": n}], pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record of each row and returns the manifest: path, size and records of each file.

    Payloads are UTF-8; null is empty. Of rows with equal payloads of SMALLEST bytes or more, those with the smallest id are responses (one, unless the id repeats), the others revisits of it; null ids
    come after all others. Other columns are ignored. Ids are whole numbers.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    large = F.octet_length("html") >= SMALLEST
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("large", large)
    # small payloads get a key of their own that meets nothing, so that they don't gather at one key
    base = base.withColumn("same", F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    firsts = base.where("large").groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    joined = base.join(firsts, "same", "left")
    joined = joined.select("page_id", "url", "html", "digest", "first", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"))
    return written(joined.mapInArrow(_write(folder, date), MANIFEST), "manifest")


class _Window:
    """Bytes of a file from any place on, read in pieces."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            keep = self.data[pos - self.at :] if self.at <= pos < self.at + len(self.data) else b""
            start = pos + len(keep)
            self.f.seek(start)
            self.data = keep + self.f.read(min(max(n - len(keep), READ), max(0, self.size - start)))
            self.at = pos
        return self.data[pos - self.at : pos - self.at + n]


def _header(text: bytes) -> tuple[dict[str, str], int] | None:
    """Fields, with names in lower case, and where the block starts; nothing if this is no record."""
    end = text.find(b"\r\n\r\n")
    if not text.startswith(b"WARC/") or end < 0:
        return None
    lines = text[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _is_member(w: _Window, pos: int) -> bool:
    """If a WARC record starts here: decodes until its header ends, however long it is, or the bytes prove to be something else."""
    z, text, at, end = zlib.decompressobj(31), bytearray(), pos, -1
    try:
        while end < 0:
            piece = w.get(at, min(PROBE, w.size - at))
            if z.eof or not piece or not b"WARC/".startswith(bytes(text[:5])):
                return False
            seen, at = max(0, len(text) - 3), at + len(piece)
            text += z.decompress(piece)
            end = text.find(b"\r\n\r\n", seen)
    except zlib.error:
        return False
    return _header(bytes(text[: end + 4])) is not None


def records_of_range(f, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and block of each record that starts in [start, end)."""
    w, pos = _Window(f, size), start
    sure = False
    while pos < end:
        if not sure or w.get(pos, 3) != MAGIC:
            found = w.get(pos, min(READ, size - pos)).find(MAGIC)
            if found < 0:
                pos += max(1, min(READ, size - pos) - 2)
                sure = False
                continue
            pos += found
            if pos >= end:
                return
            if not _is_member(w, pos):
                pos, sure = pos + 1, False
                continue
        z, parts, at = zlib.decompressobj(31), [], pos
        try:
            while not z.eof and at < size:
                piece = w.get(at, min(READ, size - at))
                parts.append(z.decompress(piece))
                at += len(piece)
        except zlib.error:
            pos, sure = pos + 1, False
            continue
        if not z.eof:
            return  # a cut-off member at the end of the file
        at -= len(z.unused_data)
        text = b"".join(parts)
        got = _header(text)
        if got:
            yield pos, got[0], text[got[1] : got[1] + int(got[0]["content-length"])]
        pos, sure = at, True


def parse_record(fields: dict[str, str], block: bytes) -> dict:
    """The row of a response or revisit record: payload_bytes and payload_digest are of the full payload; a revisit has no payload of its own."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:").lower()
    if kind == "revisit":
        return {"payload": None, "payload_bytes": int(length[1]) if length else None, "payload_digest": stated, "intact": True}
    digest = hashlib.sha256(payload).hexdigest()
    return {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "intact": stated in ("", digest)}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of the .warc.gz files of a folder that has none; the driver lists names and sizes only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return spark.createDataFrame([(x.getPath().toString(), x.getLen(), None) for x in found if x.getPath().getName().endswith(".warc.gz")], MANIFEST)


def read_warc(manifest: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """record_id, type, uri, date, refers_to, payload_bytes, payload_digest, intact [, payload] of each record of the files; intact: the payload has the stated digest. Files with zero bytes have none.

    Each range is a task of its own, up to TASKS tasks; beyond, tasks take several. Their number is set, because adaptive execution would merge the small rows that stand for large ranges.
    """
    files = manifest.where("size > 0")
    n = files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 0
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split))).alias("start"))
    ranges = ranges.repartition(max(1, min(int(n), TASKS)))
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())] + [("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = open_store(r["path"])
                rows, size = [], 0
                with fs.open_input_file(path) as f:
                    for _, fields, block in records_of_range(f, r["size"], r["start"], min(r["start"] + split, r["size"])):
                        x = parse_record(fields, block)
                        size += len(block) if payloads else 0
                        rows.append({"record_id": fields.get("warc-record-id"), "type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to")} | (x if payloads else {k: v for k, v in x.items() if k != "payload"}))
                        if len(rows) >= 2000 or size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "record_id string, type string, uri string, date string, refers_to string, payload_bytes long, payload_digest string, intact boolean" + ", payload binary" * payloads
    return ranges.mapInArrow(run, ddl)


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    manifest = write_warc(pages, fresh_dir(spark, "warc"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number_or_null = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read_warc(manifest, split, payloads=False).select(number_or_null(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number_or_null(F.col("refers_to")).alias("refers_to"))
