"""WARC: a writer of gzip-per-record archives and a splittable reader.

The reader cuts archives into byte ranges. A task scans its range for gzip's magic bytes, takes a place for the start
of a record only if a member can be decoded from there whose first lines are a WARC header, and owns the records that
start inside its range; it reads past the range's end only to finish the last of them. So no index is needed, a task's
memory is bounded by a range and one record, and a false magic inside compressed data is no record.

Archives are reached through the file system of their URI, not through Python's open(). Each is written to a name of its
task's attempt and then renamed, so attempts that fail or run twice are no part of an archive; their drafts
are deleted at the end.

Defined results: a null payload is empty. Of equal payloads of at least min_bytes bytes the row with the largest id is the
response and holds the payload; the others revisit it. Rows without an id are all responses. Rows that repeat an id and
its payload are written once for each row; the repeated largest id is a response each time. A null url is written empty.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscore.llm._common import as_bytes, join_skewed, materialize, new_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
_STEP = 1 << 16
#: Digests of repeated payloads up to which they are broadcast, so that no payload is shuffled.
BROADCAST_DIGESTS = 200_000
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str, payload: bytes | None, size: int, sha1: str, refers: int | None = None) -> bytes:
    """One gzip member: a response with an HTTP head and the payload, or a revisit with the head only."""
    url = url.replace("\r", "").replace("\n", "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}/{page}/{url}/{sha1}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _file_system(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        fs, path = _file_system(name)
        draft, n, size = f"{path}.{task.taskAttemptId()}", 0, 0
        out = None
        for batch in batches:
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            rows = zip(columns["page_id"].to_pylist(), columns["url"].to_pylist(), as_bytes(columns["html"]), columns["sha1"].to_pylist(), columns["size"].to_pylist(), columns["refers_to"].to_pylist(), strict=True)
            for page, url, html, sha1, length, refers in rows:
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(draft, compression=None)
                sha = base64.b32encode(bytes.fromhex(sha1)).decode()
                revisit = refers is not None
                data = record("revisit" if revisit else "response", page, url or "", None if revisit else html or b"", length, sha, refers)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            fs.move(draft, path)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Archives of pages (page_id, url, html) in the folder -> (path, bytes, records), one row an archive."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_dir(spark, "warc")
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"))
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("size"))
    ids = ids.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    # a digest that occurs once needs no entry, so the table is as long as there are repeated payloads
    best = materialize(ids.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("times")).where("times > 1"), "digests")
    if best.count() <= broadcast_digests:
        marked = rows.join(F.broadcast(best.drop("times")), "sha1", "left")
    else:
        # payloads are dealt by their page, digests of many pages by a salt
        revisits = join_skewed(ids, best, ["sha1"], ["best"]).where("page_id < best").distinct()
        marked = rows.join(revisits, ["page_id", "sha1"], "left")
    refers = F.when((F.col("size") >= min_bytes) & (F.col("page_id") < F.col("best")), F.col("best"))
    marked = marked.withColumn("refers_to", refers).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    done = marked.select("page_id", "url", "html", "sha1", "size", "refers_to").mapInArrow(_write(folder), "path string, bytes long, records long")
    archives = materialize(done, "archives")
    _clear_drafts(spark, folder)
    return archives


def _clear_drafts(spark: SparkSession, folder: str) -> None:
    """Deletes what attempts left that failed; done when all archives have their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*.warc.gz.*")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), False)


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """The header fields, in lower case, and the block of a record; None if it isn't one."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    size = int(fields["content-length"])
    return (fields, rest[:size]) if len(rest) >= size else None


def _member(stream, start: int, begin: bytes) -> tuple[bytes, int] | None:
    """The decoded member that starts at start, and its end; None if there is none or it is no WARC record.

    The first bytes are decoded and looked at before the rest is.
    """
    unpack, out, at, data = zlib.decompressobj(31), [], start, begin
    looked = False
    try:
        while not unpack.eof:
            if not data:
                stream.seek(at)
                data = stream.read(_STEP)
                if not data:
                    return None
            out.append(unpack.decompress(data))
            at += len(data)
            data = b""
            if not looked and sum(map(len, out)) >= 5:
                looked = True
                if not b"".join(out).startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def records_of(stream, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records that start in start..end-1."""
    at = start
    window, base = b"", start
    while at < end:
        if at < base or at + len(MAGIC) > base + len(window):
            stream.seek(at)
            window, base = stream.read(min(_STEP * 16, size - at)), at
            if len(window) < len(MAGIC):
                return
        found = window.find(MAGIC, at - base)
        if found < 0:
            step = base + len(window) - len(MAGIC) + 1
            if base + len(window) >= size:
                return
            at = max(step, at + 1)
            continue
        at = base + found
        if at >= end:
            return
        got = _member(stream, at, window[found : found + _STEP])
        parsed = parse(got[0]) if got else None
        if parsed:
            yield at, *parsed
            at = got[1]
        else:
            at += 1


_READ_SQL = "path string, offset long, warc_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(with_payload: bool):
    kinds = [("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                fs, local = _file_system(path)
                rows, held = [], 0
                with fs.open_input_file(local) as stream:
                    for at, fields, block in records_of(stream, size, start, end):
                        kind = fields["warc-type"]
                        http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                        own = kind != "revisit"
                        length = len(payload) if own else int(fields.get("x-payload-length", 0))
                        sha1 = digest(payload) if own else fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        number = lambda name: int(fields[name]) if name in fields else None
                        rows.append((path, at, kind, number("x-page-id"), fields.get("warc-target-uri"), length, sha1, number("x-refers-to-page-id"), payload if own and with_payload else None))
                        held += len(payload) if with_payload else 200
                        if held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    return run


def read_warc(files: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes) -> their records. Each range is a task's row; ranges are dealt out evenly."""
    spark = files.sparkSession
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", start.alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(_read(with_payload), _READ_SQL)


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the archives under a path of any store that Spark reads, listed by Spark's own reader."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select("path", F.col("length").alias("bytes"))
