"""WARC archives with an index first: write, note where each record is, then read chosen records back by byte ranges.

* :func:`write_archives` writes one archive a partition into a shared folder, each record a gzip member of its own, and gives
  the index: archive, offset, length, URL, digest and type of every record. Of records with equal payloads of at least
  ``least`` bytes the one with the largest page_id is the response; the others are revisit records without a payload.
* :func:`read_records` takes rows of such an index, sorts them by archive and offset, coalesces ranges that are close together into
  reads of at most ``RANGE_BYTES``, and parses the records of each.

Files are opened through ``pyarrow.fs``, so the folder may be any store it knows (local and shared mounts, HDFS, S3, GCS). A task
that is run again writes a file of a new name, and the index names the file of the attempt that counted. Null html is an empty
payload; null URLs are written as an empty header. Rows with a
null page_id are left out. Ties cannot arise as page_id decides; rows repeated whole are separate records.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import among, fresh_path, heavy_join, id_cells, in_bitmap, map_arrow, stored

#: Most bytes of one read, and the gap between records that is read through rather than skipped.
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: An archive is closed at this size.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page_id: int, url: str, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only. The full payload's length travels as an extension header."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and content of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, rest[:n]


def _clean(url: str | None) -> str:
    """URLs hold no line ends in a header."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _write(folder: str, ids=None, log2: int = 0):
    """Writes the rows it gets; with a bitmap of ids only those not in it, none of which is a revisit."""

    def step(batches):
        store, root = open_store(folder)
        context = TaskContext.get()
        out = None
        name, at = "", 0
        for b in batches:
            if ids is not None:
                b = b.filter(pa.array(~in_bitmap(ids.value, id_cells(b.column("page_id").to_numpy(zero_copy_only=False), log2))))
                b = b.append_column("refers_to", pa.nulls(b.num_rows, pa.int64()))
            if not b.num_rows:
                continue
            rows: list[tuple] = []
            for page, url, html, sha, target in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "refers_to")), strict=True):
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(record(page, _clean(url), html.encode() if html is not None else b"", sha, target)) + z.flush()
                out.write(member)
                rows.append((name, at, len(member), page, url, sha, "response" if target is None else "revisit", target))
                at += len(member)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"])
        if out is not None:
            out.close()

    return step


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder, index) of the archives written from (page_id, url, html)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    pages = pages.filter("page_id is not null").select("page_id", "url", "html").withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    digests = stored(pages.select("page_id", "sha", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).distinct(), "digests")
    newest = digests.filter(f"n >= {least}").groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("rows")).filter("rows > 1")
    kinds = heavy_join(digests, stored(newest, "newest"), ["sha"], digests.count(), "rows")
    revisits = stored(kinds.filter("page_id != newest").select("page_id", "sha", F.col("newest").alias("refers_to")), "revisits")
    # only pages that may be revisits are shuffled to learn what they refer to; the others are written where they are read
    some, ids, log2 = among(pages, revisits, "page_id")
    joined = some.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "sha", "refers_to")
    return folder, stored(map_arrow(pages, _write(folder, ids, log2), INDEX).unionByName(map_arrow(joined, _write(folder), INDEX)), "index")


def _ranges(offsets: np.ndarray, lengths: np.ndarray, most: int, gap: int) -> list[tuple[int, int]]:
    """Slices [a, b) of sorted records that one read covers."""
    out, a = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > gap or offsets[i] + lengths[i] - offsets[a] > most:
            out.append((a, i))
            a = i
    return out


def _read(folder: str, payload: bool):
    def step(batches):
        store, root = open_store(folder)
        name, source = None, None
        for b in batches:
            archives = np.array(b.column("archive").to_pylist(), dtype=object)
            offsets, lengths = b.column("offset").to_numpy(), b.column("length").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], archives[1:] != archives[:-1], [True]))) if len(archives) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if archives[lo] != name:
                    if source is not None:
                        source.close()
                    name = archives[lo]
                    source = store.open_input_file(f"{root}/{name}")
                for a, z in _ranges(offsets[lo:hi], lengths[lo:hi], RANGE_BYTES, GAP_BYTES):
                    start = int(offsets[lo + a])
                    block = source.read_at(int(offsets[lo + z - 1] + lengths[lo + z - 1]) - start, start)
                    rows: list[tuple] = []
                    for i in range(lo + a, lo + z):
                        headers, body = parse(zlib.decompress(block[int(offsets[i]) - start : int(offsets[i] + lengths[i]) - start], 31))
                        page = int(headers["warc-record-id"][len("<urn:page:") : -1])
                        kind = headers["warc-type"]
                        if kind == "response":
                            size, sha, refers = len(body), digest(body), None
                            if f"sha1:{sha}" != headers["warc-payload-digest"]:
                                raise ValueError(f"record {page}: payload does not fit its digest")
                        else:
                            size, sha = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                            refers = int(headers["warc-refers-to"][len("<urn:page:") : -1])
                        rows.append((page, headers["warc-target-uri"], size, sha, kind, refers, *([body] if payload else [])))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payload else []))
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    return step


def read_records(folder: str, index: DataFrame, payload: bool = False) -> DataFrame:
    """The records an index selects, read by coalesced byte ranges; with ``payload`` the content too (null payload: revisit's is empty)."""
    by_place = index.select("archive", "offset", "length").withColumn("part", F.expr(f"offset div {4 * RANGE_BYTES}"))
    total = by_place.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * RANGE_BYTES)))
    by_place = by_place.repartition(parts, "archive", "part").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return map_arrow(by_place, _read(folder, payload), RECORD + (", payload binary" if payload else ""))
