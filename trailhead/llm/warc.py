"""WARC archives, index first.

Writing: a task appends its records, each a gzip member of its own, to one archive in the shared folder, and returns an
index row for each (file, offset, length, URL, digest).  The index is a table committed by Spark and names the files, so
an archive of an attempt that was lost is simply never named.  Reading: the selected index rows are dealt out in ranges
of (file, offset) and sorted; neighbouring byte ranges are coalesced into one read.

Of records with equal payloads of at least ``MIN_BYTES`` the one with the smallest id is a response; the others are
revisits, which carry the HTTP head (with the payload's length) and the payload's digest, but not the payload.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

MIN_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
#: Reads are joined over gaps of at most GAP bytes, up to SPAN bytes.
GAP, SPAN = 1 << 16, 8 << 20
#: An archive is closed beyond this size and the task begins another.
ROLL = 1 << 30
_INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string"
_RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the id that a revisit refers to, null for responses.

    Null html is an empty payload.  Rows with the group's smallest id are responses, repeated rows too; a null id is
    never the smallest, and a group of null ids only has responses.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    twice = (
        base.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    known = runtime.lookup(base, twice, "digest", "n", pages.count(), "left", plain=0)  # no task gets all payloads of a digest
    return known.withColumn("first", F.when((F.col("page_id") == F.col("first")) | F.col("first").isNull(), F.lit(None)).otherwise(F.col("first")))


def _record(page_id, url, payload: bytes, digest: str, first) -> tuple[bytes, str]:
    kind = "response" if first is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the archives below ``folder`` (seen by all executors); returns the stored index."""

    def f(batches):
        fs, top = runtime.fs_of(folder)
        out, at, path = None, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first"))):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, at, out = f"{folder.rstrip('/')}/{name}", 0, fs.open_output_stream(f"{top.rstrip('/')}/{name}", compression=None)
                raw, kind = _record(page_id, url, payload, digest, first)
                member = gzip.compress(raw, 1, mtime=0)
                out.write(member)
                rows.append((path, at, len(member), url, digest, page_id, kind))
                at += len(member)
                if at >= ROLL:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(_INDEX))], _names(_INDEX))
        if out is not None:
            out.close()

    runtime.tune(planned.sparkSession)
    return runtime.stored(planned.select("page_id", "url", "payload", "digest", "first").mapInArrow(f, _INDEX), "warc-index")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _types(schema: str) -> list:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return [kinds[x.split()[1]] for x in schema.split(", ")]


def parse(raw: bytes) -> tuple:
    """A record's (page_id, url, type, payload or None, payload length, digest, refers_to); wrong digests raise."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        payload = None
    own, refers = (re.search(r"-?\d+", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return own and int(own[0]), fields.get("WARC-Target-URI"), kind, payload, size, digest, refers and int(refers[0])


def ranges(rows, gap: int = GAP, span: int = SPAN):
    """Groups of index rows (path, offset, length), sorted, that one read serves."""
    group, end = [], 0
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - end > gap or row[1] + row[2] - group[0][1] > span):
            yield group
            group = []
        group.append(row)
        end = row[1] + row[2]
    if group:
        yield group


def read(index: DataFrame) -> DataFrame:
    """The records of the index rows (any selection of them), by coalesced range reads."""
    n = runtime.partitions(index.sparkSession)
    runtime.tune(index.sparkSession)
    dealt = index.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")

    def f(batches):
        opened, handle = None, None
        for batch in batches:
            for group in ranges(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")))):
                path, start = group[0][:2]
                if path != opened:
                    if handle:
                        handle.close()
                    fs, p = runtime.fs_of(path)
                    opened, handle = path, fs.open_input_file(p)
                data = handle.read_at(group[-1][1] + group[-1][2] - start, start)
                rows = [parse(gzip.decompress(data[o - start : o - start + k])) for _, o, k in group]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(_RECORD))], _names(_RECORD))
        if handle:
            handle.close()

    return dealt.mapInArrow(f, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payload of every revisit fetched from the response that it refers to."""
    full = records.where("record_type = 'response'").select(F.col("page_id").alias("_of"), F.col("payload").alias("_full"), F.col("payload_digest").alias("_digest")).dropDuplicates(["_of", "_digest"])
    met = records.join(full, (records.refers_to == full._of) & (records.payload_digest == full._digest), "left")
    return met.withColumn("payload", F.coalesce("payload", "_full")).drop("_of", "_full", "_digest")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    return read(write(plan(pages), runtime.work_path(spark, "warc")))
