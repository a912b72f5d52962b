"""WARC archives: a writer with deduplicated payloads and a splittable reader.

The writer puts one gzip member per record (WARC/1.1). Of records with equal
payloads, of at least ``min_bytes``, the one with the smallest id is a
``response`` and the others are ``revisit`` records that refer to it.

The reader's tasks each get a byte range of a file. A task looks for gzip's
magic from the start of its range and validates each place by decoding the
member and reading a WARC header; another such member or the end of the file
must follow, so a record stored inside a record is not taken for one. From the
first valid one it follows the chain of members. It owns the records that
start inside its range, however far they reach past its end, so ranges may cut
anywhere. A chain that breaks is an error, unless ``strict`` is false: then the
reader looks for the next member. ``round_trip`` compares the number of records
read with that of rows written.

Null payloads count as empty. Rows with one id and equal payloads are all
responses; rows with a null id are written with an empty id and are responses,
unless another row has their payload. Empty tables give no file. A record is
held in memory whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, stored

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
SPLIT_BYTES = 8 << 20
MAX_TASKS = 50_000
#: Payloads with one in so many rows or more are hot: all tasks are told of them.
HOT = 1000


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "") if c.isprintable())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes archives under ``path`` and returns the manifest: ``file``, ``bytes`` and ``records``.

    A task writes a file under a name of its own and the manifest, written
    last, names the files of the attempts that counted; files of lost or
    repeated attempts are never read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sha = F.sha1(payload)
    first = pages.where(F.length(payload) >= min_bytes).groupBy(sha.alias("_sha")).agg(F.min(id_col).cast("long").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first, rows = stored(first, "warc-first"), pages.count()
    hot = F.broadcast(first.where(F.col("_n") * HOT >= rows).select("_sha", "_first"))  # at most HOT rows
    cold = first.where(F.col("_n") * HOT < rows).select("_sha", "_first")
    fields = "id long, url string, member binary, _sha string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            made = [member(i, u, p, sha1_base32(p), None, False) for i, u, p, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), b.column(3)], names=["id", "url", "member", "_sha"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("p"), sha.alias("_sha"))
    # Compressed members shuffle, not pages; one that turns out a revisit is made anew, from its header.
    members = source.mapInArrow(pack, fields)
    rest = members.join(hot, "_sha", "left_anti").join(cold, "_sha", "left")
    joined = members.join(hot, "_sha").unionByName(rest).select("id", "url", "member", "_first")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, count = None, "", 0, 0
        for b in batches:
            for i, url, m, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ref is not None and ref != i:
                    full = parse(zlib.decompress(m, 31))
                    m = member(i, url, full["payload"], full["digest"], ref, True)
                if out is None:
                    fs, at = filesystem(path)
                    fs.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                out.write(m)
                size, count = size + len(m), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["file", "bytes", "records"])

    manifest = f"{path}/_manifest"
    joined.mapInArrow(store, "file string, bytes long, records long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def parse(record: bytes) -> dict:
    """A decoded member's header fields and payload; ValueError if it is no record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"id": number(h.get("warc-record-id")), "type": h.get("warc-type"), "url": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest", "")[5:], "refers_to": number(h.get("warc-refers-to")), "payload": payload, "payload_bytes": length}


def _decode(read, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and the offset after it, or None."""
    z, out, seen = zlib.decompressobj(31), [], 0
    pos = at
    while not z.eof:
        chunk = read(pos, READ_BYTES)
        if not chunk:
            return None
        pos += len(chunk)
        try:
            out.append(z.decompress(chunk))
        except zlib.error:
            return None
        if not seen and sum(map(len, out)) >= 5:
            seen = 1
            if not b"".join(out)[:5] == b"WARC/":
                return None
    return b"".join(out), pos - len(z.unused_data)


def _record(read, at: int) -> tuple[dict, int] | None:
    """The record whose member starts at ``at`` and the offset after it, or None."""
    got = _decode(read, at)
    try:
        return got and (parse(got[0]), got[1])
    except (ValueError, KeyError):
        return None


def records(read, start: int, end: int, strict: bool = True) -> Iterator[dict]:
    """Records that start in [start, end); ``read(offset, n)`` gives bytes of the file."""
    at, synced = start, start == 0
    while at < end:
        if not synced:
            window = read(at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
            hit = window.find(MAGIC)
            if hit < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                if len(window) < len(MAGIC):
                    return
                continue
            at += hit
            if at >= end:
                return
        got = _record(read, at)
        if got is not None and (synced or not read(got[1], 1) or _record(read, got[1]) is not None):
            yield got[0]
            at, synced = got[1], True
            continue
        if synced and not read(at, 1):
            return
        if synced and strict:
            raise ValueError(f"no WARC record at byte {at}")
        at, synced = at + 1, False


def read(spark: SparkSession, path: str, manifest: DataFrame | None = None, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of the archives that the manifest names, by byte ranges of at most
    ``split_bytes``: id, url, type, digest, payload_bytes, refers_to and payload
    (of responses), with ``valid``: the payload has the digest it is said to have.
    """
    manifest = spark.read.parquet(f"{path}/_manifest") if manifest is None else manifest
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("file", "bytes", starts.alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("bytes"), F.col("start") + split_bytes).alias("end"))
    number = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(number), MAX_TASKS))  # a task a range, if they are not too many
    schema = "id long, url string, type string, digest string, payload_bytes long, refers_to long, valid boolean, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for name, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(f"{at}/{name}") as f:

                    def bytes_at(offset: int, n: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(n)

                    rows, held = [], 0
                    for r in records(bytes_at, start, end, strict):
                        valid = r["type"] == "revisit" or (sha1_base32(r["payload"]) == r["digest"] and len(r["payload"]) == r["payload_bytes"])
                        rows.append([r["id"], r["url"], r["type"], r["digest"], r["payload_bytes"], r["refers_to"], valid, r["payload"] if with_payload and r["type"] == "response" else None])
                        held += len(r["payload"]) if with_payload else 100
                        if held >= READ_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return ranges.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    manifest = write(pages, path, min_bytes=min_bytes)
    back = stored(read(pages.sparkSession, path, manifest, with_payload=False), "warc-read")
    written, found = manifest.agg(F.sum("records")).first()[0] or 0, back.count()
    if written != found:
        raise ValueError(f"{written} WARC records written, {found} read")
    return back


def checked(valid: Column, value: Column) -> Column:
    """``value``, or an error where a record read back isn't what was written."""
    return F.when(valid, value).otherwise(F.raise_error(F.lit("a WARC payload differs from its digest")).cast("string"))
