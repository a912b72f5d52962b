"""Helpers the training-data operators share.

Words everywhere are the maximal runs of ``[^\\x20\\x09-\\x0D]``. On bytes that
is exactly ``bytes.split()``, so Python code here works on UTF-8 bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a temporary one in
    local mode, where there is one machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: The tables written so far that nobody has released.
_MADE: list[str] = []


def release(spark: SparkSession, keep: tuple[str, ...] = (), since: int = 0) -> None:
    """Deletes the tables written after the first ``since``, but for those in
    ``keep``. For callers whose own results no longer need them."""
    jvm = spark.sparkContext._jvm
    for path in [p for p in _MADE[since:] if p not in keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def made() -> int:
    return len(_MADE)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: very long texts must not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(column: str | Column = "text") -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def word_count(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


class Bloom:
    """A Bloom filter of ``id`` with one hash, sized to the number of ids up to
    32 MB; what it lets through beyond them costs work, never a result."""

    MIN_BITS, MAX_BITS = 1 << 20, 1 << 28

    def __init__(self, ids: DataFrame):
        self.bits = self.MIN_BITS
        rows = ids.count()
        while self.bits < 16 * rows and self.bits < self.MAX_BITS:
            self.bits *= 2
        words = ids.select(self.slot().alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("x")).toPandas()
        found = np.zeros(self.bits >> 6, np.int64)
        found[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64)
        self.sent = ids.sparkSession.sparkContext.broadcast(found.view(np.uint64))

    def slot(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.bits))

    @staticmethod
    def has(sent, slots: pa.Array) -> np.ndarray:
        """Which of a batch's ``slot()`` values are in the broadcast filter."""
        s = slots.to_numpy(zero_copy_only=False)
        return ((sent.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, none for white space; and an odd base with its inverse modulo 2**64.
_NUMBERS = np.where(_IS_SPACE, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64)))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
HASH_BYTES = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of about HASH_BYTES that end at white space."""
    at = 0
    while len(text) - at > HASH_BYTES:
        end = re.compile(rb"[\x09-\x0d ]").search(text, at + HASH_BYTES)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: polynomials in the words'
    bytes, all of a piece of text at once, mixed with the words' lengths."""
    out = [np.empty(0, np.uint64)]
    for piece in _pieces(text or b""):
        b = np.frombuffer(piece, np.uint8)
        space = np.ones(len(b) + 2, bool)
        space[1:-1] = _IS_SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        if len(start):
            power, inverse = _powers(len(b))
            x = np.add.reduceat(_NUMBERS[b] * power[: len(b)], start) * inverse[start]
            out.append(mix64(x + mix64((end - start).astype(np.uint64))))
    return np.concatenate(out) if len(out) != 2 else out[1]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` consecutive words, by starting word."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        out = out * base + h[i : i + len(out)]
    return mix64(out)


def salted_rank(df: DataFrame, keys: list[str], ties: list[Column], rows: int, block_rows: int = 20_000) -> DataFrame:
    """``df`` with ``rank``: 1, 2, ... within ``keys``, without ever bringing a
    whole key together. Rows of a key are dealt by the hash of ``ties`` to
    blocks, ranked within their block and shifted by the blocks before it; a
    block gets about ``block_rows`` rows even when one key holds all ``rows``.
    """
    from pyspark.sql import Window

    n = max(1, -(-rows // block_rows))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*ties), F.lit(n)).cast("int")) if n > 1 else df.withColumn("_block", F.lit(0))
    blocks = dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*ties)
    ranked = dealt.withColumn("rank", F.row_number().over(inner))
    return ranked.join(blocks, [*keys, "_block"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_block", "_before")
