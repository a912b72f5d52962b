"""Removal of repeated passages by level-wise doubling.

A window is ``length`` consecutive words of one document. A word goes if a
window that covers it also starts in a document with a smaller id. Windows are
found level by level: at each level only a part of every window is hashed, of
``start`` words at first and of twice as many at the next, and windows whose
part occurs in one document alone are given up. What is left at the last
level, where the part is the whole window, is repeated. When no candidate
survives a level, there are no further levels.

The first part of a window is its minimiser, the ``start``-word part with the
smallest hash. Equal windows have equal minimisers, and neighbouring windows
mostly share theirs, so a level carries a fraction of the words' number of
hashes. Texts never move between levels: a level leaves a filter of the
parts that are repeated, which the next one asks while it reads the texts
where they are. The filter has a bit for each value of a hash, at most
``MAX_BITS`` of them (32 MB); where more parts are repeated than it can tell
apart, windows go on to the next level in vain, and none is lost. Before the
last level a task sends each part with two ids at most, however often it is
repeated. Only texts that lose words are brought together with the windows
they lose; all others are finished where they are read.

Null texts have no word. Documents with a null id are left whole and make no
other document lose words; rows with one id are no copies of each other.
Empty tables give empty tables; very long texts are worked on one at a time.
Words are compared by 64-bit hashes of windows, not once more as words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, small_batches, stored, text_bytes, windows, word_hashes
from .packed import SCHEMA, by_bucket, by_id, groups, packed, partitions_for, turned

LENGTH, START = 13, 3
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
OUT = "id long, n_words long, n_removed long, kept_sha256 string, text binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def levels(length: int = LENGTH, start: int = START) -> list[int]:
    """Part lengths: ``start``, doubled until the window's length is reached."""
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def anchors(h: np.ndarray, length: int, start: int) -> np.ndarray:
    """Of each window, where its minimiser starts."""
    part, width = windows(h, start), length - start + 1
    n = len(part) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, span = np.arange(len(part)), 1
    while span < width:  # the smallest of twice as many, or of the last ones
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(part[left] <= part[right], left, right)
        span += step
    return at


def begins(at: np.ndarray, length: int, size: int) -> np.ndarray:
    """Where each window's part of ``size`` words begins: at the window's anchor,
    or earlier where it would reach past the end."""
    return np.minimum(at, np.arange(len(at)) + length - size)


def _among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter has; a key's slot is its upper bits."""
    slot = keys >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _filter(slices: DataFrame, bits: int) -> np.ndarray | None:
    """The filter from its slices by bucket; None if it has nothing."""
    out = np.zeros(bits >> 6, np.uint64)
    for r in slices.toLocalIterator():
        words = np.frombuffer(r["bits"], np.uint64)
        out[r["first"] : r["first"] + len(words)] |= words
    return out if out.any() else None


def _finished(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def substring_dedup(df: DataFrame, length: int = LENGTH, start: int = START, text_col: str = "text", id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and, if asked for, those words as ``text``."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    sizes = levels(length, start)
    chars = df.agg(F.sum(F.length(text_col))).first()[0] or 0
    pairs = chars / 5 * 2 / (length - sizes[0] + 2)
    partitions = partitions_for(pairs)
    bits = MIN_BITS
    while bits < 8 * pairs and bits < MAX_BITS:
        bits *= 2

    def level(k: int, before) -> DataFrame:
        """The parts of level k of windows that the one before let through."""

        def emit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            keys, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                h = word_hashes(text)
                at = anchors(h, length, sizes[0])
                if not len(at):
                    continue
                here, last = begins(at, length, sizes[k]), begins(at, length, sizes[max(k - 1, 0)])
                # Neighbouring windows mostly have the same parts.
                new = np.ones(len(at), bool)
                new[1:] = (here[1:] != here[:-1]) | (last[1:] != last[:-1])
                p = windows(h, sizes[k])[here[new]]
                if k:
                    p = p[_among(before.value, windows(h, sizes[k - 1])[last[new]])]
                p = np.unique(p)
                keys.append(p)
                ids.append(np.full(len(p), doc, np.int64))
            return np.concatenate(keys), np.concatenate(ids)

        return packed(docs, emit, partitions, only_ends=k < len(sizes) - 1)

    def slices(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts, _ = groups(keys)
        ends = np.append(starts[1:], len(keys)) - 1
        slot = keys[starts[ids[starts] != ids[ends]]] >> np.uint64(64 - bits.bit_length() + 1)
        if len(slot):
            word = (slot >> np.uint64(6)).astype(np.int64)
            out = np.zeros(word[-1] - word[0] + 1, np.uint64)
            np.bitwise_or.at(out, word - word[0], np.uint64(1) << (slot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array([word[0]], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["first", "bits"])

    def repeated(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            starts, run = groups(keys)
            on = ids > ids[starts][run]
            if on.any():
                yield turned(keys[on], ids[on], partitions)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, hit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                if hit is not None:
                    at = np.flatnonzero(np.isin(windows(word_hashes(text), length), np.frombuffer(hit, np.uint64)))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if with_text else None
                rows.append((doc, *_finished(words, gone), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    before, survive = None, True
    for k in range(len(sizes) - 1):
        found = _filter(by_bucket(level(k, before), slices, "first long, bits binary", partitions), bits)
        if before is not None:
            before.unpersist()
        if found is None:
            survive = False
            break
        before = spark.sparkContext.broadcast(found)
    whole = F.lit(None).cast("binary").alias("keys")
    if not survive:
        out = docs.select("id", "text", whole).mapInArrow(settle, OUT)
    else:
        lost = stored(by_id(by_bucket(level(len(sizes) - 1, before), repeated, SCHEMA, partitions), partitions), "substring-lost")
        bloom = Bloom(lost.select("id"))
        sent = bloom.sent

        def only(loses: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    ids = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                    on = (Bloom.has(sent, b.column(2)) & ids) == loses
                    yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(on)) for i in (0, 1)], names=["id", "text"])

            return run

        slotted = docs.select("id", "text", bloom.slot().alias("slot"))
        here = slotted.mapInArrow(only(False), "id long, text binary").select("id", "text", whole)
        moved = slotted.mapInArrow(only(True), "id long, text binary").join(lost, "id", "left").select("id", "text", "keys")
        out = here.mapInArrow(settle, OUT).unionByName(moved.mapInArrow(settle, OUT))
    text = [F.col("text").cast("string").alias("text")] if with_text else []
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *text)
