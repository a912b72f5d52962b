"""A compact shuffle of (64-bit key, id) pairs.

Millions of pairs cost far less as a few rows of packed arrays than as a row
each. A task gathers pairs, sorts them by bucket and emits, per bucket, one
row with the bucket's keys and ids. The receiving task sorts a bucket by key.
The number of partitions follows the number of pairs, so that a bucket has
some hundred thousand of them. One key's pairs are at most one per document
and meet in one task, as 16 bytes each; where only the ends of a key's ids
matter, ``packed`` sends no more than those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FLUSH = 500_000
PAIRS_PER_PARTITION = 500_000
BUCKETS_PER_PARTITION = 4
#: Beyond this partitions grow; buckets are told apart by 24 bits of the key.
MAX_PARTITIONS = 1_000_000
SCHEMA = "bucket int, high binary, low binary, first long, ids binary"


def partitions_for(pairs: float) -> int:
    """Partitions so that each gets a bounded number of ``pairs``. No more than
    that: a task sends a row to each bucket it has pairs for."""
    return min(MAX_PARTITIONS, int(pairs / PAIRS_PER_PARTITION) + 1)


def rows_of(keys: np.ndarray, ids: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Pairs as rows of SCHEMA, one per bucket."""
    buckets = partitions * BUCKETS_PER_PARTITION
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, ids = bucket[order], keys[order], ids[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(bucket)]])
    cut = list(zip(starts.tolist(), ends.tolist(), strict=True))
    high, low = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    step = np.diff(ids, prepend=ids[:1])
    step[starts] = 0
    small = bool(len(step)) and step.min() >= -(1 << 31) and step.max() < 1 << 31
    step = step.astype(np.int32) if small else step
    # The upper bytes of the keys vary little within a bucket and compress away.
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([high[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()), pa.array(ids[starts], pa.int64()), pa.array([step[a:b].tobytes() for a, b in cut], pa.binary())], names=["bucket", "high", "low", "first", "ids"])


def ends(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the pairs with the smallest and the largest id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    edge = np.ones(len(keys) + 1, bool)
    edge[1:-1] = keys[1:] != keys[:-1]
    on = edge[:-1] | (edge[1:] & (ids != ids[groups(keys)[0]][groups(keys)[1]]))
    return keys[on], ids[on]


def packed(df: DataFrame, pairs: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], partitions: int, only_ends: bool = False) -> DataFrame:
    """``pairs`` maps a batch to keys (uint64) and ids (int64) of one length.

    Keys travel as arrays of their upper and lower halves, ids as differences,
    so that what varies little within a bucket compresses away. With
    ``only_ends`` a task sends a key with its smallest and largest id alone.
    """

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids = map(np.concatenate, zip(*held, strict=True))
        return rows_of(*(ends(keys, ids) if only_ends else (keys, ids)), partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            keys, ids = pairs(b)
            held.append((keys, ids))
            n += len(keys)
            if n >= FLUSH:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return df.mapInArrow(run, SCHEMA)


def by_bucket(df: DataFrame, use: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, partitions: int) -> DataFrame:
    """``use`` gets each bucket's keys and ids, sorted by key and then id, once
    each, and yields batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            yield from use(keys[new], ids[new])

        at, parts = None, []
        for b in batches:
            for bucket, high, low, first, step in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at and parts:
                    yield from done(parts)
                    parts = []
                at = bucket
                keys = np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32).astype(np.uint64)
                steps = np.frombuffer(step, np.int32 if len(step) == len(high) else np.int64)
                parts.append((keys, first + np.cumsum(steps, dtype=np.int64)))
        if parts:
            yield from done(parts)

    return df.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and each element's run."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


#: An odd number and its inverse modulo 2**64: ids spread over the buckets and back.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 1 << 64)


def turned(keys: np.ndarray, ids: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Pairs packed the other way round, to be brought together by id."""
    spread = ids.view(np.uint64) * np.uint64(SPREAD)
    order = np.argsort(spread, kind="stable")
    return rows_of(spread[order], keys.view(np.int64)[order], partitions)


def by_id(df: DataFrame, partitions: int) -> DataFrame:
    """``id, keys``: one row per id, from pairs packed by ``turned``."""

    def use(spread: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, _ = groups(spread)
        ends = np.append(starts[1:], len(spread))
        ids = (spread[starts] * np.uint64(UNSPREAD)).view(np.int64)
        for i in range(0, len(starts), 1000):
            cut = zip(starts[i : i + 1000].tolist(), ends[i : i + 1000].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1000], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary())], names=["id", "keys"])

    return by_bucket(df, use, "id long, keys binary", partitions)
