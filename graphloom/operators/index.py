"""A vector index: an inverted file of pivots, and joins that prove what they skip.

Pivots are fitted on a bounded sample; every row goes to the cell of its nearest
pivot, and a cell's rows, by their angle to it, to blocks of ``BLOCK`` rows. For
a query at angle t to a pivot, rows at angles a to b from it are at least
max(t - b, a - t) away, so no row of the block can be more similar than the
cosine of that. A search takes the cells of the nearest pivots first and then,
if it has to be exact, all blocks that could still hold a nearer row than the
k-th found. Queries and blocks are dealt by hash to packs, and each two packs
meet once, in chunks of ``CHUNK`` queries: a vector travels once for a pack,
however many of its blocks are compared, and no crowded cell is one task's.

Rows are ``id, v``: distinct long ids and arrays of one length, not null; of any
norm (similarity is the dot product, the cosine for unit vectors). Zero vectors
are as similar as 0 to everything. Ties go to the smaller id. Equal vectors are
rows like others. Without rows nothing is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import stored

BLOCK, CHUNK, ROWS_PER_CELL = 32, 256, 64
#: Pairs of packs, bytes of a pack and of a block, and rows compared with a chunk at once.
TILES, PACK_BYTES, BLOCK_BYTES, STRIP = 64, 64 << 20, 16 << 10, 4096
#: Bytes of sampled rows and of pivots, which the driver holds and sends.
SAMPLE_BYTES, PIVOT_BYTES = 64 << 20, 16 << 20
ROUNDS, PROBES = 6, 8
#: Angles are taken to be this much smaller than computed.
SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ pivots.T, -1, 1))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype("<f8")


def _parts(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        for i in range(0, len(f), rows):
            yield f.iloc[i : i + rows]


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit vectors: spherical k-means on the sample, from rows spread over it."""
    m = _unit(sample)
    pivots = m[np.linspace(0, len(m) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        cell = np.concatenate([np.argmax(m[i : i + 1024] @ pivots.T, axis=1) for i in range(0, len(m), 1024)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, m)
        pivots = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), pivots)
    return pivots


class VectorIndex:
    """``blocks``: a table of the rows in blocks, each with its cell and the least
    and greatest angle and norm of its rows; and ``pivots``."""

    def __init__(self, rows: DataFrame, rows_per_cell: int = ROWS_PER_CELL):
        spark = rows.sparkSession
        base = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        self.rows, self.dims = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        most = max(2, SAMPLE_BYTES // (8 * self.dims))
        sample = base.orderBy(F.xxhash64("id"), "id").limit(min(most, 16 * max(1, self.rows // rows_per_cell))).toPandas()
        n = max(1, min(self.rows // rows_per_cell, len(sample) // 2, PIVOT_BYTES // (8 * self.dims)))
        pivots = fit_pivots(_stack(sample["v"]), n) if len(sample) else np.zeros((1, self.dims))
        self.pivots = pivots
        sent = spark.sparkContext.broadcast(pivots)

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _parts(frames, 512):
                m = _stack(f["v"])
                a = _angles(m, sent.value)
                cell = np.argmin(a, axis=1)
                yield f.assign(cell=cell.astype(np.int32), angle=a[np.arange(len(f)), cell])

        most = max(1, min(BLOCK, BLOCK_BYTES // (8 * self.dims)))

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for cell, g in f.groupby("cell", sort=False):
                    for i in range(0, len(g), most):
                        x = g.iloc[i : i + most]
                        m = _stack(x["v"])
                        norm = np.linalg.norm(m, axis=1)
                        yield pd.DataFrame({"cell": [cell], "low": [x["angle"].min()], "high": [x["angle"].max()], "least": [norm.min()], "most": [norm.max()], "ids": [x["id"].to_numpy()], "m": [m.tobytes()]})

        cells = base.mapInPandas(placed, "id long, v array<double>, cell int, angle double")
        # Ids come last in the order: rows of one angle, however many, are split too.
        dealt = cells.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")
        blocks = dealt.mapInPandas(packed, "cell int, low double, high double, least double, most double, ids array<long>, m binary")
        self.blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "index")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """``q, p, id, v, floor``: each query, of a pack q of them, for each pack p of
        blocks. There are ``TILES`` pairs of packs, or more where packs would exceed
        ``PACK_BYTES``, so what travels grows with the rows and not with their square."""
        n, size = queries.count(), 8 * self.dims
        tiles = max(1, min(TILES, self.rows // BLOCK))
        qs = max(-(-n * size // PACK_BYTES), min(tiles, round((tiles * n / max(1, self.rows)) ** 0.5)), 1)
        ps = max(-(-self.rows * size // PACK_BYTES), -(-tiles // qs), 1)
        dealt = queries.select(F.pmod(F.xxhash64("id"), F.lit(qs)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(ps - 1))).alias("p"), "id", "v", "floor")
        self._packs = qs, ps
        return dealt

    def _compared(self, asked: DataFrame, ways: tuple[Callable, Callable]) -> DataFrame:
        """``id, other, cosine``: of each query's similarities with the blocks that the
        first of ``ways`` takes (from bounds by block, angles by pivot, the blocks'
        cells and floors) what the second keeps. A task holds a pack of blocks and a
        chunk of queries; rows come one by one, so no batch of them is large."""
        choose, keep = ways
        qs, ps = self._packs
        sent = asked.sparkSession.sparkContext.broadcast(self.pivots)
        no = lambda t, c: F.lit(None).cast(t).alias(c)
        heads = ("cell", "low", "high", "least", "most")
        pack = F.pmod(F.xxhash64("block"), F.lit(ps)).cast("int").alias("p")
        held = self.blocks.select(F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("q"), pack, F.lit(0).alias("kind"), no("long", "id"), no("array<double>", "v"), no("double", "floor"), *heads, "ids", "m")
        come = asked.select("q", "p", F.lit(1).alias("kind"), "id", "v", "floor", *[F.lit(None).alias(h) for h in heads], no("array<long>", "ids"), no("binary", "m"))
        rows = held.unionByName(come).repartition(qs * ps, "q", "p").sortWithinPartitions("q", "p", "kind")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, at, blocks, pack = sent.value, None, [], None
            for frame in frames:
                for key, g in frame.groupby(["q", "p", "kind"]):
                    if key[:2] != at:
                        at, blocks, pack = key[:2], [], None
                    if key[2] == 0:
                        blocks.append(g[[*heads, "ids", "m"]])
                        continue
                    if blocks:
                        x = pd.concat(blocks)
                        ids = [np.asarray(i) for i in x["ids"]]
                        pack = x[list(heads)].to_numpy(float), np.repeat(np.arange(len(x)), [len(i) for i in ids]), np.concatenate(ids), np.frombuffer(b"".join(x["m"])).reshape(-1, pivots.shape[1])
                        blocks = []
                    if pack is None:
                        continue  # no blocks, so nothing to find
                    stats, of, ri, rm = pack
                    cell = stats[:, 0].astype(int)
                    for f in _parts(iter([g]), CHUNK):
                        m = _stack(f["v"])
                        norm, floor = np.linalg.norm(m, axis=1)[:, None], f["floor"].to_numpy(dtype=float, na_value=np.nan)[:, None]
                        angle = _angles(m, pivots)
                        on = choose(most_similar(angle[:, cell], norm, *stats[:, 1:].T), angle, cell, floor)
                        some = np.flatnonzero(on.any(axis=0)[of])
                        # So many rows at a time that similarities stay small.
                        for i in range(0, len(some), STRIP):
                            y = some[i : i + STRIP]
                            sim = np.where(on[:, of[y]], np.round(m @ rm[y].T, 12), -np.inf)
                            qi, r = f["id"].to_numpy(), ri[y]
                            a, b = keep(sim, qi, r)
                            yield pd.DataFrame({"id": qi[a], "other": r[b], "cosine": sim[a, b]})

        return rows.mapInPandas(run, "id long, other long, cosine double")

    def knn(self, queries: DataFrame, k: int, exact: bool = True, probes: int = PROBES) -> DataFrame:
        """``id, other, cosine, k``: the ``k`` rows most similar to each query,
        itself excluded, among the cells of its ``probes`` nearest pivots or, if
        ``exact``, among all."""
        q = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        by = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")

        def nearest(bound: np.ndarray, angle: np.ndarray, cell: np.ndarray, floor: np.ndarray) -> np.ndarray:
            on = np.zeros(angle.shape, bool)
            np.put_along_axis(on, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
            return on[:, cell]

        def others(bound: np.ndarray, angle: np.ndarray, cell: np.ndarray, floor: np.ndarray) -> np.ndarray:
            return ~nearest(bound, angle, cell, floor) & (np.isnan(floor) | (bound + SLACK >= floor))

        def best(sim: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sim[qi[:, None] == ri[None]] = -np.inf
            least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k] if k < sim.shape[1] else -np.inf
            x, y = np.nonzero((sim >= least) & np.isfinite(sim))
            order = np.lexsort((ri[y], -sim[x, y], x))
            x, y = x[order], y[order]
            on = np.arange(len(x)) - np.searchsorted(x, x) < k  # of a query's, in order
            return x[on], y[on]

        def top(found: DataFrame) -> DataFrame:
            return found.withColumn("k", F.row_number().over(by)).where(F.col("k") <= k)

        first = top(self._compared(self._asked(q.withColumn("floor", F.lit(None).cast("double"))), (nearest, best)))
        if not exact:
            return first
        first = stored(first, "nearest")
        floor = first.groupBy("id").agg(F.max("k").alias("n"), F.min("cosine").alias("c")).where(F.col("n") == k).select("id", F.col("c").alias("floor"))
        more = self._compared(self._asked(q.join(floor, "id", "left").select("id", "v", "floor")), (others, best))
        return top(first.drop("k").unionByName(more))

    def probes_for(self, rows: DataFrame, k: int, recall: float = 0.95, queries: int = 128) -> int:
        """The least number of cells that would have held ``recall`` of the true
        neighbours of a few ``rows``, those with the least hashes of their ids."""
        q = rows.orderBy(F.xxhash64("id"), "id").limit(queries)
        near = self.knn(q, k).select("id", "other")
        v = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        both = near.join(v, "id").join(v.toDF("other", "w"), "other").toPandas()  # queries * k rows
        if not len(both):
            return 1
        a, home = _angles(_stack(both["v"]), self.pivots), np.argmin(_angles(_stack(both["w"]), self.pivots), axis=1)
        rank = np.sort((a < a[np.arange(len(both)), home][:, None]).sum(axis=1)) + 1
        return int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)])

    def pairs_over(self, rows: DataFrame, tau: float) -> DataFrame:
        """``a, b``, a < b, of the index's ``rows`` with a similarity above ``tau``."""
        q = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(float(tau)).alias("floor"))
        could = lambda bound, angle, cell, floor: bound + SLACK >= tau
        over = lambda sim, qi, ri: np.nonzero((sim > tau) & (qi[:, None] < ri[None]))
        return self._compared(self._asked(q), (could, over)).select(F.col("id").alias("a"), F.col("other").alias("b"))


def most_similar(angle: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What no row of a cell exceeds, for queries at ``angle`` to its pivot."""
    c = np.cos(np.maximum(0.0, np.maximum(angle - high, low - angle) - SLACK))
    return norm * np.maximum(c * most, c * least)
