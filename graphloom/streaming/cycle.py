"""The generation cycle as a stream with carried state, a project a key.

A project's state is what a cycle needs of those before: the archive's niches, the
vectors of what was kept, the last novelties and the streak of erosion, the
baseline of similarity, and the session they belong to. Rows of another session
end the one before: its state goes, and the new one begins with nothing. What a
cycle does is what ``archive.ingest``, ``measure.similarity_limits`` and
``measure.erosion`` do to its rows in order.

A cycle's rows come in one batch; several cycles of a batch are taken in order, and
one that comes again (a number not above the last) is left out. Rows without a
vector are not kept. ``keep`` bounds what the state of a project holds: beyond it
vectors go, those of elites last and else the oldest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.measure import BASELINE, CEILING, HEALTHY, LEAST_SAMPLES, LEAST_SLOPE, LIMIT, MARGIN, PERSIST, QUICKER, WINDOW

KEEP = 2000
#: ``kind`` is ``placed``, a row for each candidate kept, or ``cycle``, a row a cycle.
OUT = "project string, session string, cycle long, kind string, id long, niche_id string, fitness double, novelty double, seq long, submitted long, kept long, mean_cosine double, similarity_limit double, too_similar boolean, streak long, eroding boolean"
NICHE = ("elite", "fitness", "novelty", "n", "seq")


def survivors(v: np.ndarray, known: np.ndarray, tau: float) -> np.ndarray:
    """Which rows a greedy pass in order keeps: none too like a known one or an earlier kept one."""
    kept: list[int] = []
    for i in range(len(v)):
        if (len(known) and (known @ v[i]).max() > tau) or (kept and (v[kept] @ v[i]).max() > tau):
            continue
        kept.append(i)
    return np.array(kept, int)


def novelties(v: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Mean distance of each row to its ``k`` nearest among the others and the known."""
    sim = np.round(np.concatenate([v @ v.T, v @ known.T], axis=1) if len(known) else v @ v.T, 12)
    sim[np.arange(len(v)), np.arange(len(v))] = -np.inf
    near = -np.sort(-sim, axis=1)[:, :k]
    some = np.isfinite(near)
    total = np.where(some, np.clip(1 - np.where(some, near, 0), 0, 2), 0).sum(axis=1)
    return np.round(np.where(some.any(axis=1), total / np.maximum(some.sum(axis=1), 1), 1.0), 6)


class Cycle(StatefulProcessor):
    def __init__(self, tau: float, k: int, keep: int):
        self.tau, self.k, self.keep = tau, k, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "session string, cycle long, streak long")
        self.niches = handle.getMapState("niches", "niche_id string", "elite long, fitness double, novelty double, n long, seq long")
        self.vectors = handle.getMapState("vectors", "id long", "v array<double>, seq long")
        self.recent = handle.getListState("recent", "novelty double")
        self.baseline = handle.getListState("baseline", "mean_cosine double")

    def _begin(self) -> None:
        for state in (self.niches, self.vectors, self.recent, self.baseline):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        session, cycle, streak = self.at.get() if self.at.exists() else (None, None, 0)
        # Sessions in the order of their first rows' ``seq``, cycles by number within them.
        first = frame.groupby("session", dropna=False)["seq"].transform("min")
        for (_, name, number), rows_ in frame.assign(_first=first).groupby(["_first", "session", "cycle"], dropna=False, sort=True):
            if name != session:
                self._begin()
                session, cycle, streak = name, None, 0
            if cycle is not None and number <= cycle:
                continue
            out, streak = self._one(rows_.sort_values("id"), streak)
            cycle = int(number)
            yield out.assign(project=key[0], session=session, cycle=cycle)[[c.split()[0] for c in OUT.split(", ")]]
        self.at.update((session, cycle if cycle is not None else -1, int(streak)))

    def _one(self, rows: pd.DataFrame, streak: int) -> tuple[pd.DataFrame, int]:
        known = [(k[0], v[0], v[1]) for k, v in self.vectors.iterator()]
        there = np.array([v for _, v, _ in known], float)
        good = rows[rows["v"].notna()]
        v = np.stack(good["v"].to_numpy()).astype(float) if len(good) else np.zeros((0, 1))
        kept = survivors(v, there, self.tau)
        good, v = good.iloc[kept], v[kept]
        new = novelties(v, there, self.k) if len(v) else np.zeros(0)
        for r, x, nov in zip(good.itertuples(), v, new, strict=True):
            self.vectors.updateValue((int(r.id),), (x.tolist(), int(r.seq)))
            self._place(r.niche_id, (int(r.id), float(r.fitness), float(nov), 1, int(r.seq)))
        self._bound()
        n = len(v)
        cosine = float((np.square(v.sum(axis=0)).sum() - np.square(v).sum()) / (n * (n - 1))) if n > 1 else None
        limit, similar = self._similarity(n, cosine)
        streak = self._erosion(float(new.mean()) if n else None, len(rows), rows["target"].max(), streak)
        placed = pd.DataFrame({"kind": "placed", "id": good["id"].astype("int64"), "niche_id": good["niche_id"], "fitness": good["fitness"].astype(float), "novelty": new, "seq": good["seq"].astype("int64")})
        said = pd.DataFrame({"kind": ["cycle"], "novelty": [float(new.mean()) if n else None], "submitted": [len(rows)], "kept": [n], "mean_cosine": [cosine], "similarity_limit": [limit], "too_similar": [similar], "streak": [streak], "eroding": [streak >= PERSIST]})
        both = [x.reindex(columns=[c.split()[0] for c in OUT.split(", ")]).astype(object).where(lambda y: y.notna(), None) for x in (placed, said)]
        return pd.concat(both, ignore_index=True) if len(placed) else both[1], streak

    def _place(self, niche: str, row: tuple) -> None:
        old = dict(zip(NICHE, self.niches.getValue((niche,)), strict=True)) if self.niches.containsKey((niche,)) else None
        if old is not None:
            better = (row[1], row[2], -row[4]) > (old["fitness"], old["novelty"], -old["seq"])
            row = (*(row[:3] if better else (old["elite"], old["fitness"], old["novelty"])), old["n"] + 1, row[4] if better else old["seq"])
        self.niches.updateValue((niche,), row)

    def _bound(self) -> None:
        held = [(k[0], v[1]) for k, v in self.vectors.iterator()]
        if len(held) > self.keep:
            elites = {v[0] for _, v in self.niches.iterator()}
            for i, _ in sorted(held, key=lambda x: (x[0] in elites, x[1]))[: len(held) - self.keep]:
                self.vectors.removeKey((i,))

    def _similarity(self, n: int, cosine: float | None) -> tuple[float, bool]:
        base = [x[0] for x in self.baseline.get()]
        calibrated = len(base) >= LEAST_SAMPLES
        limit = min(sum(base) / len(base) + MARGIN, CEILING) if calibrated else LIMIT
        similar = n >= 2 and cosine > limit
        if n >= 2 and not (calibrated and similar):
            self.baseline.put([(x,) for x in [*base, cosine][-BASELINE:]])
        return round(limit, 6), similar

    def _erosion(self, novelty: float | None, submitted: int, target: float, streak: int) -> int:
        recent = [x[0] for x in self.recent.get()]
        if novelty is not None:
            recent = [*recent, novelty][-WINDOW:]
            self.recent.put([(x,) for x in recent])
        quick = False
        if len(recent) == WINDOW and not (target > 0 and submitted < HEALTHY * target):
            middle = WINDOW // 2
            early, late = (recent[0] - recent[middle]) / middle, (recent[middle] - recent[-1]) / (WINDOW - 1 - middle)
            quick = late > LEAST_SLOPE and late >= (1 + QUICKER) * max(early, LEAST_SLOPE)
        return streak + 1 if quick else 0

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in the store that this needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def cycles(candidates: DataFrame, tau: float = 0.95, k: int = 5, keep: int = KEEP) -> DataFrame:
    """``OUT`` of a stream of ``project, session, cycle, id, v, niche_id, fitness,
    seq, target``. To be started within ``state_in_rocksdb``."""
    return candidates.groupBy("project").transformWithStateInPandas(Cycle(tau, k, keep), OUT, "append", "none")
