"""Toxicity by FTRL-proximal logistic regression over hashed features.

Features are the presence of word unigrams, bigrams and skip-grams (two words
with one between), lower-cased and stripped of punctuation, hashed to
``2**BITS`` slots. FTRL-proximal has a learning rate for each coordinate and
an L1 term, so most weights end at exactly zero; what is broadcast is the
non-zero ones. A single word has the value 1, an n-gram or skip-gram ``GRAM``:
there are far more of those, and few recur.

Null, empty and wordless texts have no feature and get the score of the bias.
Very long texts are scored whole; repeated rows get equal scores; a column
``score`` gives way. Repeated ids count once for training, with the least of
their feature lists. An empty table gives an empty table, and without labels
all scores are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, small_batches, text_bytes

BITS = 21
#: Slots of single words, before those of n-grams, and the value of the latter.
SINGLE, GRAM = 1 << (BITS - 1), 0.5
#: Most labelled documents read for training, and most features of one of them:
#: of longer ones those with the smallest hashes.
TRAIN_ROWS, TRAIN_FEATURES = 15_000, 20_000
ALPHA, BETA, L2 = 1.0, 1.0, 1.0
#: The L1 term is a share of the number of training rows: a feature has to recur
#: in that share of the sample to get a weight. Which share is chosen by folds
#: over the learning rows, the sparsest first.
L1_SHARES = (1 / 12, 1 / 24, 1 / 48, 1 / 96, 1 / 192, 1 / 384)
FOLDS, REPEATS, REPEAT_ROWS = 3, 6, 600
#: Most training rows that the folds divide; the share holds for all of them.
FOLD_ROWS = 3_000
EPOCHS, FOLD_EPOCHS = 5, 3
STRIP = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.strip(STRIP))
        return h


def slots(text: bytes | None, words: dict[bytes, int]) -> np.ndarray:
    """Slots of a text's features, repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.int64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    two, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [h, h[:-1] * two + h[1:], h[:-2] * skip + h[2:] + np.uint64(1)]
    found = [(p * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(65 - BITS)).astype(np.int64) for p in parts]
    return np.concatenate([found[0], SINGLE + found[1], SINGLE + found[2]])


def values(found: np.ndarray) -> np.ndarray:
    """The values of slots; the bias, beyond them all, has 1."""
    return np.where((found < SINGLE) | (found >> BITS > 0), 1.0, GRAM)


def sampled(found: np.ndarray) -> np.ndarray:
    """A document's distinct slots, at most TRAIN_FEATURES of them, sorted."""
    found = np.unique(found)
    if len(found) > TRAIN_FEATURES:
        found = np.sort(found[np.argsort(mix64(found.astype(np.uint64) + np.uint64(1)), kind="stable")[:TRAIN_FEATURES]])
    return found


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, share: float = L1_SHARES[2]) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, what each adds to a score where that is not zero, and the bias.
    ``share`` of the rows is the L1 term."""
    n_slots = 1 << BITS
    l1 = len(rows) * share
    z, n = np.zeros(n_slots + 1), np.zeros(n_slots + 1)
    positive = sum(y for _, y in rows)
    weight = (1.0, min(20.0, (len(rows) - positive) / positive)) if positive else (1.0, 1.0)

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(z[i]) <= l1] = 0.0
        return w

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, y = rows[k]
            w, x = weights(i), values(i)
            p = 1.0 / (1.0 + np.exp(-np.clip((w * x).sum(), -35, 35)))
            g = (p - y) * weight[y] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    every = np.arange(n_slots + 1)
    w = weights(every) * values(every)
    on = np.flatnonzero(w[:-1])
    return on.astype(np.int64), w[on].astype(np.float32), float(w[-1])


def ranked_right(scores: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a 1 and a 0 of which the 1 scores higher."""
    bad, good = np.sort(scores[y == 1]), np.sort(scores[y == 0])
    if not len(bad) or not len(good):
        return 0.5
    return float((np.searchsorted(good, bad) + np.searchsorted(good, bad, "right")).sum()) / (2 * len(bad) * len(good))


def best_share(spark: SparkSession, rows: list[tuple[np.ndarray, int]]) -> float:
    """The sparsest L1 share whose fits on folds rank the rows held back no worse
    than the best share's, by one standard error.

    A fit for each share, fold and repeat (of small samples several) is a row
    of a Spark job over FOLD_ROWS training rows at most.
    """
    rows = [rows[i] for i in np.sort(np.random.default_rng(0).permutation(len(rows))[:FOLD_ROWS])]
    positive = sum(y for _, y in rows)
    if min(positive, len(rows) - positive) < FOLDS:
        return L1_SHARES[2]
    repeats = max(1, min(REPEATS, REPEAT_ROWS // len(rows) + 1))
    work = [(k, i, f) for k in range(len(L1_SHARES)) for i in range(repeats) for f in range(FOLDS)]
    sent = spark.sparkContext.broadcast(rows)  # at most FOLD_ROWS * TRAIN_FEATURES slots of four bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        y = np.array([label for _, label in every])
        for b in batches:
            got = []
            for k, i, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fold = np.empty(len(every), int)
                for label in (0, 1):  # each fold its share of both kinds
                    at = np.random.default_rng(i).permutation(np.flatnonzero(y == label))
                    fold[at] = np.arange(len(at)) % FOLDS
                on, w, bias = train([r for r, g in zip(every, fold, strict=True) if g != f], FOLD_EPOCHS, L1_SHARES[k])
                table = np.zeros((1 << BITS) + 1)
                table[on] = w
                table[-1] = bias
                back = np.flatnonzero(fold == f)
                got.append(ranked_right(np.array([table[every[j][0]].sum() for j in back]), y[back]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["k", "right"])

    table = spark.createDataFrame(work, "k int, i int, f int").repartition(len(work))
    found = table.mapInArrow(run, "k int, right double").groupBy("k").agg(F.avg("right").alias("right"), (F.stddev_pop("right") / F.sqrt(F.count("*"))).alias("error")).collect()  # a row a share
    best = max(found, key=lambda r: r["right"])
    return L1_SHARES[min(r["k"] for r in found if r["right"] >= best["right"] - best["error"])]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most ``TRAIN_ROWS`` labelled rows, those with the smallest
    hashes of their ids; the executors hash the texts, the driver gets slots."""
    small_batches(docs.sparkSession)
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    picked = marked.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            got = [sampled(slots(t, words)).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["id", "y", "slots"])

    sample = docs.select(id_col, text_bytes(text_col).alias("_bytes")).join(F.broadcast(picked), id_col)
    rows = sample.select(F.col(id_col).cast("long").alias("id"), F.col("y").cast("int"), "_bytes").mapInArrow(run, "id long, y int, slots binary").groupBy("id", "y").agg(F.min("slots").alias("slots")).toPandas()
    rows = rows.sort_values(["id", "slots"])
    bias = np.array([1 << BITS], "<i4")
    sample = [(np.concatenate([np.frombuffer(s, "<i4"), bias]), int(y)) for s, y in zip(rows["slots"], rows["y"], strict=True)]
    return train(sample, share=best_share(docs.sparkSession, sample))


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``score``, 0 to 1, for whole texts."""
    spark = df.sparkSession
    small_batches(spark)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score",)]  # clashing names give way
    sent = spark.sparkContext.broadcast(model)  # at most 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, w, bias = sent.value
        table, words = np.zeros(1 << BITS, np.float32), _Words()
        table[on] = w
        for b in batches:
            got = []
            for t in b.column(b.num_columns - 1).to_pylist():
                i = slots(t, words)
                i = np.unique(i[table[i] != 0])
                got.append(1.0 / (1.0 + np.exp(-np.clip(float(np.sort(table[i].astype(np.float64)).sum()) + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return df.select(*keep, text_bytes(text_col).alias("_graphloom_bytes")).mapInArrow(run, df.select(*keep).schema.add("score", "double"))
