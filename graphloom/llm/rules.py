"""Quality by a sparse ensemble of rules.

A random forest of shallow trees is grown on statistics of labelled texts, a
task a tree. Each path from a root is a rule: a conjunction of bounds on
statistics. Lasso logistic regression over all rules, its penalty chosen on
rows held back, leaves few with a weight, and those become one Spark column
expression over the statistics, by which every text is scored.

Null, empty and wordless texts have statistics of zero and are scored like any
other; texts are read whole. Equal texts get equal scores. Repeated ids count
once for training, by their least statistics and greatest label. Columns that
clash with the results give way. An empty table gives an empty table. Labels of
one kind alone, or none, give every text the share of ones, (ones + 1) / (rows
+ 2).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, windows, word_hashes

#: Most labelled documents read for training: those with the least hashes of their ids.
TRAIN_ROWS = 15_000
TREES, DEPTH, SHARE, BINS, LEAST_LEAF = 40, 3, 0.7, 32, 2
#: Penalties tried on held-back learning rows, the sparsest first, times sqrt(log rules / rows).
PENALTIES = (0.2, 0.05, 0.0125, 0.003)
FOLDS, STEPS = 3, 400
BLOCK = 50
STATISTICS = [
    "words", "word_chars", "long_words", "short_words", "symbols", "upper", "digits", "marks", "cries", "lines_words", "single_lines",
    "ended_lines", "dup_lines", "again", "distinct", "repeated", "repeated_3",
]
#: Kinds of bytes: white space, continuation, capital, digit, symbol, mark, cry, anything else.
_KIND = np.full(256, 7)
for _k, _bytes in enumerate((b"\t\n\v\f\r ", bytes(range(128, 192)), bytes(range(65, 91)), b"0123456789", b"#*$%&|<>{}[]~^=_@\\/+`", b".,;:'\"()-", b"!?")):
    _KIND[list(_bytes)] = _k


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of a text, all but the first as shares or means, so that they
    do not follow its length."""
    text = text or b""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return [0.0] * len(STATISTICS)
    b = np.frombuffer(text, np.uint8)
    kind = np.bincount(_KIND[b], minlength=8)
    chars = int(kind[2:].sum()) or 1  # lead bytes outside white space
    letters = int(kind[2] + kind[7]) or 1
    size = np.array([len(w) for w in text.split()])
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    per_line = np.array([x.count(b" ") + 1 for x in lines])
    full = h[: n // BLOCK * BLOCK].reshape(-1, BLOCK) if n >= BLOCK else h.reshape(1, -1)
    block = np.sort(full, axis=1)
    distinct = 1 + (block[:, 1:] != block[:, :-1]).sum(axis=1)

    def repeated(k: int) -> float:
        """The share of windows of k words that occur before."""
        w = windows(h, k)
        return 1 - len(np.unique(w)) / len(w) if len(w) else 0.0

    return [
        float(n), chars / n, float((size > 20).mean()), float((size < 4).mean()), kind[4] / chars, kind[2] / letters, kind[3] / chars,
        kind[5] / chars, kind[6] / chars, float(per_line.mean()), float((per_line == 1).mean()), sum(x[-1] in b".!?:;\"" for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, float(distinct.mean()) / block.shape[1], repeated(5), repeated(3),
    ]


def with_statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with STATISTICS as columns ``stat_...``."""
    small_batches(df.sparkSession)
    names = [f"stat_{s}" for s in STATISTICS]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, np.ascontiguousarray(table.T))], names=[*batch.schema.names[:-1], *names])

    schema = df.select(*keep).schema
    for name in names:
        schema = schema.add(name, "double")
    return df.select(*keep, text_bytes(text_col).alias("_graphloom_bytes")).mapInArrow(run, schema)


#: Of each statistic in a rule: more than the one bound, at most the other.
Rule = tuple[tuple[int, float, float], ...]


def grown(x: np.ndarray, y: np.ndarray, seed: int) -> list[Rule]:
    """The paths of a tree grown on a share of the rows, each split the best by
    Gini impurity of a third of the statistics."""
    rng = np.random.default_rng(seed)
    on = rng.permutation(len(x))[: max(2, int(SHARE * len(x)))]
    x, y = x[on], y[on]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="midpoint")) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)])
    found: list[Rule] = []

    def grow(rows: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int) -> None:
        ones = y[rows].sum()
        if depth == DEPTH or ones in (0, len(rows)):
            return
        best = (1e-12, -1, 0)
        for f in rng.permutation(x.shape[1])[: -(-x.shape[1] // 3)]:
            if not len(cuts[f]):
                continue
            n = np.cumsum(np.bincount(bins[rows, f], minlength=len(cuts[f]) + 1))[:-1]
            p = np.cumsum(np.bincount(bins[rows, f], y[rows], minlength=len(cuts[f]) + 1))[:-1]
            m, q = len(rows) - n, ones - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = p * p / n + q * q / m - ones * ones / len(rows)
            gain[(n < LEAST_LEAF) | (m < LEAST_LEAF)] = 0
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), int(f), k), key=lambda b: b[0])
        gain, f, k = best
        if f < 0:
            return
        low, high = bounds.get(f, (-np.inf, np.inf))
        at = float(cuts[f][k])
        for side, now in ((bins[rows, f] <= k, (low, min(at, high))), (bins[rows, f] > k, (max(at, low), high))):
            after = bounds | {f: now}
            found.append(tuple((g, *after[g]) for g in sorted(after)))
            grow(rows[side], after, depth + 1)

    grow(np.arange(len(x)), {}, 0)
    return found


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rules hold for which rows, as 0 and 1."""
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for f, low, high in rule:
            out[:, k] *= (x[:, f] > low) & (x[:, f] <= high)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss plus ``penalty`` times the sum of
    absolute weights of scaled rules, by accelerated proximal steps."""
    spread = r.std(axis=0)
    spread[spread < 1e-6] = np.inf
    z = ((r - r.mean(axis=0)) / spread).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.25 * (float(np.linalg.norm(z @ v)) ** 2 / len(z) + 1) + 1e-9)
    w = np.zeros(z.shape[1] + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    at, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ at[:-1].astype(np.float32) + at[-1], -35, 35)))
        new = at - step * np.append(z.T @ (p - y).astype(np.float32), (p - y).sum()) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / later * (new - w), new, later
    weights = w[:-1] / spread
    return weights, float(w[-1] - (weights * r.mean(axis=0)).sum())


def loss(r: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float) -> float:
    z = np.clip(r @ weights + bias, -35, 35)
    return float(np.mean(np.log1p(np.exp(z)) - y * z))


def holds(rule: Rule) -> Column:
    tests = []
    for feature, low, high in rule:
        c = F.col(f"stat_{STATISTICS[feature]}")
        tests += [c > low] * (low > -np.inf) + [c <= high] * (high < np.inf)
    return reduce(Column.__and__, tests)


class Ensemble:
    """Rules with their weights, and the bias."""

    def __init__(self, rules: list[tuple[Rule, float]], bias: float):
        self.rules, self.bias = rules, bias

    def column(self) -> Column:
        """The score, over the columns of ``with_statistics``."""
        terms = [F.lit(self.bias), *[F.when(holds(r), F.lit(w)).otherwise(0.0) for r, w in self.rules]]
        while len(terms) > 1:  # a balanced sum: the expression's depth is a logarithm of the rules
            terms = [reduce(Column.__add__, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))

    def __str__(self) -> str:
        said = [" and ".join(f"{low:.3g} < " * (low > -np.inf) + STATISTICS[f] + f" <= {high:.3g}" * (high < np.inf) for f, low, high in r) + f": {w:+.2f}" for r, w in self.rules]
        return "\n".join([*said, f"always: {self.bias:+.2f}"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """The ensemble learned from at most ``TRAIN_ROWS`` labelled rows."""
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("double").alias("label"))
    picked = marked.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(TRAIN_ROWS)
    sample = with_statistics(docs.select(id_col, text_col).join(F.broadcast(picked), id_col), text_col, [id_col, "label"])
    names = [f"stat_{s}" for s in STATISTICS]
    least = sample.groupBy(id_col, "label").agg(F.min(F.struct(*names)).alias("s")).select(id_col, "label", "s.*")
    rows = least.toPandas().sort_values(id_col)  # at most TRAIN_ROWS
    x, y = rows[names].to_numpy(float), rows["label"].to_numpy(float)
    n, ones = len(y), y.sum()
    share = (ones + 1) / (n + 2)
    plain = Ensemble([], float(np.log(share / (1 - share))))
    if ones in (0, n):
        return plain
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((x, y))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {r for seed in b.column(0).to_pylist() for r in grown(*sent.value, seed)}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(r) for r in found], pa.binary())], names=["rule"])

    rules = sorted(pickle.loads(r[0]) for r in spark.range(0, TREES, 1, TREES // 4).mapInArrow(grow, "rule binary").distinct().collect())  # 14 a tree
    # Of rules that hold for the same rows the shortest stays.
    rules.sort(key=lambda r: (-len(r), r))
    rules = sorted({f.tobytes(): r for r, f in zip(rules, fires(rules, x).T.astype(bool), strict=True)}.values())
    if not rules:
        return plain
    unit = float(np.sqrt(np.log(len(rules) + 1) / n))
    fold = np.empty(n, int)
    for label in (0, 1):  # each fold its share of both
        at = np.random.default_rng(7).permutation(np.flatnonzero(y == label))
        fold[at] = np.arange(len(at)) % FOLDS

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = sent.value
        for b in batches:
            got, r = [], fires(rules, x)
            for k, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.append(loss(r[fold == f], y[fold == f], *lasso(r[fold != f], y[fold != f], PENALTIES[k] * unit)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["k", "loss"])

    work = spark.createDataFrame([(k, f) for k in range(len(PENALTIES)) for f in range(FOLDS)], "k int, f int").repartition(len(PENALTIES) * FOLDS)
    found = work.mapInArrow(tried, "k int, loss double").groupBy("k").agg(F.avg("loss").alias("loss"), (F.stddev_pop("loss") / F.sqrt(F.count("*"))).alias("error")).collect()  # a row a penalty
    least = min(found, key=lambda r: r["loss"])
    best = min(r["k"] for r in found if r["loss"] <= least["loss"] + least["error"])  # the sparsest that is as good
    weights, bias = lasso(fires(rules, x), y, PENALTIES[best] * unit)
    return Ensemble([(rules[k], float(weights[k])) for k in np.flatnonzero(weights)], bias)


def score(df: DataFrame, model: Ensemble, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``score``, 0 to 1."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "score"]
    return with_statistics(df, text_col, keep).select(*keep, model.column().alias("score"))
