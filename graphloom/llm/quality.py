"""Quality rules and a line labeller: which lines are content, which boilerplate.

A linear-chain conditional random field over the lines of a text has two
labels. Viterbi decoding finds the best sequence, and a document stays if
content lines have at least ``CONTENT_SHARE`` of its words.

The field is fitted on a bounded sample of documents whose quality is
labelled, by expectation-maximisation with hard labels of single lines. Lines
that look like boilerplate (navigation, symbols, shouting, phrases of licences
and advertisements, lines that the text had before) start as such and all
others as content. After each fit the lines are decoded again, and where the
decoded share contradicts the document's quality the lines that are nearest
to the other label change until it does not; a line that looks like
boilerplate stays so. Lines of boilerplate are also spliced into every second
sequence of good documents, so that the field sees labels change.

Null, empty and blank texts have no line and no word and fail the base rules.
Very long texts are read whole. Repeated rows get equal verdicts, and repeated
ids count once for fitting, with the least of their feature tables. Columns
of the input that clash with those added give way to them. An empty table
gives an empty table, and without labels of both qualities everything that
looks like boilerplate is, and all else is content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, text_bytes, windows, word_hashes

#: Labelled documents of each quality that are read for fitting; of a document the
#: runs of ``RUN`` lines with the smallest hashes, at most ``TRAIN_RUNS`` of them.
TRAIN_ROWS, RUN, TRAIN_RUNS = 1500, 32, 16
ITERATIONS, STEPS = 3, 120
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
NOT_WORD_CHARS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
#: Phrases of licences, site furniture and advertisements, lower case.
PHRASES = re.compile(
    rb"licen[sc]ed? under|all rights reserved|copyright|\xc2\xa9|terms of (?:use|service)|privacy policy|cookie|subscribe|newsletter|sign up|log ?in\b|click here|read more|follow us|share this"
    rb"|advertis|sponsored|buy now|order now|special offer|limited (?:time|offer)|free shipping|% off|https?://|www\.|public license|creative commons"
    rb"|alle rechte vorbehalten|tous droits r\xc3\xa9serv\xc3\xa9s|todos los derechos reservados|nutzungsbedingungen|datenschutz"
)
#: bias, words, short, symbols, symbol-heavy, capitals, shouting, digits, bangs, many bangs, known, ends a sentence, bars, phrase
FEATURES = 14
MARKS = [4, 6, 9, 10, 13]
BARS = 12


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = word_hashes(text)
    n = len(words)
    chars = len(text.translate(None, NOT_WORD_CHARS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > WINDOW:
        w = windows(words, WINDOW)
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(len(w) + 1, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, dup, repeat


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that have a word, and their numbers of words."""
    seen: set[bytes] = set()
    rows, sizes = [], []
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        size = len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, UPPER))
        digits = size - len(line.translate(None, DIGITS))
        bangs = line.count(b"!")
        known = line in seen
        seen.add(line)
        rows.append((1.0, min(n, 50) / 50, n <= 2, symbols / size, 2 * symbols > n, upper / size, n > 1 and upper > 0.4 * size, digits / size, min(bangs / n, 1), 2 * bangs > n, known, line.rstrip()[-1:] in b".!?", min(line.count(b"|") / n, 1), bool(PHRASES.search(line.lower()))))
        sizes.append(n)
    return np.array(rows, float).reshape(-1, FEATURES), np.array(sizes, np.int64)


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label sequence for line ``scores`` (lines by labels)."""
    n = len(scores)
    if n == 0:
        return np.empty(0, np.int64)
    (t00, t01), (t10, t11) = trans.tolist()
    rows = scores.tolist()
    a, b = rows[0]
    back = []
    for s0, s1 in rows[1:]:
        from0, from1 = a + t00 < b + t10, a + t01 < b + t11
        a, b = s0 + (b + t10 if from0 else a + t00), s1 + (b + t11 if from1 else a + t01)
        back.append((from0, from1))
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return np.array(out[::-1], np.int64)


def boilerplate(x: np.ndarray) -> np.ndarray:
    """Which lines look like boilerplate by themselves."""
    return (x[:, MARKS] > 0).any(1) | (x[:, BARS] > 0.25)


def _padded(sequences: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, most = len(sequences), max(map(len, sequences))
    x, y, on = np.zeros((n, most, FEATURES)), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (f, label) in enumerate(zip(sequences, labels, strict=True)):
        x[i, : len(f)], y[i, : len(f)], on[i, : len(f)] = f, label, True
    return x, y, on


def likelihood(x: np.ndarray, y: np.ndarray, on: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of the labels of padded sequences, and its gradients by
    line weights and transitions: forward and backward passes, all sequences at once."""
    n, most = y.shape
    s = x @ w
    alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    alpha[:, 0] = s[:, 0]
    for i in range(1, most):
        a = np.logaddexp(alpha[:, i - 1, 0, None] + t[0], alpha[:, i - 1, 1, None] + t[1]) + s[:, i]
        alpha[:, i] = np.where(on[:, i, None], a, alpha[:, i - 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    gt = np.zeros_like(t)
    for i in range(most - 2, -1, -1):
        m = t[None] + s[:, i + 1, None, :] + beta[:, i + 1, None, :]
        beta[:, i] = np.where(on[:, i + 1, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), 0.0)
        gt -= (np.exp(alpha[:, i, :, None] + m - z[:, None, None]) * on[:, i + 1, None, None]).sum(0)
        np.add.at(gt, (y[:, i], y[:, i + 1]), on[:, i + 1])
    p = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
    truth = np.eye(2)[y] * on[:, :, None]
    steps = t[y[:, :-1], y[:, 1:]] * on[:, 1:]
    return float((s * truth).sum() + steps.sum() - z.sum()), np.einsum("ntf,ntl->fl", x, truth - p), gt


def train(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Line weights (features by labels) and transitions, by gradient ascent on
    the likelihood of the lines' labels."""
    w, t = (a.copy() for a in start) if start else (np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    x, y, on = _padded(sequences, labels)
    moment, total = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)], float(on.sum())
    for k in range(1, steps + 1):
        _, gw, gt = likelihood(x, y, on, w, t)
        for j, (param, g) in enumerate(((w, gw / total - 1e-4 * w), (t, gt / total - 1e-4 * t))):
            moment[2 * j] = 0.9 * moment[2 * j] + 0.1 * g
            moment[2 * j + 1] = 0.999 * moment[2 * j + 1] + 0.001 * g * g
            param += 0.2 * (moment[2 * j] / (1 - 0.9**k)) / (np.sqrt(moment[2 * j + 1] / (1 - 0.999**k)) + 1e-8)
    return w, t


def learned(docs: list[tuple[list[np.ndarray], list[np.ndarray], int]]) -> tuple[np.ndarray, np.ndarray]:
    """The field from documents, each with the features of its runs of lines, the
    lines' words and its quality: lines are labelled, fitted and labelled again."""
    docs = [d for d in docs if d[0]]
    if {q for _, _, q in docs} != {0, 1}:
        w = np.zeros((FEATURES, 2))
        w[0, 1], w[MARKS, 0], w[BARS, 0] = 1.0, 2.0, 8.0
        return w, np.zeros((2, 2))
    marked = [[boilerplate(x) for x in runs] for runs, _, _ in docs]
    labels = [[1 - m.astype(int) for m in each] for each in marked]
    pool = np.concatenate([x[m] for (runs, _, _), each in zip(docs, marked, strict=True) for x, m in zip(runs, each, strict=True)])
    rng, model = np.random.default_rng(0), None
    for _ in range(ITERATIONS):
        sequences, truth = [], []
        for k, ((runs, _, q), each) in enumerate(zip(docs, labels, strict=True)):
            for x, y in zip(runs, each, strict=True):
                if q == 1 and k % 2 and len(pool):
                    at = rng.integers(0, len(x) + 1)
                    x, y = np.insert(x, at, pool[rng.integers(len(pool))], axis=0), np.insert(y, at, 0)
                sequences.append(x)
                truth.append(y)
        w, t = model = train(sequences, truth, start=model)
        for (runs, sizes, q), each, fixed in zip(docs, labels, marked, strict=True):
            scores = [x @ w for x in runs]
            y = np.concatenate([np.where(m, 0, viterbi(s, t)) for s, m in zip(scores, fixed, strict=True)])
            size, free = np.concatenate(sizes), ~np.concatenate(fixed)
            lead = np.concatenate([s[:, 1] - s[:, 0] for s in scores])
            wrong = lambda y, size=size, q=q: (size[y == 1].sum() >= CONTENT_SHARE * size.sum()) != (q == 1)
            for i in np.argsort(lead if q == 0 else -lead, kind="stable"):
                if not wrong(y):
                    break
                if free[i] and y[i] != q:
                    y[i] = q
            each[:] = np.split(y, np.cumsum([len(s) for s in scores])[:-1])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """The field, from at most ``TRAIN_ROWS`` documents of each quality."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    order = (F.xxhash64(F.col(id_col).cast("string")), F.col(id_col))
    picked = marked.where("y = 0").orderBy(*order).limit(TRAIN_ROWS).unionAll(marked.where("y = 1").orderBy(*order).limit(TRAIN_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(2).to_pylist():
                x, sizes = line_features(t or b"")
                starts = np.arange(0, len(x), RUN)
                least = np.sort(starts[np.argsort(mix64(starts.astype(np.uint64) + np.uint64(1)), kind="stable")[:TRAIN_RUNS]])
                rows = [np.column_stack([np.full(len(x[i : i + RUN]), i), sizes[i : i + RUN], x[i : i + RUN]]) for i in least]
                got.append((np.concatenate(rows) if rows else np.empty((0, FEATURES + 2))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["id", "y", "x"])

    sample = docs.select(F.col(id_col).cast("long"), text_bytes(text_col).alias("_b")).join(F.broadcast(picked), id_col)
    rows = sample.select(F.col(id_col).alias("id"), F.col("y").cast("int"), "_b").mapInArrow(run, "id long, y int, x binary")
    out = []
    for r in rows.groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id").toLocalIterator():
        table = np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES + 2).astype(float)
        cuts = np.flatnonzero(np.diff(table[:, 0])) + 1
        runs = np.split(table, cuts) if len(table) else []
        out.append(([x[:, 2:] for x in runs], [x[:, 1] for x in runs], r["y"]))
    return learned(out)


def judge(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, content_share and kept."""
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a few numbers
    new = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    names = [x.split()[0] for x in new.split(", ")]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]  # clashing names give way
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = sent.value
        for b in batches:
            out = []
            for text in b.column(b.num_columns - 1).to_pylist():
                counts = base_counts(text or b"")
                n, repeat = counts[0], counts[4]
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                x, sizes = line_features(text or b"")
                share = float(sizes[viterbi(x @ w, t) == 1].sum()) / n if n else 0.0
                out.append((*counts, failed, share, not failed and share >= CONTENT_SHARE))
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *names])

    schema = df.select(*keep).schema
    for x in new.split(", "):
        schema = schema.add(*x.split())
    return df.select(*keep, text_bytes(text_col).alias("_graphloom_bytes")).mapInArrow(run, schema)
