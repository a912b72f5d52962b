"""Mergeable quantile summaries, combined and pruned up a tree of sensors.

A summary of n values is a sorted list of some of them, each with bounds
``rmin`` and ``rmax`` on its rank; the least and the greatest value are always
among them. Two summaries are combined by adding to an element's ``rmin`` that
of its predecessor in the other summary and to its ``rmax`` that of its
successor less one. A summary is pruned to k + 1 elements: those closest to the
ranks 1, 1 + (n - 1) / k, ..., n; that widens bounds by n / 2k.

A task summarises the rows it reads, by group and part: the leaves. Siblings are
combined pairwise in a balanced tree and pruned at every height. The error
budget ``ERROR`` is allotted evenly over ``HEIGHTS``, so every height prunes at
``HEIGHTS / (2 * ERROR)`` ranks; ``HEIGHTS`` levels of leaves of ``LEAF_ROWS``
rows are more rows than there are. What is kept at the end is pruned once more,
to ``POINTS`` elements. The parts' summaries alone are merged into the group's.

No rows of a group meet: a group with a thousandth of all rows or more (there
are a thousand of them at most) has its leaves merged ``FAN`` at a time by
shuffles of their own, and its rows counted in as many shares.

Rows with a null group or value are for the caller to drop. Equal values are
told apart by their order, so a value that occurs often holds a range of ranks.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

POINTS = 400
ERROR, HEIGHTS = 0.03, 32
INNER = -(-HEIGHTS * 1000 // int(2000 * ERROR)) + 1
LEAF_ROWS, CHUNK = 1 << 18, 1 << 17
FAN = 16
#: A group is hot from this share of all rows on.
HOT_SHARES = 1000
#: Values between two bounds that one pass over the rows tells apart.
SPLITS = 64
#: Rows of an Arrow batch: rows are short here.
ROWS = 20_000


class Points:
    """Elements of many summaries: ``seg`` numbers the summary of each, 0, 1,
    ..., in order; within a summary they ascend."""

    def __init__(self, seg: np.ndarray, x: np.ndarray, rmin: np.ndarray, rmax: np.ndarray):
        self.seg, self.x, self.rmin, self.rmax = seg, x, rmin, rmax

    def __len__(self) -> int:
        return len(self.x)

    def take(self, at: np.ndarray) -> Points:
        return Points(self.seg[at], self.x[at], self.rmin[at], self.rmax[at])

    def starts(self) -> np.ndarray:
        """Where each summary begins, and the end."""
        return np.searchsorted(self.seg, np.arange((self.seg[-1] if len(self) else -1) + 2))


def leaves(seg: np.ndarray, x: np.ndarray, times: np.ndarray) -> Points:
    """Summaries of values with their numbers of occurrences, nothing left out:
    the first and the last occurrence of each value, with their exact ranks."""
    order = np.lexsort((x, seg))
    seg, x, times = seg[order], x[order], times[order]
    new = np.ones(len(x), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    seg, x, times = seg[at], x[at], np.add.reduceat(times, at) if len(at) else times
    upto = np.cumsum(times)
    first = np.ones(len(x), bool)
    first[1:] = seg[1:] != seg[:-1]
    base = (upto - times)[np.flatnonzero(first)][np.cumsum(first) - 1]
    upto = upto - base
    both = np.repeat(np.arange(len(x)), np.where(times > 1, 2, 1))
    last = np.ones(len(both), bool)
    last[:-1] = both[1:] != both[:-1]
    rank = np.where(last, upto[both], (upto - times + 1)[both])
    return Points(seg[both], x[both], rank, rank)


def prune(p: Points, most: int) -> Points:
    """Summaries of more than ``most`` elements cut to those nearest to
    ``most`` evenly spaced ranks."""
    starts = p.starts()
    on = np.ones(len(p), bool)
    for s in np.flatnonzero(np.diff(starts) > most):
        a, b = starts[s], starts[s + 1]
        n = int(p.rmax[b - 1])
        ranks = 1 + np.arange(most, dtype=object) * (n - 1) // (most - 1)
        on[a:b] = False
        on[a + nearest(p.rmin[a:b], p.rmax[a:b], ranks.astype(np.int64))] = True
    return p.take(on)


def nearest(rmin: np.ndarray, rmax: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of each rank the element whose bounds are least far from it."""
    j = np.minimum(np.searchsorted(rmin + rmax, 2 * ranks), len(rmin) - 1)
    i = np.maximum(j - 1, 0)
    far = lambda k: np.maximum(ranks - rmin[k], rmax[k] - ranks)
    return np.where(far(i) <= far(j), i, j)


def combine(p: Points, side: np.ndarray) -> Points:
    """Summaries of one ``seg`` combined, those of side 0 with those of side 1."""
    order = np.lexsort((side, p.x, p.seg))
    p, side = p.take(order), side[order]
    starts = p.starts()
    here = np.arange(len(p))
    size = np.zeros((2, len(starts) - 1), np.int64)
    for k in (0, 1):
        np.maximum.at(size[k], p.seg[side == k], p.rmax[side == k])
    last = [np.maximum.accumulate(np.where(side == k, here, -1)) for k in (0, 1)]
    following = [np.minimum.accumulate(np.where(side == k, here, len(p))[::-1])[::-1] for k in (0, 1)]
    before, after = np.where(side == 0, last[1], last[0]), np.where(side == 0, following[1], following[0])
    has, more = before >= starts[p.seg], after < starts[p.seg + 1]
    rmin = p.rmin + np.where(has, p.rmin[np.maximum(before, 0)], 0)
    rmax = p.rmax + np.where(more, p.rmax[np.minimum(after, len(p) - 1)] - 1, size[1 - side, p.seg])
    return Points(p.seg, p.x, rmin, rmax)


def tree(p: Points, leaf: np.ndarray, most: int) -> Points:
    """All leaves of a ``seg`` merged pairwise, level by level, each level
    pruned. Elements come by ``seg``, ``leaf`` and value."""
    if not len(p):
        return p
    new = np.ones(len(p), bool)
    new[1:] = p.seg[1:] != p.seg[:-1]
    step = np.ones(len(p), bool)
    step[1:] = new[1:] | (leaf[1:] != leaf[:-1])
    number = np.cumsum(step)
    k = number - number[np.flatnonzero(new)][np.cumsum(new) - 1]  # the leaf's number in its summary
    done: list[Points] = []
    while True:
        many = np.zeros(p.seg[-1] + 1, np.int64)
        np.maximum.at(many, p.seg, k)
        alone = many[p.seg] == 0
        done.append(p.take(alone))
        p, k = p.take(~alone), k[~alone]
        if not len(p):
            break
        node = np.ones(len(p), bool)
        node[1:] = (p.seg[1:] != p.seg[:-1]) | (k[1:] // 2 != k[:-1] // 2)
        of = p.seg[np.flatnonzero(node)]
        up = k[np.flatnonzero(node)] // 2
        p = prune(combine(Points(np.cumsum(node) - 1, p.x, p.rmin, p.rmax), k % 2), most)
        p, k = Points(of[p.seg], p.x, p.rmin, p.rmax), up[p.seg]
    out = Points(*(np.concatenate([getattr(d, name) for d in done]) for name in ("seg", "x", "rmin", "rmax")))
    return out.take(np.argsort(out.seg, kind="stable"))


def codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's values, in order of first rows, and those rows."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = pc.dictionary_encode(c, null_encoding="encode")
        out = np.unique(out * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, at = np.unique(out, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    return rank[at], np.sort(first)


def _table(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _leaf_table(rows: DataFrame, by: list[str], part: str, value: str, times: str) -> DataFrame:
    """``by``, ``part``, ``leaf`` and an element of its summary a row."""
    df = rows.select(*by, part, F.col(value).alias("x"), F.col(times).cast("long").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def leaf() -> pa.RecordBatch:
            t = _table(held)
            seg, first = codes(t.columns[:-2])
            p = prune(leaves(seg, _longs(t.column("x")), _longs(t.column("times"))), INNER)
            keys = t.select(t.schema.names[:-2]).take(pa.array(first[p.seg]))
            return pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.full(len(p), task + made)), *map(pa.array, (p.x, p.rmin, p.rmax))], names=[*keys.schema.names, "leaf", "x", "rmin", "rmax"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= LEAF_ROWS:
                yield leaf()
                held, n, made = [], 0, made + 1
        if n:
            yield leaf()

    schema = df.select(*by, part).schema.add("leaf", "long").add("x", "long").add("rmin", "long").add("rmax", "long")
    return df.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches in chunks that no group of the first columns goes over."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            t = _table(held)
            seg, _ = codes(t.columns[:n_keys])
            cut = int(np.searchsorted(seg, seg[-1]))
            if cut:
                yield t.slice(0, cut)
            held, n = [t.slice(cut)], t.num_rows - cut
    if n:
        yield _table(held)


def _merged(table: DataFrame, by: list[str], part: str) -> DataFrame:
    """Leaves of a group of leaves made one leaf, for groups of one shuffle."""
    keys = [*by, part, "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, len(keys)):
            seg, first = codes(t.columns[: len(keys)])
            p = tree(Points(seg, *(_longs(t.column(c)) for c in ("x", "rmin", "rmax"))), _longs(t.column("leaf")), INNER)
            out = t.select(keys).take(pa.array(first[p.seg]))
            yield pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, (p.x, p.rmin, p.rmax))], names=[*keys[:-1], "leaf", "x", "rmin", "rmax"])

    df = table.select(*keys, "leaf", "x", "rmin", "rmax").repartition(*keys).sortWithinPartitions(*keys, "leaf", "x", "rmin")
    return df.mapInArrow(run, table.select(*by, part, "leaf", "x", "rmin", "rmax").schema)


def _finished(table: DataFrame, by: list[str], part: str, whole: int, most: int) -> DataFrame:
    """A row for each part's summary, and for that of the whole group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, len(by)):
            cut, first = codes(t.columns[: len(by) + 1])
            parts = prune(tree(Points(cut, *(_longs(t.column(c)) for c in ("x", "rmin", "rmax"))), _longs(t.column("leaf")), INNER), most)
            group, first_of = codes(t.columns[: len(by)])
            of = group[first]  # of each part its group
            wholes = prune(tree(Points(of[parts.seg], parts.x, parts.rmin, parts.rmax), parts.seg, INNER), most)
            for p, rows, part_of in ((parts, first, t.column(part).take(pa.array(first))), (wholes, first_of, pa.array(np.full(len(first_of), whole), t.schema.field(part).type))):
                starts = p.starts()
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v)) for v in (p.x, p.rmin, p.rmax)]
                keys = t.select(by).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*keys.columns, part_of, pa.array(p.rmax[starts[1:] - 1]), *lists], names=[*by, part, "n", "xs", "rmins", "rmaxs"])

    df = table.select(*by, part, "leaf", "x", "rmin", "rmax").repartition(*by).sortWithinPartitions(*by, part, "leaf", "x", "rmin")
    lists = table.select(*by, part, F.lit(0).cast("long").alias("n"), *[F.array(F.lit(0).cast("long")).alias(c) for c in ("xs", "rmins", "rmaxs")])
    return df.mapInArrow(run, lists.schema)


def wide_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def hot_groups(rows: DataFrame, by: list[str], times: str) -> DataFrame:
    """``by``, ``shares``: the groups, ``HOT_SHARES`` at most, with a share of
    all rows that is to be split, and into how many."""
    n = rows.groupBy(*by).agg(F.sum(times).alias("n"))
    total = F.broadcast(rows.agg(F.sum(times).alias("total")))  # one row
    shares = F.ceil(F.col("n") * HOT_SHARES / F.col("total")).cast("int")
    return stored(n.crossJoin(total).where(F.col("n") * HOT_SHARES >= F.col("total")).select(*by, shares.alias("shares")), "hot-groups")


def summaries(rows: DataFrame, hot: DataFrame, by: list[str], part: str, value: str, times: str, whole: int, most: int | None = None) -> DataFrame:
    """``by``, ``part``, ``n`` and the elements ``xs``, ``rmins``, ``rmaxs`` of
    the summary of each part and, as part ``whole``, of each group. ``value`` is
    a long, ``times`` its number of occurrences, ``hot`` from ``hot_groups``."""
    wide_batches(rows)
    table = stored(_leaf_table(rows, by, part, value, times), "leaves")
    marked = table.join(F.broadcast(hot), by, "left")
    split = marked.where("shares is not null").drop("shares")
    left = split.agg(F.count_distinct("leaf")).first()[0]
    while left > FAN:
        left = -(-left // FAN)
        split = stored(_merged(split.withColumn("node", F.pmod(F.xxhash64("leaf"), F.lit(left))), by, part), "leaves")
    return _finished(marked.where("shares is null").drop("shares").unionByName(split), by, part, whole, most or POINTS)


def answers(summary: DataFrame, keys: list[str], quantiles: int) -> DataFrame:
    """For i in 1 to ``quantiles`` - 1 the rank ``target`` = ceil(i n /
    quantiles), the element nearest to it, and the elements ``low`` and ``high``
    between which the value of that rank must lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(1, quantiles)
        for t in batches:
            if not t.num_rows:
                continue
            n = _longs(t.column("n"))
            xs, rmin, rmax = (t.column(c).flatten().to_numpy() for c in ("xs", "rmins", "rmaxs"))
            size = _longs(pc.list_value_length(t.column("xs")))
            seg = np.repeat(np.arange(len(n)), size)
            base = np.cumsum(n + 1) - (n + 1)  # keeps the summaries' ranks apart
            target = -(-i * n[:, None] // quantiles)
            ranks = (target + base[:, None]).ravel()
            rmin, rmax = rmin + base[seg], rmax + base[seg]
            at = nearest(rmin, rmax, ranks)
            low, high = np.searchsorted(rmax, ranks, "right") - 1, np.searchsorted(rmin, ranks)
            row = np.repeat(np.arange(len(n)), len(i))
            carried = t.select([*keys, "n"]).take(pa.array(row))
            made = [pa.array(np.tile(i, len(n)), pa.int32()), *map(pa.array, (target.ravel(), size[row], xs[at], xs[low], xs[high]))]
            yield pa.RecordBatch.from_arrays([*carried.columns, *made], names=[*keys, "n", "i", "target", "points", "answer", "low", "high"])

    schema = summary.select(*keys, "n").schema.add("i", "integer")
    for c in ("target", "points", "answer", "low", "high"):
        schema = schema.add(c, "long")
    return summary.select(*keys, "n", "xs", "rmins", "rmaxs").mapInArrow(run, schema)


def counted(rows: DataFrame, probes: DataFrame, hot: DataFrame, by: list[str], part: str, value: str, times: str, whole: int) -> DataFrame:
    """``probes`` (``by``, ``part``, ``v`` and more) with ``below`` and
    ``upto``: how many rows of their part, or group, have less than ``v``, and
    at most ``v``. Rows and probes of a hot group are dealt to its shares."""
    shares = F.coalesce("shares", F.lit(1))
    more = [c for c in probes.columns if c not in (*by, part, "v")]
    r = rows.join(F.broadcast(hot), by, "left").select(*by, part, F.floor(F.rand(11) * shares).cast("int").alias("_share"), F.col(value).alias("_v"), F.lit(1).alias("_tag"), F.col(times).cast("long").alias("_n"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in more])
    p = probes.join(F.broadcast(hot), by, "left").select(*by, part, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share"), F.col("v").alias("_v"), F.explode(F.array(F.lit(0), F.lit(2))).alias("_tag"), F.lit(0).cast("long").alias("_n"), *more)
    at = Window.partitionBy(*by, "_share").orderBy("_v", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    at_part = Window.partitionBy(*by, "_share", part).orderBy("_v", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(p).repartition(*by, "_share")
    seen = both.withColumn("_whole", F.sum("_n").over(at)).withColumn("_part", F.sum("_n").over(at_part)).where("_tag <> 1")
    seen = seen.withColumn("_c", F.when(F.col(part) == whole, F.col("_whole")).otherwise(F.col("_part")))
    sums = [F.sum(F.when(F.col("_tag") == tag, F.col("_c"))).alias(name) for tag, name in ((0, "below"), (2, "upto"))]
    return seen.groupBy(*by, part, F.col("_v").alias("v"), *more).agg(*sums)


def exact(rows: DataFrame, asked: DataFrame, hot: DataFrame, by: list[str], part: str, value: str, times: str, whole: int) -> DataFrame:
    """``asked`` (a table of ``answers``) with ``exact_x``, ``n_below`` and
    ``n_upto``, counted over all rows.

    The value of a rank lies between ``low`` and ``high``; a pass counts rows up
    to ``SPLITS`` values between them and keeps the interval that holds the
    rank, until one value is left.
    """
    keys = [*by, part, "i"]

    def between(low: str, high: str) -> Column:
        step = f"(({high} - {low}) div {SPLITS} + 1)"
        return F.expr(f"transform(sequence(0, cast(({high} - {low} - 1) div {step} as int)), k -> {low} + k * {step})")

    def narrowed(open_: DataFrame, got: DataFrame) -> DataFrame:
        low = F.greatest(F.col("low"), F.max(F.when(F.col("upto") < F.col("target"), F.col("v") + 1)))
        high = F.least(F.col("high"), F.min(F.when(F.col("upto") >= F.col("target"), F.col("v"))))
        return got.join(open_, keys).groupBy(*keys, "target", "low", "high").agg(low.alias("l"), high.alias("h")).select(*keys, "target", F.col("l").alias("low"), F.col("h").alias("high"))

    first = asked.select(*keys, F.col("answer").alias("v"))
    open_ = asked.where("low < high").select(*keys, "target", "low", "high")
    cuts = open_.select(*keys, F.explode(between("low", "high")).alias("v"))
    got = stored(counted(rows, first.unionByName(cuts).distinct(), hot, by, part, value, times, whole), "counts")
    done = asked.where("low = high").select(*keys, F.col("low").alias("exact_x"))
    open_ = stored(narrowed(open_, got), "intervals")
    found = [done]
    while True:
        found.append(open_.where("low = high").select(*keys, F.col("low").alias("exact_x")))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        mine = rows.join(open_.select(*by).distinct(), by, "left_semi")
        cuts = open_.select(*keys, F.explode(between("low", "high")).alias("v"))
        open_ = stored(narrowed(open_, counted(mine, cuts, hot, by, part, value, times, whole)), "intervals")
    exact_x = found[0]
    for f in found[1:]:
        exact_x = exact_x.unionByName(f)
    counts = got.select(*keys, F.col("v").alias("answer"), F.col("below").alias("n_below"), F.col("upto").alias("n_upto"))
    return asked.join(counts, [*keys, "answer"]).join(exact_x, keys)
