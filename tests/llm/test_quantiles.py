"""Summaries against sorted lists."""

import math
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quantiles, queries

BY = ["stream", "grp"]


def run(spark, rows, least=1):
    df = spark.createDataFrame(rows, "stream string, grp string, batch int, x long, times long").repartition(7)
    hot = quantiles.hot_groups(df, BY, "times")
    summary = quantiles.stored(quantiles.summaries(df, hot, BY, "batch", "x", "times", whole=-1), "t")
    asked = quantiles.stored(quantiles.answers(summary.where(F.col("n") >= least), [*BY, "batch"], 10), "t")
    return summary.collect(), quantiles.exact(df, asked, hot, BY, "batch", "x", "times", whole=-1).collect()


def lists(rows):
    out = defaultdict(list)
    for stream, grp, batch, x, times in rows:
        out[stream, grp, batch] += [x] * times
        out[stream, grp, -1] += [x] * times
    return {k: sorted(v) for k, v in out.items()}


def compare(rows, summary, found, error=0.05):
    want = lists(rows)
    assert {(r["stream"], r["grp"], r["batch"]): r["n"] for r in summary} == {k: len(v) for k, v in want.items()}
    for r in summary:
        v = want[r["stream"], r["grp"], r["batch"]]
        assert min(4, len(set(v))) <= len(r["xs"]) <= min(len(v), quantiles.POINTS) and (r["xs"][0], r["xs"][-1]) == (v[0], v[-1])
        for x, low, high in zip(r["xs"], r["rmins"], r["rmaxs"], strict=True):
            assert low <= high and low <= bisect_right(v, x) and high > bisect_left(v, x)  # some rank of x is between
    assert len(found) == 9 * len(want)
    last = {}
    for r in sorted(found, key=lambda r: r["i"]):
        key = (r["stream"], r["grp"], r["batch"])
        v, target = want[key], -(-r["i"] * len(want[key]) // 10)
        assert (r["target"], r["exact_x"]) == (target, v[target - 1])
        assert (r["n_below"], r["n_upto"]) == (bisect_left(v, r["answer"]), bisect_right(v, r["answer"]))
        assert max(0, r["n_below"] + 1 - target, target - r["n_upto"]) <= error * len(v)
        assert r["answer"] >= last.get(key, r["answer"])
        last[key] = r["answer"]


def test_hot_group_ties_and_wide_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LEAF_ROWS", 700)
    monkeypatch.setattr(quantiles, "CHUNK", 900)
    monkeypatch.setattr(quantiles, "FAN", 3)
    monkeypatch.setattr(quantiles, "POINTS", 60)
    rng = np.random.default_rng(5)
    rows = [("v", "hot", int(b), int(x), 1) for b, x in zip(rng.integers(0, 8, 12_000), rng.normal(0, 1e12, 12_000), strict=True)]
    rows += [("v", "tied", int(b), int(x), int(t)) for b, x, t in zip(rng.integers(0, 8, 4000), rng.integers(0, 3, 4000), rng.integers(1, 9, 4000), strict=True)]
    rows += [("v", "mostly one", 1, 7, 5000), ("v", "mostly one", 1, 8, 1), ("v", "mostly one", 2, -(10**15), 1)]
    rows += [("p", f"g{k % 300}", k % 8, (k * 7919) % 1000, 1) for k in range(6000)]
    rows += [("p", "one", 3, 5, 1)]
    compare(rows, *run(spark, rows))


def test_summaries_are_within_half_the_budget_of_random_orders(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LEAF_ROWS", 3000)
    rows = [("v", "g", k % 2, k * k % 100_003, 1) for k in range(60_000)]
    compare(rows, *run(spark, rows), error=0.02)


def test_empty_table(spark):
    summary, found = run(spark, [])
    assert summary == [] and found == []


def test_query_over_the_shop(spark, sf):
    import pyarrow.parquet as pq

    groups, seen, items = defaultdict(list), {}, defaultdict(list)

    def add(stream, grp, i, money):
        if grp is not None and money is not None:
            batch = zlib.crc32(str(i).encode()) % 8
            for b in (batch, -1):
                groups[stream, grp, b].append(math.floor(100 * money + 0.5) + 1000 * batch)

    for r in pq.read_table(f"{sf}/clicks.parquet").to_pylist():
        seen.setdefault(r["click_id"], r)
    for r in seen.values():
        add("value", None if r["client_id"] is None else str(r["client_id"]), r["click_id"], r["value"])
    for r in pq.read_table(f"{sf}/items.parquet").to_pylist():
        items[r["item_id"]].append(r)
    for r in pq.read_table(f"{sf}/sale_lines.parquet").to_pylist():
        for item in items[r["item_id"]]:
            add("price", item["brand"], r["vendor_id"], item["price"])
    found = queries.op13_quantiles(spark, sf).collect()
    assert len(found) == 9 * sum(len(v) >= 20 for v in groups.values()) and all(r["within"] for r in found)
    for v in groups.values():
        v.sort()
    for r in found:
        v = groups[r["stream"], r["grp"], r["batch"]]
        target = -(-r["i"] * len(v) // 10)
        below, upto = bisect_left(v, r["answer"]), bisect_right(v, r["answer"])
        assert (r["n"], r["target"], r["exact_x"], r["n_below"], r["n_upto"]) == (len(v), target, v[target - 1], below, upto)
        assert r["rank_error"] == max(0, below + 1 - target, target - upto)


@pytest.mark.parametrize("sizes", [(1, 1), (5, 400), (333, 1000)])
def test_combine_of_exact_summaries_bounds_every_rank(sizes):
    rng = np.random.default_rng(1)
    parts = [np.sort(rng.integers(0, 500, n)) for n in sizes]
    side = np.repeat([0, 1], sizes)
    ranks = np.concatenate([np.arange(1, n + 1) for n in sizes])
    p = quantiles.combine(quantiles.Points(np.zeros(sum(sizes), np.int64), np.concatenate(parts), ranks, ranks), side)
    assert p.rmin.tolist() == p.rmax.tolist() == list(range(1, sum(sizes) + 1))
