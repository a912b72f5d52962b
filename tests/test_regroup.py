"""Regroup against plain Python, and how many pairs it makes."""

import random

import pytest

from graphloom.operators import generate as gen


def wanted(nodes, adj, k):
    out = []
    for i, c, s, m in nodes:
        for j, d, t, n in nodes:
            if i < j and c == d and m != n and (i, j) not in adj:
                out.append((-round(s + t + 1e-3, 6), i, j))
    return [(a, b, -s) for s, a, b in sorted(out)[:k]]


def made(spark, nodes, pairs, k):
    n = spark.createDataFrame([x[:3] for x in nodes], "id string, community int, strength double")
    other = spark.createDataFrame([(x[0], x[3]) for x in nodes], "id string, community int")
    adj = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "u string, v string")
    return [(r["source"], r["target"], r["score"]) for r in gen.regroup(n, adj, other, k).orderBy("rank").collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_regroup_of_random_graphs(spark, seed):
    r = random.Random(seed)
    strength = lambda: r.choice([1 + r.randrange(6) * 1e-6, 1 + r.random() * 1e-5, r.random()])
    nodes = [(f"n{i:03}", r.randrange(3), strength(), r.randrange(3)) for i in range(120)]
    pairs = {tuple(sorted(r.sample([x[0] for x in nodes], 2))) for _ in range(2500)}
    k = (4, 10, 100000)[seed - 1]
    got, want = made(spark, nodes, pairs, k), wanted(nodes, pairs, k)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_hub_next_to_all_of_its_community_makes_no_square_of_pairs(spark, monkeypatch):
    size, counts = 600, []
    plain = gen.stored

    def counted(df, what):
        out = plain(df, what)
        if what == "regroup-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(gen, "stored", counted)
    nodes = [("hub", 0, 1.9, 0), *((f"n{i:04}", 0, 1 + i * 1e-6, i % 3) for i in range(size))]
    pairs = {tuple(sorted(("hub", x[0]))) for x in nodes[1:]}
    got = made(spark, nodes, pairs, 10)
    assert [x[:2] for x in got] == [x[:2] for x in wanted(nodes, pairs, 10)]
    assert 0 < sum(counts) < 10 * size  # the pairs of all are 120,000
