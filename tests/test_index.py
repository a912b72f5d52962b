"""The vector index against comparing everything."""

import numpy as np
import pytest

from graphloom.operators import index, vector


def table(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, m, strict=True)], "id long, v array<double>").repartition(5)


def nearest(m, k):
    sim = np.round(m @ m.T, 12)
    return {i: sorted((j for j in range(len(m)) if j != i), key=lambda j: (-sim[i, j], j))[:k] for i in range(len(m))}


def clustered(rng, n=900, dims=8, spread=0.08):
    centres = rng.normal(size=(12, dims))
    m = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_exact_search_with_equal_rows_zero_rows_and_norms(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 40)
    monkeypatch.setattr(index, "CHUNK", 7)
    rng = np.random.default_rng(3)
    m = clustered(rng)
    m[100:400] = m[5]  # a third of all rows is one vector
    m[400:420] = 0
    m[420:500] *= rng.uniform(0.2, 3, (80, 1))
    rows = table(spark, m)
    got = {}
    for r in index.VectorIndex(rows, 20).knn(rows.where("id % 7 = 0"), 4).collect():
        got.setdefault(r["id"], {})[r["k"]] = r["other"]
    want = nearest(m, 4)
    assert {i: [x[k] for k in sorted(x)] for i, x in got.items()} == {i: want[i] for i in range(0, len(m), 7)}


@pytest.mark.parametrize("tau", [0.97, 0.2])
def test_similar_pairs(spark, monkeypatch, tau):
    monkeypatch.setattr(index, "BLOCK", 30)
    m = clustered(np.random.default_rng(4), 300)
    m[50:90] = m[0]
    rows = table(spark, m)
    sim = np.round(m @ m.T, 12)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sim[i, j] > tau}
    assert {tuple(r) for r in index.VectorIndex(rows, 16).pairs_over(rows, tau).collect()} == want


def test_recall_of_the_calibrated_search(spark):
    m = np.random.default_rng(5).normal(size=(1500, 32))
    rows = table(spark, m / np.linalg.norm(m, axis=1, keepdims=True))
    idx = index.VectorIndex(rows, 40)
    q = rows.where("id % 50 = 0")
    probes = idx.probes_for(rows, 5)
    exact = {(r["id"], r["other"]) for r in idx.knn(q, 5).collect()}
    found = {(r["id"], r["other"]) for r in idx.knn(q, 5, exact=False, probes=probes).collect()}
    assert 1 <= probes <= len(idx.pivots) and len(exact & found) >= 0.9 * len(exact)


def test_blocks_far_away_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 50)
    m = clustered(np.random.default_rng(6), 1200, spread=0.02)
    rows = table(spark, m)
    idx = index.VectorIndex(rows, 50)
    seen = []
    compared = idx._compared
    monkeypatch.setattr(idx, "_compared", lambda asked, keep: seen.append(asked.count()) or compared(asked, keep))
    idx.knn(rows, 3, probes=2).collect()
    assert sum(seen) < 0.5 * idx.blocks.count() * len(m)


def test_empty_and_single(spark):
    none = table(spark, [])
    one = table(spark, [[1.0, 0.0]])
    assert index.VectorIndex(none).knn(one, 3).count() == 0
    assert index.VectorIndex(one).knn(none, 3).count() == 0
    assert index.VectorIndex(one).knn(one, 3).count() == 0 and index.VectorIndex(one).pairs_over(one, 0.0).count() == 0


def test_small_and_large_tables_agree(spark, monkeypatch):
    m = clustered(np.random.default_rng(8), 400)
    rows = table(spark, m)
    small = {tuple(r)[:2] for r in vector.knn(rows, rows, 3).collect()}
    monkeypatch.setattr(vector, "FEW_BLOCKS", 0)
    assert {tuple(r)[:2] for r in vector.knn(rows, rows, 3).collect()} == small


def test_vectors_travel_once_for_a_pack(spark, monkeypatch):
    """On vectors without structure every cell is asked, yet no vector goes to each."""
    m = np.random.default_rng(9).normal(size=(600, 16))
    rows = table(spark, m / np.linalg.norm(m, axis=1, keepdims=True))
    idx = index.VectorIndex(rows, 5)
    seen, compared = [], idx._compared
    monkeypatch.setattr(idx, "_compared", lambda asked, keep: seen.append(asked.count()) or compared(asked, keep))
    idx.pairs_over(rows, 0.3)
    assert len(idx.pivots) == 120 and seen[0] <= 10 * len(m)


def test_greedy_pass_beside_existing_rows(spark):
    m = clustered(np.random.default_rng(10), 120)
    old, new = range(0, 120, 10), [i for i in range(120) if i % 10]
    want, sim = [], m @ m.T
    for i in new:
        if not any(sim[i, j] > 0.9 for j in [*old, *want]):
            want.append(i)
    got = vector.near_dedupe(table(spark, m[new], new), 0.9, table(spark, m[list(old)], old)).collect()
    assert sorted(r["id"] for r in got) == new and sorted(r["id"] for r in got if r["kept"]) == want


def test_gap_to_all_needs_no_pairs(spark):
    m = clustered(np.random.default_rng(11), 200)
    rows = spark.createDataFrame([(i, [float(x) for x in r], i % 7) for i, r in enumerate(m)], "id long, v array<double>, label int")
    got = vector.gap_to_all(rows.where("id % 10 = 0"), rows).first()
    pairs = [(1 - m[q] @ m[r], abs(q % 7 - r % 7)) for q in range(0, 200, 10) for r in range(200) if q != r]
    s, k = np.array(pairs).T
    assert np.allclose([got["surface"], got["mechanism"], got["gap"], got["correlation"]], [s.mean(), k.mean(), s.mean() - k.mean(), np.corrcoef(s, k)[0, 1]], atol=2e-6)
