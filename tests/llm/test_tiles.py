"""Pairs that the tiles of the near-duplicate join hand on."""

import numpy as np

from graphloom.llm import partenum


def test_tiles_hand_on_little_more_than_what_is_similar(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
    common = draw(700)
    sets = [np.unique(np.concatenate([common, draw(150)])) for _ in range(40)]  # 0.7 similar to each other
    sets += [np.unique(np.concatenate([sets[0][:-60], draw(60)])), np.unique(np.concatenate([sets[1], draw(200)]))]
    rows = [(i, len(s), np.bincount((s >> np.uint64(58)).astype(int), minlength=64).astype("<i4").tobytes(), s.tobytes()) for i, s in enumerate(sets)]
    loaded = spark.createDataFrame(rows, "id long, n long, hist binary, s binary")
    open_ = spark.createDataFrame([(1, i, i) for i in range(len(sets))], "sig long, id long, comp long")
    similar = set()
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 5 * inter >= 4 * (len(sets[i]) + len(sets[j]) - inter):
                similar.add((j, i))
    got = {tuple(r) for r in partenum._across(partenum._tiles(open_, loaded)).collect()}
    assert {(0, 40), (1, 41)} <= similar <= got
    assert len(got) <= len(similar) + 20  # the coarse histograms alone let hundreds pass
