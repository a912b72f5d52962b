"""The stream of cycles against the batch operators applied in order."""

import numpy as np

from graphloom.operators import archive, measure
from graphloom.streaming import audit, cycle

SCHEMA = "project string, session string, cycle long, id long, v array<double>, niche_id string, fitness double, seq long, target long"


def candidates(seed, project, session, cycles, start, n=9, dims=6):
    rng = np.random.default_rng(seed)
    rows, i = [], start
    for c in cycles:
        for _ in range(n):
            v = rng.normal(size=dims) + np.array([c / 5, *[0] * (dims - 1)])
            v /= np.linalg.norm(v)
            rows.append((project, session, c, i, [float(x) for x in v], f"n{rng.integers(0, 4)}", float(rng.integers(0, 3)), i, 10))
            i += 1
    return rows


def streamed(spark, tmp_path, batches, **more):
    path = f"file://{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    with cycle.state_in_rocksdb(spark):
        return audit.run_to_end(cycle.cycles(stream, **more), f"file://{tmp_path}/out", "append").collect()


def in_order(spark, rows):
    """Placements and cycles of one session by the batch operators."""
    niches = spark.createDataFrame([], "niche_id string, elite long, fitness double, novelty double, n long, seq long")
    vectors = spark.createDataFrame([], "id long, v array<double>")
    placed, told = [], []
    for c in sorted({r[2] for r in rows}):
        df = spark.createDataFrame([r for r in rows if r[2] == c], SCHEMA)
        got, niches = archive.ingest(df.select("id", "v", "niche_id", "fitness", "seq"), niches, vectors, 0.9, 3)
        niches = spark.createDataFrame(niches.collect(), niches.schema)
        kept = df.join(got.select("id"), "id", "left_semi").select("id", "v").collect()
        vectors = spark.createDataFrame([*vectors.collect(), *kept], "id long, v array<double>")
        placed += [(c, x["id"], x["niche_id"], x["fitness"], x["novelty"], x["seq"]) for x in got.collect()]
        m = np.array([x["v"] for x in kept])
        cosine = float((np.square(m.sum(axis=0)).sum() - np.square(m).sum()) / (len(m) * (len(m) - 1))) if len(m) > 1 else None
        told.append(("s", c, len(m), cosine, float(np.mean([x[4] for x in placed if x[0] == c])) if len(m) else None, df.count(), 10))
    t = spark.createDataFrame(told, "session string, cycle long, n long, mean_cosine double, novelty double, submitted long, target long")
    limits = {r["cycle"]: (r["similarity_limit"], r["too_similar"]) for r in measure.similarity_limits(t).collect()}
    erosion = {r["cycle"]: (r["streak"], r["eroding"]) for r in measure.erosion(t).collect()}
    return placed, {c: (*limits[c], *erosion[c]) for c in limits}


def test_cycles_equal_the_batch_operators_in_order(spark, tmp_path):
    a, b = candidates(1, "a", "s1", range(1, 7), 0), candidates(2, "b", "t1", range(1, 3), 1000)
    split = lambda rows, low, high: [r for r in rows if low <= r[2] < high]
    batches = [split(a, 1, 3) + split(b, 1, 2), split(a, 3, 7), split(a, 7, 9) + split(b, 2, 9), split(a, 3, 4)]  # the last comes again
    out = streamed(spark, tmp_path, batches, tau=0.9, k=3)
    assert {r["cycle"] for r in out if r["project"] == "b"} == {1, 2}
    for project, rows in (("a", a),):
        placed, told = in_order(spark, rows)
        mine = [r for r in out if r["project"] == project]
        got = sorted((r["cycle"], r["id"], r["niche_id"], r["fitness"], r["novelty"], r["seq"]) for r in mine if r["kind"] == "placed")
        assert [g[:4] + g[5:] for g in got] == [p[:4] + p[5:] for p in sorted(placed)]
        assert np.allclose([g[4] for g in got], [p[4] for p in sorted(placed)], atol=2e-6)
        said = {r["cycle"]: (r["similarity_limit"], r["too_similar"], r["streak"], r["eroding"]) for r in mine if r["kind"] == "cycle"}
        assert said.keys() == told.keys() and all(said[c][1:] == told[c][1:] and abs(said[c][0] - told[c][0]) < 1e-5 for c in told)


def test_a_new_session_begins_with_nothing(spark, tmp_path):
    one = candidates(3, "a", "s1", [1, 2], 0)
    again = [(p, "s2", c - 1, i + 500, v, n, f, s + 500, t) for p, _, c, i, v, n, f, s, t in one if c == 2]
    out = streamed(spark, tmp_path, [one, again], tau=0.9, k=3)
    fresh = [r for r in out if r["session"] == "s2" and r["kind"] == "placed"]
    placed, _ = in_order(spark, [(p, s, c, i - 500, v, n, f, q - 500, t) for p, s, c, i, v, n, f, q, t in again])
    assert sorted(r["id"] - 500 for r in fresh) == sorted(p[1] for p in placed)


def test_no_vector_one_row_and_a_bounded_state(spark, tmp_path):
    row = lambda c, i, v: ("a", "s", c, i, v, "n", 1.0, i, 1)
    batches = [[row(1, 1, None), row(1, 2, [1.0, 0.0])], [row(2, 3, [0.0, 1.0])], [row(3, 4, [0.0, 1.0]), row(3, 5, [1.0, 0.0])]]
    out = streamed(spark, tmp_path, batches, tau=0.9, k=2, keep=1)
    got = sorted((r["cycle"], r["id"]) for r in out if r["kind"] == "placed")
    # Of two vectors the elite's stays: the first of equal fitness is less novel, so the second leads.
    assert got[:2] == [(1, 2), (2, 3)] and len([g for g in got if g[0] == 3]) == 1
    assert {r["cycle"]: (r["submitted"], r["kept"]) for r in out if r["kind"] == "cycle"} == {1: (2, 1), 2: (1, 1), 3: (2, 1)}
