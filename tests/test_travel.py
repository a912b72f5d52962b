"""What travels: pairs once, searches together, seeds without all pairs, few items to many edges."""

import random

from pyspark.sql import functions as F

from graphloom.operators import commit
from graphloom.operators import generate as gen
from graphloom.operators import graph as g

EDGE = "id string, source string, target string, relation string, provenance string, epistemic_state string, confidence_score double, owner string"


def frame(spark, pairs, state="grounded"):
    return spark.createDataFrame([(f"e_{a}_{b}", a, b, "bridges", "inferred", state, 1.0, a) for a, b in pairs], EDGE)


def test_a_pair_travels_once(spark):
    adj = g.adjacency(frame(spark, [("b", "a"), ("a", "b"), ("c", "c"), ("b", "c")]))
    assert sorted(tuple(r) for r in adj.collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    plan = adj._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # both ways only after the exchange


def test_paths_of_several_nodes_are_searched_together(spark, monkeypatch):
    made, plain = [], g.stored
    monkeypatch.setattr(g, "stored", lambda df, what: made.append(what) or plain(df, what))
    e = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("far", "away")])
    steps = g.explain_path(e, ["n0", "n2", "n4"]).orderBy("step").collect()
    assert [(r["source"], r["target"], r["hops"], r["path"]) for r in steps] == [("n0", "n2", 2, ["n0", "n1", "n2"]), ("n2", "n4", 2, ["n2", "n3", "n4"])]
    assert made.count("bfs") == 5  # the start and four levels, not those of three searches to their ends
    lost = g.explain_path(e, ["n0", "away"]).collect()
    assert [r["hops"] for r in lost] == [None]


def test_seeds_for_agreement_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample([f"n{i:02}" for i in range(30)], 2))) for _ in range(90)})
    e = frame(spark, pairs).unionByName(frame(spark, [("n03", "n11"), ("n07", "n02")], "failed"))
    adj = gen.stored(g.adjacency(e), "adjacency")
    others = sorted({tuple(sorted(r.sample([f"n{i:02}" for i in range(30)], 2))) for _ in range(60)} - set(pairs))
    ensemble = lambda: gen.ensemble(adj, adj.select(F.col("u").alias("id")).distinct(), spark.createDataFrame(others, "u string, v string"))
    none = lambda: ensemble().where("false")
    makers = {m: none for m in gen.ORDER} | {"ensemble": ensemble, "seed": lambda: gen.seed(adj)}
    want = sorted(tuple(x) for x in gen.run(makers, "all", 10, e).select("mechanism", "source", "target", "score", "convergence").collect())
    makers["seed"] = lambda pairs: gen.seed(adj, e, 10, pairs)

    def fail(adj):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(gen, "wedges", fail)
    got = sorted(tuple(x) for x in gen.run(makers, "all", 10, e).select("mechanism", "source", "target", "score", "convergence").collect())
    assert got == want and any(x[4] > 1 for x in got)


def test_few_incoming_edges_meet_the_existing_as_many_do(spark):
    old = frame(spark, [("a", "b"), ("b", "c")]).unionByName(frame(spark, [("c", "d")], "unverified"))
    new = frame(spark, [("a", "b"), ("c", "d"), ("d", "e")], "unverified").withColumn("owner", F.lit("new")).withColumn("ord", F.lit(1))
    many, few = (sorted(tuple(x) for x in commit.merged_edges(old, new, few=f).select("id", "epistemic_state", "owner").collect()) for f in (False, True))
    assert few == many and len(few) == 4


def test_graph_json_is_packed_and_comes_back(spark, tmp_path):
    from graphloom.sources import io

    e = frame(spark, [("b", "c"), ("a", "b")])
    n = spark.createDataFrame([("b", None), ("a", 'x "y"')], "id string, label string")
    path = f"file://{tmp_path}/graph"
    io.write_graph_json(n, e, path)
    assert [f.suffix for f in (tmp_path / "graph").glob("part-*")] == [".gz"] * len(list((tmp_path / "graph").glob("part-*"))) != []
    lines = [r["value"][:30] for r in spark.read.text(path).collect()]
    assert sorted(lines)[0].startswith('{"kind":"link"') and len(lines) == 4
    back_n, back_e = io.read_graph_json(spark, path, n, e)
    assert sorted(map(tuple, back_n.collect()), key=str) == sorted(map(tuple, n.collect()), key=str)
    assert sorted(map(tuple, back_e.collect())) == sorted(map(tuple, e.collect()))


def test_texts_are_scanned_once_to_be_scrubbed(spark, tmp_path):
    from graphloom.functions import scrub as sc

    spark.createDataFrame([(1, "write to a@example.com"), (2, "nothing here"), (3, None)], "i long, t string").write.parquet(f"file://{tmp_path}/t")
    out = sc.scrub(spark.read.parquet(f"file://{tmp_path}/t"), "i", "t")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    got = {r["i"]: (r["text"], len(r["placeholders"])) for r in out.collect()}
    assert got[2] == ("nothing here", 0) and got[3] == ("", 0) and got[1][1] == 1 and "example" not in got[1][0]


def test_merges_are_a_table_that_edges_need_not_travel_for(spark, sf):
    from graphloom.plans import write_queries as q

    merges = q._merges(spark, sf)
    assert "parquet" in merges.inputFiles()[0] and "/merges-" in merges.inputFiles()[0]
