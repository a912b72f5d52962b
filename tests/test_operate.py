"""The four operations: what they find, what they refuse and what the store has after them."""

import pytest

from graphloom.operators import commit, operate
from graphloom.operators.operate import Refused
from graphloom.sources import store

PACK = {"node_types": ["compression", "primitive"], "edge_types": ["collapses_into", "bridges"]}
EDGES = "id string, source string, target string, relation string, provenance string, epistemic_state string, confidence_score double"


@pytest.fixture
def graph(spark):
    """Two triangles and a loner; ``a`` has two relations and a failed third."""
    ends = [("a", "b", "grounds", "grounded"), ("a", "c", "projects", "grounded"), ("b", "c", "grounds", "unverified"), ("d", "e", "grounds", "grounded"), ("e", "f", "grounds", "grounded"), ("f", "d", "grounds", "grounded"), ("a", "d", "approximates", "failed")]
    edges = spark.createDataFrame([(f"e_{s}__{r}__{t}", s, t, r, "inferred", state, 1.0) for s, t, r, state in ends], EDGES)
    nodes = spark.createDataFrame([(x, x.upper(), "primitive") for x in "abcdefz"], "id string, label string, node_type string")
    of = spark.createDataFrame([(x, 1) for x in "abc"] + [(x, 2) for x in "def"], "id string, community int")
    return nodes, edges, of


def made(pair):
    nodes, edges = pair
    return sorted((r["id"], r["authored_by"]) for r in nodes.collect()), sorted((r["source"], r["relation"], r["target"]) for r in edges.collect())


def test_collapse_takes_members_a_community_or_the_largest(graph):
    nodes, edges, of = graph
    n, e = made(operate.structure("collapse", nodes, edges, of, members=["b", "a", "b", "nobody"]))
    assert len(n) == 1 and n[0][0].startswith("compression-a-") and [x[0] for x in e] == ["a", "b"] and {x[2] for x in e} == {n[0][0]}
    n, e = made(operate.structure("collapse", nodes, edges, of, target="e", label="Mine"))
    assert n[0][1] == "agent" and [x[0] for x in e] == ["d", "e", "f"]
    n, e = made(operate.structure("collapse", nodes, edges, of))
    assert n[0][1] == "deterministic" and [x[0] for x in e] == ["a", "b", "c"]
    for wrong, why in (({"target": "nobody"}, "not in the graph"), ({"target": "z"}, "at least 2"), ({"members": ["a", "nobody"]}, "at least 2")):
        with pytest.raises(Refused, match=why):
            operate.structure("collapse", nodes, edges, of, **wrong)


def test_collapse_finds_communities_itself(graph):
    nodes, edges, _ = graph
    assert [x[0] for x in made(operate.structure("collapse", nodes, edges))[1]] == ["a", "b", "c"]


def test_explode_numbers_relations_and_bounds_them(graph):
    nodes, edges, _ = graph
    n, e = made(operate.structure("explode", nodes, edges, target="a"))
    assert [x[0] for x in n] == ["a-facet-1", "a-facet-2", "a-facet-3"] and e == [(x[0], "collapses_into", "a") for x in n]
    assert [x[0] for x in made(operate.structure("explode", nodes, edges, target="z"))[0]] == ["z-facet-1", "z-facet-2"]
    assert [x[0] for x in made(operate.structure("explode", nodes, edges))[0]] == ["f-facet-1"]
    for k, many in ((0, 0), (-3, 0), (2, 2), (9, 3)):
        assert len(made(operate.structure("explode", nodes, edges, target="a", k=k))[1]) == many
    with pytest.raises(Refused, match="not in the graph"):
        operate.structure("explode", nodes, edges, target="nobody")
    with pytest.raises(Refused, match="no node"):
        operate.structure("explode", nodes.where("false"), edges.where("false"))


def test_open_attaches_to_the_highest_degrees(graph):
    nodes, edges, _ = graph
    n, e = made(operate.structure("open", nodes, edges))
    assert n == [("opening-a", "deterministic")] and e == [("opening-a", "bridges", "a"), ("opening-a", "bridges", "b")]
    assert len(made(operate.structure("open", nodes, edges, k=-1))[1]) == 1
    with pytest.raises(Refused, match="nothing"):
        operate.structure("open", nodes.where("false"), edges.where("false"))


def test_regroup_leaves_out_neighbours_and_failures(spark, graph):
    nodes, edges, _ = graph
    one = nodes.selectExpr("id", "1 as community")
    other = spark.createDataFrame([(x, int(x > "c")) for x in "abcdefz"], "id string, community int")
    pairs = lambda e: [x[::2] for x in made(operate.structure("regroup", nodes, e, one, other, k=100))[1]]
    want = [(x, y) for x in "abc" for y in "defz"]
    assert pairs(edges) == want  # the failed edge has another relation
    failed = spark.createDataFrame([("e_d__bridges__a", "d", "a", "bridges", "inferred", "failed", 1.0), ("e_b__bridges__f", "b", "f", "bridges", "inferred", "rejected", 1.0)], EDGES)
    assert pairs(edges.unionAll(failed)) == [p for p in want if p not in (("a", "d"), ("b", "f"))]
    with pytest.raises(Refused, match="no bridges"):
        operate.structure("regroup", nodes, edges, one, one)
    with pytest.raises(Refused, match="unknown"):
        operate.structure("fold", nodes, edges)


def test_operations_are_written_as_hypotheses_once(spark, tmp_path, graph):
    nodes, edges, of = graph
    path = f"file://{tmp_path}/s"
    commit.create(spark, path, nodes, edges.withColumn("owner", edges["source"]))
    told = operate.operate(spark, path, "Collapse", PACK, of).collect()
    assert {(r["kind"], r["disposition"], r["authored_by"]) for r in told} == {("node", "ACCEPTED", "deterministic"), ("edge", "ACCEPTED", "deterministic")}
    operate.operate(spark, path, "collapse", PACK, of)
    now = store.current(spark, path)
    new = [r for r in now["edges"].collect() if r["relation"] == "collapses_into"]
    assert len(new) == 3 and {(r["provenance"], r["epistemic_state"], r["authored_by"]) for r in new} == {("hypothesized", "unverified", "deterministic")}
    assert [r["node_type"] for r in now["nodes"].collect() if r["id"] == new[0]["target"]] == ["compression"]
    assert now["edges"].count() == 10 and now["nodes"].count() == 8
    with pytest.raises(Refused):
        operate.operate(spark, path, "explode", PACK, target="nobody")
    # A type that the pack does not have keeps the node out, and an edge that failed stays a failure.
    told = operate.operate(spark, path, "open", {"node_types": [], "edge_types": ["bridges"]}, label="New").collect()
    assert [(r["disposition"], r["authored_by"]) for r in told if r["kind"] == "node"] == [("QUARANTINED", "agent")]
