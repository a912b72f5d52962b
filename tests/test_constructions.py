"""Alternate graphs by name: fresh in a session, built again for another source, few."""

import pytest

from graphloom.operators import generate as gen
from graphloom.sources import store
from graphloom.sources.constructions import MOST, Constructions

EDGES = "id string, source string, target string, relation string, provenance string, epistemic_state string, confidence_score double, owner string"


def edges(spark, *ends):
    return spark.createDataFrame([(f"e_{s}__bridges__{t}", s, t, "bridges", "inferred", state, 1.0, s) for s, t, state in ends], EDGES)


def test_constructions_of_a_session(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    first, later = edges(spark, ("a", "b", "unverified"), ("a", "c", "failed")), edges(spark, ("b", "c", "grounded"))
    many = lambda path: store.current(spark, path)["edges"].count()
    one = Constructions(spark, root)
    path = one.open("Other View", "book", edges=first)
    assert many(path) == 2 and one.open("other-view", "book", edges=later) == path and one.open("Other View") == path
    assert many(path) == 2
    one.open("Other View", "another book", edges=later)
    assert many(path) == 1
    # Another session finds none of it, and the first one's other names stay where they are.
    kept = one.open("kept", edges=first)
    two = Constructions(spark, root)
    assert many(two.open("Other View")) == 0 and many(kept) == 2
    with pytest.raises(KeyError):
        two.pairs("kept")
    for i in range(MOST - 1):
        two._source[f"n{i}"] = None
    with pytest.raises(ValueError, match="at most"):
        two.open("one more")
    two.open("Other View", "book")


def test_pairs_of_a_construction_cross_with_the_graph(spark, tmp_path):
    c = Constructions(spark, f"file://{tmp_path}/c")
    c.open("x", edges=edges(spark, ("a", "b", "unverified"), ("c", "a", "grounded"), ("b", "c", "failed"), ("a", "ghost", "grounded")))
    adj = spark.createDataFrame([("a", "b"), ("b", "a")], "u string, v string")
    known = spark.createDataFrame([(x,) for x in "abc"], "id string")
    assert [(r["source"], r["target"]) for r in gen.ensemble(adj, known, c.pairs("x")).collect()] == [("a", "c")]
