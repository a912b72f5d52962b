"""Operators on small graphs, texts and vectors."""

import itertools
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scrub as sc
from graphloom.functions import text as tx
from graphloom.operators import generate as gen
from graphloom.operators import graph as g
from graphloom.operators import measure as m
from graphloom.operators import retrieve as r
from graphloom.operators import vector as v
from graphloom.operators import write as w
from graphloom.sources import io


def graph(spark, pairs, states=None):
    ids = sorted({x for p in pairs for x in p})
    n = spark.createDataFrame([(i, i, "claim", 0) for i in ids], "id string, label string, node_type string, community int")
    e = spark.createDataFrame([(f"e_{a}__bridges__{b}", a, b, "bridges", "span-present", (states or {}).get((a, b), "grounded"), 0.5, a) for a, b in pairs], "id string, source string, target string, relation string, provenance string, epistemic_state string, confidence_score double, owner string")
    return n, e


def brandes(ids, neighbours):
    total = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, paths, order, before = {s: 0}, {s: 1.0}, [], {s: []}
        q = deque([s])
        while q:
            x = q.popleft()
            order.append(x)
            for y in neighbours[x]:
                if y not in dist:
                    dist[y], paths[y], before[y] = dist[x] + 1, 0.0, []
                    q.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
                    before[y].append(x)
        delta = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for p in before[x]:
                delta[p] += paths[p] / paths[x] * (1 + delta[x])
            if x != s:
                total[x] += delta[x]
    n = len(ids)
    return {i: t / ((n - 1) * (n - 2)) for i, t in total.items()}


def test_betweenness_equals_brandes(spark):
    rng = random.Random(3)
    ids = [f"n{i:02}" for i in range(14)]
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(24)})
    n, e = graph(spark, pairs)
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    known = [i for i in ids if near[i]]
    want = brandes(known, near)
    got = {x["id"]: x["betweenness"] for x in g.betweenness(g.vertices(n, e), g.adjacency(e)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_centrality_queries_see_the_whole_graph(spark, sf):
    from graphloom.plans import graph_queries as q
    from graphloom.sources import lift

    n, e = lift.nodes(spark, sf), lift.edges(spark, sf)
    ids = {x["id"] for x in g.vertices(n, e).collect()}
    near = {i: set() for i in ids}
    for x in g.adjacency(e).collect():
        near[x["u"]].add(x["v"])
    want = brandes(sorted(ids), near)
    got = {x["id"]: x["betweenness"] for x in q.betweenness(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-9 for i in want)
    assert any(got[i] > 0 for i in got if i.startswith("part-"))
    assert {x["id"] for x in q.communities(spark, sf).select("id").collect()} == {x["id"] for x in n.select("id").collect()}
    assert q.ranks_bundle(spark, sf).where("node_type = 'part' and betweenness > 0").count() > 0


@pytest.mark.parametrize("state", ["failed", "rejected", "obsolete"])
def test_no_path_through_what_is_not_live(spark, state):
    _, e = graph(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "f"), ("f", "c")], {("b", "c"): state})
    path = [x["id"] for x in g.shortest_path(g.adjacency(e), "a", "c").orderBy("position").collect()]
    assert path == ["a", "d", "f", "c"]
    assert g.shortest_path(g.adjacency(e), "a", "zzz").count() == 0
    assert [x["id"] for x in g.shortest_path(g.adjacency(e), "q", "q").collect()] == ["q"]


def test_search_ends_when_the_frontier_is_empty(spark):
    ids = [f"n{i:02}" for i in range(68)]
    _, e = graph(spark, list(zip(ids, ids[1:], strict=False)))
    got = {x["id"]: (x["hops"], x["path"]) for x in g.shortest_lengths(g.stored(g.adjacency(e), "adjacency"), "n00").collect()}
    assert got == {x: (i, ids[: i + 1]) for i, x in enumerate(ids)}


def test_explain_path_orders_and_reports_unreachable(spark):
    _, e = graph(spark, [("h", "a"), ("h", "b"), ("x", "y")])
    steps = g.explain_path(e, ["a", "b", "x"]).orderBy("step").collect()
    assert [(s["source"], s["target"], s["hops"]) for s in steps] == [("a", "b", 2), ("b", "x", None)]
    with pytest.raises(ValueError):
        g.explain_path(e, ["a"])


def test_communities_split_two_triangles(spark):
    n, e = graph(spark, [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("a1", "b1")])
    got = {x["id"]: x["community"] for x in g.communities(n, g.adjacency(e)).collect()}
    assert {got["a1"], got["a2"], got["a3"]} == {"a1"} and {got["b1"], got["b2"], got["b3"]} == {"b1"}


def test_seed_ranks_the_bipartite_pair_first(spark):
    pairs = [("h", f"l{i}") for i in range(1, 6)] + [(x, f"m{i}") for x in "pq" for i in (1, 2, 3)]
    _, e = graph(spark, pairs)
    best = gen.top(gen.seed(g.adjacency(e)), 1).first()
    assert (best["source"], best["target"]) == ("p", "q")


def test_failed_pairs_are_not_proposed_either_way(spark):
    _, e = graph(spark, [("a", "b")], {("a", "b"): "failed"})
    cand = spark.createDataFrame([("edge", "seed", "b", "a", "bridges", 1.0), ("edge", "seed", "a", "c", "bridges", 1.0)], "kind string, mechanism string, source string, target string, relation string, score double")
    assert [x["target"] for x in gen.not_failed(cand, e).collect()] == ["c"]


def test_run_generators_runs_all_seven(spark, sf, monkeypatch):
    from graphloom.plans import graph_queries as q

    seen = {}
    monkeypatch.setattr(gen, "run", lambda makers, mechanism, k, edges: seen.update(makers) or (mechanism, k))
    assert q.run_generators(spark, sf) == ("all", 10) and tuple(seen) == gen.ORDER
    monkeypatch.undo()
    got = {x["mechanism"] for x in q.run_generators(spark, sf).select("mechanism").distinct().collect()}
    assert {"seed", "ensemble", "regroup"} <= got
    with pytest.raises(ValueError):
        gen.run({"bridge": seen["bridge"]}, "all", 10, None)
    with pytest.raises(ValueError):
        gen.run({"bridge": seen["bridge"]}, "seed", 10, None)


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(f"{i:02}", "x" * (4 * n)) for i, n in enumerate([3, 1, 9, 1])], "id string, t string")
    got = r.budgeted(df, [F.asc("id")], 10, ["t"]).collect()
    assert [x["id"] for x in got] == ["00", "01"]


def test_flood_rejects_what_is_over_and_does_not_seed_repeats(spark):
    rows_ = [(1, i, f"id{i}", None) for i in range(70)] + [(1, 70, "id3", None), (1, 71, "id69", None)]
    df = spark.createDataFrame(rows_, "payload int, ord int, id string, reason string").withColumn("known", F.lit(False))
    got = {(x["ord"]): (x["reason"], x["deduped"]) for x in w.flood(df, F.lit(0), 64).collect()}
    assert got[63] == (None, False) and got[64][0] == "rate-limited-flood"
    assert got[70] == (None, True) and got[71] == ("rate-limited-flood", False)


def test_three_way_merge_over_all_states(spark):
    states = ["unverified", "grounded", "rejected", "failed", "obsolete"]
    pairs = list(itertools.product(states, states))
    df = lambda k: spark.createDataFrame([(f"{o}-{t}", (o, t)[k] if k < 2 else "unverified") for o, t in pairs], "id string, epistemic_state string")
    for x in w.three_way(df(2), df(0), df(1)).collect():
        o, t = x["id"].split("-")
        want = o if o == t else t if o == "unverified" else o if t == "unverified" else "unverified"
        assert x["epistemic_state"] == want and x["conflict"] == (o != t and "unverified" not in (o, t))


def test_alpha_bounds(spark):
    table = lambda rows_: spark.createDataFrame(rows_, "coder string, unit int, label string")
    alpha = lambda rows_: m.krippendorff_alpha(table(rows_)).first()["alpha"]
    same = [(c, u, "x" if u % 2 else "y") for c in "ab" for u in range(6)]
    assert alpha(same) == 1.0
    assert alpha([(c, u, {"a": "x", "b": "y"}[c]) for c in "ab" for u in range(6)]) < 0
    assert alpha([("a", 1, "x")]) is None
    assert alpha([(c, u, "x ") for c in "ab" for u in range(3)]) == 1.0


def test_normalisation_and_slugs(spark):
    df = spark.createDataFrame([("  A–B  “c” d​ ",), ("Plain  TEXT",), ("Straße",), (None,)], "t string")
    assert [x[0] for x in df.select(tx.normalize("t")).collect()] == ['a-b "c" d', "plain text", "strasse", None]
    s = spark.createDataFrame([("Hello, World",), ("é_x",), ("con",), ("!!",)], "t string")
    assert [x[0] for x in s.select(tx.slug("t")).collect()] == ["hello-world", "é-x", "con-", "node"]


def test_sections_ignore_headings_in_fences(spark):
    text = "intro\n## One\nbody\n```\n## not a heading\n```\n## Two\n\n## Three\nx"
    got = tx.sections(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id int, t string"), "id", "t").collect()
    assert [(x["id"], x["title"]) for x in got] == [(1, ""), (1, "One"), (1, "Two"), (1, "Three"), (3, "")]


def test_scrub_restores_and_numbers_consistently():
    text = "mail a@b.example and c@d.example, again a@b.example; token = \"abcdef123\""
    out, back = sc.scrub_py(text)
    assert out.count("⟦MAIL:1⟧") == 2 and "⟦MAIL:2⟧" in out and "abcdef123" not in out
    assert sc.restore_py(out, back) == text
    assert sc.scrub_py("⟦MAIL:7⟧ x@y.example")[0] == "⟦MAIL:7⟧ ⟦MAIL:8⟧"


def test_parallel_dedupe_equals_the_greedy_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = []
    for i in range(40):
        if all(x[i] @ x[j] <= 0.7 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "id long, v array<double>")
    assert sorted(y["id"] for y in v.near_dedupe(df, 0.7).where("kept").collect()) == kept


def test_diverse_choice_beats_chance():
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(12)[:5], 6, axis=0) + rng.normal(scale=0.01, size=(30, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spread = lambda c: np.mean([1 - x[a] @ x[b] for a, b in itertools.combinations(c, 2)])
    chosen = v.greedy_dpp(x, np.ones(30), 5)
    chance = np.mean([spread(rng.choice(30, 5, replace=False)) for _ in range(50)])
    assert len(set(chosen)) == 5 and spread(chosen) > chance + 0.05
    assert len(set(v.farthest(x, 5))) == 5


def test_vendi_and_mean_cosine(spark):
    df = lambda rows_: spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rows_)], "id long, v array<double>")
    assert abs(v.vendi(df(np.eye(6))) - 6) < 1e-9 and abs(v.vendi(df([[1, 0]] * 4)) - 1) < 1e-9
    assert v.mean_pairwise_cosine(df(np.eye(3))).first()["mean_cosine"] == 0


def test_bins_and_categories(spark):
    df = spark.createDataFrame([("0.0",), ("0.7",), ("1.0",), ("5.0",), ("-1",), ("NaN",), ("x",)], "t string")
    assert [x[0] for x in df.select(v.bin_of(F.col("t"), 0.0, 1.0)).collect()] == ["b0", "b3", "b4", "b4", "b0", "b0", "b2"]
    c = spark.createDataFrame([("Young Adults",), ("",), (None,), ("日本",)], "t string")
    got = [x[0] for x in c.select(v.category_of(F.col("t"))).collect()]
    assert got[:3] == ["young-adults", "none", "none"] and got[3].startswith("x-")


def test_notes_and_files_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: a\nlabel: A\nedges:\n- relation: bridges\n  target: b\n- nonsense\n---\nBody\n")
    (tmp_path / "bad.md").write_text("no front matter")
    notes = io.read_notes(spark, str(tmp_path))
    assert [(x["id"], x["body"]) for x in notes.collect()] == [("a", "Body")]
    assert [(x["source"], x["target"]) for x in io.note_edges(notes).collect()] == [("a", "b")]
    (tmp_path / "ledger.jsonl").write_text('{"key": "k", "to": "failed"}\nnot json\n\n')
    good, bad = io.read_ledger(spark, str(tmp_path / "ledger.jsonl"))
    assert good.count() == 1 and bad.count() == 1


def test_merges_are_refused_for_a_reason(spark):
    nodes = spark.createDataFrame([("a", "claim"), ("b", "claim"), ("c", "source"), ("d", "undeclared-type"), ("e", None), ("f", "claim")], "id string, node_type string")
    asked = [("A", "b"), ("b", "B "), ("c", "f"), ("c", "d"), ("d", "f"), ("zz", "a"), ("f", "zz"), ("e", "c")]
    got = {(r["old"], r["new"]): r["error"] for r in w.merge_requests(spark.createDataFrame(asked, "from string, into string"), nodes).collect()}
    assert got == {("a", "b"): "target-is-merged-too", ("b", "b"): "merge-into-itself", ("c", "f"): "node-type-conflict", ("c", "d"): "source-merged-twice", ("d", "f"): "target-is-merged-too", ("zz", "a"): "source-not-found", ("f", "zz"): "target-not-found", ("e", "c"): "target-is-merged-too"}


def test_a_merge_reports_and_migrates_what_it_moved(spark):
    edge = lambda s, t, state: (f"e_{s}__bridges__{t}", s, t, "bridges", "inferred", state)
    e = spark.createDataFrame([edge("a", "x", "grounded"), edge("b", "x", "unverified"), edge("a", "b", "unverified"), edge("b", "a", "failed"), edge("y", "a", "grounded"), edge("y", "z", "grounded")], "id string, source string, target string, relation string, provenance string, epistemic_state string")
    mapping = spark.createDataFrame([("a", "b")], "old string, new string")
    assert tuple(w.merge_report(e, mapping).first()) == (3, 1, 1)
    got = {(r["key"], r["to"]) for r in w.migrations(e, w.renamed(e, mapping)).collect()}
    assert got == {("e_b__bridges__x", "grounded"), ("e_b__bridges__b", "failed"), ("e_y__bridges__b", "grounded")}
