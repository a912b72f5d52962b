"""Projections from deltas against whole ones, and flags over several projections."""

import random

from graphloom.operators import flags, projection

OWNED = "id string, source string, target string, relation string, provenance string, epistemic_state string, owner string"
STATES = ["unverified", "grounded", "failed", "obsolete"]


def rows(r, n=60):
    out = {}
    for _ in range(n):
        a, b = (f"n{r.randrange(12)}" for _ in "ab")
        owner = r.choice([a, b, "other"])
        out[f"e_{a}_{b}", owner] = (f"e_{a}_{b}", a, b, "bridges", "inferred", r.choice(STATES), owner)
    return out


def plain(table):
    return sorted(map(tuple, table.collect()), key=str)


def test_deltas_equal_a_whole_projection(spark):
    r = random.Random(1)
    old = rows(r)
    communities = {f"n{i}": r.randrange(3) for i in range(12)}
    frame = lambda x: spark.createDataFrame(list(x.values()), OWNED)
    node_table = lambda c: spark.createDataFrame(list(c.items()), "id string, community int")
    now = projection.project(node_table(communities), frame(old))
    for _ in range(2):
        new = dict(old)
        for key in r.sample(sorted(old), 6):
            del new[key]
        new |= dict(r.sample(sorted(rows(r, 8).items()), 4))
        for key in r.sample(sorted(new), 5):
            new[key] = (*new[key][:5], r.choice(STATES), key[1])
        after = dict(communities)
        after.pop(r.choice(sorted(after)))
        after[r.choice(sorted(after))] = 9
        after[f"n{20 + r.randrange(9)}"] = 1
        owners = {k[1] for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
        before = now
        now = projection.projected(now, node_table(after), frame(old), frame(new), spark.createDataFrame([(o,) for o in owners], "owner string"))
        whole = projection.project(node_table(after), frame(new))
        for name in ("canonical", "pairs", "degree", "bridges", "signature"):
            assert plain(now[name].select(*whole[name].columns)) == plain(whole[name]), name
        moved = {x["id"] for n in ("degree", "bridges") for x in whole[n].exceptAll(before[n]).collect()}
        assert {x["id"] for x in now["moved"].collect()} == moved
        old, communities = new, after


def test_betweenness_is_reused_while_the_topology_is_the_same(spark, monkeypatch):
    calls = []
    kept = projection.betweenness
    monkeypatch.setattr(projection, "betweenness", lambda *a: calls.append(1) or kept(*a))
    nodes = spark.createDataFrame([(x, 1) for x in "abc"], "id string, community int")
    edge = lambda a, b, state: (f"e_{a}_{b}", a, b, "bridges", "inferred", state, a)
    old = spark.createDataFrame([edge("a", "b", "unverified"), edge("b", "c", "unverified")], OWNED)
    graded = spark.createDataFrame([edge("a", "b", "grounded"), edge("b", "c", "unverified")], OWNED)
    cut = spark.createDataFrame([edge("a", "b", "failed"), edge("b", "c", "unverified")], OWNED)
    owner = spark.createDataFrame([("a",)], "owner string")
    now = projection.projected(projection.project(nodes, old, ranks=True), nodes, old, graded, owner)
    assert len(calls) == 1 and {x["id"]: x["betweenness"] for x in now["betweenness"].collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    now = projection.projected(now, nodes, graded, cut, owner)
    assert len(calls) == 2 and {x["betweenness"] for x in now["betweenness"].collect()} == {0.0}


def test_re_examinable_flags_over_projections(spark):
    r = random.Random(4)
    held, want = None, {}
    for now in range(1, 5):
        items = [("node" if i % 2 else "edge", f"i{i}", r.choice(["failed", "rejected", "grounded", "unverified"]) if r.random() < 0.4 or now == 1 else None, [f"t{r.randrange(9)}", f"t{i % 9}"]) for i in range(30)]
        items = [(k, i, s or last[i], t) for (k, i, s, t) in items] if now > 1 else items
        last = {i: s for _, i, s, _ in items}
        terms = {f"t{r.randrange(9)}" for _ in range(2)}
        df = spark.createDataFrame(items, "kind string, id string, epistemic_state string, terms array<string>")
        held = flags.re_examinable(flags.none(df) if held is None else held, df, spark.createDataFrame([(t,) for t in terms], "term string"), now)
        held = spark.createDataFrame(held.collect(), held.schema)
        bad = {(k, i) for k, i, s, _ in items if s in ("failed", "rejected")}
        want = {x: since for x, since in want.items() if x in bad} | {(k, i): want.get((k, i), now) for k, i, _, t in items if (k, i) in bad and terms & set(t)}
        assert {(x["kind"], x["id"]): x["since"] for x in held.collect()} == want


def test_stale_flags_until_the_span_is_there_again(spark):
    edge = lambda i, state="grounded", span="a span": ("edge", i, state, "span-present", span, "book")
    table = lambda *x: spark.createDataFrame(list(x), "kind string, id string, epistemic_state string, provenance string, norm_span string, source_file string")
    book = lambda text: spark.createDataFrame([("book", text)], "name string, norm string")
    changed = lambda *ids: spark.createDataFrame([("edge", i) for i in ids], "kind string, id string")
    found = lambda f: {x["id"]: x["since"] for x in f.collect()}
    edges = table(edge("x"), edge("y", span="other words"), edge("z", "unverified"), edge("q", "failed"))
    one = flags.stale(flags.none(edges), edges, book("nothing"), 1)
    assert found(one) == {"x": 1, "y": 1, "q": 1}
    two = flags.stale(one, edges, book("here is a span"), 2)
    assert found(two) == {"y": 1}
    edited = table(edge("x", span="lost"), edge("y", "rejected", "other words"), edge("q", "failed"))
    three = flags.stale(two, edited, book("here is a span"), 3, changed("x", "y"))
    assert found(three) == {"x": 3}
    four = flags.stale(three, table(edge("x", span="a span"), edge("q", "failed")), book("here is a span"), 4, changed("x"))
    assert found(four) == {}
