"""The rule ensemble: paths, compiled column, held-out accuracy, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, rules

INF = float("inf")


def test_a_tree_finds_a_conjunction_and_lasso_keeps_it():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(600, len(rules.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.6)).astype(float)
    found = sorted({r for seed in range(rules.TREES) for r in rules.grown(x, y, seed)})
    assert all(low < high for r in found for _, low, high in r) and all(1 <= len(r) <= rules.DEPTH for r in found)
    r = rules.fires(found, x)
    for k in range(0, len(found), 7):
        assert r[:, k].tolist() == [float(all(low < row[f] <= high for f, low, high in found[k])) for row in x]
    weights, bias = rules.lasso(r, y, 0.01)
    assert 0 < np.count_nonzero(weights) < len(found) / 2
    assert ((1 / (1 + np.exp(-(r @ weights + bias))) > 0.5) == (y == 1)).mean() > 0.97
    many, _ = rules.lasso(r, y, 0.0001)
    assert np.count_nonzero(many) > np.count_nonzero(weights)
    none, level = rules.lasso(r, y, 10.0)
    assert not none.any() and level == pytest.approx(np.log(y.mean() / (1 - y.mean())), abs=0.05)


def test_compiled_column_equals_the_rules_by_hand(spark):
    some = [((4, -INF, 0.5),), ((1, -INF, 2.0), (4, -INF, 0.5)), ((1, 2.0, INF),), ((4, 0.2, 0.9),), ((0, 4.5, INF), (4, -INF, 0.4))]
    model = rules.Ensemble([(r, 0.3 * k - 1) for k, r in enumerate(some)], 0.25)
    texts = [None, "", "a b c", "# # # $ %", "longerwordshere andmore", "a # b # c # d"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in rules.score(df, model).collect():
        s = rules.statistics((r["text"] or "").encode())
        z = 0.25 + sum(w for rule, w in model.rules if all(low < s[f] <= high for f, low, high in rule))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    out = queries.op12_rule_ensemble(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(g >= 0.7 for g in good) >= 0.97 * len(good) and sum(b < 0.7 for b in bad) >= 0.9 * len(bad)


def test_no_labels_one_kind_of_label_and_an_empty_table(spark):
    docs = spark.createDataFrame([(k, "some words " * k, 7.0) for k in range(1, 6)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    always = F.lit(True)
    assert [r["score"] for r in rules.score(docs, rules.fit(docs, labels.where("false"), always)).collect()] == [0.5] * 5
    assert [r["score"] for r in rules.score(docs, rules.fit(docs, labels, always)).collect()] == pytest.approx([0.75] * 5)
    empty = docs.where("false")
    out = rules.score(empty, rules.fit(empty, labels, always))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "score"]


def test_statistics_do_not_follow_the_length():
    text = b"The cat sat on the mat, and the dog lay by the door of a house.\nIt was late in the evening when rain began to fall.\n"
    once, often = rules.statistics(text * 4), rules.statistics(text * 400)
    for name, a, b in zip(rules.STATISTICS, once, often, strict=True):
        if name not in ("words", "dup_lines", "repeated", "repeated_3"):
            assert a == pytest.approx(b, rel=0.15, abs=0.02), name
