"""Registered queries of the vector pipeline, preference memory and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vector as v
from ..operators.checkpoint import shared_dir
from ..operators.index import VectorIndex
from ..sources import lift
from ..streaming import audit
from .registry import query


def _vectors(spark, d) -> DataFrame:
    return lift.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


E = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(E + """, s AS (SELECT q.id, r.id AS other, round(list_inner_product(q.v, r.v), 12) AS c FROM e q JOIN e r ON q.id % 50 = 0 AND q.id <> r.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rn FROM s)
SELECT id, round(avg(least(greatest(1 - c, 0), 2)), 6) AS novelty FROM k WHERE rn <= 5 GROUP BY id""")
def knn_novelty(spark, d):
    e = _vectors(spark, d)
    return v.novelty(e.where("id % 50 = 0"), e, 5)


@query(E + """, s AS (SELECT q.id, r.id AS other, round(list_inner_product(q.v, r.v), 12) AS c FROM e q JOIN e r ON q.id % 50 = 0 AND q.id <> r.id)
SELECT id, other, k, round(c, 9) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS k FROM s) WHERE k <= 5""")
def knn_join(spark, d):
    """Ids divisible by 50 against all rows; exact."""
    e = _vectors(spark, d)
    near = VectorIndex(e).knn(e.where("id % 50 = 0"), 5)
    return near.select("id", "other", F.col("k").cast("long").alias("k"), F.round("cosine", 9).alias("cosine"))


@query()
def knn_recall(spark, d):
    """``id, found``: how many of the five nearest the cells alone give that hold
    0.95 of a sample's neighbours; ids divisible by 50 against all rows."""
    e = _vectors(spark, d)
    index, q = VectorIndex(e), e.where("id % 50 = 0")
    fast = index.knn(q, 5, exact=False, probes=index.probes_for(e, 5)).select("id", "other", F.lit(1).alias("hit"))
    return index.knn(q, 5).join(fast, ["id", "other"], "left").groupBy("id").agg(F.count("*").alias("asked"), F.count("hit").alias("found"))


@query(E + " SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE round(list_inner_product(a.v, b.v), 12) > 0.35")
def similarity_join(spark, d):
    e = _vectors(spark, d)
    return VectorIndex(e).pairs_over(e, 0.35)


@query(E.replace("WITH e", "WITH RECURSIVE e", 1) + """, p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE list_inner_product(a.v, b.v) > 0.35), o AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM e),
nb AS (SELECT o.i, o.id, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS near FROM o LEFT JOIN p ON p.b = o.id GROUP BY ALL),
f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT nb.i, CASE WHEN list_has_any(f.kept, nb.near) THEN f.kept ELSE list_append(f.kept, nb.id) END FROM f JOIN nb ON nb.i = f.i + 1)
SELECT id, id IN (SELECT unnest(kept) FROM f WHERE i = (SELECT max(i) FROM f)) AS kept FROM e""")
def near_dedupe(spark, d):
    return v.near_dedupe(_vectors(spark, d), 0.35)


@query(E + ", p AS (SELECT list_inner_product(a.v, b.v) AS c FROM e a JOIN e b ON a.id < b.id) SELECT (SELECT count(*) FROM e) AS n, round(avg(c), 6) AS mean_cosine FROM p")
def mean_cosine(spark, d):
    return v.mean_pairwise_cosine(_vectors(spark, d)).select("n", F.round("mean_cosine", 6).alias("mean_cosine"))


PLACED = """, pl AS (SELECT id, 'edginess=b' || least(greatest(floor((v[1] + 1) / 2 * 5), 0), 4)::INT || '|label=' || label AS niche_id, (label % 3)::DOUBLE AS fitness, round(v[2], 6) AS novelty FROM e),
el AS (SELECT niche_id, max_by(id, struct_pack(f := fitness, n := novelty, a := -id)) AS elite, max(fitness) AS fitness, count(*) AS n FROM pl GROUP BY 1)"""


def _placed(spark, d) -> DataFrame:
    e = _vectors(spark, d)
    niche = v.niche_id({"label": v.category_of(F.col("label").cast("string")), "edginess": v.bin_of(F.col("v")[0].cast("double").cast("string"), -1.0, 1.0)})
    return e.select("id", niche.alias("niche_id"), (F.col("label") % 3).cast("double").alias("fitness"), F.round(F.col("v")[1].cast("double"), 6).alias("novelty"), F.col("id").alias("seq"))


@query(E + PLACED + " SELECT niche_id, elite, fitness, n FROM el")
def niche_elites(spark, d):
    return v.elites(_placed(spark, d)).select("niche_id", "elite", "fitness", "n")


@query(E + PLACED + ", t AS (SELECT count(*) AS occupied, sum(n) AS t, sum(n * ln(n)) AS x FROM el) SELECT occupied, round(ln(t) - x / t, 6) AS entropy, round((ln(t) - x / t) / ln(occupied), 6) AS normalised FROM t")
def niche_entropy(spark, d):
    return v.entropy(v.elites(_placed(spark, d)))


@query(E + PLACED + """, pc AS (SELECT avg(list_inner_product(a.v, b.v)) AS c FROM e a JOIN e b ON a.id < b.id), t AS (SELECT count(*) AS occupied, sum(n) AS t, sum(n * ln(n)) AS x FROM el), m AS (SELECT round(c, 6) AS mean_cosine, c, occupied, round((ln(t) - x / t) / ln(occupied), 6) AS normalised FROM pc, t)
SELECT mean_cosine, occupied, normalised, c > 0.55 AS too_similar, occupied >= 3 AND normalised < 0.5 AS too_concentrated, c > 0.55 OR (occupied >= 3 AND normalised < 0.5) AS collapsing FROM m""")
def collapse_monitor(spark, d):
    return v.monitor(_vectors(spark, d), _placed(spark, d))


@query(E + ", s AS (SELECT q.id, max(list_inner_product(q.v, r.v)) AS c FROM e q JOIN e r ON r.id % 50 = 0 AND q.id <> r.id GROUP BY q.id) SELECT id, round(least(greatest(1 - c, 0), 2), 4) AS originality FROM s")
def originality(spark, d):
    e = _vectors(spark, d)
    return v.originality(e, e.where("id % 50 = 0"))


@query()
def vendi_score(spark, d):
    return spark.createDataFrame([(round(v.vendi(_vectors(spark, d)), 6),)], "vendi double")


@query()
def dpp_slate(spark, d):
    e = _vectors(spark, d)
    return v.slate(e.withColumn("novelty", F.col("v")[1].cast("double")).withColumn("fitness", (F.col("label") % 3).cast("double")))


@query()
def kmeans_freeze(spark, d):
    e = _vectors(spark, d)
    cells = v.freeze_cells(e, 24)
    return e.groupBy(v.nearest_cell(F.col("v"), cells).alias("cell")).agg(F.count("*").alias("n"))


@query(E + """, cl AS (SELECT 'cell' || c.label AS cell, c.v AS cv, c.label FROM e c JOIN (SELECT label, min(id) AS id FROM e GROUP BY label) m USING (id)), s AS (SELECT e.id, cl.cell, row_number() OVER (PARTITION BY e.id ORDER BY round(list_inner_product(e.v, cl.cv), 12) DESC, cl.label) AS k FROM e, cl)
SELECT id, cell FROM s WHERE k = 1""")
def open_axis_cells(spark, d):
    e = _vectors(spark, d)
    cells = e.groupBy(F.col("label").alias("cell")).agg(F.min_by("v", "id").alias("v"))
    return e.select("id", v.nearest_cell(F.col("v"), cells).alias("cell"))


@query(E + """, sl AS (SELECT id, v, (label % 3)::DOUBLE AS fitness, round(v[2], 6) AS novelty FROM e ORDER BY round(v[2], 6) DESC, id LIMIT 30)
SELECT a.id AS a, b.id AS b, round(0.5 * list_inner_product(a.v, b.v) + 0.3 * (1 - abs(a.fitness - b.fitness)) + 0.2 * (a.novelty + b.novelty) / 2, 6) AS score FROM sl a JOIN sl b ON a.id < b.id WHERE (a.id + b.id) % 2 = 1 ORDER BY score DESC, a, b LIMIT 2""")
def ask_pairs(spark, d):
    """A slate of the 30 most novel rows; pairs of an even sum are decided."""
    e = _vectors(spark, d).withColumn("fitness", (F.col("label") % 3).cast("double")).withColumn("novelty", F.round(F.col("v")[1].cast("double"), 6))
    sl = e.orderBy(F.desc("novelty"), "id").limit(30)
    ids = sl.select(F.col("id").alias("a"))
    decided = ids.join(F.broadcast(ids.toDF("b")), F.col("a") < F.col("b")).where("(a + b) % 2 = 0")
    return v.ask_pairs(sl, decided)


EV = "WITH ev AS (SELECT user_id % 5 AS domain, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'pin' WHEN 'error' THEN 'discard' WHEN 'signup' THEN 'release' WHEN 'click' THEN 'comparison' END AS kind, user_id AS id, user_id AS winner FROM events)"


def _events(spark, d) -> DataFrame:
    t = F.col("event_type")
    return lift.table(spark, d, "events").select((F.col("user_id") % 5).alias("domain"), F.col("event_id").alias("seq"), F.when(t == "purchase", "pin").when(t == "error", "discard").when(t == "signup", "release").when(t == "click", "comparison").alias("kind"), F.col("user_id").alias("id"), F.col("user_id").alias("winner"))


@query(EV + " SELECT domain, id, max_by(kind, seq) AS lane FROM ev WHERE kind IN ('pin', 'discard', 'release') GROUP BY domain, id HAVING max_by(kind, seq) <> 'release'")
def pin_lanes(spark, d):
    return v.lanes(_events(spark, d))


@query(EV + " SELECT domain, winner AS id, wins, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY wins DESC, f) AS rn FROM (SELECT domain, winner, count(*) AS wins, min(seq) AS f FROM ev WHERE kind = 'comparison' GROUP BY ALL)) WHERE rn <= 10")
def preference_recall(spark, d):
    return v.recall(_events(spark, d)).select("domain", "id", "wins", "position")


@query(E + EV.replace("WITH ", ", ") + PLACED + " SELECT elite AS id FROM el UNION SELECT id FROM ev WHERE kind = 'pin' UNION SELECT winner FROM ev WHERE kind = 'comparison'")
def keep_set(spark, d):
    ev = _events(spark, d)
    return v.keep_set(v.elites(_placed(spark, d)).select(F.col("elite").alias("id")), ev.where("kind = 'pin'"), ev.where("kind = 'comparison'"))


@query(E + ", p AS (SELECT 1 - list_inner_product(q.v, r.v) AS surface, abs(q.label - r.label)::DOUBLE AS mechanism FROM e q JOIN e r ON q.id % 50 = 0 AND q.id <> r.id) SELECT round(avg(surface), 6) AS surface, round(avg(mechanism), 6) AS mechanism, round(avg(surface) - avg(mechanism), 6) AS gap, round(corr(surface, mechanism), 6) AS correlation FROM p")
def surface_gap(spark, d):
    e = _vectors(spark, d)
    return v.gap_to_all(e.where("id % 50 = 0"), e)


@query("SELECT user_id AS key, event_type AS \"to\", count(*) AS have FROM events GROUP BY ALL")
def audit_tail_stream(spark, d):
    src = lift.table(spark, d, "events")
    stream = spark.readStream.schema(src.schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{d}/events.parquet*")
    ledger = stream.select(F.col("user_id").alias("key"), F.col("event_type").alias("to"))
    return audit.run_to_end(audit.records(ledger), f"{shared_dir(spark)}/graphloom/audit-{uuid.uuid4().hex}")


@query("SELECT item_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM benchmark")
def hash_embedder(spark, d):
    b = v.hash_embedding(lift.table(spark, d, "benchmark"), "item_id", "text")
    return b.select("item_id", F.round(v.dot(F.col("v"), F.col("v")), 6).alias("norm"))
