"""Registered queries of the advisories, the archive, the boundary and the stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import advise as a
from ..operators import archive as ar
from ..operators import boundary as b
from ..operators import commit, flags, operate, projection
from ..operators import graph as g
from ..operators import measure as m
from ..operators.checkpoint import shared_dir, stored
from ..sources import lift, store
from ..sources.lift import LIFT_SQL, edges, nodes, stored_edges
from .graph_queries import COLLAPSE, OTHER, R
from .registry import query

L = f"WITH {LIFT_SQL}"
STALE = " WHERE epistemic_state IN ('grounded', 'failed') AND provenance = 'span-present'"


@query(L + "SELECT id AS edge_id, 'span-no-longer-in-source' AS reason FROM kg_edges" + STALE + " AND length(id) % 3 <> 0")
def stale_verdicts(spark, d):
    return a.stale_verdicts(edges(spark, d).withColumn("verified", F.length("id") % 3 == 0))


@query(L + "SELECT id AS edge_id, 'span-no-longer-in-source' AS reason FROM kg_edges" + STALE + " AND length(id) % 3 <> 0 AND relation = 'bridges'")
def refiltered_flags(spark, d):
    e = edges(spark, d).withColumn("verified", F.length("id") % 3 == 0)
    prior = e.where("relation = 'bridges'").select(F.col("id").alias("edge_id"))
    return a.refiltered(prior.unionAll(spark.range(1).select(F.lit("gone").alias("edge_id"))), e)


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the columns that a context row has."""
    e = edges(spark, d)
    span = F.when(F.col("confidence_score") > 0.5, F.lit('naïve "span" 😀 of Supplier')).otherwise("")
    return e.select("*", F.lit("agent").alias("authored_by"), span.alias("span"), F.upper("provenance").alias("confidence"))


CONTEXT = """, told AS (SELECT *, 'agent' AS authored_by, CASE WHEN confidence_score > 0.5 THEN 'naïve "span" 😀 of Supplier' ELSE '' END AS span, upper(provenance) AS confidence FROM kg_edges
), js AS (SELECT *, '{"id": ' || to_json(id) || ', "source": ' || to_json(source) || ', "target": ' || to_json(target) || ', "relation": ' || to_json(relation) || ', "provenance": ' || to_json(provenance) || ', "authored_by": ' || to_json(authored_by) || ', "epistemic_state": ' || to_json(epistemic_state) || ', "span": ' || to_json(span) || ', "confidence": ' || to_json(confidence) || ', "confidence_score": ' || to_json(confidence_score) || '}' AS j FROM told
), tk AS (SELECT *, greatest(1, (length(regexp_replace(j, '[^\\x00-\\x7f]', '', 'g')) + 6 * (len(regexp_extract_all(j, '[^\\x00-\\x7f]')) + len(regexp_extract_all(j, '[\\x{10000}-\\x{10FFFF}]')))) // 4) AS tokens FROM js
  WHERE translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%-77%' OR target LIKE '%-77%'
), it AS (SELECT *, sum(tokens) OVER (ORDER BY CASE WHEN epistemic_state = 'grounded' THEN 0 ELSE 1 END, CASE provenance WHEN 'span-present' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END, confidence_score DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS used FROM tk WHERE epistemic_state NOT IN ('failed', 'rejected', 'obsolete') AND provenance <> 'hypothesized'
), hy AS (SELECT *, sum(tokens) OVER (ORDER BY confidence_score DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS used FROM tk WHERE provenance = 'hypothesized' AND epistemic_state = 'unverified')"""


@query(L + CONTEXT + """ SELECT 'items' AS lane, row_number() OVER (ORDER BY used)::INT AS position, id, tokens::BIGINT AS tokens, used::BIGINT AS used FROM it WHERE used <= 60000
UNION ALL SELECT 'hypotheses', row_number() OVER (ORDER BY used)::INT, id, tokens::BIGINT, used::BIGINT FROM hy WHERE used <= 60000 - (SELECT coalesce(max(used), 0) FROM it WHERE used <= 60000)""")
def context_whole(spark, d):
    return a.context(_told(spark, d), "-77", 60_000)


@query(L + CONTEXT + " SELECT id, tokens::BIGINT AS tokens FROM tk")
def json_tokens(spark, d):
    from ..operators.retrieve import matches

    return _told(spark, d).where(matches("-77", ["source", "target"])).select("id", a.json_tokens().alias("tokens"))


BRIDGE = """, br AS (SELECT n.id, count(DISTINCT c.community) AS bridge_communities FROM kg_nodes n LEFT JOIN kg_adj x ON x.u = n.id LEFT JOIN kg_nodes c ON c.id = x.v GROUP BY n.id
), rk AS (SELECT d.*, bridge_communities, (bridge_communities >= 2)::INT AS structural_bridge, (length(label) % 7)::DOUBLE AS betweenness, (length(id) % 5 + 1)::DOUBLE AS specificity FROM kg_degree d JOIN br USING (id))"""


def _ranked(spark, d) -> DataFrame:
    n = nodes(spark, d)
    adj = g.adjacency(edges(spark, d))
    r = g.degree(n, adj).join(g.bridge_communities(n, adj), "id")
    r = r.withColumn("betweenness", (F.length("label") % 7).cast("double")).withColumn("specificity", (F.length("id") % 5 + 1).cast("double"))
    return r.withColumn("spec_betweenness", F.col("betweenness") * F.col("specificity"))


@query(L + BRIDGE + " SELECT row_number() OVER (ORDER BY degree DESC, id)::INT AS position, id, label, degree, bridge_communities FROM rk WHERE bridge_communities >= 2 ORDER BY degree DESC, id LIMIT 10")
def structural_bridges(spark, d):
    return a.structural_bridges(_ranked(spark, d))


@query(L + BRIDGE + """, t AS (SELECT *, betweenness * specificity AS sb FROM rk), on_ AS (SELECT 1 AS gate_on, row_number() OVER (ORDER BY sb DESC, degree DESC, id)::INT AS position, id FROM t), off_ AS (SELECT 0 AS gate_on, row_number() OVER (ORDER BY structural_bridge DESC, betweenness DESC, degree DESC, id)::INT AS position, id FROM t)
SELECT * FROM on_ WHERE position <= 10 UNION ALL SELECT * FROM off_ WHERE position <= 10""")
def bridge_metric(spark, d):
    r = g.stored(_ranked(spark, d), "ranked")
    one = lambda on: a.bridge_metric(r, on).select(F.lit(on).alias("gate_on"), "position", "id")
    return one(1).unionAll(one(0))


@query(L + "SELECT id, epistemic_state, count(*) OVER () AS total FROM kg_edges WHERE epistemic_state IN ('failed', 'rejected') ORDER BY id LIMIT 50")
def capped_failures(spark, d):
    f = edges(spark, d).where("epistemic_state in ('failed', 'rejected')").select("id", "epistemic_state")
    return a.capped(f, [F.asc("id")])


@query(L + """, x AS (SELECT 'node' AS kind, CASE node_type WHEN 'part' THEN 'unverified' ELSE 'grounded' END AS state FROM kg_nodes UNION ALL SELECT 'edge', epistemic_state FROM kg_edges)
SELECT kind, state, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT kind, 'queue', count(*) FILTER (state = 'unverified') FROM x GROUP BY kind""")
def status_by_state(spark, d):
    n = nodes(spark, d).withColumn("epistemic_state", F.when(F.col("node_type") == "part", "unverified").otherwise("grounded"))
    return a.status(n, edges(spark, d))


@query(L + """, x AS (SELECT id, count(*) AS n FROM (SELECT source AS id, epistemic_state FROM kg_edges UNION ALL SELECT target, epistemic_state FROM kg_edges) WHERE epistemic_state = 'grounded' GROUP BY id)
SELECT row_number() OVER (ORDER BY n DESC, id)::INT AS position, id, label, n FROM x JOIN kg_nodes USING (id) ORDER BY n DESC, id LIMIT 6""")
def grounded_hubs(spark, d):
    return a.grounded_hubs(nodes(spark, d), stored_edges(spark, d))


PAIRS = "SELECT DISTINCT 'customer-' || o_custkey AS source, 'supplier-' || (o_custkey % 100 + 1) AS target FROM orders"


def _pairs(spark, d) -> DataFrame:
    o = lift.table(spark, d, "orders")
    return o.select(F.concat(F.lit("customer-"), "o_custkey").alias("source"), F.concat(F.lit("supplier-"), F.col("o_custkey") % 100 + 1).alias("target")).distinct()


@query(L + ", c AS (" + PAIRS + """), p AS (SELECT id, count(*) FILTER (s = 'grounded') AS g, count(*) AS n FROM (SELECT source AS id, epistemic_state AS s FROM kg_edges UNION ALL SELECT target, epistemic_state FROM kg_edges WHERE source <> target) GROUP BY id)
SELECT c.source, c.target, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) > 0 THEN (coalesce(x.g, 0) + coalesce(y.g, 0)) / (coalesce(x.n, 0) + coalesce(y.n, 0)) ELSE 0 END, 4) AS grounded_mix FROM c LEFT JOIN p x ON x.id = c.source LEFT JOIN p y ON y.id = c.target""")
def grounded_mix(spark, d):
    return a.grounded_mix(_pairs(spark, d), stored_edges(spark, d))


@query(L + ", c AS (" + PAIRS + """) SELECT c.source, c.target, least(coalesce(length(x.label) % 7, 1), coalesce(length(y.label) % 7, 1))::DOUBLE AS specificity, trim(c.source || ' bridges ' || c.target || ' (seed)') AS said FROM c LEFT JOIN kg_nodes x ON x.id = c.source LEFT JOIN kg_nodes y ON y.id = c.target""")
def pair_specificity(spark, d):
    spec = nodes(spark, d).select("id", (F.length("label") % 7).cast("double").alias("specificity"))
    c = _pairs(spark, d).select("*", F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit("seed").alias("mechanism"), F.lit("bridges").alias("relation"))
    return a.pair_specificity(c, spec).select("source", "target", "specificity", a.candidate_text().alias("said"))


@query(L + """, f AS (SELECT id FROM kg_edges WHERE epistemic_state IN ('failed', 'rejected')), c AS (SELECT DISTINCT 'e_part-' || l_partkey || '__approximates__supplier-' || l_suppkey AS id, 'e_supplier-' || l_suppkey || '__approximates__part-' || l_partkey AS reverse FROM lineitem)
SELECT id, id IN (FROM f) OR reverse IN (FROM f) AS known_failure FROM c""")
def failure_memory(spark, d):
    x = lift.table(spark, d, "lineitem").select(F.concat(F.lit("part-"), "l_partkey").alias("p"), F.concat(F.lit("supplier-"), "l_suppkey").alias("s")).distinct()
    c = x.select(tx.edge_id_of_slugs("p", F.lit("approximates"), "s").alias("id"), tx.edge_id_of_slugs("s", F.lit("approximates"), "p").alias("reverse"))
    return a.failure_memory(c, edges(spark, d)).select("id", "known_failure")


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '([\\`*_\[\]<>|#])', '\\\1', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS said FROM s""")
def markdown_labels(spark, d):
    return lift.table(spark, d, "documents").select("doc_id", a.cut(a.markdown_safe(F.col("text")), 80).alias("said"))


TALKS = r"""talk AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body FROM conversations)"""


def _talks(spark, d) -> DataFrame:
    """Conversations as documents of a section for each turn."""
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    c = lift.table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), body).alias("s")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("text"))


@query("WITH " + TALKS + " SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS section, role || ' ' || turn AS title, body FROM talk")
def sections_of_talks(spark, d):
    return tx.sections(_talks(spark, d), "conv_id", "text")


SPANS = r"""sp AS (SELECT DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS span FROM benchmark UNION SELECT DISTINCT array_to_string(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')[2:9], ' ') FROM conversations WHERE conv_id % 3 = 0 AND text IS NOT NULL)"""


def _spans(spark, d) -> DataFrame:
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    some = lift.table(spark, d, "conversations").where("conv_id % 3 = 0 and text is not null").select(F.array_join(F.slice(F.split(flat, " "), 2, 8), " ").alias("span"))
    return lift.table(spark, d, "benchmark").select(flat.alias("span")).unionAll(some).distinct()


COVERED = "WITH " + TALKS + ", " + SPANS + ", sec AS (SELECT conv_id AS file, turn AS section, lower(body) AS norm FROM talk), cv AS (SELECT file, section, EXISTS (SELECT 1 FROM sp WHERE span <> '' AND contains(norm, span)) AS covered FROM sec)"


def _covered(spark, d) -> DataFrame:
    body = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    sec = lift.table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("section"), body.alias("norm"))
    return m.section_coverage(sec, _spans(spark, d))


@query(COVERED + " SELECT file, section, covered FROM cv")
def section_coverage(spark, d):
    return _covered(spark, d)


@query(COVERED + " SELECT file, count(*) AS sections, count(*) FILTER (covered) AS covered_sections FROM cv GROUP BY file")
def file_coverage(spark, d):
    return m.file_coverage(_covered(spark, d))


NICHES = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), pl AS (SELECT id, 'b' || least(greatest(floor((v[1] + 1) / 2 * 5), 0), 4)::INT AS edge, 'l' || label AS label, (label % 3)::DOUBLE AS fitness, round(v[2], 6) AS novelty FROM e
), ni AS (SELECT 'edge=' || edge || '|label=' || label AS niche_id, edge, label, max_by(id, (fitness, novelty, -id)) AS elite, max(fitness) AS fitness, max_by(novelty, (fitness, novelty, -id)) AS novelty, count(*) AS n, min(id) AS seq FROM pl GROUP BY ALL)"""


def _niches(spark, d) -> DataFrame:
    e = lift.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    x = lambda i: F.col("v")[i].cast("double")
    edge = F.concat(F.lit("b"), F.least(F.greatest(F.floor((x(0) + 1) / 2 * 5), F.lit(0)), F.lit(4)).cast("int"))
    pl = e.select("id", edge.alias("edge"), F.concat(F.lit("l"), "label").alias("label"), (F.col("label") % 3).cast("double").alias("fitness"), F.round(x(1), 6).alias("novelty"))
    key = F.struct("fitness", "novelty", (-F.col("id")).alias("age"))
    ni = pl.groupBy("edge", "label").agg(F.max_by("id", key).alias("elite"), F.max("fitness").alias("fitness"), F.max_by("novelty", key).alias("novelty"), F.count("*").alias("n"), F.min("id").alias("seq"))
    return ni.select(F.concat(F.lit("edge="), "edge", F.lit("|label="), "label").alias("niche_id"), F.create_map(F.lit("edge"), "edge", F.lit("label"), "label").alias("coords"), "elite", "fitness", "novelty", "n", "seq")


@query(NICHES + " SELECT 'edge=' || edge || '|label=' || CASE WHEN n % 5 = 0 THEN label ELSE 'cell' || (length(label) % 2) END AS new_id, max_by(elite, (fitness, novelty, -seq)) AS elite, max(fitness) AS fitness, max_by(novelty, (fitness, novelty, -seq)) AS novelty, sum(n)::BIGINT AS n, count(*) AS merged FROM ni GROUP BY 1")
def rekeyed_archive(spark, d):
    n = _niches(spark, d)
    cells = n.where("n % 5 <> 0").select("niche_id", (F.length(F.col("coords")["label"]) % 2).alias("cell"))
    return ar.rekeyed(n, cells, "label")


@query(NICHES + " SELECT niche_id, elite FROM ni ORDER BY novelty DESC, elite LIMIT 20")
def most_novel_elites(spark, d):
    return ar.capped_by_novelty(_niches(spark, d), 20).select("niche_id", "elite")


@query(NICHES + ", t AS (SELECT count(*) AS occupied, sum(n) AS t, sum(n * ln(n)) AS x, count(elite) AS elites FROM ni) SELECT round(ln(t) - x / t, 4) AS entropy, occupied, round(occupied / 100, 4) AS coverage, elites, 0.25::DOUBLE AS mean_cosine FROM t")
def archive_metrics(spark, d):
    return ar.metrics(_niches(spark, d), spark.range(1).select(F.lit(0.25).alias("mean_cosine")), 100)


@query(NICHES + " SELECT elite, elite % 4 = 0 AS stale, elite % 3 <> 0 AS embedded FROM ni")
def elite_records(spark, d):
    ids = lift.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return ar.elite_records(_niches(spark, d), ids.where("id % 4 <> 0"), ids.where("id % 3 <> 0"))


@query()
def parent_selection(spark, d):
    ids = lift.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pins = ids.where("id in (3, 8)").select("id", (-F.col("id")).alias("seq"))
    return ar.parents(_niches(spark, d), ids, pins, ids.where("id % 10 = 0").select("id"), 8)


MEMORY = "ev AS (SELECT event_type AS domain, event_id AS seq, CASE WHEN user_id % 4 = 0 THEN 'pin' ELSE 'comparison' END AS kind, CASE WHEN user_id % 7 <> 0 THEN user_id % 23 END AS winner, CASE WHEN event_id % 5 <> 0 THEN event_id % 17 END AS loser FROM events), co AS (SELECT * FROM ev WHERE kind = 'comparison')"


@query("WITH " + MEMORY + """, t AS (SELECT domain, seq, 'win' AS part, winner::VARCHAR AS key FROM co WHERE winner IS NOT NULL UNION ALL SELECT domain, seq, 'loss', loser::VARCHAR FROM co WHERE loser IS NOT NULL
  UNION ALL SELECT domain, seq, 'value', unnest(['tone=t' || winner % 3, 'size=s' || winner % 2]) FROM co WHERE winner < 20),
c AS (SELECT domain, part, key, count(*) AS n, min(seq) AS f FROM t GROUP BY ALL), r AS (SELECT domain, part, row_number() OVER (PARTITION BY domain, part ORDER BY n DESC, f, key)::INT AS position, key, n FROM c),
l AS (SELECT domain, seq, row_number() OVER (PARTITION BY domain ORDER BY seq DESC) AS k FROM co)
SELECT * FROM r WHERE position <= 10 UNION ALL SELECT domain, 'last', row_number() OVER (PARTITION BY domain ORDER BY seq)::INT, seq::VARCHAR, 1 FROM l WHERE k <= 10""")
def preference_summary(spark, d):
    u, i = F.col("user_id"), F.col("event_id")
    ev = lift.table(spark, d, "events").select(F.col("event_type").alias("domain"), i.alias("seq"), F.when(u % 4 == 0, "pin").otherwise("comparison").alias("kind"), F.when(u % 7 != 0, u % 23).alias("winner"), F.when(i % 5 != 0, i % 17).alias("loser"))
    rec = spark.range(20).select("id", F.create_map(F.lit("tone"), F.concat(F.lit("t"), F.col("id") % 3), F.lit("size"), F.concat(F.lit("s"), F.col("id") % 2)).alias("descriptor"))
    return ar.preferences(ev, rec)


@query("""WITH x AS (SELECT doc_id AS candidate, doc_id % 3 <> 0 AS pinned, trim(coalesce(text, ''), chr(32)) AS t, lang FROM documents), s AS (SELECT *, CASE WHEN NOT pinned THEN 'refused' WHEN t = '' THEN 'skipped' ELSE 'proposed' END AS status FROM x)
SELECT candidate, status, CASE status WHEN 'refused' THEN 'not-pinned' WHEN 'skipped' THEN 'no-session-record' ELSE '' END AS reason, CASE WHEN status = 'proposed' THEN 'idea-my-brief-' || candidate END AS id, CASE WHEN status = 'proposed' THEN CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END END AS label,
  CASE WHEN status = 'proposed' THEN t || chr(10) || chr(10) || '[diverge] pinned candidate=' || candidate || ' brief=My Brief session=s1 mechanism=''' || coalesce(lang, '') || ''' operator=' || chr(10) END AS body FROM s""")
def materialized_pins(spark, d):
    docs = lift.table(spark, d, "documents")
    rec = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("mechanism"), F.lit(None).cast("string").alias("operator"))
    return ar.materialized(docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 != 0).alias("pinned")), rec, "My Brief", "s1")


@query(L + """, lg AS (SELECT source AS candidate, id AS item, CASE WHEN length(source) % 4 = 0 THEN 'failed' END AS fate, CASE WHEN length(source) % 8 = 0 THEN 'old' END AS sig, CASE WHEN source LIKE '%3' THEN 'now' WHEN source LIKE '%4' THEN 'old' END AS op, epistemic_state = 'failed' AS f FROM kg_edges WHERE relation = 'approximates'),
p AS (SELECT candidate, max(fate) AS fate, max(sig) AS sig, max(op) AS op, bool_or(f) AS f FROM lg GROUP BY 1), n AS (SELECT *, fate IS NULL AND f AND coalesce(op <> 'now', true) AS new FROM p), q AS (SELECT candidate, CASE WHEN new THEN 'failed' ELSE fate END AS fate, CASE WHEN new OR (fate = 'failed' AND sig IS NULL) THEN 'now' ELSE sig END AS fate_signature, new AS newly_discarded FROM n)
SELECT *, coalesce(fate = 'failed' AND fate_signature <> 'now', false) AS re_examinable FROM q""")
def pin_fates(spark, d):
    e = stored_edges(spark, d).where("relation = 'approximates'")
    s = F.col("source")
    lg = e.select(s.alias("candidate"), F.col("id").alias("item"), F.when(F.length(s) % 4 == 0, "failed").alias("fate"), F.when(F.length(s) % 8 == 0, "old").alias("fate_signature"), F.when(s.endswith("3"), "now").when(s.endswith("4"), "old").alias("unsealed_signature"))
    return ar.fates(lg, e.select("id", "epistemic_state"), "now")


@query("SELECT kind, id, CASE kind WHEN 'samey' THEN 'a better app for everyone ' || id WHEN 'clones-first' THEN CASE WHEN id < 50 THEN 'a better app for everyone' ELSE dv END WHEN 'cliched' THEN ['river', 'library'][(id + 2) % 2 + 1] || ' as a service' ELSE dv END AS text FROM (SELECT unnest(['diverse', 'cliched', 'samey', 'clones-first']) AS kind, id, concat_ws(' ', ['river', 'library', 'market', 'garden', 'engine', 'festival', 'harbor'][(id * 3 + 2) % 7 + 1], ['reframes', 'couples', 'inverts', 'measures', 'trades'][(id * 7 + 2) % 5 + 1], ['memory', 'risk', 'heat', 'trust', 'noise', 'time', 'debt', 'light', 'soil', 'code', 'salt'][(id * 5 + 2) % 11 + 1], 'case' || id) AS dv FROM range(100) t(id))")
def synthetic_streams(spark, d):
    out = None
    for kind in ("diverse", "cliched", "samey", "clones-first"):
        one = ar.synthetic(spark, 100, kind, 2).select(F.lit(kind).alias("kind"), "id", "text")
        out = one if out is None else out.unionAll(one)
    return out


def _json_payloads(spark, d) -> DataFrame:
    """Orders as payloads in JSON: an edge for each line. Some are out of shape,
    some are not complete."""
    q, span = F.col("l_quantity").cast("int"), lift.table(spark, d, "benchmark").agg(F.min("text").alias("t")).scalar()
    edge = F.struct(
        F.when(q == 2, "--").otherwise(F.concat(F.lit("supplier-"), "l_suppkey")).alias("source"), F.when(q == 3, "approximates").when(q % 2 == 0, "grounds").otherwise("bridges").alias("relation"), F.concat(F.lit("part-"), "l_partkey").alias("target"),
        F.when(F.col("l_linestatus") == "F", "span-present").otherwise("hypothesized").alias("provenance"), F.when(q == 5, "human").otherwise("agent").alias("authored_by"), F.when(q == 6, "grounded").otherwise("unverified").alias("epistemic_state"),
        F.when(q == 7, "  ").when(q.isin(9, 10), "nowhere to be found in any text").otherwise(span).alias("span"), F.when(q == 9, "source-1").otherwise("unknown").alias("source_file"),
    )
    line = lift.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("payload"), F.struct(F.col("l_linenumber").alias("k"), edge.alias("e")).alias("x"))
    p = line.groupBy("payload").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("edges"))
    body = F.to_json(F.struct("edges", (F.col("payload") % 13 != 0).alias("complete")))
    return p.select("payload", F.when(F.col("payload") % 11 == 0, F.regexp_replace(body, r"^\{", '{"surprise":1,')).when(F.col("payload") % 17 == 0, "[1, 2").otherwise(body).alias("json"))


SHAPES = """sh AS (SELECT DISTINCT l_orderkey AS payload, CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 17 = 0 THEN 'schema-invalid: 1 errors' WHEN l_orderkey % 13 = 0 THEN 'truncated-payload' END AS bad FROM lineitem)"""


@query("WITH " + SHAPES + " SELECT payload, bad AS reason, bad IS NOT NULL AS retryable FROM sh")
def payload_shapes(spark, d):
    return b.parsed(_json_payloads(spark, d)).select("payload", "reason", "retryable")


WRITE = f"WITH {LIFT_SQL}, {SHAPES}" + """, pl AS (SELECT l_orderkey AS payload, l_linenumber AS ord, CASE WHEN l_quantity = 2 THEN '--' ELSE 'supplier-' || l_suppkey END AS source, CASE WHEN l_quantity = 3 THEN 'approximates' WHEN l_quantity::INT % 2 = 0 THEN 'grounds' ELSE 'bridges' END AS relation, 'part-' || l_partkey AS target, l_linestatus <> 'F' AS hyp, l_quantity::INT AS q FROM lineitem JOIN sh ON sh.payload = l_orderkey AND bad IS NULL
), ids AS (SELECT *, 'e_' || CASE WHEN source = '--' THEN 'node' ELSE source END || '__' || relation || '__' || target AS id, 'e_' || target || '__' || relation || '__' || CASE WHEN source = '--' THEN 'node' ELSE source END AS rid FROM pl
), ex AS (SELECT replace(id, '__approximates__', '__bridges__') AS id, epistemic_state AS s FROM kg_edges WHERE relation = 'approximates'
), chk AS (SELECT *, CASE WHEN source = '--' THEN 'empty-source' WHEN hyp AND (id IN (SELECT id FROM ex WHERE s IN ('failed', 'rejected')) OR rid IN (SELECT id FROM ex WHERE s IN ('failed', 'rejected'))) THEN 'collapses-into-known-failure' WHEN NOT hyp AND q = 7 THEN 'no-supporting-span' WHEN NOT hyp AND q = 9 THEN 'span-not-in-named-source' WHEN NOT hyp AND q = 10 THEN 'span-not-in-source'
    WHEN NOT hyp AND id IN (SELECT id FROM ex WHERE s IN ('failed', 'rejected')) THEN 'collapses-into-known-failure' WHEN NOT hyp AND id IN (SELECT id FROM ex WHERE s IN ('grounded', 'obsolete')) THEN 'collapses-into-known-verdict' WHEN relation = 'approximates' THEN 'undeclared-edge-type' END AS reason, CASE WHEN q = 6 THEN 'forged-verdict-stripped' WHEN q = 5 THEN 'human-claim-stripped' END AS forged FROM ids
), fi AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY payload, id, reason IS NULL ORDER BY ord) END AS k FROM chk
), dd AS (SELECT payload, 'edge' AS kind, id, CASE WHEN reason LIKE 'collapses%' OR reason LIKE 'undeclared%' THEN 'QUARANTINED' WHEN reason IS NOT NULL THEN 'REJECTED' WHEN forged IS NOT NULL THEN 'DEMOTED' ELSE 'ACCEPTED' END AS disposition, concat_ws('; ', reason, forged, CASE WHEN reason IS NULL AND k > 1 THEN 'deduped' END) AS reason, false AS retryable FROM fi
  UNION ALL SELECT payload, 'payload', NULL, 'REJECTED', bad, true FROM sh WHERE bad IS NOT NULL)"""


def _write_inputs(spark, d) -> tuple:
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    src = lift.table(spark, d, "benchmark").select(F.concat(F.lit("source-"), "item_id").alias("name"), tx.normalize("text").alias("norm")).where(flat.alias("x").isNotNull())
    ex = stored_edges(spark, d).where("relation = 'approximates'").select(F.regexp_replace("id", "__approximates__", "__bridges__").alias("id"), "source", "target", F.lit("bridges").alias("relation"), "provenance", "epistemic_state", "confidence_score", "owner")
    pack = {"node_types": ["claim"], "edge_types": ["grounds", "bridges"]}
    return pack, src, ex


def _written(spark, d) -> DataFrame:
    pack, src, ex = _write_inputs(spark, d)
    return b.write(_json_payloads(spark, d), pack, src, nodes(spark, d), ex.select("id", "epistemic_state"))


@query(WRITE + """, inc AS (SELECT id, max_by(CASE WHEN hyp THEN 'hypothesized' ELSE 'span-present' END, payload * 1000 + ord) AS provenance FROM fi WHERE reason IS NULL GROUP BY id), old AS (SELECT replace(id, '__approximates__', '__bridges__') AS id, epistemic_state, provenance FROM kg_edges WHERE relation = 'approximates')
SELECT coalesce(old.id, inc.id) AS id, CASE WHEN inc.id IS NULL OR old.epistemic_state <> 'unverified' THEN old.epistemic_state ELSE 'unverified' END AS epistemic_state, CASE WHEN inc.id IS NULL OR old.epistemic_state <> 'unverified' THEN old.provenance ELSE inc.provenance END AS provenance FROM old FULL JOIN inc ON inc.id = old.id""")
def kg_write_committed(spark, d):
    """The edges of a store that payloads were written to twice; the second time
    the ledger of receipts has them all."""
    pack, src, ex = _write_inputs(spark, d)
    path, payloads = _folder(spark, "store"), stored(_json_payloads(spark, d), "payloads")
    commit.create(spark, path, nodes(spark, d), ex)
    commit.commit(spark, path, payloads, pack, src)
    commit.commit(spark, path, payloads, pack, src)
    return store.current(spark, path)["edges"].select("id", "epistemic_state", "provenance")


@query(WRITE + " SELECT * FROM dd")
def kg_write(spark, d):
    return _written(spark, d)


@query(WRITE + " SELECT payload, disposition, count(*) AS n FROM dd GROUP BY ALL")
def kg_write_summary(spark, d):
    return b.summary(_written(spark, d))


@query("WITH " + SHAPES + " SELECT l_orderkey AS payload, CASE WHEN l_quantity = 2 THEN '--' ELSE 'supplier-' || l_suppkey END AS id, 'propose-lane-text-claim' AS reason FROM lineitem JOIN sh ON sh.payload = l_orderkey AND bad IS NULL WHERE l_linestatus = 'F' UNION ALL SELECT payload, NULL, bad FROM sh WHERE bad IS NOT NULL")
def propose_refusals(spark, d):
    return b.items(_json_payloads(spark, d), propose=True)[2].select("payload", "id", "reason")


@query("SELECT count(DISTINCT l_orderkey) AS payloads, count(DISTINCT l_orderkey) FILTER (l_orderkey % 2 = 0) AS replays FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 17 <> 0")
def receipts_replayed(spark, d):
    """Payloads sent again, every second one with its lines in another order, which
    is the same payload; of the others a field differs."""
    p = _json_payloads(spark, d).where("payload % 11 <> 0 and payload % 17 <> 0")
    before = b.receipts(p).select(F.col("payload").alias("key"), "receipt", F.lit(1).alias("ord"))
    turned = F.to_json(F.struct(F.reverse(F.from_json(F.get_json_object("json", "$.edges"), "array<map<string,string>>")).alias("edges")))
    again = p.select("payload", F.when(F.col("payload") % 2 == 0, turned).otherwise(F.regexp_replace("json", '"target":"', '"target":"other-')).alias("json"))
    out = b.replayed(b.receipts(again).select(F.col("payload").alias("key"), "receipt"), before)
    return out.agg(F.count("*").alias("payloads"), F.count_if("replay").alias("replays"))


@query("""WITH n AS (SELECT 'supplier-' || s_suppkey AS id, max_by(s_name, s_suppkey) AS label FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1), e AS (SELECT DISTINCT 'supplier-' || l_suppkey AS id FROM lineitem)
SELECT id, label, false AS placeholder FROM n UNION ALL SELECT id, id, true FROM e WHERE id NOT IN (SELECT id FROM n)""")
def merged_results(spark, d):
    n = lift.table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_suppkey").alias("ord"))
    e = lift.table(spark, d, "lineitem").select(F.concat(F.lit("supplier-"), "l_suppkey").alias("source"), F.col("l_orderkey").alias("ord"))
    return b.merged_nodes(n, e)


@query(L + "SELECT id, epistemic_state FROM kg_edges WHERE epistemic_state IN ('grounded', 'failed') AND length(id) % 2 = 0")
def audited_verdicts(spark, d):
    e = stored_edges(spark, d)
    v = e.where("epistemic_state in ('grounded', 'failed')").select("id", "epistemic_state", F.lit(1).alias("ord"))
    au = e.where(F.length("id") % 2 == 0).select(F.col("id").alias("key"), F.col("epistemic_state").alias("to"), F.lit(1).alias("ord"))
    return b.audited(v, au).select("id", "epistemic_state")


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex}"


@query(L + "SELECT 'nodes' AS name, count(*) AS n, count(DISTINCT id) AS ids FROM kg_nodes UNION ALL SELECT 'edges', count(*), count(DISTINCT id) FROM kg_edges")
def index_tables(spark, d):
    """Two versions published, the second without edges, and the first pointed to again."""
    path = _folder(spark, "index")
    first = store.publish({"nodes": nodes(spark, d), "edges": edges(spark, d)}, path)
    store.publish({"nodes": nodes(spark, d), "edges": edges(spark, d).where("false")}, path)
    store.roll_back(spark, path, first)
    now = store.current(spark, path)
    one = lambda n: now[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    return one("nodes").unionAll(one("edges"))


@query(L + """SELECT id, CASE WHEN relation = 'bridges' THEN 'inserted' WHEN relation = 'projects' THEN 'deleted' WHEN provenance = 'hypothesized' THEN 'updated' ELSE 'kept' END AS change FROM kg_edges""")
def index_refresh(spark, d):
    e = stored_edges(spark, d)
    new = e.where("relation <> 'projects'").withColumn("epistemic_state", F.when(F.col("provenance") == "hypothesized", "unknown").otherwise(F.col("epistemic_state")))
    return store.refreshed(e.where("relation <> 'bridges'"), new, "id").select("id", "change")


@query(L + "SELECT epistemic_state AS batch, count(*) AS records FROM kg_edges WHERE epistemic_state IN ('grounded', 'failed') GROUP BY 1")
def audit_ledger(spark, d):
    """Three batches appended, one of them twice, and one taken back."""
    path, e = _folder(spark, "audit"), stored_edges(spark, d)
    for state in ("grounded", "failed", "failed", "obsolete"):
        store.append_audit(e.where(F.col("epistemic_state") == state).select(F.col("id").alias("key"), F.col("epistemic_state").alias("to")), path, state)
    store.truncate_audit(spark, path, "obsolete")
    return store.audit_size(store.read_audit(spark, path))


@query(L + """, au AS (SELECT id AS key, unnest(['failed', 'grounded', 'failed']) AS "to" FROM kg_edges WHERE relation = 'approximates') SELECT key, "to", count(*) AS used FROM au JOIN kg_edges e ON e.id = key AND e.epistemic_state = "to" GROUP BY ALL""")
def audit_checkpoint(spark, d):
    e = stored_edges(spark, d)
    au = e.where("relation = 'approximates'").select(F.col("id").alias("key"), F.explode(F.array(*[F.lit(x) for x in ("failed", "grounded", "failed")])).alias("to"))
    return store.spent(au, e)


@query("""WITH x AS (SELECT event_type AS domain, user_id AS id, CASE event_id % 3 WHEN 0 THEN 'pin' WHEN 1 THEN 'discard' ELSE 'comparison' END AS kind, event_id AS seq FROM events)
SELECT domain, id, CASE WHEN bool_or(kind = 'pin') THEN 'pin' ELSE 'discard' END AS kind, max(seq) AS seq FROM x WHERE kind <> 'comparison' GROUP BY domain, id UNION ALL SELECT DISTINCT domain, id, kind, seq FROM x WHERE kind = 'comparison'""")
def legacy_import(spark, d):
    i = F.col("event_id")
    x = lift.table(spark, d, "events").select(F.col("event_type").alias("domain"), F.col("user_id").alias("id"), F.when(i % 3 == 0, "pin").when(i % 3 == 1, "discard").otherwise("comparison").alias("kind"), i.alias("seq"))
    return store.imported(x.where("seq % 2 = 0"), x.where("seq % 2 = 1 or seq % 10 = 0"))


@query(L + "SELECT key AS id FROM (SELECT DISTINCT 'supplier-' || l_suppkey AS key FROM lineitem UNION SELECT 'ghost-' || r_regionkey FROM region) WHERE key NOT IN (SELECT id FROM kg_nodes)")
def orphan_verdicts(spark, d):
    from ..operators.write import orphans

    keys = lift.table(spark, d, "lineitem").select(F.concat(F.lit("supplier-"), "l_suppkey").alias("key")).unionAll(lift.table(spark, d, "region").select(F.concat(F.lit("ghost-"), "r_regionkey").alias("key")))
    return orphans(keys, nodes(spark, d))


@query(L + "SELECT count(*) AS pairs, lpad(lower(printf('%x', bit_xor(('0x' || substr(md5(u || chr(9) || v), 1, 15))::BIGINT))), 15, '0') AS signature FROM kg_adj WHERE u < v")
def topology_digest(spark, d):
    """As many hexadecimal digits as a long holds of the pairs' digests, folded by
    exclusive or: the same whatever the order, without a list of all pairs."""
    adj = g.adjacency(edges(spark, d)).where("u < v")
    word = F.conv(F.substring(F.md5(F.concat_ws("\t", "u", "v").cast("binary")), 1, 15), 16, 10).cast("long")
    return adj.agg(F.count("*").alias("pairs"), F.lpad(F.lower(F.hex(F.bit_xor(word))), 15, "0").alias("signature"))


EDIT = """, kg_own AS (SELECT * FROM kg_edges UNION ALL SELECT id, source, target, relation, provenance, 'unverified', confidence_score, target FROM kg_edges),
own2 AS (SELECT id, source, target, relation, provenance, CASE WHEN owner LIKE 'supplier-%' AND TRY_CAST(regexp_extract(owner, '[0-9]+$') AS BIGINT) % 5 = 1 AND relation = 'approximates' THEN 'failed' ELSE epistemic_state END AS epistemic_state, owner FROM kg_own WHERE NOT (owner LIKE 'supplier-%' AND TRY_CAST(regexp_extract(owner, '[0-9]+$') AS BIGINT) % 5 = 0)),
nodes2 AS (SELECT id, CASE WHEN node_type = 'part' AND TRY_CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 50 = 0 THEN -1 ELSE community END AS community FROM kg_nodes WHERE NOT (node_type = 'customer' AND TRY_CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 9 = 0)),
can AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY owner <> source, owner) AS rn FROM own2) WHERE rn = 1 AND epistemic_state NOT IN ('failed', 'rejected', 'obsolete') AND source <> target),
adj2 AS (SELECT source AS u, target AS v FROM can UNION SELECT target, source FROM can)"""


@query(L + EDIT + " SELECT n.id, count(a.v) AS degree, count(DISTINCT m.community) AS bridge_communities FROM nodes2 n LEFT JOIN adj2 a ON a.u = n.id LEFT JOIN nodes2 m ON m.id = a.v GROUP BY n.id")
def projection_after_edit(spark, d):
    """Notes of a fifth of the suppliers deleted and of a fifth changed, some
    customers gone and parts in another community: tables brought up to date."""
    n, e = g.stored(nodes(spark, d).select("id", "node_type", "community"), "nodes"), stored_edges(spark, d)
    own = stored(e.unionByName(e.withColumn("owner", F.col("target")).withColumn("epistemic_state", F.lit("unverified"))), "owned")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '[0-9]+$', 0) as long)")
    mine = F.col("owner").startswith("supplier-")
    gone, other = mine & (number("owner") % 5 == 0), mine & (number("owner") % 5 == 1) & (F.col("relation") == "approximates")
    new = stored(own.where(~gone).withColumn("epistemic_state", F.when(other, "failed").otherwise(F.col("epistemic_state"))), "owned")
    after = n.where(~((F.col("node_type") == "customer") & (number("id") % 9 == 0))).withColumn("community", F.when((F.col("node_type") == "part") & (number("id") % 50 == 0), -1).otherwise(F.col("community")))
    now = projection.projected(projection.project(n, own), after, own, new, own.where(gone | other).select("owner"))
    return now["degree"].join(now["bridges"], "id")


@query(L + """, it AS (SELECT e.id, epistemic_state AS s, confidence_score AS c, split(p_name, ' ') AS w FROM kg_edges e JOIN part ON target = 'part-' || p_partkey WHERE relation = 'approximates'),
st AS (SELECT id, w, s IN ('failed', 'rejected') AS f1, CASE WHEN c >= 0.8 THEN false ELSE s IN ('failed', 'rejected') END AS f2, CASE WHEN c < 0.1 THEN false ELSE s IN ('failed', 'rejected') END AS f3 FROM it),
ch AS (SELECT list_distinct(flatten(list(split(p_name, ' ')) FILTER (p_partkey % 211 = 1))) AS t1, list_distinct(flatten(list(split(p_name, ' ')) FILTER (p_partkey % 223 = 2))) AS t2, list_distinct(flatten(list(split(p_name, ' ')) FILTER (p_partkey % 227 = 3))) AS t3 FROM part)
SELECT 'edge' AS kind, id, CASE WHEN f1 AND f2 AND list_has_any(w, t1) THEN 1 WHEN f2 AND list_has_any(w, t2) THEN 2 ELSE 3 END::BIGINT AS since FROM st, ch WHERE f3 AND ((f1 AND f2 AND list_has_any(w, t1)) OR (f2 AND list_has_any(w, t2)) OR list_has_any(w, t3))""")
def persistent_flags(spark, d):
    """Three projections: what was flagged stays while it has failed."""
    p = lift.table(spark, d, "part")
    e = stored_edges(spark, d).where("relation = 'approximates'").join(p.select(F.concat(F.lit("part-"), "p_partkey").alias("target"), F.split("p_name", " ").alias("terms")), "target")
    e = stored(e.select(F.lit("edge").alias("kind"), "id", "epistemic_state", "confidence_score", "terms"), "items")
    c, held = F.col("confidence_score"), flags.none(e)
    for now, (cured, every, rest) in enumerate(((F.lit(False), 211, 1), (c >= 0.8, 223, 2), (c < 0.1, 227, 3)), 1):
        items = e.withColumn("epistemic_state", F.when(cured, "grounded").otherwise(F.col("epistemic_state")))
        terms = p.where(F.col("p_partkey") % every == rest).select(F.explode(F.split("p_name", " ")).alias("term"))
        held = stored(flags.re_examinable(held, items, terms, now), "flags")
    return held


@query(R + COLLAPSE + f""", o AS (SELECT *, {OTHER} AS moved FROM kg_ranked WHERE community <> -1), hub AS (SELECT id FROM kg_degree ORDER BY degree DESC, id DESC LIMIT 1), pt AS (SELECT id FROM kg_degree ORDER BY degree DESC, id LIMIT 3),
rel AS (SELECT relation, row_number() OVER (ORDER BY relation) AS i FROM (SELECT DISTINCT relation FROM kg_edges WHERE source = (FROM hub)) UNION ALL SELECT 'aspect-' || i, i FROM range(1, 3) t(i) WHERE NOT EXISTS (SELECT 1 FROM kg_edges WHERE source = (FROM hub))),
rg AS (SELECT a.id AS source, b.id AS target FROM o a JOIN o b ON a.community = b.community AND a.id < b.id AND a.moved <> b.moved ANTI JOIN kg_adj x ON x.u = a.id AND x.v = b.id WHERE NOT EXISTS (SELECT 1 FROM kg_edges f WHERE f.epistemic_state IN ('failed', 'rejected') AND f.relation = 'bridges' AND ((f.source = a.id AND f.target = b.id) OR (f.source = b.id AND f.target = a.id))) ORDER BY round(a.strength + b.strength + 1e-3, 6) DESC, a.id, b.id LIMIT 10)
SELECT 'collapse' AS op, id AS source, 'collapses_into' AS relation, target FROM mb, nm UNION ALL SELECT 'explode', (FROM hub) || '-facet-' || i, 'collapses_into', (FROM hub) FROM rel
UNION ALL SELECT 'open', 'opening-' || (SELECT id FROM kg_degree ORDER BY degree DESC, id LIMIT 1), 'bridges', id FROM pt UNION ALL SELECT 'regroup', source, 'bridges', target FROM rg""")
def operations(spark, d):
    """The edges that the four operations would write."""
    n, e = nodes(spark, d), stored_edges(spark, d)
    other, adj = n.select("id", F.expr(OTHER).cast("int").alias("community")), stored(g.adjacency(e), "adjacency")
    out = None
    for op, k in (("collapse", None), ("explode", None), ("open", 3), ("regroup", None)):
        made = operate.structure(op, n, e, n, other, k=k, adj=adj)[1].select(F.lit(op).alias("op"), "source", "relation", "target")
        out = made if out is None else out.unionByName(made)
    return out


@query(L + COLLAPSE + """, wr AS (SELECT 'e_' || id || '__collapses-into__' || target AS id, id AS source, target FROM mb, nm), al AS (SELECT source, target FROM kg_edges WHERE epistemic_state NOT IN ('failed', 'rejected', 'obsolete') UNION ALL SELECT source, target FROM wr),
ad AS (SELECT source AS u, target AS v FROM al WHERE source <> target UNION SELECT target, source FROM al WHERE source <> target), dg AS (SELECT u, count(*) AS n FROM ad GROUP BY u ORDER BY n DESC, u LIMIT 2), op AS (SELECT 'opening-' || u AS source FROM dg ORDER BY n DESC, u LIMIT 1)
SELECT id, 'collapses_into' AS relation, 'deterministic' AS authored_by FROM wr UNION ALL SELECT 'e_' || source || '__bridges__' || u, 'bridges', 'deterministic' FROM op, dg""")
def kg_operate(spark, d):
    """Hypotheses that a store has after a collapse, the same again, and an opening
    of what the collapse has made of the graph."""
    pack, n = {"node_types": ["compression", "primitive"], "edge_types": ["collapses_into", "bridges"]}, nodes(spark, d)
    path = _folder(spark, "operate")
    commit.create(spark, path, n, edges(spark, d))
    for op in ("collapse", "collapse", "open"):
        operate.operate(spark, path, op, pack, n)
    return store.current(spark, path)["edges"].where("authored_by is not null").select("id", "relation", "authored_by")


@query(L + CONTEXT + BRIDGE + """, rs AS (SELECT *, betweenness * specificity AS sb FROM rk), ld AS (SELECT id, specificity FROM rs ORDER BY betweenness DESC, id LIMIT 5), wt AS (SELECT id FROM rs ORDER BY sb DESC, id LIMIT 5),
gt AS (SELECT ((SELECT count(*) FROM rs) >= 3 AND (SELECT avg(specificity) FROM ld) < (SELECT avg(specificity) FROM rs) AND (SELECT count(*) FROM ld FULL JOIN wt USING (id) WHERE ld.id IS NULL OR wt.id IS NULL) / (2.0 * (SELECT count(*) FROM ld)) > 0.2 AND (SELECT max(specificity) - min(specificity) FROM rs) > 1e-9)::INT AS g),
src AS (SELECT DISTINCT p_name AS norm FROM part WHERE p_partkey % 3 <> 0), nm AS (SELECT DISTINCT p_name, EXISTS (SELECT 1 FROM src WHERE contains(norm, p_name)) AS found FROM part), cl AS (SELECT e.*, p_name, found FROM kg_edges e JOIN part ON target = 'part-' || p_partkey JOIN nm USING (p_name) WHERE relation = 'approximates'),
st AS (SELECT id FROM cl WHERE epistemic_state IN ('grounded', 'failed') AND provenance = 'span-present' AND NOT found), ch AS (SELECT list_distinct(flatten(list(split(p_name, ' ')))) AS t FROM part WHERE p_partkey % 211 = 1), re AS (SELECT id FROM cl, ch WHERE epistemic_state IN ('failed', 'rejected') AND list_has_any(split(p_name, ' '), t)),
ln AS (SELECT 'items' AS block, row_number() OVER (ORDER BY used) AS position, id, tokens FROM it WHERE used <= 60000 UNION ALL SELECT 'hypotheses', row_number() OVER (ORDER BY used), id, tokens FROM hy WHERE used <= 60000 - (SELECT coalesce(max(used), 0) FROM it WHERE used <= 60000)),
bm AS (SELECT row_number() OVER (ORDER BY CASE WHEN g = 1 THEN sb ELSE structural_bridge END DESC, CASE WHEN g = 1 THEN 0 ELSE betweenness END DESC, degree DESC, id) AS position, id, label, CASE WHEN g = 1 THEN sb ELSE betweenness END AS value FROM rs, gt)
SELECT block, position::INT AS position, id, NULL::VARCHAR AS label, tokens::DOUBLE AS value, 0::BIGINT AS total FROM ln UNION ALL SELECT 'approx_tokens', 1, NULL, NULL, coalesce(sum(tokens), 0), 0 FROM ln UNION ALL SELECT 'failures', 1, NULL, NULL, count(*), 0 FROM kg_edges WHERE epistemic_state IN ('failed', 'rejected')
UNION ALL SELECT 'gate', 1, NULL, NULL, g, 0 FROM gt UNION ALL SELECT 'structural_bridge', position, id, label, degree, 0 FROM (SELECT row_number() OVER (ORDER BY degree DESC, id) AS position, * FROM rs WHERE bridge_communities >= 2) WHERE position <= 10 UNION ALL SELECT 'bridge_metric', position, id, label, value, 0 FROM bm WHERE position <= 10
UNION ALL SELECT 'stale', position, id, NULL, NULL, total FROM (SELECT row_number() OVER (ORDER BY id) AS position, count(*) OVER () AS total, id FROM st) WHERE position <= 50 UNION ALL SELECT 're_examinable', position, id, NULL, NULL, total FROM (SELECT row_number() OVER (ORDER BY id) AS position, count(*) OVER () AS total, id FROM re) WHERE position <= 50""")
def kg_context(spark, d):
    """A read whole: lanes, counters and advisories. Edges to parts stand on the part's
    name, which some sources have no more, and other sources have changed."""
    p = lift.table(spark, d, "part")
    told = stored(_told(spark, d), "told")
    ranked = g.stored(_ranked(spark, d), "ranked")
    ranked = ranked.crossJoin(F.broadcast(g.specificity_gate(ranked).select("gate_on")))
    claims = told.where("relation = 'approximates'").join(p.select(F.concat(F.lit("part-"), "p_partkey").alias("target"), F.col("p_name").alias("norm_span")), "target")
    claims = stored(claims.select(F.lit("edge").alias("kind"), "id", "epistemic_state", "provenance", "norm_span", F.lit("").alias("source_file"), F.split("norm_span", " ").alias("terms")), "claims")
    sources = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_name").alias("norm"))
    terms = p.where("p_partkey % 211 = 1").select(F.explode(F.split("p_name", " ")).alias("term"))
    none = flags.none(claims)
    return a.answer(told, ranked, flags.stale(none, claims, sources, 1), flags.re_examinable(none, claims, terms, 1), "-77", 60_000)
