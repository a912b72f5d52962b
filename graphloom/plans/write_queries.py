"""Registered queries of the write path, measurement and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scrub as sc
from ..functions import text as tx
from ..operators import graph as g
from ..operators import measure as m
from ..operators import retrieve as r
from ..operators import write as w
from ..operators.spans import span_verified
from ..sources import lift
from ..sources.lift import LIFT_SQL, edges, nodes, stored_edges
from .registry import query

L = f"WITH {LIFT_SQL}"
PACK = ["grounds", "bridges", "projects"]


def _payload(spark, d):
    """A payload made of all line items: each claims an edge."""
    line = lift.table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    return line.select(
        F.col("l_orderkey").alias("payload"), F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("ord"),
        F.when(q == 2, "--").otherwise(F.concat(F.lit("supplier-"), "l_suppkey")).alias("source"), F.when(q == 3, "approximates").when(q % 2 == 0, "grounds").otherwise("bridges").alias("relation"), F.concat(F.lit("part-"), "l_partkey").alias("target"),
        F.when(F.col("l_linestatus") == "F", "span-present").otherwise("hypothesized").alias("provenance"), F.when(q == 5, "human").otherwise("agent").alias("authored_by"), F.when(q == 6, "grounded").otherwise("unverified").alias("epistemic_state"), F.col("l_discount").alias("confidence_score"),
        F.when(q == 7, "  ").when(q == 8, "a b").otherwise("some span").alias("span"), (q == 9).alias("span_named"), (~q.isin(9, 10)).alias("span_found"),
    )


PAYLOAD = """, pl AS (
  SELECT l_orderkey AS payload, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS ord,
    CASE WHEN l_quantity = 2 THEN '--' ELSE 'supplier-' || l_suppkey END AS source, CASE WHEN l_quantity = 3 THEN 'approximates' WHEN l_quantity::INT % 2 = 0 THEN 'grounds' ELSE 'bridges' END AS relation, 'part-' || l_partkey AS target,
    l_linestatus <> 'F' AS hyp, l_quantity::INT AS q FROM lineitem
), ids AS (
  SELECT *, 'e_' || CASE WHEN source = '--' THEN 'node' ELSE source END || '__' || relation || '__' || target AS id, 'e_' || target || '__' || relation || '__' || CASE WHEN source = '--' THEN 'node' ELSE source END AS rid FROM pl
), fl AS (SELECT replace(id, '__approximates__', '__bridges__') AS id FROM kg_edges WHERE epistemic_state IN ('failed', 'rejected')
), vd AS (SELECT replace(id, '__approximates__', '__grounds__') AS id FROM kg_edges WHERE epistemic_state IN ('grounded', 'obsolete')
), chk AS (
  SELECT *, CASE WHEN source = '--' THEN 'empty-source' WHEN hyp AND (id IN (FROM fl) OR rid IN (FROM fl)) THEN 'collapses-into-known-failure' WHEN NOT hyp AND q = 7 THEN 'no-supporting-span' WHEN NOT hyp AND q = 9 THEN 'span-not-in-named-source' WHEN NOT hyp AND q = 10 THEN 'span-not-in-source' WHEN NOT hyp AND q = 8 THEN 'span-too-short' WHEN NOT hyp AND id IN (FROM fl) THEN 'collapses-into-known-failure' WHEN NOT hyp AND id IN (FROM vd) THEN 'collapses-into-known-verdict' WHEN relation = 'approximates' THEN 'undeclared-edge-type' END AS reason,
    CASE WHEN q = 6 THEN 'forged-verdict-stripped' WHEN q = 5 THEN 'human-claim-stripped' ELSE '' END AS forged FROM ids
), fi AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY payload, id, reason IS NULL ORDER BY ord) END AS k FROM chk
)"""


@query(L + PAYLOAD + """, dd AS (SELECT *, reason IS NULL AND k > 1 AS dup FROM fi)
SELECT CASE WHEN reason LIKE 'collapses%' OR reason LIKE 'undeclared%' THEN 'QUARANTINED' WHEN reason IS NOT NULL THEN 'REJECTED' WHEN forged <> '' THEN 'DEMOTED' ELSE 'ACCEPTED' END AS disposition,
  concat_ws('; ', reason, CASE WHEN forged <> '' THEN forged END, CASE WHEN dup THEN 'deduped' END) AS reason, count(*) AS n FROM dd GROUP BY ALL""")
def edge_dispositions(spark, d):
    e = stored_edges(spark, d)
    swap = lambda relation: F.regexp_replace("id", "__approximates__", f"__{relation}__").alias("id")
    failed = e.where(F.col("epistemic_state").isin("failed", "rejected")).select(swap("bridges"))
    verdicts = e.where(F.col("epistemic_state").isin("grounded", "obsolete")).select(swap("grounds"))
    none = e.where("false").select("id")
    out = w.edge_dispositions(_payload(spark, d), PACK, failed, verdicts, none, 10_000_000)
    return out.groupBy("disposition", "reason").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT c_mktsegment AS payload, c_custkey AS ord, c_name AS label, lower(c_name) AS id FROM customer),
x AS (SELECT *, CASE WHEN c THEN NULL END AS reason FROM (SELECT *, true AS c FROM p)), f AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY ord) AS running FROM x)
SELECT payload, CASE WHEN running > 512 THEN 'REJECTED' ELSE 'ACCEPTED' END AS disposition, count(*) AS n FROM f GROUP BY ALL""")
def node_flood(spark, d):
    c = lift.table(spark, d, "customer").select(F.col("c_mktsegment").alias("payload"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("label"), F.lit("customer").alias("node_type"), F.lit("span-present").alias("provenance"), F.lit("agent").alias("authored_by"), F.lit("unverified").alias("epistemic_state"))
    out = w.node_dispositions(c, ["customer"], c.where("false").select(F.col("label").alias("id")), 0)
    return out.groupBy("payload", "disposition").agg(F.count("*").alias("n"))


INCOMING = """, inc AS (SELECT id, CASE WHEN relation = 'approximates' THEN 'unverified' ELSE 'rejected' END AS epistemic_state, provenance, 0.5::DOUBLE AS confidence_score FROM kg_edges WHERE provenance = 'span-present')"""


@query(L + INCOMING + """ SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR (o.epistemic_state IN ('grounded', 'rejected', 'failed', 'obsolete') AND n.epistemic_state = 'unverified') THEN o.epistemic_state ELSE n.epistemic_state END AS epistemic_state,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL OR (o.epistemic_state IN ('grounded', 'rejected', 'failed', 'obsolete') AND n.epistemic_state = 'unverified') OR (o.epistemic_state = n.epistemic_state AND o.provenance = n.provenance AND o.confidence_score = n.confidence_score) THEN 'kept' ELSE 'updated' END AS change
FROM (FROM kg_edges WHERE relation <> 'bridges') o FULL JOIN inc n USING (id)""")
def merge_into_existing(spark, d):
    e = stored_edges(spark, d)
    inc = e.where("provenance = 'span-present'").select("id", F.when(F.col("relation") == "approximates", "unverified").otherwise("rejected").alias("epistemic_state"), "provenance", F.lit(0.5).alias("confidence_score"), F.lit(1).alias("ord"))
    return w.merged(e.where("relation <> 'bridges'"), inc).select("id", "epistemic_state", "change")


@query(L + """, v AS (SELECT id, epistemic_state AS from_state, provenance, CASE WHEN confidence_score < 0.3 THEN 'grounded' WHEN confidence_score < 0.6 THEN 'failed' WHEN confidence_score < 0.8 THEN 'obsolete' ELSE 'maybe' END AS verdict, source LIKE '%1' AS span, source LIKE '%2' AS note FROM kg_edges WHERE epistemic_state = 'unverified'),
e AS (SELECT *, CASE WHEN verdict = 'maybe' THEN 'unknown-verdict' WHEN verdict = 'grounded' AND provenance = 'hypothesized' AND NOT span AND NOT note THEN 'promotion-needs-support' END AS error FROM v)
SELECT id, from_state, CASE WHEN error IS NULL THEN verdict ELSE from_state END AS epistemic_state, CASE WHEN error IS NULL AND verdict = 'grounded' AND provenance = 'hypothesized' THEN CASE WHEN span THEN 'span-present' ELSE 'inferred' END ELSE provenance END AS provenance, error FROM e""")
def ground_verdicts(spark, d):
    e = edges(spark, d).where("epistemic_state = 'unverified'")
    c = F.col("confidence_score")
    v = e.select("id", F.when(c < 0.3, "grounded").when(c < 0.6, "failed").when(c < 0.8, "obsolete").otherwise("maybe").alias("verdict"), F.when(F.col("source").endswith("1"), "s").alias("support_span"), F.when(F.col("source").endswith("2"), "n").alias("support_note"), F.lit("t").alias("by"), F.lit("2024").alias("at"), F.lit(1).alias("ord"))
    return w.ground(e, v).select("id", "from_state", "epistemic_state", "provenance", "error")


RENAME = """, mp AS (SELECT 'supplier-' || s_suppkey AS old, 'supplier-' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new FROM supplier),
mv AS (SELECT e.id AS was, coalesce(a.new, source) AS source, coalesce(b.new, target) AS target, relation, provenance, epistemic_state FROM kg_edges e LEFT JOIN mp a ON a.old = e.source LEFT JOIN mp b ON b.old = e.target),
rk AS (SELECT *, 'e_' || source || '__' || relation || '__' || target AS id, list_position(['obsolete', 'unverified', 'grounded', 'rejected', 'failed'], epistemic_state) AS s, list_position(['hypothesized', 'inferred', 'span-present'], provenance) AS p FROM mv)"""


@query(L + RENAME + " SELECT id, epistemic_state, provenance, n AS merged_from FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY s DESC, p DESC, was DESC) AS k FROM rk) WHERE k = 1")
def merge_nodes(spark, d):
    return w.renamed(edges(spark, d), _merges(spark, d)).select("id", "epistemic_state", "provenance", "merged_from")


def _merges(spark, d):
    s = lift.table(spark, d, "supplier")
    low = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("low"))
    # A table, so that its size is known and the edges need not travel for their ends.
    return g.stored(s.join(low, "s_nationkey").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("old"), F.concat(F.lit("supplier-"), "low").alias("new")), "merges")


MERGED = " SELECT id, epistemic_state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, p DESC, was DESC) AS k FROM rk) WHERE k = 1"


@query(L + RENAME + f", m AS ({MERGED}) SELECT id AS key, 'unverified' AS \"from\", epistemic_state AS \"to\", 'agent' AS \"by\" FROM m WHERE epistemic_state <> 'unverified' AND (id, epistemic_state) NOT IN (SELECT (id, epistemic_state) FROM kg_edges)")
def merge_migrations(spark, d):
    e = stored_edges(spark, d)
    return w.migrations(e, w.renamed(e, _merges(spark, d)))


@query(L + """, rq AS (SELECT 'Supplier-' || s_suppkey AS a, CASE WHEN s_suppkey % 5 = 0 THEN 'nation-' || s_nationkey WHEN s_suppkey % 7 = 0 THEN 'nowhere' ELSE 'supplier-' || (s_suppkey // 10 * 10 + 1) END AS b FROM supplier UNION ALL SELECT 'customer-' || c_custkey, 'customer-' || (c_custkey - c_custkey % 3) FROM customer),
r AS (SELECT lower(a) AS old, b AS new FROM rq), n AS (SELECT old, count(*) AS n FROM r GROUP BY 1)
SELECT r.old, r.new, CASE WHEN r.old = r.new THEN 'merge-into-itself' WHEN x.id IS NULL THEN 'source-not-found' WHEN y.id IS NULL THEN 'target-not-found' WHEN x.node_type <> y.node_type THEN 'node-type-conflict' WHEN n.n > 1 THEN 'source-merged-twice' WHEN r.new IN (SELECT old FROM n) THEN 'target-is-merged-too' END AS error
FROM r JOIN n ON n.old = r.old LEFT JOIN kg_nodes x ON x.id = r.old LEFT JOIN kg_nodes y ON y.id = r.new""")
def merge_refusals(spark, d):
    k = F.col("s_suppkey")
    into = F.when(k % 5 == 0, F.concat(F.lit("nation-"), "s_nationkey")).when(k % 7 == 0, "nowhere").otherwise(F.concat(F.lit("supplier-"), F.floor(k / 10) * 10 + 1))
    s = lift.table(spark, d, "supplier").select(F.concat(F.lit("Supplier-"), k).alias("from"), into.alias("into"))
    c = lift.table(spark, d, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("from"), F.concat(F.lit("customer-"), F.col("c_custkey") - F.col("c_custkey") % 3).alias("into"))
    return w.merge_requests(s.unionByName(c), nodes(spark, d))


@query(L + """, b AS (SELECT id, epistemic_state FROM kg_edges WHERE relation <> 'bridges'), o AS (SELECT id, CASE WHEN confidence_score > 0.7 THEN 'failed' ELSE epistemic_state END AS epistemic_state FROM kg_edges), t AS (SELECT id, CASE WHEN confidence_score > 0.5 THEN 'grounded' ELSE epistemic_state END AS epistemic_state FROM kg_edges),
j AS (SELECT o.id, b.epistemic_state AS b, o.epistemic_state AS o, t.epistemic_state AS t FROM o JOIN t USING (id) LEFT JOIN b USING (id))
SELECT id, CASE WHEN o = t THEN o WHEN o IS NOT DISTINCT FROM b THEN t WHEN t IS NOT DISTINCT FROM b THEN o ELSE 'unverified' END AS epistemic_state, o <> t AND o IS DISTINCT FROM b AND t IS DISTINCT FROM b AS conflict FROM j""")
def three_way_merge(spark, d):
    e = stored_edges(spark, d)
    c = F.col("confidence_score")
    change = lambda over, to: e.select("id", F.when(c > over, to).otherwise(F.col("epistemic_state")).alias("epistemic_state"))
    return w.three_way(e.where("relation <> 'bridges'"), change(0.7, "failed"), change(0.5, "grounded"))


@query(L + """, b AS (SELECT *, 'agent' AS verdict_by FROM kg_edges WHERE relation <> 'bridges'), o AS (SELECT id, confidence_score AS c, CASE WHEN confidence_score > 0.7 THEN 'failed' ELSE epistemic_state END AS s FROM kg_edges WHERE relation <> 'projects'), t AS (SELECT id, confidence_score + 1 AS c, CASE WHEN confidence_score > 0.5 THEN 'grounded' ELSE epistemic_state END AS s FROM kg_edges WHERE relation <> 'grounds'),
j AS (SELECT id, o.c AS oc, t.c AS tc, o.s AS os, t.s AS ts, b.epistemic_state AS bs FROM o FULL JOIN t USING (id) LEFT JOIN b USING (id)),
k AS (SELECT *, os IS NOT NULL AND ts IS NOT NULL AND os <> ts AND coalesce(os <> bs, true) AND coalesce(ts <> bs, true) AS conflict, os IS NULL OR (ts IS NOT NULL AND (os = ts OR coalesce(os = bs, false))) AS take FROM j)
SELECT id, CASE WHEN conflict THEN 'unverified' WHEN take THEN ts ELSE os END AS epistemic_state, CASE WHEN take THEN tc ELSE oc END AS confidence_score, CASE WHEN conflict THEN NULL WHEN take THEN 'theirs' ELSE 'ours' END AS verdict_by, conflict FROM k""")
def three_way_edges(spark, d):
    """Whole edges: ours lacks a relation, theirs another, the base a third."""
    e, c = stored_edges(spark, d), F.col("confidence_score")

    def side(df, over, to, score, by):
        return df.select("id", F.when(c > over, to).otherwise(F.col("epistemic_state")).alias("epistemic_state"), score.alias("confidence_score"), F.lit(by).alias("verdict_by"))

    ours = side(e.where("relation <> 'projects'"), 0.7, "failed", c, "ours")
    theirs = side(e.where("relation <> 'grounds'"), 0.5, "grounded", c + 1, "theirs")
    return w.three_way_edges(side(e.where("relation <> 'bridges'"), 9, "failed", c, "agent"), ours, theirs)


@query(L + """, v AS (SELECT id, label, node_type, community AS c, length(label) AS n FROM kg_nodes), b AS (SELECT id, label, node_type, 'unverified' AS s, 'about ' || label AS body FROM v WHERE c <> -1),
o AS (SELECT id, CASE WHEN c % 2 = 0 THEN upper(label) ELSE label END AS label, node_type, CASE WHEN c % 4 = 0 THEN 'grounded' ELSE 'unverified' END AS s, 'about ' || label || CASE WHEN c % 5 = 0 THEN ' here' ELSE '' END AS body FROM v WHERE c % 7 <> 3),
t AS (SELECT id, CASE WHEN c % 3 = 0 THEN lower(label) ELSE label END AS label, CASE WHEN c % 9 = 1 THEN 'concept' ELSE node_type END AS node_type, CASE WHEN c % 3 = 0 THEN 'failed' ELSE 'unverified' END AS s, 'about ' || label || CASE WHEN c % 3 = 1 THEN ' there' ELSE '' END AS body FROM v WHERE c % 7 <> 4),
j AS (SELECT id, o.label AS ol, t.label AS tl, b.label AS bl, o.node_type AS ok, t.node_type AS tk, b.node_type AS bk, o.s AS os, t.s AS ts, b.s AS bs, o.body AS oy, t.body AS ty, coalesce(b.body, '') AS y FROM o FULL JOIN t USING (id) LEFT JOIN b USING (id)),
k AS (SELECT *, coalesce(os <> ts, false) AND coalesce(os <> bs, true) AND coalesce(ts <> bs, true) AS conflict, coalesce(oy <> ty AND oy <> y AND ty <> y, false) AS body_conflict FROM j)
SELECT id, CASE WHEN os IS NULL OR (ts IS NOT NULL AND ol = bl) THEN tl ELSE ol END AS label, CASE WHEN os IS NULL OR (ts IS NOT NULL AND ok = bk) THEN tk ELSE ok END AS node_type, CASE WHEN conflict THEN 'unverified' WHEN os IS NULL OR (ts IS NOT NULL AND os = bs) THEN ts ELSE os END AS epistemic_state,
  CASE WHEN body_conflict THEN '<<<<<<< ours' || chr(10) || oy || chr(10) || '=======' || chr(10) || ty || chr(10) || '>>>>>>> theirs' || chr(10) WHEN os IS NULL OR (ts IS NOT NULL AND oy = y) THEN ty ELSE oy END AS body, conflict, body_conflict FROM k""")
def three_way_notes(spark, d):
    """Labels, types, states and bodies of notes that two sides changed, some without a base."""
    n = nodes(spark, d).withColumn("about", F.concat(F.lit("about "), "label"))
    c, same = F.col("community"), F.col("label")
    state = lambda when, to: F.when(when, to).otherwise("unverified").alias("epistemic_state")
    more = lambda when, word: F.when(when, F.concat("about", F.lit(word))).otherwise(F.col("about")).alias("body")
    never = F.lit(False)
    base = n.where(c != -1).select("id", "label", "node_type", state(never, ""), more(never, ""))
    ours = n.where(c % 7 != 3).select("id", F.when(c % 2 == 0, F.upper(same)).otherwise(same).alias("label"), "node_type", state(c % 4 == 0, "grounded"), more(c % 5 == 0, " here"))
    theirs = n.where(c % 7 != 4).select("id", F.when(c % 3 == 0, F.lower(same)).otherwise(same).alias("label"), F.when(c % 9 == 1, "concept").otherwise(F.col("node_type")).alias("node_type"), state(c % 3 == 0, "failed"), more(c % 3 == 1, " there"))
    return w.three_way_nodes(base, ours, theirs)


@query(L + """, au AS (SELECT id AS key, epistemic_state AS st FROM kg_edges WHERE confidence_score < 0.4), ba AS (SELECT id, CASE WHEN confidence_score > 0.8 THEN epistemic_state WHEN confidence_score > 0.6 THEN 'failed' ELSE 'unverified' END AS was FROM kg_edges),
j AS (SELECT e.id, e.epistemic_state AS st, b.was, a.key IS NOT NULL AS paid FROM kg_edges e JOIN ba b USING (id) LEFT JOIN au a ON a.key = e.id),
x AS (SELECT *, CASE WHEN st = was THEN 'unchanged' WHEN st <> 'unverified' AND paid THEN 'audited' WHEN was IN ('failed', 'rejected') THEN 'failure-restored' WHEN st <> 'unverified' THEN 're-quarantined' ELSE 'unchanged' END AS action FROM j)
SELECT id, action, CASE action WHEN 'failure-restored' THEN was WHEN 're-quarantined' THEN 'unverified' ELSE st END AS epistemic_state, (CASE WHEN action = 'audited' THEN 1 ELSE 0 END)::BIGINT AS spent FROM x""")
def reconcile_forged(spark, d):
    e = stored_edges(spark, d)
    c = F.col("confidence_score")
    audit = e.where(c < 0.4).select(F.col("id").alias("key"), F.col("epistemic_state").alias("to"))
    base = e.select("id", F.when(c > 0.8, F.col("epistemic_state")).when(c > 0.6, "failed").otherwise("unverified").alias("epistemic_state"))
    consumed = audit.where("false").select("key", "to", F.lit(0).cast("long").alias("used"))
    return w.sweep(e, base, audit, consumed).select("id", "action", "epistemic_state", "spent")


@query(L + "SELECT id, CASE WHEN relation = 'bridges' THEN 'inserted' WHEN relation = 'projects' THEN 'deleted' ELSE 'updated' END AS change FROM kg_edges WHERE relation IN ('bridges', 'projects') OR provenance = 'hypothesized'".replace("SELECT id", " SELECT id", 1))
def incremental_diff(spark, d):
    e = stored_edges(spark, d)
    new = e.where("relation <> 'projects'").withColumn("epistemic_state", F.when(F.col("provenance") == "hypothesized", "unknown").otherwise(F.col("epistemic_state")))
    return w.changes(e.where("relation <> 'bridges'"), new, "id", ["source", "target", "epistemic_state"])


@query("SELECT doc_id FROM documents WHERE source <> 'src0' AND coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE source = 'src0')")
def new_source_text(spark, d):
    docs = lift.table(spark, d, "documents").select("doc_id", "text", "source")
    seen = docs.where("source = 'src0'").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return w.new_texts(docs.where("source <> 'src0'"), seen).select("doc_id")


@query(L + " SELECT count(*) AS pairs FROM kg_adj WHERE u < v")
def topology_signature(spark, d):
    return w.topology_signature(g.adjacency(edges(spark, d))).select("pairs")


@query("""WITH x AS (SELECT doc_id AS unit, unnest(['q' || quality, 'q' || (1 - toxic)]) AS label FROM labels), c AS (SELECT unit, label, count(*) AS n FROM x GROUP BY ALL), u AS (SELECT unit, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY unit HAVING sum(n) >= 2),
o AS (SELECT sum(m) AS total, sum((m * m - sq) / (m - 1)) AS dis FROM u), mg AS (SELECT sum(t * t) AS csq FROM (SELECT sum(n) AS t FROM c SEMI JOIN u USING (unit) GROUP BY label))
SELECT round(1 - dis / ((total * total - csq) / (total - 1)), 9) AS alpha FROM o, mg""")
def krippendorff_alpha(spark, d):
    lab = lift.table(spark, d, "labels")
    long = lab.select(F.col("doc_id").alias("unit"), F.explode(F.array(F.struct(F.lit("quality").alias("coder"), F.concat(F.lit("q"), "quality").alias("label")), F.struct(F.lit("toxic").alias("coder"), F.concat(F.lit("q"), 1 - F.col("toxic")).alias("label")))).alias("x")).select("x.coder", "unit", "x.label")
    return m.krippendorff_alpha(long).select(F.round("alpha", 9).alias("alpha"))


@query("""WITH h AS (SELECT l_linenumber AS convergence, l_returnflag = 'A' AS grounded FROM lineitem)
SELECT count(*) FILTER (convergence >= 2) AS n_high, count(*) FILTER (convergence < 2) AS n_low, round(avg(grounded::INT) FILTER (convergence >= 2) - avg(grounded::INT) FILTER (convergence < 2), 6) AS margin, avg(grounded::INT) FILTER (convergence >= 2) - avg(grounded::INT) FILTER (convergence < 2) > 0.1 AS gate_on FROM h""")
def convergence_gate(spark, d):
    h = lift.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("convergence"), (F.col("l_returnflag") == "A").alias("grounded"))
    return m.convergence_gate(h)


@query(L + """, md AS (SELECT n.id, count(e.x) AS md FROM kg_nodes n LEFT JOIN (SELECT source AS x FROM kg_edges UNION ALL SELECT target FROM kg_edges) e ON e.x = n.id GROUP BY n.id), h AS (SELECT id, length(label) % 5 AS introduced_at, length(id) % 4 AS introduced_degree FROM kg_nodes)
SELECT id, greatest(0, md - introduced_degree) AS growth, CASE WHEN md - introduced_degree >= 3 THEN 'absorbed' WHEN md = 0 THEN 'isolated' ELSE 'fertile' END AS status, CASE WHEN md > introduced_degree THEN round((10 - introduced_at) / (md - introduced_degree), 6) END AS half_life FROM h JOIN md USING (id)""")
def absorption(spark, d):
    n = nodes(spark, d)
    h = n.select("id", (F.length("label") % 5).alias("introduced_at"), (F.length("id") % 4).alias("introduced_degree"))
    return m.absorption(h, g.multi_degree(n, edges(spark, d)), 10)


SCORES = """WITH o AS (SELECT conv_id || '-' || turn AS output, role AS arm, text, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{1,}'), lambda x: lower(x)) AS w FROM conversations WHERE text IS NOT NULL
), src AS (SELECT list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{1,}'), lambda x: lower(x)) AS w, lower(text) AS t FROM benchmark
), sg AS (SELECT DISTINCT unnest([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM src
), og AS (SELECT output, arm, unnest(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])) AS g FROM o
), dv AS (SELECT arm, count(DISTINCT g) / count(*) AS diversity FROM og GROUP BY arm
), nv AS (SELECT output, 1 - count(*) FILTER (g IN (FROM sg)) / count(*) AS novelty FROM og GROUP BY output
), se AS (SELECT output, unnest(regexp_split_to_array(text, '[.!?]+\\s+')) AS s FROM o
), kt AS (SELECT output, list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9_-]{1,}'), lambda x: length(x) > 5)[1:3] AS k FROM se WHERE len(regexp_extract_all(s, '\\S+')) >= 4
), al AS (SELECT string_agg(t, chr(10)) AS t FROM src
), un AS (SELECT output, avg(CASE WHEN len(list_filter(k, lambda x: contains(al.t, lower(x)))) = 0 THEN 1.0 ELSE 0.0 END) AS bare FROM kt, al WHERE len(k) > 0 GROUP BY output
), sc AS (SELECT arm, count(*) AS n, round(coalesce(any_value(diversity), 0), 3) AS diversity, round(avg(coalesce(novelty, 0)), 3) AS novelty,
    round(avg(least(1.0, len(regexp_extract_all(lower(text), '\\bbecause\\b|\\bif\\b|\\btherefore\\b|\\bbridge|\\bconnect')) / 5)), 3) AS utility, round(coalesce(avg(bare), 0), 3) AS unsupported_rate
  FROM o LEFT JOIN dv USING (arm) LEFT JOIN nv USING (output) LEFT JOIN un USING (output) GROUP BY arm)"""


def _scores(spark, d):
    c = lift.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("output"), F.col("role").alias("arm"), "text")
    return m.ideation(c, lift.table(spark, d, "benchmark").select("text"))


@query(SCORES + " SELECT * FROM sc")
def ideation_scores(spark, d):
    return _scores(spark, d)


@query(SCORES + """ SELECT a.arm AS a, b.arm AS b, a.diversity >= b.diversity AND a.novelty >= b.novelty AND a.unsupported_rate <= b.unsupported_rate + 0.05 AND (a.diversity > b.diversity OR a.novelty > b.novelty) AS beats FROM sc a, sc b WHERE a.arm <> b.arm""")
def ideation_verdicts(spark, d):
    return m.ideation_verdicts(g.stored(_scores(spark, d), "scores"))


@query(L + """, s AS (SELECT relation, CASE epistemic_state WHEN 'grounded' THEN 'correct' WHEN 'failed' THEN 'wrong' WHEN 'rejected' THEN 'astrology' END AS verdict, provenance = 'span-present' AS span_found, confidence_score FROM kg_edges), b AS (SELECT unnest(['*', relation]) AS relation, verdict, span_found, confidence_score FROM s WHERE verdict IS NOT NULL)
SELECT relation, count(*) AS judged, round(avg((verdict = 'correct')::INT), 6) AS precision, round(avg((verdict = 'astrology')::INT), 6) AS astrology, round(avg(span_found::INT), 6) AS span_support, round(avg(confidence_score) FILTER (verdict = 'correct'), 6) AS confidence_right, round(avg(confidence_score) FILTER (verdict <> 'correct'), 6) AS confidence_wrong FROM b GROUP BY relation HAVING relation = '*' OR count(*) >= 3""")
def precision_scoring(spark, d):
    state = F.col("epistemic_state")
    sheet = edges(spark, d).select("relation", F.when(state == "grounded", "correct").when(state == "failed", "wrong").when(state == "rejected", "astrology").alias("verdict"), (F.col("provenance") == "span-present").alias("span_found"), "confidence_score")
    return m.precision(sheet)


@query(L + " SELECT relation, count(*) AS n, round(min(confidence_score), 6) AS low, round(median(confidence_score), 6) AS mid, round(max(confidence_score), 6) AS high FROM kg_edges GROUP BY relation")
def graph_summary(spark, d):
    return m.graph_summary(edges(spark, d))


@query("""WITH t AS (SELECT DISTINCT lower(trim(x)) AS term FROM (SELECT unnest(list_concat(list_concat(regexp_extract_all(text, '\\*\\*([^*\\n]{1,60})\\*\\*', 1), regexp_extract_all(text, '`([^`\\n]{1,60})`', 1)), regexp_extract_all(text, '"([^"\\n]{3,60})"', 1))) AS x FROM documents) WHERE trim(x) <> ''), g AS (SELECT DISTINCT lower(trim(p_name)) AS term FROM part)
SELECT coalesce(t.term, g.term) AS term, t.term IS NOT NULL AS in_text, g.term IS NOT NULL AS in_glossary FROM t FULL JOIN g ON t.term = g.term""")
def pack_coverage(spark, d):
    return m.pack_coverage(lift.table(spark, d, "documents").select("text"), lift.table(spark, d, "part").select(F.col("p_name").alias("term")))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{1,}'))) AS term FROM documents) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (1 + count(*))) + 1, 6) AS idf FROM t GROUP BY term""")
def idf_terms(spark, d):
    return tx.idf(lift.table(spark, d, "documents"), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


SPEC = """, t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{1,}'))) AS term FROM benchmark), seeds AS (SELECT term, ln((SELECT count(*) FROM benchmark) / (1 + count(*))) + 1 AS seed FROM t GROUP BY term),
lt AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS term FROM (SELECT id, regexp_extract_all(lower(label), '[a-z][a-z0-9_-]{1,}') AS w FROM kg_nodes)),
sp AS (SELECT id, avg(coalesce(seed, (SELECT avg(seed) FROM seeds))) AS specificity FROM lt LEFT JOIN seeds USING (term) GROUP BY id)"""


def _spec(spark, d, n):
    seeds = tx.idf(lift.table(spark, d, "benchmark"), "item_id", "text").select("term", F.col("idf").alias("seed"))
    return tx.specificity(n, "id", "label", seeds)


@query(L + SPEC + " SELECT id, round(specificity, 6) AS specificity FROM sp")
def label_specificity(spark, d):
    return _spec(spark, d, nodes(spark, d)).select("id", F.round("specificity", 6).alias("specificity"))


@query(L + SPEC.replace("sp AS", "sp0 AS") + """, r AS (SELECT id, degree::DOUBLE AS b, (length(label) % 7 + 1)::DOUBLE AS s FROM kg_degree), a AS (SELECT id, s FROM r ORDER BY b DESC, id LIMIT 5), c AS (SELECT id FROM r ORDER BY b * s DESC, id LIMIT 5)
SELECT (SELECT count(*) FROM r) AS n, (SELECT avg(s) FROM a) < (SELECT avg(s) FROM r) AS confound, ((SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM c)) + (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM a))) / 10 AS churn, (SELECT max(s) - min(s) FROM r) AS spread""")
def specificity_gate(spark, d):
    n = nodes(spark, d)
    ranked = g.degree(n, g.adjacency(edges(spark, d))).select("id", F.col("degree").cast("double").alias("betweenness"), (F.length("label") % 7 + 1).cast("double").alias("specificity"))
    return g.specificity_gate(ranked).drop("gate_on")


@query()
def sections(spark, d):
    return tx.sections(lift.table(spark, d, "documents"), "doc_id", "text")


@query("""WITH h AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', E'\\n', 'g') AS t FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(t, '(?m)^## ')) AS heads, (CASE WHEN regexp_matches(t, '(?m)^\\s*(```|~~~)') THEN 1 ELSE 0 END) AS fenced FROM h)
SELECT doc_id, heads FROM c WHERE heads > 0 AND fenced = 0""")
def section_heads(spark, d):
    docs = lift.table(spark, d, "documents").where("not regexp_like(coalesce(text, ''), '(?m)^\\\\s*(```|~~~)')")
    parts = tx.sections(docs, "doc_id", "text").where("section > 0")
    return parts.groupBy("doc_id").agg(F.max("section").cast("long").alias("heads"))


@query("""WITH s AS (SELECT unnest(['the', 'thndor', 'zzznomatch', 'la le la', 'of%%%']) AS span) SELECT span, count(*) FILTER (d.text LIKE '%' || replace(span, '%', '\\%') || '%' ESCAPE '\\') AS docs FROM s, documents d GROUP BY span""")
def span_search(spark, d):
    spans = ["the", "thndor", "zzznomatch", "la le la", "of%%%"]
    docs = lift.table(spark, d, "documents")
    hits = docs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.coalesce(F.col("text").contains(s), F.lit(False)).alias("hit")) for s in spans])).alias("x"))
    return hits.groupBy("x.span").agg(F.count_if("x.hit").alias("docs"))


NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("WITH src AS (SELECT 'doc-' || doc_id AS name, " + NORM + " AS norm FROM documents), sp AS (SELECT item_id, 'doc-' || item_id AS f, " + NORM + " AS span FROM benchmark) SELECT item_id, CASE WHEN s.name IS NOT NULL THEN contains(s.norm, span) ELSE EXISTS (SELECT 1 FROM src x WHERE contains(x.norm, span)) END AS verified FROM sp LEFT JOIN src s ON s.name = f AND item_id % 2 = 0")
def span_verification(spark, d):
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    sources = lift.table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), norm("text").alias("norm"))
    spans = lift.table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("doc-"), "item_id")).otherwise("unnamed").alias("source_file"), norm("text").alias("norm_span"))
    return span_verified(spans, sources).select("item_id", "verified")


def _replaced(text: str, forms: list[tuple[str, str]]) -> str:
    for kind, form in forms:
        text = "regexp_replace(" + text + ", '" + form.replace("'", "''") + f"', '[{kind}]', 'g')"
    return text


_LOW = len(sc.rules("low"))


@query(f"""WITH low AS MATERIALIZED (SELECT doc_id, {_replaced("coalesce(text, '')", sc.rules("low"))} AS t FROM documents
), runs AS (SELECT doc_id, t, list_transform(list_reverse_sort(list_transform(list_filter(list_distinct(regexp_extract_all(t, '{sc.RUN}')), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')), lambda x: lpad(length(x)::VARCHAR, 9, '0') || x)), lambda x: x[10:]) AS r FROM low
), free AS MATERIALIZED (SELECT doc_id, list_reduce(list_prepend(t, r), lambda a, x: replace(a, x, '[{sc.RANDOM}]')) AS t FROM runs)
SELECT doc_id, md5({_replaced("t", sc.rules()[_LOW:])}) AS digest FROM free""")
def scrub_redact(spark, d):
    docs = lift.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(sc.redact(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query()
def scrub_consistent(spark, d):
    return sc.scrub(lift.table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("placeholders").alias("redacted"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(source)), '[^\\w\\s-]', '-', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def slugs(spark, d):
    return lift.table(spark, d, "documents").select("doc_id", tx.slug("source").alias("slug"))


@query(L + ", ch AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{3,}')) AS term FROM benchmark), it AS (SELECT n.id, unnest(regexp_extract_all(lower(label), '[\\p{L}\\p{N}]{3,}')) AS term FROM kg_nodes n) SELECT DISTINCT id FROM it SEMI JOIN (SELECT term FROM ch UNION ALL SELECT unnest(['europe', 'asia'])) c USING (term)")
def re_examinable(spark, d):
    changed = lift.table(spark, d, "benchmark").select(F.explode(tx.terms("text")).alias("term")).unionAll(spark.createDataFrame([("europe",), ("asia",)], "term string"))
    items = nodes(spark, d).withColumn("epistemic_state", F.lit("failed"))
    return m.re_examinable(items, changed, tx.terms("label"))


CYCLES = """WITH h AS (SELECT event_type AS session, epoch_us(date_trunc('hour', ts)) // 3600000000 AS cycle, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE avg(ln(2 + abs(value))) END AS novelty, count(*) AS submitted, 3 AS target, round(avg(value) / 100, 9) AS mean_cosine FROM events GROUP BY ALL)"""


def _cycles(spark, d):
    """Cycles of a session: the events of a type by the hour."""
    e = lift.table(spark, d, "events").groupBy(F.col("event_type").alias("session"), F.floor(F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))) / 3_600_000_000).alias("cycle"))
    novelty = F.when(F.count("*") % 7 == 0, None).otherwise(F.avg(F.log(2 + F.abs("value"))))
    return e.agg(novelty.alias("novelty"), F.count("*").alias("submitted"), F.round(F.avg("value") / 100, 9).alias("mean_cosine")).withColumn("target", F.lit(3))


@query(CYCLES + """, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY cycle) AS i, count(novelty) OVER (PARTITION BY session ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS c FROM h),
v AS (SELECT session, c, novelty AS x FROM k WHERE novelty IS NOT NULL),
s AS (SELECT k.*, submitted < 0.6 * target AS under, (v4.x - v2.x) / 2 AS e, (v2.x - v0.x) / 2 AS r FROM k LEFT JOIN v v0 ON v0.session = k.session AND v0.c = k.c LEFT JOIN v v2 ON v2.session = k.session AND v2.c = k.c - 2 LEFT JOIN v v4 ON v4.session = k.session AND v4.c = k.c - 4),
a AS (SELECT *, CASE WHEN NOT under AND e IS NOT NULL THEN e END AS se, CASE WHEN NOT under AND e IS NOT NULL THEN r END AS sr FROM s),
q AS (SELECT *, coalesce(sr > 0.005 AND sr >= 1.5 * greatest(se, 0.005), false) AS acc FROM a),
z AS (SELECT *, i - coalesce(max(CASE WHEN NOT acc THEN i END) OVER (PARTITION BY session ORDER BY cycle ROWS UNBOUNDED PRECEDING), 0) AS streak FROM q)
SELECT session, cycle, under AS under_generation, round(se, 4) AS slope_earlier, round(sr, 4) AS slope_recent, acc AS accelerating, streak, streak >= 2 AS eroding FROM z""")
def variety_erosion(spark, d):
    return m.erosion(_cycles(spark, d))


@query("WITH RECURSIVE " + CYCLES[5:] + """, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY cycle) AS i FROM h),
f AS (SELECT session, 0 AS i, 0::BIGINT AS cycle, 0.55::DOUBLE AS lim, false AS sim, 0 AS nb, []::DOUBLE[] AS base FROM k WHERE i = 1
  UNION ALL SELECT session, i, cycle, lim, sim, len(old) AS nb, CASE WHEN n >= 2 AND NOT (len(old) >= 2 AND sim) THEN list_append(old, c)[-5:] ELSE old END AS base FROM (
    SELECT k.session, k.i, k.cycle, k.submitted AS n, k.mean_cosine AS c, f.base AS old, CASE WHEN len(f.base) >= 2 THEN least(list_avg(f.base) + 0.15, 0.80) ELSE 0.55 END AS lim, k.submitted >= 2 AND k.mean_cosine > CASE WHEN len(f.base) >= 2 THEN least(list_avg(f.base) + 0.15, 0.80) ELSE 0.55 END AS sim FROM f JOIN k ON k.session = f.session AND k.i = f.i + 1))
SELECT session, cycle, round(lim, 6) AS similarity_limit, sim AS too_similar, nb AS baseline FROM f WHERE i > 0""")
def similarity_limits(spark, d):
    return m.similarity_limits(_cycles(spark, d).withColumnRenamed("submitted", "n"))
