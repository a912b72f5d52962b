"""The relational tables as a knowledge graph: ``nodes`` and ``edges``.

Nodes are regions, nations, suppliers, customers and parts. Edges are the
foreign keys among them and one edge per supplier and part that some line item
relates; of several line items the first by order, line, quantity and price
gives the edge its state, provenance and confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edge_id_of_slugs
from ..operators.checkpoint import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, node_type, community``; the community of a customer or a
    supplier is its nation, that of a part its size."""
    read = lambda n: table(spark, sf_dir, n)
    row = lambda df, kind, key, label, community: df.select(F.concat(F.lit(f"{kind}-"), F.col(key)).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("node_type"), F.col(community).cast("int").alias("community") if isinstance(community, str) else F.lit(community).alias("community"))
    parts = read("part").withColumn("c", F.col("p_size") + 1000)
    out = row(read("region"), "region", "r_regionkey", "r_name", -1)
    for df in (row(read("nation"), "nation", "n_nationkey", "n_name", "n_nationkey"), row(read("supplier"), "supplier", "s_suppkey", "s_name", "s_nationkey"), row(read("customer"), "customer", "c_custkey", "c_name", "c_nationkey"), row(parts, "part", "p_partkey", "p_name", "c")):
        out = out.unionByName(df)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source, target, relation, provenance, epistemic_state, confidence_score, owner``."""
    read = lambda n: table(spark, sf_dir, n)

    def dim(df: DataFrame, a: str, key: str, b: str, to: str, relation: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{a}-"), F.col(key)).alias("source"), F.concat(F.lit(f"{b}-"), F.col(to)).alias("target"), F.lit(relation).alias("relation"), F.lit("span-present").alias("provenance"), F.lit("grounded").alias("epistemic_state"), F.lit(1.0).alias("confidence_score"))

    line = read("lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount")
    # One aggregation with map-side combining; no window over a supplier's lines.
    first = line.groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount")).alias("l"))
    quantity, flag = F.col("l.l_quantity"), F.col("l.l_returnflag")
    state = F.when(quantity == 50, "obsolete").when(quantity == 1, "rejected").when(flag == "A", "grounded").when(flag == "R", "failed").otherwise("unverified")
    lines = first.select(F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("part-"), F.col("l_partkey")).alias("target"), F.lit("approximates").alias("relation"), F.when(F.col("l.l_linestatus") == "F", "span-present").otherwise("hypothesized").alias("provenance"), state.alias("epistemic_state"), (F.col("l.l_discount") * 10).alias("confidence_score"))
    out = dim(read("nation"), "nation", "n_nationkey", "region", "n_regionkey", "projects")
    out = out.unionByName(dim(read("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "grounds")).unionByName(dim(read("customer"), "customer", "c_custkey", "nation", "c_nationkey", "bridges")).unionByName(lines)
    # Kinds and keys are slugs already.
    return out.select(edge_id_of_slugs("source", "relation", "target").alias("id"), "source", "target", "relation", "provenance", "epistemic_state", "confidence_score", F.col("source").alias("owner"))


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a table, for queries that use them more than once."""
    return stored(edges(spark, sf_dir), "edges")


#: The same as common table expressions.
LIFT_SQL = """
kg_nodes AS (
  SELECT 'region-' || r_regionkey AS id, r_name AS label, 'region' AS node_type, -1 AS community FROM region
  UNION ALL SELECT 'nation-' || n_nationkey, n_name, 'nation', n_nationkey FROM nation
  UNION ALL SELECT 'supplier-' || s_suppkey, s_name, 'supplier', s_nationkey FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey, c_name, 'customer', c_nationkey FROM customer
  UNION ALL SELECT 'part-' || p_partkey, p_name, 'part', p_size + 1000 FROM part
), kg_line AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount) AS rn FROM lineitem
), kg_raw AS (
  SELECT 'nation-' || n_nationkey AS source, 'region-' || n_regionkey AS target, 'projects' AS relation, 'span-present' AS provenance, 'grounded' AS epistemic_state, 1.0::DOUBLE AS confidence_score FROM nation
  UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'grounds', 'span-present', 'grounded', 1.0 FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'bridges', 'span-present', 'grounded', 1.0 FROM customer
  UNION ALL SELECT 'supplier-' || l_suppkey, 'part-' || l_partkey, 'approximates',
    CASE WHEN l_linestatus = 'F' THEN 'span-present' ELSE 'hypothesized' END,
    CASE WHEN l_quantity = 50 THEN 'obsolete' WHEN l_quantity = 1 THEN 'rejected' WHEN l_returnflag = 'A' THEN 'grounded' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'unverified' END,
    l_discount * 10 FROM kg_line WHERE rn = 1
), kg_edges AS (
  SELECT 'e_' || source || '__' || relation || '__' || target AS id, *, source AS owner FROM kg_raw
), kg_adj AS (
  SELECT source AS u, target AS v FROM kg_edges WHERE epistemic_state NOT IN ('failed', 'rejected', 'obsolete') AND source <> target
  UNION SELECT target, source FROM kg_edges WHERE epistemic_state NOT IN ('failed', 'rejected', 'obsolete') AND source <> target
), kg_degree AS (
  SELECT n.id, n.label, n.node_type, n.community, count(a.v) AS degree FROM kg_nodes n LEFT JOIN kg_adj a ON a.u = n.id GROUP BY ALL
)
"""
