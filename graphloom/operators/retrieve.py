"""Reads: filtered lists, neighbours, context within a budget, agenda, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FAILURE, is_live

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_ROWS, MAX_TERMS, MAX_BUDGET, MAX_AGENDA = 10_000, 12, 100_000, 50


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def query_nodes(nodes: DataFrame, node_type: str | None = None, limit: int = 50) -> DataFrame:
    """By degree, then id. ``nodes`` has ``degree``."""
    df = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    return df.orderBy(F.desc("degree"), "id").limit(clamp(limit, 0, MAX_ROWS))


def query_edges(edges: DataFrame, relation: str | None = None, state: str | None = None, limit: int = 50) -> DataFrame:
    """By id; the unverified queue has hypothesized edges first."""
    df = edges if relation is None else edges.where(F.col("relation") == relation)
    df = df if state is None else df.where(F.col("epistemic_state") == state)
    first = [F.when(F.col("provenance") == "hypothesized", 0).otherwise(1)] if state == "unverified" else []
    return df.orderBy(*first, "id").limit(clamp(limit, 0, MAX_ROWS))


def incident(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """Edges at a node, live or not."""
    at = (F.col("source") == node) | (F.col("target") == node)
    return edges.where(at if relation is None else at & (F.col("relation") == relation))


def node_with_edges(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    e = incident(edges, node).agg(F.count("*").alias("n_edges"), F.min("id").alias("first_edge"), F.max("id").alias("last_edge"))
    return nodes.where(F.col("id") == node).crossJoin(F.broadcast(e))


def query_terms(query: str) -> list[str]:
    """The first terms of a query; none means: look for the whole query."""
    import re

    found = re.findall(r"[^\W_]{3,}", query.lower())
    return list(dict.fromkeys(found))[:MAX_TERMS]


def matches(query: str, columns: list[str]) -> Column:
    """Any term in any of the columns, whatever the case of A to Z."""
    fold = lambda c: F.translate(c, UPPER, UPPER.lower())
    wanted = query_terms(query) or [query]
    ascii_lower = [t.translate({ord(u): u.lower() for u in UPPER}) for t in wanted]
    return reduce(lambda a, b: a | b, [fold(F.coalesce(F.col(c), F.lit(""))).contains(t) for t in ascii_lower for c in columns])


def tokens(columns: list[str]) -> Column:
    """An estimate: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.concat_ws(" ", *[F.col(c) for c in columns])) / 4)).cast("long")


def priority() -> list[Column]:
    """Grounded first, then span-present before inferred, confidence, id."""
    return [F.when(F.col("epistemic_state") == "grounded", 0).otherwise(1), F.when(F.col("provenance") == "span-present", 0).when(F.col("provenance") == "inferred", 1).otherwise(2), F.desc_nulls_last("confidence_score"), F.asc("id")]


def budgeted(df: DataFrame, order: list[Column], cap: int, columns: list[str]) -> DataFrame:
    """The longest prefix of ``df`` in ``order`` whose tokens fit ``cap``.

    A row has one token at least, so ``cap + 1`` rows are enough for the
    running sum: the global window never sees more.
    """
    top = df.withColumn("tokens", tokens(columns)).orderBy(*order).limit(cap + 1)
    running = F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", running).where(F.col("used") <= cap)


CONTEXT_COLUMNS = ["id", "source", "relation", "target"]


def context_items(edges: DataFrame, query: str, budget: int = 2000) -> DataFrame:
    lane = edges.where(is_live() & (F.col("provenance") != "hypothesized"))
    if query:
        lane = lane.where(matches(query, ["source", "target", "relation"]))
    return budgeted(lane, priority(), clamp(budget, 0, MAX_BUDGET), CONTEXT_COLUMNS)


def context_hypotheses(edges: DataFrame, query: str, budget: int = 2000) -> DataFrame:
    """What the budget leaves after the items goes to unverified hypotheses."""
    used = context_items(edges, query, budget).agg(F.coalesce(F.max("used"), F.lit(0)).alias("spent")).first()["spent"]
    lane = edges.where((F.col("provenance") == "hypothesized") & (F.col("epistemic_state") == "unverified"))
    if query:
        lane = lane.where(matches(query, ["source", "target", "relation"]))
    order = [F.desc_nulls_last("confidence_score"), F.asc("id")]
    return budgeted(lane, order, max(0, clamp(budget, 0, MAX_BUDGET) - used), CONTEXT_COLUMNS)


def failure_counter(edges: DataFrame, query: str = "") -> DataFrame:
    lane = edges.where(F.col("epistemic_state").isin(*FAILURE))
    return (lane.where(matches(query, ["source", "target", "relation"])) if query else lane).agg(F.count("*").alias("failures"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``metric, value``: nodes, edges and edges by state."""
    e = edges.groupBy("epistemic_state").agg(F.count("*").alias("value"))
    by = e.select(F.concat(F.lit("edges_"), F.col("epistemic_state")).alias("metric"), "value")
    return nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), "value").unionAll(e.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit("edges"), "value")).unionAll(by)


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, key, value`` counts of nodes by type and of edges by state and provenance."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("key")).agg(F.count("*").alias("value"))
    e = edges.groupBy(F.lit("edge").alias("kind"), F.concat_ws("/", "epistemic_state", "provenance").alias("key")).agg(F.count("*").alias("value"))
    return n.unionAll(e)


def incident_labels(nodes: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """``id, labels``: the first few distinct labels of a node's neighbours, by label.

    Partial top-k aggregation: a hub's edges are never gathered.
    """
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionAll(edges.select("target", "source"))
    pairs = ends.join(nodes.select(F.col("id").alias("other"), "label"), "other").select("id", "label").distinct()
    rank = Window.partitionBy("id").orderBy("label")
    few = pairs.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= most)
    return few.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels"))


def agenda(nodes: DataFrame, edges: DataFrame, hub: int = 3) -> DataFrame:
    """``id, detector, lane``: what a node needs, if anything; the first that fits.

    orphan: no live neighbour. hypothesized-only: all live edges are
    hypotheses. Hubs (at least ``hub`` neighbours) are well-grounded from a
    half of grounded live edges, else under-grounded. ``nodes`` has ``degree``.
    """
    live = edges.where(is_live())
    ends = live.select(F.col("source").alias("id"), "provenance", "epistemic_state").unionAll(live.where("source <> target").select("target", "provenance", "epistemic_state"))
    per = ends.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("provenance") == "hypothesized").alias("h"), F.count_if(F.col("epistemic_state") == "grounded").alias("g"))
    at = nodes.join(per, "id", "left")
    detector = F.when(F.col("degree") == 0, "orphan").when(F.col("h") == F.col("n"), "hypothesized-only").when((F.col("degree") >= hub) & (2 * F.col("g") >= F.col("n")), "well-grounded").when(F.col("degree") >= hub, "under-grounded-hub")
    lane = F.when(detector == "well-grounded", "answerable_now").otherwise("needs_work")
    return at.select("id", "degree", detector.alias("detector"), lane.alias("lane")).where("detector is not null")


def agenda_lanes(items: DataFrame, limit: int = 5) -> DataFrame:
    rank = Window.partitionBy("lane").orderBy(F.desc("degree"), "id")
    return items.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= clamp(limit, 1, MAX_AGENDA))


def edgeless_communities(nodes: DataFrame, adj: DataFrame, least: int = 2) -> DataFrame:
    """Communities of at least ``least`` members with no live edge to another."""
    c = nodes.select("id", "community")
    crossing = adj.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v").where("cu <> cv").select(F.col("cu").alias("community")).distinct()
    return nodes.groupBy("community").agg(F.count("*").alias("members")).where(F.col("members") >= least).join(crossing, "community", "left_anti")
