"""Four operations that write what they find as hypotheses: collapse, explode, regroup, open.

Each derives ``nodes`` (``payload, ord, id, label, node_type, body, authored_by``)
and ``edges`` (``payload, ord, source, relation, target, notes, authored_by``) from
the graph. ``operate`` puts them into a store through the propose lane, so they are
hypothesized, unverified and without a span, and known failures bind them. A node is
the rule's own work unless the caller gave its label or body; edges always are.
What cannot be done raises ``Refused`` with the reason, and nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..schema import FAILURE
from . import generate as gen
from .boundary import authorship
from .checkpoint import stored
from .commit import propose
from .graph import adjacency, bridge_communities, bridge_strength, communities, degree

# Bridges of a regroup, points that an opening attaches to.
REGROUP_K, OPEN_POINTS = 10, 2
OPS = ("collapse", "explode", "regroup", "open")


class Refused(ValueError):
    """There is nothing to operate on."""


def _node(of: DataFrame, key: Column, kind: str, label: str, body: str, own_body: Column) -> DataFrame:
    given = of.withColumn("_label", F.lit(label)).withColumn("_body", F.lit(body))
    said = F.when(F.trim("_body") != "", F.col("_body")).otherwise(own_body)
    return given.select(F.lit("op").alias("payload"), F.lit(0).alias("ord"), key.alias("id"), F.lit(label).alias("label"), F.lit(kind).alias("node_type"), said.alias("body"), authorship("_label", "_body").alias("authored_by"))


def _edges(df: DataFrame, notes: Column | None = None) -> DataFrame:
    """In the order of their ends; a struct orders rows as a running number would, without one task for all."""
    return df.select(F.lit("op").alias("payload"), F.struct("source", "target").alias("ord"), "source", "relation", "target", (F.lit("") if notes is None else notes).alias("notes"), F.lit("deterministic").alias("authored_by"))


def _there(nodes: DataFrame, target: str, op: str) -> None:
    if nodes.where(F.col("id") == target).isEmpty():
        raise Refused(f"{op} target {target!r} is not in the graph")


def collapse(nodes: DataFrame, target: str | None = None, members: list[str] | None = None, label: str = "", body: str = "") -> tuple[DataFrame, DataFrame]:
    """A compression node that the given members, the target's community or the
    largest community collapse into. ``nodes`` has ``id, community``. Unknown
    members are left out; fewer than two are refused, as is a target that the
    graph does not have; a target without a community has no members."""
    if target is not None and not members:
        _there(nodes, target, "collapse")
    found = stored(gen.collapse(nodes, members, target), "collapse")
    if found.limit(2).count() < 2:
        raise Refused("collapse needs at least 2 members")
    of = found.groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("first"), F.max("source").alias("last"))
    own = F.concat(F.lit("stands for "), F.col("n"), F.lit(" members, from "), F.col("first"), F.lit(" to "), F.col("last"))
    return _node(of, F.col("target"), "compression", label, body, own), _edges(found)


def explode(nodes: DataFrame, edges: DataFrame, target: str | None = None, k: int | None = None, label: str = "", body: str = "") -> tuple[DataFrame, DataFrame]:
    """A primitive for each distinct relation that leaves the target, or two where
    none does, numbered in order and collapsing into it; without a target, of
    the node of the highest degree. ``k`` bounds the facets (0: none, null: all)."""
    if target is None:
        top = nodes.orderBy(F.desc("degree"), F.desc("id")).select("id").first()
        if top is None:
            raise Refused("no node to explode")
        target = top["id"]
    else:
        _there(nodes, target, "explode")
    # Relations are a vocabulary, not rows: a window over the distinct ones is small.
    roles = edges.where((F.col("source") == target) & (F.col("relation") != "")).select("relation").distinct()
    none = edges.sparkSession.createDataFrame([("aspect-1",), ("aspect-2",)], "relation string")
    any_role = roles.agg((F.count("*") > 0).alias("x")).scalar()
    roles = roles.unionAll(none.where(~any_role)).withColumn("i", F.row_number().over(Window.orderBy("relation")))
    if k is not None:
        roles = roles.where(F.col("i") <= max(0, k))
    facets = stored(roles.select("relation", "i", F.concat(slug(F.lit(target)), F.lit("-facet-"), "i").alias("facet")), "facets")
    own = F.concat(F.lit(f"what {target} is as "), F.col("relation"))
    made = _node(facets, F.col("facet"), "primitive", label, body, own)
    return made, _edges(facets.select(F.col("facet").alias("source"), F.lit("collapses_into").alias("relation"), F.lit(target).alias("target")))


def regroup(nodes: DataFrame, adj: DataFrame, edges: DataFrame, other: DataFrame, k: int = REGROUP_K) -> tuple[DataFrame, DataFrame]:
    """The ``k`` strongest bridges that another partition makes visible, leaving
    out those that failed before, whichever way round."""
    failed = edges.where(F.col("epistemic_state").isin(*FAILURE) & (F.col("relation") == gen.RELATION))
    barred = adj.unionAll(failed.select("source", "target")).unionAll(failed.select("target", "source"))
    found = stored(gen.regroup(nodes, barred, other, k), "regroup")
    if found.isEmpty():
        raise Refused("another partition shows no bridges")
    no_nodes = _node(found, F.col("source"), "primitive", "", "", F.lit("")).where("false")
    return no_nodes, _edges(found, F.concat(F.lit("one community apart at another resolution, strength "), F.col("score")))


def open_up(nodes: DataFrame, k: int = OPEN_POINTS, label: str = "", body: str = "") -> tuple[DataFrame, DataFrame]:
    """A primitive named by the node of the highest degree and bridged to the ``k``
    highest, one at least."""
    points = stored(nodes.orderBy(F.desc("degree"), "id").limit(max(1, k)).select("id", "degree"), "points")
    if points.isEmpty():
        raise Refused("nothing to open against")
    first = points.orderBy(F.desc("degree"), "id").limit(1).select(F.concat(F.lit("opening-"), slug("id")).alias("source"))
    made = _node(first, F.col("source"), "primitive", label, body, F.lit("what the present vocabulary has no word for"))
    return made, _edges(points.crossJoin(F.broadcast(first)).select("source", F.lit(gen.RELATION).alias("relation"), F.col("id").alias("target")))


def structure(op: str, nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None, other: DataFrame | None = None, *, target: str | None = None, members: list[str] | None = None, k: int | None = None, label: str = "", body: str = "", adj: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What an operation would write. ``of`` and ``other`` are partitions ``id,
    community``; where none is given, communities are found, ``other`` at a
    resolution of 4. Nodes that ``of`` does not have are in no community. ``adj``
    is the adjacency of ``edges``, where the caller has it."""
    if op not in OPS:
        raise Refused(f"unknown operation {op!r}: one of {', '.join(OPS)}")
    ids = nodes.select("id")
    if op == "collapse" and members:
        return collapse(ids, None, members, label, body)
    near = lambda: stored(adjacency(edges), "adjacency") if adj is None else adj
    if op in ("explode", "open"):
        n = degree(ids, near())
        return explode(n, edges, target, k, label, body) if op == "explode" else open_up(n, k or OPEN_POINTS, label, body)
    if op == "collapse":
        n = ids.join(communities(ids, near()) if of is None else of.select("id", "community"), "id", "left")
        return collapse(n, target, None, label, body)
    adj = near()
    n = ids.join(communities(ids, adj) if of is None else of.select("id", "community"), "id", "left")
    other = stored(communities(ids, adj, resolution=4.0), "regrouped") if other is None else other
    ranked = degree(n, adj).join(bridge_communities(n, adj), "id").withColumn("strength", bridge_strength(F.lit(0)))
    return regroup(stored(ranked, "ranked"), adj, edges, other, k or REGROUP_K)


def operate(spark: SparkSession, path: str, op: str, pack: dict[str, list[str]], of: DataFrame | None = None, other: DataFrame | None = None, **options) -> DataFrame:
    """Runs an operation on the store at ``path`` and writes its result; ``kind, id,
    disposition, reason, authored_by`` of each item. Options are those of ``structure``."""
    return propose(spark, path, lambda now: structure(op.lower(), now["nodes"], now["edges"], of, other, **options), pack)
