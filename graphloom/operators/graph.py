"""Graph operators: live topology, degrees, communities, betweenness, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_COMMUNITY, is_live
from .centrality import betweenness, numbered, renumbered
from .checkpoint import stored
from .leiden import leiden


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id: its source's own note wins, then the smallest owner."""
    key = F.struct((F.col("owner") != F.col("source")).alias("foreign"), F.col("owner").alias("o"))
    return edges.groupBy("id").agg(F.min_by(F.struct(*[c for c in edges.columns if c != "id"]), key).alias("e")).select("id", "e.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """``u, v``: distinct neighbours over live edges, both ways, no loops."""
    live = edges.where(is_live() & (F.col("source") != F.col("target")))
    # A pair travels once, in one order, and has both after that.
    pairs = live.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def vertices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids, those of dangling endpoints too."""
    return nodes.select("id").unionAll(edges.select("source")).unionAll(edges.select("target")).distinct()


def degree(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``nodes`` with the number of distinct live neighbours."""
    d = adj.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def multi_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends per node over the whole multigraph; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))  # one pass over the edges
    d = ends.groupBy("id").agg(F.count("*").alias("multi_degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("multi_degree", F.lit(0)).cast("long").alias("multi_degree"))


def bridge_communities(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``id, bridge_communities, structural_bridge``: distinct communities among neighbours."""
    c = adj.join(nodes.select(F.col("id").alias("v"), "community"), "v").groupBy(F.col("u").alias("id")).agg(F.countDistinct("community").alias("b"))
    b = F.coalesce(F.col("b"), F.lit(0)).cast("long")
    return nodes.select("id").join(c, "id", "left").select("id", b.alias("bridge_communities"), (b >= 2).cast("int").alias("structural_bridge"))


def community_stats(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``community, members, internal``: members and distinct internal pairs."""
    c = nodes.select("id", "community")
    inner = adj.where("u < v").join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("internal"))
    return nodes.groupBy("community").agg(F.count("*").alias("members")).join(inner, "community", "left").select("community", "members", F.coalesce("internal", F.lit(0)).alias("internal"))


def communities(nodes: DataFrame, adj: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``id, community``: connected communities of high modularity, named by
    their smallest member; isolated nodes are their own."""
    numbers = numbered(nodes.select("id").distinct())
    found = leiden(renumbered(adj, numbers).withColumn("w", F.lit(1.0)), resolution)
    of = stored(numbers.join(found.toDF("n", "label"), "n", "left").select("id", F.coalesce("label", "n").alias("label")), "communities")
    return of.join(of.groupBy("label").agg(F.min("id").alias("community")), "label").select("id", "community")


def _lengths(adj: DataFrame, sources: list[str], depth: int | None = None, wanted: list[str] | None = None) -> DataFrame:
    """``start, id, hops, path`` from each of ``sources``. One join per level for
    all of them; each level is written, and visited nodes never come back. With
    ``wanted`` it ends where all of these are reached from every source, too."""
    spark = adj.sparkSession
    seen = stored(spark.createDataFrame([(s, s, 0, [s]) for s in sources], "start string, id string, hops int, path array<string>"), "bfs")
    frontier, last, level, left = seen, None, 0, None
    if wanted is not None:
        left = {(s, w) for s in sources for w in wanted if s != w}
    while depth is None or level < depth:
        step = frontier.join(adj, frontier["id"] == adj["u"]).groupBy("start", F.col("v").alias("id")).agg(F.min("path").alias("path"))
        # Who is next to a level is in it or beside it, so the last two levels are all that can come back.
        known = frontier.select("start", "id") if last is None else frontier.select("start", "id").unionByName(last.select("start", "id"))
        new = step.join(known, ["start", "id"], "left_anti").select("start", "id", F.lit(level + 1).alias("hops"), F.concat("path", F.array("id")).alias("path"))
        last, frontier = frontier, stored(new, "bfs")
        if frontier.isEmpty():
            break
        level += 1
        seen = seen.unionByName(frontier)
        if level % 16 == 0:  # the plan must not grow with the levels
            seen = stored(seen, "bfs")
        if left is not None:
            left -= {tuple(r) for r in frontier.where(F.col("id").isin(wanted)).select("start", "id").collect()}  # at most all of ``left``
            if not left:
                break
    return seen


def shortest_lengths(adj: DataFrame, source: str, depth: int | None = None) -> DataFrame:
    """``id, hops, path``: nodes reachable from ``source``, within ``depth`` hops
    if given, with the lexicographically smallest of their shortest paths over
    ``adj`` (``u, v`` both ways)."""
    return _lengths(adj, [source], depth).drop("start")


def shortest_path(adj: DataFrame, source: str, target: str) -> DataFrame:
    """``position, id`` of one shortest path; a node alone reaches itself, and
    there is no row if there is no path."""
    spark = adj.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "position int, id string")
    return shortest_lengths(adj, source).where(F.col("id") == target).select(F.posexplode("path").alias("position", "id"))


def grounded_view(edges: DataFrame) -> DataFrame:
    """``u, v, id, relation``: undirected pairs with a grounded edge, represented by the smallest id."""
    g = edges.where((F.col("epistemic_state") == "grounded") & (F.col("source") != F.col("target")))
    return g.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.min("id").alias("id"), F.min_by("relation", "id").alias("relation"))


def explain_path(edges: DataFrame, wanted: list[str], most: int = 32) -> DataFrame:
    """``step, source, target, hops, path`` through the grounded view.

    Two nodes give the segment between them; more are ordered by nearest
    neighbour over the pairwise distances, from the smallest id. Unreachable
    steps have null hops. At most ``most`` nodes may be asked for.
    """
    wanted = sorted(set(wanted))
    if not 2 <= len(wanted) <= most:
        raise ValueError(f"from 2 to {most} nodes can be explained, not {len(wanted)}")
    spark = edges.sparkSession
    # The pairs of the grounded view, without the edges that stand for them.
    adj = stored(adjacency(edges.where(F.col("epistemic_state") == "grounded")), "grounded")
    known: dict[str, dict] = {w: {} for w in wanted}
    for r in _lengths(adj, wanted, wanted=wanted).where(F.col("id").isin(wanted)).collect():  # at most 32 rows a node
        known[r["start"]][r["id"]] = (r["hops"], r["path"])
    at, left, out = wanted[0], wanted[1:], []
    while left:
        to = min(left, key=lambda x: (known[at].get(x, (1 << 30, []))[0], x))
        hops, path = known[at].get(to, (None, None))
        out.append((len(out), at, to, hops, path))
        left.remove(to)
        at = to
    return spark.createDataFrame(out, "step int, source string, target string, hops int, path array<string>")


def specificity_gate(ranked: DataFrame, id_col: str = "id", top: int = 5) -> DataFrame:
    """One row: ``n, confound, churn, spread, gate_on`` from betweenness and specificity.

    The gate opens when the leaders by betweenness are vaguer than the average
    and weighting by specificity changes more than a fifth of them.
    """
    w = Window.orderBy(F.desc("betweenness"), id_col)
    v = Window.orderBy(F.desc(F.col("betweenness") * F.col("specificity")), id_col)
    lead = ranked.select(id_col, "specificity", F.row_number().over(w).alias("a")).where(F.col("a") <= top)
    weighted = ranked.select(id_col, F.row_number().over(v).alias("b")).where(F.col("b") <= top)
    both = lead.join(weighted, id_col, "full_outer")
    ends = both.agg(F.avg(F.when(F.col("a").isNotNull(), F.col("specificity"))).alias("lead"), (F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(0)) / (2 * F.count("a"))).alias("churn"))
    everyone = ranked.agg(F.count("*").alias("n"), F.avg("specificity").alias("mean"), (F.max("specificity") - F.min("specificity")).alias("spread"))
    out = everyone.crossJoin(F.broadcast(ends))
    confound = F.col("lead") < F.col("mean")
    gate = (F.col("n") >= 3) & confound & (F.col("churn") > 0.2) & (F.col("spread") > 1e-9)
    return out.select("n", confound.alias("confound"), "churn", "spread", gate.cast("int").alias("gate_on"))


def bridge_strength(gate_on: Column, weighted: Column | None = None) -> Column:
    """How much a node bridges: by weighted betweenness where the gate is on, else
    whether it is a structural bridge, and by a millionth of its degree."""
    honest = F.col("structural_bridge") + 1e-6 * F.col("degree")
    return honest if weighted is None else F.when(gate_on == 1, weighted).otherwise(honest)


def ranks(nodes: DataFrame, edges: DataFrame, spec: DataFrame) -> DataFrame:
    """The bundle of ranks for ``nodes`` (with ``community``): degree, bridge
    communities, betweenness, specificity, their product and the gate."""
    adj = stored(adjacency(edges), "adjacency")
    base = degree(nodes, adj).join(bridge_communities(nodes, adj), "id").join(betweenness(vertices(nodes, edges), adj), "id").join(spec, "id", "left")
    base = base.withColumn("specificity", F.coalesce("specificity", F.lit(1.0))).withColumn("spec_betweenness", F.col("betweenness") * F.col("specificity"))
    base = stored(base, "ranks")
    return base.crossJoin(F.broadcast(specificity_gate(base).select("gate_on")))


def rank_order() -> list[Column]:
    """Best first: by weighted betweenness and degree if the gate is on, else by
    bridge, betweenness and degree; ids break ties."""
    on = F.col("gate_on") == 1
    return [F.desc(F.when(on, F.col("spec_betweenness")).otherwise(F.col("structural_bridge").cast("double"))), F.desc(F.when(on, F.lit(0.0)).otherwise(F.col("betweenness"))), F.desc("degree"), F.asc("id")]


def real_community(c: str = "community") -> Column:
    """Is it a community, whether they are numbers or names? Null is none."""
    return F.coalesce(F.col(c).cast("string") != str(NO_COMMUNITY), F.lit(False))
