"""Structural link prediction: seven generators, their dispatch and agreement.

Inputs are ``nodes`` with ``id, community, degree, strength, specificity`` and
the symmetric live adjacency ``adj(u, v)``. All give ``kind, mechanism, source,
target, relation, score`` (compression: the community as target).
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..schema import FAILURE
from .checkpoint import stored
from .graph import community_stats, real_community
from .shared import counted, twins

ORDER = ("bridge", "seed", "compression", "regroup", "transplant", "ensemble", "periphery")
DEFAULT = ("bridge", "seed", "compression")
RELATION = "bridges"


def _shape(df: DataFrame, mechanism: str, kind: str = "edge", relation: str = RELATION) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(mechanism).alias("mechanism"), "source", "target", (F.col("relation") if "relation" in df.columns else F.lit(relation)).alias("relation"), F.round(F.col("score").cast("double"), 6).alias("score"))


def not_failed(cand: DataFrame, edges: DataFrame) -> DataFrame:
    """Without candidates that failed or were rejected before, either way round."""
    f = edges.where(F.col("epistemic_state").isin(*FAILURE)).select("source", "relation", "target")
    both = f.unionAll(f.select("target", "relation", "source")).distinct()
    return cand.join(both, ["source", "relation", "target"], "left_anti")


def top(cand: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each mechanism; partial top-k before the exchange."""
    w = Window.partitionBy("mechanism").orderBy(F.desc("score"), "source", "relation", "target")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def wedges(adj: DataFrame) -> DataFrame:
    """``u, v, shared``: pairs u < v with their number of common neighbours, an
    equi-join on the middle node with partial sums before the exchange."""
    a, b = adj.toDF("u", "m"), adj.toDF("v", "m")
    return a.join(b, "m").where("u < v").groupBy("u", "v").agg(F.count("*").alias("shared"))


def bridge(nodes: DataFrame, adj: DataFrame, k: int = 10) -> DataFrame:
    """Strong nodes of different communities that are not adjacent.

    Only the strongest can be among the best k: for every community keep its
    k + (its strongest's neighbours) bound away by rank, so the candidate set
    is small however many nodes there are. A pair among the k best has both
    ends within the best k + max-degree-among-them of their community; ranks
    beyond k are only needed where nearer pairs are adjacent, so the number of
    leaders doubles until the k-th score beats anything left out.
    """
    strong = stored(nodes.where("strength > 0").select("id", "community", "strength"), "strong")
    n, leaders = strong.count(), max(64, 4 * k)
    while True:
        lead = strong.orderBy(F.desc("strength"), "id").limit(leaders)
        a, b = lead.toDF("source", "ca", "sa"), lead.toDF("target", "cb", "sb")
        pairs = stored(a.join(F.broadcast(b), F.col("source") < F.col("target")).where("ca <> cb"), "bridge-pairs")
        out = stored(top(_shape(_apart(pairs, adj).withColumn("score", F.col("sa") + F.col("sb")), "bridge"), k), "bridge")
        if leaders >= n:
            return out
        ends = lead.agg(F.max("strength").alias("hi"), F.min("strength").alias("lo")).first()
        rows = out.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if rows["n"] == k and rows["s"] > round(ends["hi"] + ends["lo"], 6):
            return out
        leaders *= 4


def seed(adj: DataFrame, edges: DataFrame | None = None, k: int | None = None, also: DataFrame | None = None) -> DataFrame:
    """Non-adjacent pairs with more common neighbours than pairs at distance two
    have on average; others share none, so no search is needed. With ``k`` only
    the best k, ties by ids, and those among the few pairs ``also`` (``source,
    target``), without a row for each pair."""
    if k is None:
        far = wedges(adj).join(adj.toDF("u", "v"), ["u", "v"], "left_anti")
        mean = far.agg(F.avg("shared").alias("mean"))
    else:
        gone = None if edges is None else edges.where(F.col("epistemic_state").isin(*FAILURE) & (F.col("relation") == RELATION)).select("source", "target").toDF("u", "v")
        sums, far = counted(adj, k, gone)
        mean = sums.where("far").agg((F.sum(F.col("shared") * F.col("pairs")) / F.sum("pairs")).alias("mean"))
        if also is not None:
            asked = also.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where("source <> target").distinct()
            asked = _apart(stored(asked, "asked"), adj)
            met = asked.join(adj.toDF("source", "m"), "source").join(adj.toDF("target", "m"), ["target", "m"])
            far = far.unionByName(met.groupBy(F.col("source").alias("u"), F.col("target").alias("v")).agg(F.count("*").alias("shared"))).dropDuplicates(["u", "v"])
    out = far.crossJoin(F.broadcast(mean)).select(F.col("u").alias("source"), F.col("v").alias("target"), (F.col("shared") - F.col("mean")).alias("score")).where("score > 0")
    out = _shape(out, "seed")
    return out if edges is None else not_failed(out, edges)


def compression(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Communities whose internal edges cost more bits one by one than as one
    node with its members, and that are no vaguer than the average."""
    n, mean = nodes.agg(F.count("*").alias("n"), F.avg("specificity").alias("mean")).first()
    stats = community_stats(nodes, adj).join(nodes.groupBy("community").agg(F.avg("specificity").alias("spec"), F.min("id").alias("first")), "community")
    bits = F.log2(F.lit(float(max(n, 2))))
    saved = 2 * F.col("internal") * bits - (F.col("members") + 1) * bits
    out = stats.where(real_community() & (F.col("members") >= 3) & (saved > 0) & (F.col("spec") >= (mean or 0.0) - 1e-12))
    return _shape(out.select(F.col("first").alias("source"), F.concat(F.lit("community-"), "community").alias("target"), saved.alias("score")), "compression", "node", "collapses_into")


def _apart(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """``pairs`` (a table) that are not adjacent. Where they are few, they go to the
    adjacency, which stays where it is."""
    met = adj.toDF("source", "target").join(pairs.select("source", "target"), ["source", "target"], "left_semi")
    return pairs.join(met, ["source", "target"], "left_anti")


def regroup(nodes: DataFrame, adj: DataFrame, other: DataFrame, k: int = 10) -> DataFrame:
    """Pairs together now, apart in another partition ``other(id, community)``.

    A node of a (community, other community) cell is among the k best partners of
    another node only if fewer than k ahead of it in its cell are not adjacent to
    that node. So the first k of the cells meet, and a node meets as many more of a
    cell as it has neighbours there; these only where they can reach the k best
    of the first. Both are in proportion to the nodes and edges. Ahead is who is
    stronger by more than rounding can hide, or as strong with a smaller id.
    """
    both = nodes.where(real_community()).select("id", "community", "strength").join(other.select("id", F.col("community").alias("moved")), "id")
    both = both.withColumn("_q", F.floor(F.col("strength") * 1e6).cast("long"))
    stronger = F.count("*").over(Window.partitionBy("community", "moved").orderBy(F.desc("_q")).rangeBetween(Window.unboundedPreceding, -3))
    earlier = F.row_number().over(Window.partitionBy("community", "moved", "strength").orderBy("id"))
    ranked = stored(both.withColumn("_r", stronger + earlier).drop("_q"), "regroup-cells")
    score = F.round(F.col("sa") + F.col("sb") + 1e-3, 6)
    side = lambda df, of, s, m: df.select(F.col("id").alias(of), "community", F.col("strength").alias(s), F.col("moved").alias(m), F.col("_r").alias(f"_{of}"))
    two = lambda df: (side(df, "source", "sa", "ma"), side(df, "target", "sb", "mb"))

    def best(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select("source", "target", score.alias("score")), "regroup-pairs")
        return top(_shape(_apart(pairs, adj), "regroup"), k)

    a, b = two(ranked.where(F.col("_r") <= k))
    first = stored(best(a.join(b, "community").where("source < target and ma <> mb")), "regroup")
    found = first.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    good = score >= (found["least"] if found["n"] >= k else float("-inf"))
    most = ranked.groupBy("community").agg(F.max("strength").alias("sb"))
    hot = stored(ranked.withColumn("sa", F.col("strength")).join(most, "community").where(good).select(*ranked.columns), "regroup-hot")
    a, b = two(hot)
    tied = adj.toDF("source", "target").join(a, "source").join(b.withColumnRenamed("community", "cb"), "target").where("community = cb and ma <> mb").where(good)
    more = stored(tied.groupBy("source", "community", "sa", "mb").agg(F.count("*").alias("n")), "regroup-more")
    more = more.join(b, ["community", "mb"]).where((F.col("_target") <= F.col("n") + k) & good)
    ends = more.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "sa", "sb")
    out = first.drop("rank").unionByName(best(ends).drop("rank")).dropDuplicates(["source", "target"])
    return stored(top(out, k), "regroup")


def transplant(nodes: DataFrame, adj: DataFrame, edges: DataFrame) -> DataFrame:
    """The dominant relation of the largest hub, to the members of the community
    that is most specific for its density."""
    real = nodes.where(real_community())
    hub = real.orderBy(F.desc("degree"), F.desc("id")).limit(1).select(F.col("id").alias("source"), F.col("degree").alias("hd"), F.col("community").alias("hc"))
    rel = edges.where("relation <> ''").join(F.broadcast(hub), "source").groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(1).select("relation")
    stats = community_stats(real, adj).join(real.groupBy("community").agg(F.avg("specificity").alias("spec")), "community")
    density = F.when(F.col("members") > 1, 2 * F.col("internal") / (F.col("members") * (F.col("members") - 1))).otherwise(0.0)
    absorb = F.round(F.col("spec") / (density + 1e-6), 6)
    goal = stats.join(F.broadcast(hub.select("hc")), stats["community"] != F.col("hc")).select(F.col("community").alias("tc"), absorb.alias("absorb")).orderBy(F.desc("absorb"), F.desc("tc")).limit(1)
    to = real.join(F.broadcast(goal), real["community"] == F.col("tc")).select(F.col("id").alias("target"), "degree", "absorb")
    out = to.crossJoin(F.broadcast(hub)).crossJoin(F.broadcast(rel)).where("source <> target").withColumn("score", F.round(F.col("hd") * F.col("absorb") * (F.col("degree") + 1), 2))
    return _shape(out.join(adj.toDF("source", "target"), ["source", "target"], "left_anti"), "transplant")


def ensemble(adj: DataFrame, known: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs adjacent in a second construction ``second(u, v)`` but not here,
    both ends known here."""
    pairs = second.select(F.least("u", "v").alias("source"), F.greatest("u", "v").alias("target")).where("source <> target").distinct()
    out = pairs.join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi").join(adj.toDF("source", "target"), ["source", "target"], "left_anti")
    return _shape(out.withColumn("score", F.lit(1.0)), "ensemble")


def periphery(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Nodes of low degree (up to the first quartile of those above zero), each
    with the best anchor it shares neighbours with.

    Twins, nodes with the same neighbours, have the same anchors but for
    themselves, so classes of twins meet instead of nodes: of each only the best
    two members can be anyone's anchor, and a class keeps its best two anchors.
    """
    cut = nodes.where("degree > 0").agg(F.expr("percentile_disc(0.25) within group (order by degree)").alias("cut"))
    low = nodes.where("degree > 0").crossJoin(F.broadcast(cut)).where(F.col("degree") <= F.col("cut")).select(F.col("id").alias("u"), "degree")
    of = twins(adj).select("id", F.col("first").alias("c"))
    low = stored(low.join(of.withColumnRenamed("id", "u"), "u"), "low")
    one = of.where("id = c").select("c")
    ends = stored(adj.join(one.toDF("u"), "u"), "class-ends")  # of one member of each class
    a, b = ends.toDF("cu", "m").join(low.select(F.col("c").alias("cu")).distinct(), "cu"), ends.toDF("cv", "m")
    shared = a.join(b, "m").groupBy("cu", "cv").agg(F.count("*").alias("shared")).join(ends.toDF("cu", "cv"), ["cu", "cv"], "left_anti")
    order = F.struct((-F.col("specificity")).alias("p"), F.col("id").alias("v"))
    in_class = Window.partitionBy("cv").orderBy("o")
    members = nodes.select("id", "specificity").join(of.withColumnRenamed("c", "cv"), "id").select("cv", order.alias("o")).withColumn("_k", F.row_number().over(in_class)).where("_k <= 2")
    anchor = F.struct((-F.col("shared")).alias("s"), F.col("o.p").alias("p"), F.col("o.v").alias("v"))
    best = shared.join(members, "cv").select(F.col("cu").alias("c"), anchor.alias("b"))
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("c").orderBy("b"))).where("_k <= 2").drop("_k")
    mine = low.join(best, "c").where("b.v <> u").groupBy("u").agg(F.first("degree").alias("degree"), F.min("b").alias("b"))
    out = mine.select(F.col("u").alias("source"), F.col("b.v").alias("target"), ((1 - F.col("b.s")) / (F.col("degree") + 1)).alias("score"))
    return _shape(out, "periphery")


def agreement(cand: DataFrame) -> DataFrame:
    """``cand`` with ``convergence``: how many mechanisms propose the pair."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    keyed = cand.withColumn("_a", a).withColumn("_b", b)
    n = keyed.groupBy("_a", "_b", "relation").agg(F.countDistinct("mechanism").alias("convergence"))
    return keyed.join(n, ["_a", "_b", "relation"]).drop("_a", "_b")


def first_of_each(cand: DataFrame) -> DataFrame:
    """One row per candidate, of the mechanism that runs first; ``bridges`` has no direction."""
    sym = F.col("relation") == RELATION
    a = F.when(sym, F.least("source", "target")).otherwise(F.col("source"))
    b = F.when(sym, F.greatest("source", "target")).otherwise(F.col("target"))
    position = F.array_position(F.array(*[F.lit(m) for m in ORDER]), F.col("mechanism"))
    w = Window.partitionBy("_a", "_b", "relation").orderBy("_p", "rank")
    return cand.withColumns({"_a": a, "_b": b, "_p": position}).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_a", "_b", "_p", "_k")


def run(makers: dict[str, Callable[..., DataFrame]], mechanism: str | None, k: int, edges: DataFrame) -> DataFrame:
    """The candidates of one mechanism, of all, or of the default three. A maker of
    seeds that takes an argument gets the best pairs of the others: it makes the k
    best seeds and those among these pairs, as agreement asks for no more."""
    names = ORDER if mechanism == "all" else (mechanism,) if mechanism in ORDER else DEFAULT
    missing = [name for name in names if name not in makers]
    if missing:
        raise ValueError(f"no maker for {', '.join(missing)}")
    last = "seed" in names and len(signature(makers["seed"]).parameters) > 0
    out = None
    for name in names:
        if not (last and name == "seed"):
            out = makers[name]() if out is None else out.unionByName(makers[name](), allowMissingColumns=True)
    if last and out is None:
        out = makers["seed"](edges.where("false").select("source", "target"))
    elif last:
        out = stored(not_failed(out.drop("rank"), edges), "candidates")
        out = out.unionByName(makers["seed"](top(out, k).where(F.col("relation") == RELATION).select("source", "target")), allowMissingColumns=True)
    return first_of_each(top(agreement(not_failed(out.drop("rank"), edges)), k))


#: Candidates that are put into an order of diversity.
ORDERED = 200


def advisory_order(cand: DataFrame) -> DataFrame:
    """``cand`` (as ``run`` gives it) with ``position``: the best ``ORDERED`` by score in
    the order in which a determinantal process over their embedded texts picks
    them, all others after them by score. Nothing is dropped and no score changes.
    """
    import numpy as np

    from .advise import candidate_text
    from .vector import greedy_dpp, hash_embedding

    spark = cand.sparkSession
    shown = cand if "label" in cand.columns else cand.withColumn("label", F.lit(None).cast("string"))
    order = [F.desc("score"), F.asc("mechanism"), F.asc("source"), F.asc("target")]
    ranked = stored(shown.withColumn("_r", F.row_number().over(Window.orderBy(*order))), "advisory")
    best = ranked.where(F.col("_r") <= ORDERED).select(F.col("_r").cast("long").alias("id"), candidate_text().alias("said"))
    rows = hash_embedding(best, "id", "said").orderBy("id").collect()  # at most ORDERED rows
    if not rows:
        return ranked.withColumn("position", F.col("_r")).drop("_r", *set(shown.columns) - set(cand.columns))
    x = np.array([r["v"] for r in rows])
    picks = [int(i) for i in greedy_dpp(x, np.ones(len(x)), len(x))]
    picks += [i for i in range(len(rows)) if i not in set(picks)]
    place = spark.createDataFrame([(rows[i]["id"], k + 1) for k, i in enumerate(picks)], "_r long, position long")
    out = ranked.withColumn("_r", F.col("_r").cast("long")).join(F.broadcast(place), "_r", "left")
    return out.withColumn("position", F.coalesce("position", "_r")).drop("_r", *set(shown.columns) - set(cand.columns))


def collapse(nodes: DataFrame, members: list[str] | None = None, of: str | None = None) -> DataFrame:
    """Edges that collapse the named members, the community of a node, or the
    largest community into one node named by its first member and their hash."""
    if members:
        chosen = nodes.where(F.col("id").isin(members)).select("id").distinct()
    else:
        real = nodes.where(real_community())
        pick = real.where(F.col("id") == of).select("community") if of else real.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(1).select("community")
        chosen = real.join(F.broadcast(pick), "community").select("id")
    # The members' list makes the name; only their hashes are folded, whatever their number.
    word = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 15), 16, 10).cast("long")
    said = F.concat_ws("|", F.bit_xor(word), F.count("*")).cast("binary")
    name = chosen.agg(F.concat(F.lit("compression-"), slug(F.min("id")), F.lit("-"), F.substring(F.md5(said), 1, 8)).alias("target"))
    return chosen.crossJoin(F.broadcast(name)).select(F.col("id").alias("source"), F.lit("collapses_into").alias("relation"), "target")


def explode(nodes: DataFrame, edges: DataFrame, of: str | None = None, k: int = 5) -> DataFrame:
    """A facet per distinct relation that leaves the node (two aspects if none)."""
    at = nodes.where(F.col("id") == of) if of else nodes.orderBy(F.desc("degree"), F.desc("id")).limit(1)
    node = at.select(F.col("id").alias("source"))
    rel = edges.join(F.broadcast(node), "source").groupBy("source", "relation").count().orderBy("relation").limit(k)
    facets = rel.select("source", F.concat("source", F.lit("-facet-"), "relation").alias("target"))
    none = node.join(rel, "source", "left_anti").select("source", F.explode(F.array(F.lit("aspect-1"), F.lit("aspect-2"))).alias("a")).select("source", F.concat("source", F.lit("-"), "a"))
    return facets.unionAll(none)


def open_up(nodes: DataFrame, label: str, k: int = 2) -> DataFrame:
    """A new primitive bridged to the k nodes of highest degree."""
    return nodes.orderBy(F.desc("degree"), F.desc("id")).limit(k).select(F.lit(label).alias("source"), F.lit(RELATION).alias("relation"), F.col("id").alias("target"))
