"""Advisories around the reads: context whole, hubs, bridges, coverage, mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FAILURE, is_live
from .checkpoint import stored
from .graph import rank_order
from .retrieve import MAX_BUDGET, clamp, matches, priority

# Rows of the bridge advisories, rows of the verdict advisories, characters of a token.
BRIDGES, CAPPED, TOKEN = 10, 50, 4
COLUMNS = ("id", "source", "target", "relation", "provenance", "authored_by", "epistemic_state", "span", "confidence", "confidence_score")
TERM_COLUMNS = ["source", "target", "relation", "span"]


def json_text(columns: tuple[str, ...]) -> Column:
    """A row as JSON with a blank after commas and colons; what is not ASCII is
    escaped, six characters for each UTF-16 unit, as its length matters here."""

    def value(c: str) -> Column:
        s = F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"})
        return F.substring(s, F.lit(6), F.length(s) - 6)

    inner = F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), value(c)) for c in columns])
    return F.concat(F.lit("{"), inner, F.lit("}"))


def json_length(columns: tuple[str, ...]) -> Column:
    text = json_text(columns)
    plain = F.regexp_replace(text, r"[^\x00-\x7f]", "")
    # Beyond the first plane a character is two units, of six characters each.
    far = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(plain) + 6 * (F.length(text) - F.length(plain) + far)


def json_tokens(columns: tuple[str, ...] = COLUMNS) -> Column:
    """A row's token estimate: a quarter of its JSON's characters, one at least."""
    return F.greatest(F.lit(1), F.floor(json_length(columns) / TOKEN)).cast("long")


def _fill(lane: DataFrame, order: list[Column], cap: Column, most: int) -> DataFrame:
    """The longest prefix whose tokens fit ``cap``. A row has one token at least,
    so the running sum never sees more than ``most + 1`` rows."""
    top = lane.withColumn("tokens", json_tokens()).orderBy(*order).limit(most + 1)
    o = Window.orderBy(*order)
    run = top.withColumn("position", F.row_number().over(o)).withColumn("used", F.sum("tokens").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("used") <= cap)


def context(edges: DataFrame, query: str = "", budget: int = 2000) -> DataFrame:
    """``lane, position, id, tokens, used``: live items that are no hypotheses,
    by priority, then in what they leave of the budget unverified hypotheses by
    confidence. ``edges`` has the columns of ``COLUMNS``. One plan, no action:
    the second lane's cap is a scalar of the first."""
    budget = clamp(int(budget), 0, MAX_BUDGET)
    seen = edges.where(matches(query, TERM_COLUMNS)) if query else edges
    items = _fill(seen.where(is_live() & (F.col("provenance") != "hypothesized")), priority(), F.lit(budget), budget)
    left = budget - F.coalesce(items.agg(F.max("used").alias("x")).scalar(), F.lit(0))
    ideas = seen.where((F.col("provenance") == "hypothesized") & (F.col("epistemic_state") == "unverified"))
    ideas = _fill(ideas, [F.desc_nulls_last("confidence_score"), F.asc("id")], left, budget)
    pick = lambda df, lane: df.select(F.lit(lane).alias("lane"), "position", "id", "tokens", "used")
    return pick(items, "items").unionByName(pick(ideas, "hypotheses"))


def structural_bridges(ranked: DataFrame, limit: int = BRIDGES) -> DataFrame:
    """The structural bridges of the highest degree: ``position, id, label, degree, bridge_communities``."""
    top = ranked.where("bridge_communities >= 2").orderBy(F.desc("degree"), "id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("degree"), "id")).alias("position"), "id", "label", "degree", "bridge_communities")


def bridge_metric(ranked: DataFrame, gate_on: int, limit: int = BRIDGES) -> DataFrame:
    """The best nodes by weighted betweenness and degree where the gate is on, else by
    structural bridge, betweenness and degree; ids break ties."""
    keys = ["spec_betweenness", "degree"] if gate_on else ["structural_bridge", "betweenness", "degree"]
    order = [*[F.desc(k) for k in keys], F.asc("id")]
    top = ranked.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"), "id", "label", "degree", "betweenness", "spec_betweenness", "specificity")


def capped(rows: DataFrame, order: list[Column], most: int = CAPPED) -> DataFrame:
    """The first ``most`` rows, each with the true ``total``; a partial top-k and a
    count, both of which combine before they shuffle."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))


def answer(edges: DataFrame, ranked: DataFrame, stale: DataFrame, re_examinable: DataFrame, query: str = "", budget: int = 2000) -> DataFrame:
    """The whole answer of a read as ``block, position, id, label, value, total``:
    ``items`` and ``hypotheses`` with their tokens, ``approx_tokens`` of both,
    ``failures`` (all edges that failed or were rejected, whatever was asked),
    ``structural_bridge`` nodes by degree, the ``gate``, the ``bridge_metric`` nodes
    it ranks, and ``stale`` and ``re_examinable`` ids, each with the true total, which is 0 in other blocks.

    ``edges`` is as for ``context``; ``ranked`` as ``graph.ranks`` gives it; ``stale`` and
    ``re_examinable`` have ``id``, once each. The advisories don't count as tokens,
    so their lengths are fixed; none of them depends on the query.
    """
    lanes = stored(context(edges, query, budget), "context")
    none = F.lit(None)

    def rows(df: DataFrame, block: Column, position: Column, id_: Column = none, label: Column = none, value: Column = none, total: Column = F.lit(0)) -> DataFrame:
        return df.select(block.alias("block"), position.cast("int").alias("position"), id_.cast("string").alias("id"), label.cast("string").alias("label"), value.cast("double").alias("value"), total.cast("long").alias("total"))

    one, col = F.lit(1), F.col
    out = rows(lanes, col("lane"), col("position"), col("id"), value=col("tokens"))
    spent = lanes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"))
    failures = edges.agg(F.count_if(col("epistemic_state").isin(*FAILURE)).alias("n"))
    gate = ranked.agg(F.max("gate_on").alias("n"))
    for name, df in (("approx_tokens", spent), ("failures", failures), ("gate", gate)):
        out = out.unionByName(rows(df, F.lit(name), one, value=col("n")))
    out = out.unionByName(rows(structural_bridges(ranked), F.lit("structural_bridge"), col("position"), col("id"), col("label"), col("degree")))
    best = ranked.orderBy(*rank_order()).limit(BRIDGES).withColumn("position", F.row_number().over(Window.orderBy(*rank_order())))
    metric = F.when(col("gate_on") == 1, col("spec_betweenness")).otherwise(col("betweenness"))
    out = out.unionByName(rows(best, F.lit("bridge_metric"), col("position"), col("id"), col("label"), metric))
    for name, df in (("stale", stale), ("re_examinable", re_examinable)):
        few = capped(df.select("id"), [F.asc("id")]).withColumn("position", F.row_number().over(Window.orderBy("id")))
        out = out.unionByName(rows(few, F.lit(name), col("position"), col("id"), total=col("total")))
    return out


def stale_verdicts(edges: DataFrame) -> DataFrame:
    """``edge_id, reason``: grounded or failed edges of a span that no longer
    verifies. ``edges`` has ``verified``. A second look at prior flags is the
    same filter over the edges flagged."""
    gone = F.col("epistemic_state").isin("grounded", "failed") & (F.col("provenance") == "span-present") & ~F.coalesce("verified", F.lit(False))
    return edges.where(gone).select(F.col("id").alias("edge_id"), F.lit("span-no-longer-in-source").alias("reason"))


def refiltered(prior: DataFrame, edges: DataFrame) -> DataFrame:
    """Prior flags that still hold: those of edges that are there and still stale."""
    return stale_verdicts(edges).join(prior.select("edge_id").distinct(), "edge_id", "left_semi")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, state, n`` of nodes and edges by state, with the unverified of each as ``queue``."""
    one = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), F.col("epistemic_state").alias("state")).agg(F.count("*").alias("n"))
    by = one(nodes, "node").unionAll(one(edges, "edge"))
    queue = by.groupBy("kind").agg(F.sum(F.when(F.col("state") == "unverified", F.col("n")).otherwise(0)).alias("n"))
    return by.unionAll(queue.select("kind", F.lit("queue").alias("state"), "n"))


def _ends(edges: DataFrame) -> DataFrame:
    """Each edge at both its ends; a loop at one alone."""
    cols = ["epistemic_state"]
    return edges.select(F.col("source").alias("id"), *cols).unionAll(edges.where("source <> target").select(F.col("target").alias("id"), *cols))


def grounded_hubs(nodes: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """``position, id, label, n``: the nodes with most ends of grounded edges (a loop
    has two), or of any edges where none is grounded; ids break ties."""
    both = edges.select(F.col("source").alias("id"), "epistemic_state").unionAll(edges.select("target", "epistemic_state"))
    n = both.groupBy("id").agg(F.count_if(F.col("epistemic_state") == "grounded").alias("g"), F.count("*").alias("all"))
    some = n.agg(F.max("g").alias("x")).scalar() > 0
    n = n.withColumn("n", F.when(some, F.col("g")).otherwise(F.col("all"))).where("n > 0")
    top = n.orderBy(F.desc("n"), "id").limit(k)
    labelled = top.join(nodes.select("id", "label"), "id", "left")
    return labelled.select(F.row_number().over(Window.orderBy(F.desc("n"), "id")).alias("position"), "id", F.coalesce("label", "id").alias("label"), "n")


def grounded_mix(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, target, grounded_mix``: the share of grounded edges among those
    at a candidate's two ends, each end's counted. Sums per node are joined,
    never the edges themselves."""
    per = _ends(edges).groupBy("id").agg(F.count_if(F.col("epistemic_state") == "grounded").alias("g"), F.count("*").alias("n"))
    a, b = per.toDF("source", "ga", "na"), per.toDF("target", "gb", "nb")
    j = candidates.select("source", "target").distinct().join(a, "source", "left").join(b, "target", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    total = z("na") + z("nb")
    return j.select("source", "target", F.round(F.when(total > 0, (z("ga") + z("gb")) / total).otherwise(0.0), 4).alias("grounded_mix"))


def candidate_text(c: str = "") -> Column:
    """What of a candidate is embedded: its label, or its edge, and the mechanism."""
    t = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    node = (F.col("kind") == "node") | (t("label") != "")
    said = F.concat(F.lit("("), t("mechanism"), F.lit(")"))
    return F.trim(F.when(node, F.concat_ws(" ", t("label"), said)).otherwise(F.concat_ws(" ", t("source"), t("relation"), t("target"), said)))


def pair_specificity(candidates: DataFrame, spec: DataFrame) -> DataFrame:
    """``candidates`` with ``specificity``: the lesser of the two ends', 1 where unknown."""
    a, b = spec.select(F.col("id").alias("source"), F.col("specificity").alias("_a")), spec.select(F.col("id").alias("target"), F.col("specificity").alias("_b"))
    j = candidates.join(a, "source", "left").join(b, "target", "left")
    return j.withColumn("specificity", F.least(F.coalesce("_a", F.lit(1.0)), F.coalesce("_b", F.lit(1.0)))).drop("_a", "_b")


def failure_memory(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """``candidates`` (with ``id, reverse``) with ``known_failure``: one of the two
    ids failed or was rejected. Both ids meet the failures in one join."""
    f = edges.where(F.col("epistemic_state").isin(*FAILURE)).select(F.col("id").alias("_f")).distinct()
    both = candidates.select("id", F.explode(F.array("id", "reverse")).alias("_f"))
    hit = both.join(f, "_f").select("id").distinct().withColumn("known_failure", F.lit(True))
    return candidates.join(hit, "id", "left").withColumn("known_failure", F.coalesce("known_failure", F.lit(False)))


def markdown_safe(c: Column) -> Column:
    """Text that cannot open Markdown or HTML: line breaks to blanks, marks escaped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), r"([\\`*_\[\]<>|#])", r"\\$1")


def cut(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots where there were more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(c)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
