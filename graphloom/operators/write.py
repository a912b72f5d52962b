"""The write path: dispositions, merges, verdicts and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_id, edge_id_of_slugs, slug, slug_signature
from ..schema import CONFIDENCE, FAILURE, GROUNDABLE, PROVENANCE, STATES, clamped_confidence, coerced

EDGE_FLOOR, NODE_FLOOR, FLOOD_FACTOR, MIN_SPAN = 64, 512, 20, 4
WORD_CHAR = r"[\p{L}\p{N}]"


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in pairs])


def guard(df: DataFrame, node: bool = False) -> DataFrame:
    """Claims that a writer may not make are taken back: any state but
    unverified, human authorship, and deterministic authorship unless
    hypothesized. Adds ``forged`` with the reasons, blank if none."""
    state, author = F.col("epistemic_state"), F.col("authored_by")
    forged = _reasons((state != "unverified", "forged-verdict-stripped"), (author == "human", "human-claim-stripped"), ((author == "deterministic") & (F.col("provenance") != "hypothesized"), "deterministic-claim-stripped"))
    keep = (author == "deterministic") & (F.col("provenance") == "hypothesized")
    return df.withColumn("forged", forged).withColumn("authored_by", F.when(keep, author).otherwise("agent")).withColumn("epistemic_state", F.lit("unverified"))


def flood(df: DataFrame, baseline: Column, floor: int, existing: str = "known") -> DataFrame:
    """``df`` (rows ``ord, id, reason``) with first occurrences told from
    repeats, and net-new ids beyond max(floor, 20 * baseline) rejected.

    Only rows that would be written take part. Payloads are one writer's batch,
    so their running count is small; it is still taken after the filter.
    """
    fits = F.col("reason").isNull()
    df = df.repartition("payload")  # which all three windows can use
    first = F.row_number().over(Window.partitionBy("payload", "id", fits).orderBy("ord"))
    marked = df.withColumn("_first", F.when(fits, first))
    new = (fits & (F.col("_first") == 1) & ~F.col(existing)).cast("int")
    count = F.sum(new).over(Window.partitionBy("payload").orderBy("ord"))
    budget = F.greatest(F.lit(floor), baseline * FLOOD_FACTOR)
    over = (new == 1) & (count > budget)
    out = marked.withColumn("_over", over)
    lost = F.max(F.col("_over").cast("int")).over(Window.partitionBy("payload", "id"))
    repeat = fits & (F.col("_first") > 1) & (lost == 0)
    reject = fits & (lost == 1)
    return out.withColumn("deduped", repeat).withColumn("reason", F.when(reject, "rate-limited-flood").otherwise(F.col("reason"))).drop("_first", "_over")


def edge_dispositions(payload: DataFrame, pack: list[str], failed: DataFrame, verdicts: DataFrame, existing: DataFrame, baseline: int) -> DataFrame:
    """Payload edges (``payload, ord, source, relation, target, provenance,
    authored_by, epistemic_state, confidence_score, span, span_named,
    span_found``) with ``id, disposition, reason``.

    The order of the checks is that of the boundary: empty endpoints, forged
    claims, then for hypotheses the failure memory both ways, else the span and
    the failures and verdicts one way, then the vocabulary, then flooding.
    """
    e = payload.withColumn("provenance", coerced(F.col("provenance"), PROVENANCE, "inferred")).withColumn("confidence_score", clamped_confidence(F.col("confidence_score")))
    e = guard(e.withColumn("epistemic_state", coerced(F.col("epistemic_state"), STATES, "unverified")))
    e = e.select("*", F.struct(slug("source").alias("s"), slug("relation").alias("r"), slug("target").alias("t")).alias("_x"))
    e = e.withColumn("id", edge_id_of_slugs("_x.s", "_x.r", "_x.t")).withColumn("reverse", edge_id_of_slugs("_x.t", "_x.r", "_x.s")).drop("_x")
    # One table of what is known of an id, joined once for it; reversed ids matter to hypotheses alone.
    mark = lambda df, name: df.select("id", *[F.lit(True if n == name else None).cast("boolean").alias(n) for n in ("_f", "_v", "known")])
    known = mark(failed, "_f").unionAll(mark(verdicts, "_v")).unionAll(mark(existing, "known"))
    known = known.groupBy("id").agg(*[F.max(n).alias(n) for n in ("_f", "_v", "known")])
    back = failed.select(F.col("id").alias("reverse")).distinct().withColumn("_r", F.lit(True))
    e = e.join(known, "id", "left").join(back, "reverse", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    hyp = F.col("provenance") == "hypothesized"
    empty = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(WORD_CHAR)
    blank = F.trim(F.coalesce(F.col("span"), F.lit(""))) == ""
    short = F.length(F.regexp_replace(F.coalesce(F.col("span"), F.lit("")), r"\s", "")) < MIN_SPAN
    reason = (
        F.when(empty("source"), "empty-source").when(empty("relation"), "empty-relation").when(empty("target"), "empty-target")
        .when(hyp & (yes("_f") | yes("_r")), "collapses-into-known-failure")
        .when(~hyp & blank, "no-supporting-span")
        .when(~hyp & ~F.col("span_found") & F.col("span_named"), "span-not-in-named-source")
        .when(~hyp & ~F.col("span_found"), "span-not-in-source")
        .when(~hyp & short, "span-too-short")
        .when(~hyp & yes("_f"), "collapses-into-known-failure")
        .when(~hyp & yes("_v"), "collapses-into-known-verdict")
        .when(~F.col("relation").isin(pack), "undeclared-edge-type")
    )
    e = flood(e.withColumn("reason", reason).withColumn("known", yes("known")), F.lit(baseline), EDGE_FLOOR)
    return _disposed(e)


def _disposed(e: DataFrame) -> DataFrame:
    quarantined = F.col("reason").isin("collapses-into-known-failure", "collapses-into-known-verdict", "undeclared-edge-type", "undeclared-node-type")
    disposition = F.when(quarantined, "QUARANTINED").when(F.col("reason").isNotNull(), "REJECTED").when(F.col("forged") != "", "DEMOTED").otherwise("ACCEPTED")
    said = F.concat_ws("; ", F.col("reason"), F.when(F.col("forged") != "", F.col("forged")), F.when(F.col("deduped"), F.lit("deduped")))
    return e.withColumn("disposition", disposition).withColumn("reason", said)


def node_dispositions(payload: DataFrame, pack: list[str], existing: DataFrame, baseline: int) -> DataFrame:
    """Payload nodes (``payload, ord, label, node_type, provenance,
    authored_by, epistemic_state`` and, if they have one, ``id``) with ``id,
    disposition, reason`` and ``collision``: another label of this payload has the
    same id. The id is the slug of the one given, else of the label."""
    n = guard(payload.withColumn("provenance", coerced(F.col("provenance"), PROVENANCE, "span-present")))
    label = F.coalesce("label", F.lit(""))
    said = F.coalesce(F.when(F.trim("id") != "", F.col("id")), label) if "id" in n.columns else label
    n = n.withColumn("_said", said).withColumn("id", slug("_said")).withColumn("sig", slug_signature("label"))
    first = F.first("sig").over(Window.partitionBy("payload", "id").orderBy("ord"))
    n = n.withColumn("collision", F.col("sig") != first).join(existing.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    reason = F.when(~F.col("_said").rlike(WORD_CHAR), "empty-label").when(~F.col("node_type").isin(pack), "undeclared-node-type")
    n = flood(n.withColumn("reason", reason).withColumn("known", F.coalesce("known", F.lit(False))).drop("_said"), F.lit(baseline), NODE_FLOOR)
    return _disposed(n)


def slug_collisions(ids: DataFrame) -> DataFrame:
    """Slugs that two distinct ids share; a batch with any is refused."""
    return ids.select(slug("id").alias("slug"), "id").distinct().groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming edges win, but a verdict is never overwritten by an unverified
    row, and of several incoming rows the last counts."""
    last = incoming.groupBy("id").agg(F.max_by(F.struct("epistemic_state", "provenance", "confidence_score"), "ord").alias("n"))
    old = existing.select("id", F.struct("epistemic_state", "provenance", "confidence_score").alias("o"))
    both = old.join(last, "id", "full_outer")
    keep = F.col("o").isNotNull() & (F.col("n").isNull() | (F.col("o.epistemic_state").isin(*GROUNDABLE) & (F.col("n.epistemic_state") == "unverified")))
    return both.select("id", F.when(keep, F.col("o")).otherwise(F.col("n")).alias("x"), F.when(F.col("o").isNull(), "inserted").when(keep | (F.col("o") == F.col("n")), "kept").otherwise("updated").alias("change")).select("id", "x.*", "change")


def ground(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts ``id, verdict, support_span, support_note, by, at, ord`` applied
    to items: the state, the provenance of promoted hypotheses, or an error.
    Of several verdicts on an item the last is applied."""
    last = verdicts.groupBy("id").agg(F.max_by(F.struct("verdict", "support_span", "support_note", "by", "at"), "ord").alias("v"))
    j = items.join(last, "id")
    hyp = (F.col("provenance") == "hypothesized") & (F.col("v.verdict") == "grounded")
    span = F.trim(F.coalesce(F.col("v.support_span"), F.lit(""))) != ""
    note = F.trim(F.coalesce(F.col("v.support_note"), F.lit(""))) != ""
    error = F.when(~F.col("v.verdict").isin(*GROUNDABLE), "unknown-verdict").when(hyp & ~span & ~note, "promotion-needs-support")
    state = F.when(error.isNull(), F.col("v.verdict")).otherwise(F.col("epistemic_state"))
    prov = F.when(error.isNull() & hyp, F.when(span, "span-present").otherwise("inferred")).otherwise(F.col("provenance"))
    return j.select("id", F.col("epistemic_state").alias("from_state"), state.alias("epistemic_state"), prov.alias("provenance"), error.alias("error"), F.col("v.by").alias("by"), F.col("v.at").alias("at"))


def audit_rows(grounded: DataFrame) -> DataFrame:
    return grounded.where("error is null").select(F.col("id").alias("key"), F.col("from_state").alias("from"), F.col("epistemic_state").alias("to"), "by", "at")


def state_rank(c: str) -> Column:
    """Precedence where edges collide: failures outlast everything."""
    order = ("obsolete", "unverified", "grounded", "rejected", "failed")
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.col(c))


def provenance_rank(c: str) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ("hypothesized", "inferred", "span-present")]), F.col(c))


def renamed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with endpoints rewritten by ``old, new``; loops that arise go
    unless they failed or were rejected; colliding edges become one by state,
    provenance and id, with how many there were in ``merged_from``."""
    m = mapping.select("old", "new")
    e = edges.join(m.toDF("source", "_s"), "source", "left").join(m.toDF("target", "_t"), "target", "left")
    moved = F.col("_s").isNotNull() | F.col("_t").isNotNull()
    e = e.withColumn("_was", F.col("id")).withColumn("_moved", moved).withColumn("source", F.coalesce("_s", "source")).withColumn("target", F.coalesce("_t", "target"))
    e = e.where(~F.col("_moved") | (F.col("source") != F.col("target")) | F.col("epistemic_state").isin(*FAILURE))
    e = e.withColumn("id", F.when(F.col("_moved"), edge_id("source", "relation", "target")).otherwise(F.col("id")))
    key = F.struct(state_rank("epistemic_state").alias("s"), provenance_rank("provenance").alias("p"), F.col("_was").alias("i"))
    return e.groupBy("id").agg(F.max_by(F.struct("source", "target", "relation", "provenance", "epistemic_state"), key).alias("x"), F.count("*").alias("merged_from")).select("id", "x.*", "merged_from")


# Fixed value: the type of a node that nobody declared yet.
UNDECLARED = "undeclared-type"


def merge_requests(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``old, new, error`` of requests ``from, into``: ids as slugs, and why a merge
    is refused, null if it is not. A node does not become itself; both have to be
    there; two declared types are never made one; and of the requests of one call
    a node is the source of one at most and not the target of another's."""
    r = requests.select(slug("from").alias("old"), slug("into").alias("new"))
    kind = lambda key, name: nodes.select(F.col("id").alias(key), F.coalesce("node_type", F.lit(UNDECLARED)).alias(name))
    sources = r.groupBy("old").agg(F.count("*").alias("_n"))
    j = r.join(kind("old", "_a"), "old", "left").join(kind("new", "_b"), "new", "left").join(sources, "old")
    j = j.join(sources.select(F.col("old").alias("new"), F.lit(True).alias("_goes")), "new", "left")
    differ = (F.col("_a") != F.col("_b")) & (F.col("_a") != UNDECLARED) & (F.col("_b") != UNDECLARED)
    error = F.when(F.col("old") == F.col("new"), "merge-into-itself").when(F.col("_a").isNull(), "source-not-found").when(F.col("_b").isNull(), "target-not-found").when(differ, "node-type-conflict").when(F.col("_n") > 1, "source-merged-twice").when(F.col("_goes"), "target-is-merged-too")
    return j.select("old", "new", error.alias("error"))


def merge_report(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row for a merge or rename by ``old, new``: ``edges_rewritten``, the
    ``self_loops_dropped`` and the ``edges_deduped``, ids that several edges became."""
    moved = lambda c: F.col(f"_{c}").isNotNull()
    m = mapping.select("old", "new")
    e = edges.join(m.toDF("source", "_s"), "source", "left").join(m.toDF("target", "_t"), "target", "left").where(moved("s") | moved("t"))
    loop = (F.coalesce("_s", "source") == F.coalesce("_t", "target")) & ~F.col("epistemic_state").isin(*FAILURE)
    counts = e.agg(F.count_if(~loop).alias("edges_rewritten"), F.count_if(loop).alias("self_loops_dropped"))
    return counts.crossJoin(renamed(edges, mapping).agg(F.count_if(F.col("merged_from") > 1).alias("edges_deduped")))


def migrations(edges: DataFrame, after: DataFrame) -> DataFrame:
    """``key, from, to, by``: the audit records that a rename or merge needs. A
    verdict that now is at an id, or in a state, where no edge had it before has no
    record to stand on; all others keep theirs."""
    new = after.where(F.col("epistemic_state").isin(*GROUNDABLE)).join(edges.select("id", "epistemic_state"), ["id", "epistemic_state"], "left_anti")
    return new.select(F.col("id").alias("key"), F.lit("unverified").alias("from"), F.col("epistemic_state").alias("to"), F.lit("agent").alias("by"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """States by edge id: a change on one side is taken, two different changes
    give unverified and ``conflict``; edges of either side stay."""
    j = base.select("id", F.col("epistemic_state").alias("b")).join(ours.select("id", F.col("epistemic_state").alias("o")), "id", "full_outer").join(theirs.select("id", F.col("epistemic_state").alias("t")), "id", "full_outer")
    o, t, b = F.col("o"), F.col("t"), F.col("b")
    state = F.when(o.isNull(), t).when(t.isNull(), o).when(o == t, o).when(o.eqNullSafe(b), t).when(t.eqNullSafe(b), o).otherwise("unverified")
    conflict = o.isNotNull() & t.isNotNull() & (o != t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
    return j.select("id", state.alias("epistemic_state"), conflict.alias("conflict")).where("epistemic_state is not null")


def _three(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Three versions of rows ``id, epistemic_state, ...`` beside each other as structs
    ``b, o, t``; whether theirs alone changed the state, and whether both did, differently."""
    cols = [c for c in ours.columns if c != "id"]
    side = lambda df, name: df.select("id", F.struct(*cols).alias(name))
    j = side(ours, "o").join(side(theirs, "t"), "id", "full_outer").join(side(base, "b"), "id", "left")
    o, t, b = (F.col(f"{x}.epistemic_state") for x in "otb")
    both = F.col("o").isNotNull() & F.col("t").isNotNull() & ~o.eqNullSafe(t)
    adopted = both & F.coalesce(o == b, F.lit(False))
    return j, adopted, both & ~adopted & ~F.coalesce(t == b, F.lit(False))


def three_way_edges(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Edges of two versions with all their columns and ``conflict``. An edge of one
    side alone stays. In the same state theirs is taken whole, a correction of
    other fields with it; where one side changed the state that side's is. Where
    both did, differently, or without a base, ours becomes unverified and loses
    ``verdict_by`` and ``verdict_at``, if there are such columns."""
    j, adopted, conflict = _three(base, ours, theirs)
    same = F.col("o.epistemic_state").eqNullSafe(F.col("t.epistemic_state"))
    pick = F.when(F.col("o").isNull() | (F.col("t").isNotNull() & (same | adopted)), F.col("t")).otherwise(F.col("o"))
    out = j.select("id", pick.alias("x"), conflict.alias("conflict")).select("id", "x.*", "conflict")
    lost = {c: F.when(~F.col("conflict"), F.col(c)) for c in ("verdict_by", "verdict_at") if c in out.columns}
    return out.withColumns(lost | {"epistemic_state": F.when(F.col("conflict"), "unverified").otherwise(F.col("epistemic_state"))})


def three_way_nodes(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes of two versions with ``conflict`` of their states, as those of edges, and
    ``body_conflict``. Of every other column the one side's change from the base is
    taken, else ours. A ``body`` that both changed, differently, has both texts
    between marks; without a base it was empty."""
    j, adopted, conflict = _three(base, ours, theirs)
    one = F.when(F.col("o").isNull(), F.col("t")).when(F.col("t").isNull(), F.col("o"))
    at = lambda side, c: F.col(f"{side}.{c}")

    def merged_column(c: str) -> Column:
        o, t, b = (at(side, c) for side in "otb")
        if c == "epistemic_state":
            two = F.when(conflict, "unverified").when(adopted, t).otherwise(o)
        elif c == "body":
            two = F.when(clash, F.concat(F.lit("<<<<<<< ours\n"), o, F.lit("\n=======\n"), t, F.lit("\n>>>>>>> theirs\n"))).when(text("o") == text("b"), t).otherwise(o)
        else:
            two = F.when(F.coalesce(o == b, F.lit(False)), t).otherwise(o)
        return F.when(one.isNotNull(), one[c]).otherwise(two).alias(c)

    cols = [c for c in ours.columns if c != "id"]
    text = lambda side: F.coalesce(at(side, "body"), F.lit(""))
    clash = one.isNull() & (text("o") != text("t")) & (text("o") != text("b")) & (text("t") != text("b")) if "body" in cols else F.lit(False)
    return j.select("id", *[merged_column(c) for c in cols], conflict.alias("conflict"), clash.alias("body_conflict"))


def sweep(items: DataFrame, baseline: DataFrame, audit: DataFrame, consumed: DataFrame) -> DataFrame:
    """Verdicts without an unspent audit record are taken back.

    A verdict stands if the item had it at the baseline or if the audit has
    more records of (key, state) than were consumed; otherwise it returns to a
    failure of the baseline, else to unverified. A failure that vanished
    without a record is restored. All records of a key that is used are spent.
    """
    have = audit.groupBy(F.col("key").alias("id"), F.col("to").alias("state")).agg(F.count("*").alias("have"))
    used = consumed.select(F.col("key").alias("id"), F.col("to").alias("state"), "used")
    credit = have.join(used, ["id", "state"], "left").select("id", "state", (F.col("have") - F.coalesce("used", F.lit(0))).alias("credit"))
    j = items.select("id", F.col("epistemic_state").alias("state")).join(baseline.select("id", F.col("epistemic_state").alias("was")), "id", "left").join(credit, ["id", "state"], "left")
    claims = F.col("state").isin(*GROUNDABLE)
    paid = F.coalesce(F.col("credit") > 0, F.lit(False))
    failed = F.coalesce(F.col("was").isin(*FAILURE), F.lit(False))
    same = F.col("state").eqNullSafe(F.col("was"))
    action = F.when(same, "unchanged").when(claims & paid, "audited").when(failed, "failure-restored").when(claims, "re-quarantined").otherwise("unchanged")
    state = F.when(action == "failure-restored", F.col("was")).when(action == "re-quarantined", "unverified").otherwise(F.col("state"))
    return j.select("id", state.alias("epistemic_state"), action.alias("action"), F.when(action == "audited", F.col("credit")).otherwise(0).cast("long").alias("spent"))


def orphans(audit: DataFrame, items: DataFrame) -> DataFrame:
    """Audit keys of which no item is left."""
    return audit.select(F.col("key").alias("id")).distinct().join(items.select("id"), "id", "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change``: inserted, deleted or updated rows by a hash of ``columns``."""
    h = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256).alias(n))
    j = h(old, "o").join(h(new, "n"), key, "full_outer")
    change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "updated")
    return j.select(key, change.alias("change")).where("change is not null")


def new_texts(sources: DataFrame, seen_hashes: DataFrame, text_col: str = "text") -> DataFrame:
    """Sources whose content was not there before, under whatever name."""
    return sources.withColumn("hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).join(seen_hashes.select("hash").distinct(), "hash", "left_anti")


def topology_signature(adj: DataFrame) -> DataFrame:
    """One row that changes with the topology, whatever the order of the pairs."""
    return adj.where("u < v").agg(F.count("*").alias("pairs"), F.bit_xor(F.xxhash64("u", "v")).alias("signature"))


def receipt(df: DataFrame, columns: list[str]) -> DataFrame:
    """A payload's fingerprint for idempotent replay."""
    return df.groupBy("payload").agg(F.count("*").alias("items"), F.bit_xor(F.xxhash64(*columns)).alias("receipt"))
