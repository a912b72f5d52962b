"""The divergence archive: elites, preferences, parents, pins and their fates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from .advise import cut
from .checkpoint import stored
from .vector import dot, near_dedupe, novelty

# Vectors that quadratic measures look at, characters of a label.
NOVEL_CAP, LABEL = 500, 80


def capped_by_novelty(elites: DataFrame, cap: int = NOVEL_CAP) -> DataFrame:
    """The ``cap`` most novel elites, ids breaking ties; all if they are no more."""
    return elites.orderBy(F.desc(F.coalesce("novelty", F.lit(0.0))), "elite").limit(cap)


def rekeyed(niches: DataFrame, cells: DataFrame, axis: str) -> DataFrame:
    """The archive with the bucket of one ``axis`` replaced by its frozen cell.

    ``niches`` has ``niche_id, coords (map), elite, fitness, novelty, n`` and
    ``cells`` ``niche_id, cell``; niches without a cell stay. Niches that now
    are one keep the better elite (fitness, novelty, then the older niche) and
    add their counts: one aggregation with partial sums.
    """
    j = niches.join(cells, "niche_id", "left")
    moved = F.map_concat(F.map_filter("coords", lambda k, _: k != axis), F.create_map(F.lit(axis), F.concat(F.lit("cell"), F.col("cell").cast("string"))))
    coords = F.when(F.col("cell").isNull(), F.col("coords")).otherwise(moved)
    pairs = F.array_sort(F.map_entries(coords))
    new = F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")
    best = F.struct("fitness", "novelty", F.col("niche_id").alias("old"))
    key = F.struct("fitness", "novelty", (-F.col("seq")).alias("age"))
    return j.withColumn("new_id", new).groupBy("new_id").agg(F.max_by("elite", key).alias("elite"), F.max("fitness").alias("fitness"), F.max_by("novelty", key).alias("novelty"), F.sum("n").alias("n"), F.count(best).alias("merged"))


def ingest(candidates: DataFrame, niches: DataFrame, vectors: DataFrame, tau: float = 0.95, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """A generation's cycle: the survivors with their novelty, and the archive after it.

    ``candidates`` has ``id, v, niche_id, fitness, seq``, ``niches`` ``niche_id,
    elite, fitness, novelty, n, seq`` and ``vectors`` ``id, v`` of what is there.
    Candidates too like what is there, or an earlier one, go; novelty is measured
    against the others and what is there; a niche keeps the best by fitness,
    novelty and age, and counts every placement. Ids are numbers.
    """
    kept = near_dedupe(candidates.select("id", "v"), tau, vectors.select("id", "v")).where("kept").select("id")
    rest = stored(candidates.join(kept, "id"), "ingest")
    new = novelty(rest.select("id", "v"), rest.select("id", "v").unionByName(vectors.select("id", "v")), k)
    placed = stored(rest.join(new, "id").select("id", "niche_id", "fitness", "novelty", "seq"), "placed")
    rows = placed.select("niche_id", F.col("id").alias("elite"), "fitness", "novelty", F.lit(1).cast("long").alias("n"), "seq")
    key = F.struct("fitness", "novelty", (-F.col("seq")).alias("age"))
    both = niches.select(*rows.columns).unionByName(rows).groupBy("niche_id")
    after = both.agg(F.max_by("elite", key).alias("elite"), F.max("fitness").alias("fitness"), F.max_by("novelty", key).alias("novelty"), F.sum("n").alias("n"), F.max_by("seq", key).alias("seq"))
    return placed, after


def preferences(events: DataFrame, records: DataFrame, k: int = 10) -> DataFrame:
    """``domain, part, position, key, n``: the summary of a domain's memory.

    ``events`` has ``domain, seq, kind, winner, loser``, ``records`` ``id,
    descriptor (map)``. Parts: ``last`` (sequence numbers of the last k
    comparisons, oldest first), ``win``, ``loss`` and ``value`` (axis=value of
    winners), the k most frequent of each; ties go to what came first.
    """
    c = events.where("kind = 'comparison'")
    recent = Window.partitionBy("domain").orderBy(F.desc("seq"))
    last = c.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= k)
    order = Window.partitionBy("domain").orderBy("seq")
    last = last.select("domain", F.lit("last").alias("part"), F.row_number().over(order).alias("position"), F.col("seq").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    told = lambda part, col: c.where(f"{col} is not null").select("domain", "seq", F.lit(part).alias("part"), F.col(col).cast("string").alias("key"))
    axis = F.explode(F.map_entries("descriptor")).alias("a")
    liked = c.where("winner is not null").select("domain", "seq", F.col("winner").cast("string").alias("id")).join(records.select(F.col("id").cast("string").alias("id"), "descriptor"), "id").select("domain", "seq", axis)
    liked = liked.where("a.value is not null").select("domain", "seq", F.lit("value").alias("part"), F.concat("a.key", F.lit("="), "a.value").alias("key"))
    counts = told("win", "winner").unionAll(told("loss", "loser")).unionAll(liked).groupBy("domain", "part", "key").agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    best = Window.partitionBy("domain", "part").orderBy(F.desc("n"), "_first", "key")
    top = counts.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
    return last.unionByName(top.select("domain", "part", "position", "key", "n"))


def elite_records(elites: DataFrame, records: DataFrame, vectors: DataFrame) -> DataFrame:
    """``elite, stale, embedded``: elites without a record are stale."""
    r = records.select(F.col("id").alias("elite")).distinct().withColumn("_r", F.lit(True))
    v = vectors.select(F.col("id").alias("elite")).distinct().withColumn("_v", F.lit(True))
    j = elites.select("elite").join(r, "elite", "left").join(v, "elite", "left")
    return j.select("elite", F.col("_r").isNull().alias("stale"), F.col("_v").isNotNull().alias("embedded"))


def parents(elites: DataFrame, vectors: DataFrame, pins: DataFrame, discards: DataFrame, k: int) -> DataFrame:
    """``position, id, pinned``: every pin, by ``seq``, then the elites farthest by
    cosine from all chosen so far, up to ``k``; discarded ones never. Without a
    pin that has a vector the first elite by id begins; ids break ties.

    Pins are a user's picks and k is a slate, both small; each further pick is one
    top-1 over the elites, which stay where they are.
    """
    spark = elites.sparkSession
    chosen = [(r["id"], True) for r in pins.groupBy("id").agg(F.min("seq").alias("seq")).orderBy("seq", "id").toLocalIterator()]
    unit = lambda df: df.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).select("id", F.transform("v", lambda x: x / F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12))).alias("v"))
    free = elites.select(F.col("elite").alias("id")).distinct().join(pins.select("id"), "id", "left_anti").join(discards.select("id"), "id", "left_anti")
    pool = stored(unit(free.join(vectors.select("id", "v"), "id")), "parents")
    seen = [r["v"] for r in unit(vectors.join(pins.select("id").distinct(), "id", "left_semi")).toLocalIterator()]
    while len(chosen) < k:
        near = [dot(F.col("v"), F.array(*[F.lit(float(x)) for x in s])) for s in seen]
        far = F.lit(0.0) if not near else 1 - (near[0] if len(near) == 1 else F.greatest(*near))
        row = pool.where(~F.col("id").isin([c for c, _ in chosen])).orderBy(F.desc(F.round(far, 12)), "id").limit(1).first()
        if row is None:
            break
        chosen.append((row["id"], False))
        seen.append(row["v"])
    kind = dict(vectors.dtypes)["id"]
    return spark.createDataFrame([(i, x, p) for i, (x, p) in enumerate(chosen)], f"position int, id {kind}, pinned boolean")


def metrics(niches: DataFrame, mean_cosine: DataFrame, cells: int) -> DataFrame:
    """One row: entropy of the occupancy, niches occupied, coverage of ``cells``
    possible ones, elites and their mean cosine."""
    t = niches.agg(F.count_if(F.col("n") > 0).alias("occupied"), F.sum("n").cast("double").alias("t"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("x"), F.count("elite").alias("elites"))
    h = F.coalesce(F.log("t") - F.col("x") / F.col("t"), F.lit(0.0))
    return t.crossJoin(F.broadcast(mean_cosine)).select(F.round(h, 4).alias("entropy"), "occupied", F.round(F.col("occupied") / cells, 4).alias("coverage"), "elites", F.round("mean_cosine", 4).alias("mean_cosine"))


def materialized(pins: DataFrame, records: DataFrame, project: str, session: str) -> DataFrame:
    """``candidate, status, reason, id, label, body``: pinned ideas as nodes for the
    propose lane. Candidates asked for that are not pinned are refused, pins
    without a text skipped. ``pins`` has ``id, pinned``; ``records`` has ``id,
    text, mechanism, operator``."""
    j = pins.select("id", "pinned").join(records, "id", "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    status = F.when(~F.col("pinned"), "refused").when(text == "", "skipped").otherwise("proposed")
    reason = F.when(~F.col("pinned"), "not-pinned").when(text == "", "no-session-record").otherwise("")
    node = F.concat(F.lit("idea-"), slug(F.lit(project)), F.lit("-"), slug(F.col("id").cast("string")))
    lineage = F.concat(F.lit("[diverge] pinned candidate="), F.col("id").cast("string"), F.lit(f" brief={project} session={session} mechanism='"), F.coalesce("mechanism", F.lit("")), F.lit("' operator="), F.coalesce("operator", F.lit("")))
    on = status == "proposed"
    return j.select(F.col("id").alias("candidate"), status.alias("status"), reason.alias("reason"), F.when(on, node).alias("id"), F.when(on, cut(text, LABEL)).alias("label"), F.when(on, F.concat(text, F.lit("\n\n"), lineage, F.lit("\n"))).alias("body"))


def fates(ledger: DataFrame, items: DataFrame, signature: str) -> DataFrame:
    """``candidate, fate, fate_signature, newly_discarded, re_examinable``.

    ``ledger`` has ``candidate, item, fate, fate_signature, unsealed_signature``,
    a row for each node or edge of a materialised candidate, ``items`` ``id,
    epistemic_state``. A candidate one of whose items failed (not: was rejected)
    is discarded and remembers the signature of the sources it failed against;
    one unsealed against these sources stays out. A fate of other sources can
    be looked at again; a fate without signature takes the present one.
    """
    s = items.select(F.col("id").alias("item"), (F.col("epistemic_state") == "failed").alias("_failed"))
    per = ledger.join(s, "item", "left").groupBy("candidate").agg(F.max("fate").alias("fate"), F.max("fate_signature").alias("sig"), F.max("unsealed_signature").alias("open"), F.max(F.coalesce("_failed", F.lit(False))).alias("failed"))
    folded = F.col("fate").isin("failed", "rejected")
    new = ~F.coalesce(folded, F.lit(False)) & F.col("failed") & ~F.coalesce(F.col("open") == signature, F.lit(False))
    fate = F.when(new, "failed").otherwise(F.col("fate"))
    sig = F.when(new | ((F.col("fate") == "failed") & F.col("sig").isNull()), F.lit(signature)).otherwise(F.col("sig"))
    again = F.coalesce((fate == "failed") & (sig != signature), F.lit(False))
    return per.select("candidate", fate.alias("fate"), sig.alias("fate_signature"), new.alias("newly_discarded"), again.alias("re_examinable"))


#: Words of the synthetic streams.
SUBJECTS = ("river", "library", "market", "garden", "engine", "festival", "harbor")
VERBS = ("reframes", "couples", "inverts", "measures", "trades")
OBJECTS = ("memory", "risk", "heat", "trust", "noise", "time", "debt", "light", "soil", "code", "salt")


def synthetic(spark, n: int, kind: str = "diverse", generation: int = 0) -> DataFrame:
    """``id, text``: a stream of candidates by modular arithmetic, ``diverse``,
    ``cliched`` (few texts again and again), ``samey`` (one text, numbered) or
    ``clones-first`` (its first half one text)."""
    i = F.col("id")
    word = lambda words, a: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(i * a + generation, F.lit(len(words))) + 1).cast("int"))
    diverse = F.concat_ws(" ", word(SUBJECTS, 3), word(VERBS, 7), word(OBJECTS, 5), F.concat(F.lit("case"), i.cast("string")))
    one = F.lit("a better app for everyone")
    text = {"diverse": diverse, "cliched": F.concat_ws(" ", word(SUBJECTS[:2], 1), F.lit("as a service")), "samey": F.concat_ws(" ", one, i.cast("string")), "clones-first": F.when(i < n // 2, one).otherwise(diverse)}[kind]
    return spark.range(n).select("id", text.alias("text"))
