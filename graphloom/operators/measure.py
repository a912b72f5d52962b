"""Measurement: agreement, gates, absorption, ideation, precision, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, words
from .checkpoint import stored
from .spans import span_hits


def krippendorff_alpha(labels: DataFrame) -> DataFrame:
    """One row, ``alpha``: nominal agreement of ``coder, unit, label``. Blank
    labels and units with one label don't count; no unit gives null, no
    disagreement to expect gives 1."""
    clean = labels.select("unit", F.trim("label").alias("label")).where("label is not null and label <> ''")
    counts = clean.groupBy("unit", "label").agg(F.count("*").alias("n"))
    units = counts.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m >= 2")
    observed = units.agg(F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("dis"))
    margin = counts.join(units.select("unit"), "unit", "left_semi").groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("csq"))
    n = F.col("total")
    expected = (n * n - F.col("csq")) / F.when(n > 1, n - 1)
    alpha = F.when(n.isNull(), F.lit(None)).when(expected == 0, 1.0).otherwise(1 - F.col("dis") / expected)
    return observed.crossJoin(F.broadcast(margin)).select(alpha.cast("double").alias("alpha"))


def convergence_gate(history: DataFrame, least: int = 3, margin: float = 0.10) -> DataFrame:
    """Is the grounded rate of candidates that two mechanisms agree on higher?"""
    high = F.col("convergence") >= 2
    a = history.agg(F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"), F.avg(F.when(high, F.col("grounded").cast("double"))).alias("high"), F.avg(F.when(~high, F.col("grounded").cast("double"))).alias("low"))
    enough = (F.col("n_high") >= least) & (F.col("n_low") >= least)
    gap = F.when(enough, F.col("high") - F.col("low")).otherwise(0.0)
    return a.select("n_high", "n_low", F.round(gap, 6).alias("margin"), (enough & (gap > margin)).alias("gate_on"))


def absorption(history: DataFrame, degree: DataFrame, now: int, absorbed: int = 3) -> DataFrame:
    """``id, growth, status, half_life`` from ``id, introduced_at, introduced_degree``
    and today's multigraph degree."""
    j = history.join(degree.select("id", "multi_degree"), "id", "left")
    deg = F.coalesce("multi_degree", F.lit(0))
    growth = F.greatest(F.lit(0), deg - F.col("introduced_degree"))
    status = F.when(growth >= absorbed, "absorbed").when(deg == 0, "isolated").otherwise("fertile")
    return j.select("id", growth.cast("long").alias("growth"), status.alias("status"), F.when(growth > 0, F.round((now - F.col("introduced_at")) / growth, 6)).alias("half_life"))


# What counts as a sign of use, the words a key term has to be longer
# than, key terms of a sentence, words of a sentence, signs that are enough.
MARKERS = r"\bbecause\b|\bif\b|\btherefore\b|\bbridge|\bconnect"
KEY_LENGTH, KEY_TERMS, SENTENCE_WORDS, ENOUGH = 5, 3, 4, 5
WORDS = r"[A-Za-z][A-Za-z0-9_-]{1,}"
SCORES = ("diversity", "novelty", "utility", "unsupported_rate")


def ideation(outputs: DataFrame, source: DataFrame) -> DataFrame:
    """Per ``arm``: ``n`` outputs and, to three places, ``diversity`` (distinct
    3-grams of the arm over the sum of its outputs'), and over outputs the mean
    ``novelty`` (share of an output's 3-grams that the source has not; none is
    0), ``utility`` (signs of use, five are enough) and ``unsupported_rate``
    (of sentences with key terms, those none of whose key terms the source has).

    ``outputs`` has ``output`` (a key), ``arm, text``; ``source`` has ``text``.
    Texts are split once; 3-grams are compared by 64-bit hashes. The distinct key
    terms, a vocabulary, are looked for in the source by ``span_hits``.
    """
    found = lambda c: F.regexp_extract_all(c, F.lit(WORDS), F.lit(0))
    # Words have no blanks, so all of a text are lowered at once.
    lowered = lambda c: F.split(F.lower(F.array_join(found(c), " ")), " ")
    hashed = lambda w: F.array_distinct(F.transform(ngrams(w), lambda g: F.xxhash64(g)))
    o = stored(outputs.where("text is not null").select("output", "arm", "text", hashed(lowered(F.col("text"))).alias("grams")), "outputs")
    src = source.where("text is not null").select(F.monotonically_increasing_id().alias("doc"), "text", F.lower("text").alias("norm"))
    known = src.select(F.explode(hashed(lowered(F.col("text")))).alias("g")).distinct().withColumn("known", F.lit(1))
    per = stored(o.select("arm", "output", F.explode("grams").alias("g")).join(known, "g", "left"), "grams")
    pooled = per.groupBy("arm").agg((F.count_distinct("g") / F.count("*")).alias("diversity"))
    new = per.groupBy("output").agg((1 - F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias("novelty"))
    sentences = o.select("output", F.posexplode(F.split("text", r"[.!?]+\s+")).alias("i", "s")).where(F.size(F.filter(F.split("s", r"\s+"), lambda w: w != "")) >= SENTENCE_WORDS)
    terms = F.slice(F.filter(found(F.col("s")), lambda w: F.length(w) > KEY_LENGTH), 1, KEY_TERMS)
    each = stored(sentences.select("output", "i", F.explode(F.transform(terms, F.lower)).alias("term")), "terms")
    parts = span_hits(src, ["doc"], each.select(F.col("term").alias("span"))).select(F.col("span").alias("term")).distinct().withColumn("k", F.lit(1))
    backed = each.join(parts, "term", "left").groupBy("output", "i").agg(F.max("k").alias("k"))
    bare = backed.groupBy("output").agg(F.avg(F.col("k").isNull().cast("double")).alias("bare"))
    use = F.least(F.lit(1.0), F.regexp_count(F.lower("text"), F.lit(MARKERS)) / ENOUGH)
    scored = o.select("output", "arm", use.alias("use")).join(new, "output", "left").join(bare, "output", "left")
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 3)
    out = scored.groupBy("arm").agg(F.count("*").alias("n"), r(F.avg(F.coalesce("novelty", F.lit(0.0)))).alias("novelty"), r(F.avg("use")).alias("utility"), r(F.avg("bare")).alias("unsupported_rate"))
    return out.join(pooled, "arm", "left").select("arm", "n", r(F.col("diversity")).alias("diversity"), "novelty", "utility", "unsupported_rate")


def ideation_verdicts(scores: DataFrame, slack: float = 0.05) -> DataFrame:
    """``a, b, beats``: arm a loses to b neither in diversity nor in novelty nor,
    by more than ``slack``, in support, and gains in diversity or novelty. Arms
    are few: both sides are the score table, a row each."""
    a = scores.select(F.col("arm").alias("a"), *[F.col(c).alias(f"a_{c}") for c in SCORES])
    b = scores.select(F.col("arm").alias("b"), *[F.col(c).alias(f"b_{c}") for c in SCORES])
    holds = (F.col("a_diversity") >= F.col("b_diversity")) & (F.col("a_novelty") >= F.col("b_novelty")) & (F.col("a_unsupported_rate") <= F.col("b_unsupported_rate") + slack)
    gains = (F.col("a_diversity") > F.col("b_diversity")) | (F.col("a_novelty") > F.col("b_novelty"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", (holds & gains).alias("beats"))


def precision(sheet: DataFrame, least: int = 3) -> DataFrame:
    """Per relation, and for all as ``*``: judged, precision, span support and
    mean confidence of right and wrong edges; relations with too few are left out."""
    right = F.col("verdict") == "correct"
    judged = sheet.where(F.col("verdict").isin("correct", "wrong", "astrology"))
    both = judged.withColumn("relation", F.explode(F.array(F.lit("*"), F.col("relation"))))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = both.groupBy("relation").agg(F.count("*").alias("judged"), rate(right).alias("precision"), rate(F.col("verdict") == "astrology").alias("astrology"), rate(F.col("span_found")).alias("span_support"), F.round(F.avg(F.when(right, F.col("confidence_score"))), 6).alias("confidence_right"), F.round(F.avg(F.when(~right, F.col("confidence_score"))), 6).alias("confidence_wrong"))
    return out.where((F.col("relation") == "*") | (F.col("judged") >= least))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Per relation: edges, least, exact median and most confidence."""
    c = F.col("confidence_score")
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.min(c), 6).alias("low"), F.round(F.percentile(c, 0.5), 6).alias("mid"), F.round(F.max(c), 6).alias("high"))


def sheet_sample(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sample by hash: the same rows however the table is partitioned."""
    return edges.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def pack_coverage(text: DataFrame, glossary: DataFrame, text_col: str = "text") -> DataFrame:
    """Marked terms (bold, code, quoted) against the glossary: ``term, in_text, in_glossary``."""
    c = F.col(text_col)
    found = F.concat(F.regexp_extract_all(c, F.lit(r"\*\*([^*\n]{1,60})\*\*"), F.lit(1)), F.regexp_extract_all(c, F.lit("`([^`\n]{1,60})`"), F.lit(1)), F.regexp_extract_all(c, F.lit('"([^"\n]{3,60})"'), F.lit(1)))
    t = text.select(F.explode(F.transform(found, lambda x: F.lower(F.trim(x)))).alias("term")).where("term <> ''").distinct().withColumn("t", F.lit(True))
    g = glossary.select(F.lower(F.trim("term")).alias("term")).distinct().withColumn("g", F.lit(True))
    return t.join(g, "term", "full_outer").select("term", F.coalesce("t", F.lit(False)).alias("in_text"), F.coalesce("g", F.lit(False)).alias("in_glossary"))


def section_coverage(sections: DataFrame, spans: DataFrame) -> DataFrame:
    """``file, section, covered`` from ``file, section, norm`` (the normalised body)
    and ``span`` (normalised): does the body contain some span?"""
    hit = span_hits(sections, ["file", "section"], spans).select("file", "section").distinct().withColumn("covered", F.lit(True))
    return sections.select("file", "section").join(hit, ["file", "section"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def file_coverage(sections: DataFrame) -> DataFrame:
    """``file, sections, covered_sections`` of covered sections."""
    return sections.groupBy("file").agg(F.count("*").alias("sections"), F.count_if("covered").alias("covered_sections"))


def re_examinable(items: DataFrame, changed_terms: DataFrame, term_col: Column) -> DataFrame:
    """Failed or rejected items that share a term with changed source text."""
    t = items.where(F.col("epistemic_state").isin("failed", "rejected")).select("id", F.explode(F.array_distinct(term_col)).alias("term"))
    return t.join(changed_terms.select("term").distinct(), "term", "left_semi").select("id").distinct()


# Cycles of the window, by how much decay has to quicken, for how many
# cycles, the least slope that counts, and the share of the target that is enough.
WINDOW, QUICKER, PERSIST, LEAST_SLOPE, HEALTHY = 5, 0.5, 2, 0.005, 0.6


def erosion(history: DataFrame, session: str = "session") -> DataFrame:
    """``session, cycle`` with ``under_generation, slope_earlier, slope_recent,
    accelerating, streak, eroding`` from ``session, cycle, novelty, submitted, target``.

    The slopes are the mean falls in the two halves of the last five novelties
    (cycles without one add none). Decay accelerates where the recent slope
    exceeds the earlier one by half, in healthy cycles only; two in a row are
    erosion. The streak is a running count since the last cycle that was not.
    """
    o = f"over (partition by {session} order by cycle)"
    back = lambda k: F.expr(f"lag(novelty, {k}) ignore nulls {o}")
    has = F.col("novelty").isNotNull()
    s = history.withColumn("v0", F.coalesce("novelty", back(1)))
    for k in range(1, WINDOW):
        s = s.withColumn(f"v{k}", F.when(has, back(k)).otherwise(back(k + 1)))
    under = (F.col("target") > 0) & (F.col("submitted") < HEALTHY * F.col("target"))
    full = ~under & F.col(f"v{WINDOW - 1}").isNotNull()
    s = s.withColumn("under_generation", under)
    s = s.withColumn("slope_earlier", F.when(full, (F.col("v4") - F.col("v2")) / 2)).withColumn("slope_recent", F.when(full, (F.col("v2") - F.col("v0")) / 2))
    quick = (F.col("slope_recent") > LEAST_SLOPE) & (F.col("slope_recent") >= (1 + QUICKER) * F.greatest("slope_earlier", F.lit(LEAST_SLOPE)))
    s = s.withColumn("accelerating", F.coalesce(quick, F.lit(False)))
    w = Window.partitionBy(session).orderBy("cycle")
    s = s.withColumn("_run", F.sum((~F.col("accelerating")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("accelerating").cast("long")).over(Window.partitionBy(session, "_run").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("streak", streak)
    return s.select(session, "cycle", "under_generation", F.round("slope_earlier", 4).alias("slope_earlier"), F.round("slope_recent", 4).alias("slope_recent"), "accelerating", "streak", (F.col("streak") >= PERSIST).alias("eroding"))


# Samples of the baseline, margin over it, ceiling, and the limit without it.
BASELINE, MARGIN, CEILING, LIMIT, LEAST_SAMPLES = 5, 0.15, 0.80, 0.55, 2


def similarity_limits(cycles: DataFrame, session: str = "session") -> DataFrame:
    """``session, cycle, similarity_limit, too_similar, baseline`` from ``session, cycle, n,
    mean_cosine``: a cycle is too similar above the mean of the baseline plus
    a margin, or above a fixed limit while the baseline has too few samples.
    A cycle of two rows or more joins the baseline unless a calibrated limit
    flagged it, so what a cycle adds depends on those before: a fold over the
    session's cycles, in order, of which a session has few.
    """
    ordered = cycles.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("cycle", F.col("n").cast("long").alias("n"), F.col("mean_cosine").cast("double").alias("c")))).alias("xs"))
    start = F.struct(F.array().cast("array<double>").alias("base"), F.array().cast("array<struct<cycle:bigint,similarity_limit:double,too_similar:boolean,baseline:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        base = acc["base"]
        calibrated = F.size(base) >= LEAST_SAMPLES
        mean = F.aggregate(base, F.lit(0.0), lambda p, q: p + q) / F.greatest(F.size(base), F.lit(1))
        limit = F.when(calibrated, F.least(mean + MARGIN, F.lit(CEILING))).otherwise(LIMIT)
        similar = (x["n"] >= 2) & (x["c"] > limit)
        grown = F.concat(base, F.array(x["c"]))
        keep = F.when((x["n"] >= 2) & ~(calibrated & similar), F.slice(grown, F.greatest(F.size(grown) - BASELINE + 1, F.lit(1)), F.lit(BASELINE))).otherwise(base)
        row = F.struct(x["cycle"].cast("long").alias("cycle"), limit.alias("similarity_limit"), similar.alias("too_similar"), F.size(base).alias("baseline"))
        return F.struct(keep.alias("base"), F.concat(acc["out"], F.array(row)).alias("out"))

    return ordered.select(session, F.explode(F.aggregate("xs", start, step, lambda acc: acc["out"])).alias("x")).select(session, "x.cycle", F.round("x.similarity_limit", 6).alias("similarity_limit"), "x.too_similar", "x.baseline")
