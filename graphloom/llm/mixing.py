"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Documents get rates ``r`` that
minimise the entropy ``sum size * (r log r - r)`` under these token constraints:
each source meets its target, no rate exceeds ``CAP``, and (as soft
constraints) each band of document lengths keeps its share of the words, so
that no source meets its target with short or with long documents alone.

The dual is convex and the rates are exponential tilts,
``r = min(CAP, exp(lambda[source] + mu[band]))``. Newton's method solves it:
each iteration is one distributed aggregation over the cells (source, band).
As the Hessian's source block is diagonal, it is eliminated in that
aggregation, and only the Schur complement over the bands (at most ``BANDS``
squared numbers) comes to the driver.

Rates are then rounded into whole copies. Within a source, cells of one size
take turns from the largest size down; each rounds its number of extra copies
and hands the words left over to the next, so a source misses its target by at
most about half of its smallest sizes. Which documents of a cell get the extra
copy is decided by the rank of their ids' hashes.

Null texts have size 0, take nothing and keep one copy. Sources are told apart
by code point, null is a source of its own and comes last. Rows with one id
are told apart only by rank. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_rank, stored, word_count

CAP = 3.0
BANDS = 48
ITERATIONS = 60
#: Parts of the gradient and Hessian that reach the driver in an iteration.
TASKS = 64
TOLERANCE = 1e-7
OUT = ("size", "source_size", "target", "rate", "copies", "taken")
#: Strength of the soft constraints on bands.
SOFT = 4.0


def targets(cells: DataFrame, weights: tuple[float, ...], cap: float = CAP) -> DataFrame:
    """``source``, its 0-based rank ``sid``, ``source_size`` and ``target``. A
    source is "=" and its name, and "" stands for null.

    Sources share all words by their weights, which repeat in code-point order.
    A target stops at ``cap`` times its source's size and the excess is shared
    anew: all targets are min(cap * size, weight * level) for one level, found
    by ordering the sources by the level at which they saturate.
    """
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source") == "", F.encode("source", "utf-8"))
    per = per.withColumn("sid", (F.row_number().over(order) - 1).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("full", F.col("source_size") * cap / F.col("weight"))
    by = Window.orderBy("full", "sid")
    everything = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # The level if exactly the sources before this one are saturated.
    total = F.sum("source_size").over(everything)
    spent = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - spent) / open_weight)
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "sid", "level"))).over(everything)
    per = per.withColumn("level", first["level"])
    target = F.least(F.col("source_size") * cap, F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return per.select("source", "sid", "source_size", target.alias("target"))


def tilts(tokens: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float = CAP) -> np.ndarray:
    """For each row of ``tokens`` (sources by bands) the lambda at which
    ``sum tokens * min(cap, exp(lambda + mu))`` is its target; the sum is
    monotone in lambda, so bisection holds what Newton's steps may leave."""
    full, top = tokens.sum(1), math.log(cap)
    low, high = np.full(len(target), -700.0), np.full(len(target), top - mu.min())
    lam = np.log(np.clip(target / np.maximum(full, 1e-300), 1e-300, cap))
    for _ in range(200):
        e = np.minimum(top, lam[:, None] + mu)
        g = tokens * np.exp(e)
        miss, slope = g.sum(1) - target, np.where(e < top, g, 0.0).sum(1)
        low, high = np.where(miss < 0, lam, low), np.where(miss > 0, lam, high)
        if np.all(np.abs(miss) <= 1e-10 * np.maximum(target, 1.0)) or np.all(high - low < 1e-13):
            break
        step = lam - np.divide(miss, slope, out=np.full_like(miss, np.inf), where=slope > 1e-9)
        lam = np.where((step > low) & (step < high), step, (low + high) / 2)
    return np.where(target >= cap * full * (1 - 1e-12), high, np.where(target > 0, lam, low))


def solve(cells: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``sid, lam`` and mu, from cells ``sid, band, tokens, target``.

    Newton's method on mu; at each mu the sources' own lambdas follow. One
    iteration is one pass over the sources, each task adding up its sources'
    parts of the gradient and of the Hessian's Schur complement.
    """
    by_band = F.map_from_entries(F.collect_list(F.struct("band", "tokens")))
    sources = stored(cells.groupBy("sid").agg(F.first("target").alias("target"), by_band.alias("m")).select("sid", "target", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("tokens")), "mix-sources")

    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.stack(pdf["tokens"].to_numpy()).astype(float), pdf["target"].to_numpy(float)

    def parts(mu: np.ndarray):
        def run(pdfs):
            grad, hess, total, spent = np.zeros(BANDS), np.zeros((BANDS, BANDS)), np.zeros(BANDS), 0.0
            for pdf in pdfs:
                if len(pdf):
                    tokens, target = arrays(pdf)
                    e = np.minimum(math.log(CAP), tilts(tokens, target, mu)[:, None] + mu)
                    g = tokens * np.exp(e)
                    h = np.where(e < math.log(CAP), g, 0.0)
                    grad += g.sum(0)
                    hess += np.diag(h.sum(0)) - (h / np.maximum(h.sum(1, keepdims=True), 1e-300)).T @ h
                    total += tokens.sum(0)
                    spent += target.sum()
            yield pd.DataFrame({"x": [np.concatenate([grad, hess.ravel(), total, [spent]])]})

        return run

    mu = np.zeros(BANDS)
    for _ in range(ITERATIONS):
        sums = sources.coalesce(TASKS).mapInPandas(parts(mu), "x array<double>").toPandas()["x"]
        x = np.sum(np.stack(sums.to_numpy()), axis=0) if len(sums) else np.zeros(BANDS * (BANDS + 2) + 1)
        grad, hess, total, spent = x[:BANDS], x[BANDS : BANDS * (BANDS + 1)].reshape(BANDS, BANDS), x[-BANDS - 1 : -1], x[-1]
        ridge = max(spent, 1.0) / SOFT / BANDS
        wanted = total / max(total.sum(), 1.0) * spent
        step = np.clip(-np.linalg.solve(hess + ridge * np.eye(BANDS), grad - wanted + ridge * mu), -1.0, 1.0)
        mu = mu + step
        if np.abs(step).max() < TOLERANCE:
            break

    def own(pdfs):
        for pdf in pdfs:
            if len(pdf):
                yield pd.DataFrame({"sid": pdf["sid"], "lam": tilts(*arrays(pdf), mu)})

    return sources.mapInPandas(own, "sid long, lam double"), mu


def _round(cap: float):
    """Per source, from large sizes to small: copies that all documents of a
    size get, and how many of them get one more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        target, got = float(pdf["target"].iloc[0]) if len(pdf) else 0.0, 0.0
        planned = float((pdf["size"] * pdf["n"] * pdf["rate"]).sum())
        factor = target / planned if planned > 0 else 0.0
        base, extra, due = [], [], 0.0
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            due += size * n * rate * factor
            copies = min(max(int(math.floor((due - got) / size + 0.5)), 0), int(cap) * int(n))
            base.append(copies // int(n))
            extra.append(copies % int(n))
            got += copies * size
        return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "base": base, "extra": extra})

    return run


def mix(df: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) with ``size``, ``source_size``,
    ``target``, ``rate``, ``copies`` and ``taken`` = copies * size, a row each.
    Carried columns with the name of one of these give way to it."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in OUT]
    base = df.select(F.struct(*carry).alias("_row"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"), F.col(id_col).alias("_id"), word_count(text_col).alias("size"))
    if text_col not in carry:
        base = stored(base, "mix-sizes")
    counts = stored(base.groupBy(F.col("_source").alias("source"), "size").agg(F.count("*").alias("n")), "mix-cells")
    goals = stored(targets(counts, weights), "mix-targets")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    # Bands are octaves of size; a cell's number of rows is bounded by sources and sizes, not by documents.
    band = F.least(F.lit(BANDS - 1), F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))))).cast("int")
    sized = counts.where("size > 0").join(goals, "source").select("sid", "size", "n", "target", band.alias("band"))
    sized = stored(sized, "mix-sized")
    cells = stored(sized.groupBy("sid", "band").agg(F.sum((F.col("size") * F.col("n")).cast("double")).alias("tokens"), F.first("target").alias("target")), "mix-bands")
    dual, mu = solve(cells)
    tilt = F.array(*[F.lit(float(x)) for x in mu])
    rates = sized.join(dual, "sid").withColumn("rate", F.least(F.lit(CAP), F.exp(F.col("lam") + F.element_at(tilt, F.col("band") + 1)))).select("sid", "size", "n", "target", "rate")
    plan = rates.groupBy("sid").applyInPandas(_round(CAP), "sid long, size long, base long, extra long")
    plan = stored(plan.join(rates.select("sid", "size", "rate"), ["sid", "size"]), "mix-plan")
    info = goals.join(plan, "sid", "left").select("source", "source_size", F.col("target"), F.col("size").alias("_size"), "rate", "base", "extra")
    ranked = salted_rank(base, ["_source", "size"], [F.xxhash64(F.col("_id").cast("string")), F.col("_id")], rows)
    joined = ranked.join(info, (ranked["_source"] == info["source"]) & (ranked["size"] == info["_size"]), "left")
    sizes = goals.select(F.col("source").alias("_s"), F.col("source_size").alias("_z"), F.col("target").alias("_t"))
    zero = joined["_size"].isNull()
    joined = joined.join(sizes, joined["_source"] == sizes["_s"], "left")
    copies = F.when(zero, F.lit(1)).otherwise(F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")).cast("int")
    out = joined.select("_row.*", ranked["size"].cast("long").alias("size"), F.col("_z").cast("long").alias("source_size"), F.col("_t").cast("double").alias("target"), F.coalesce("rate", F.lit(1.0)).alias("rate"), copies.alias("copies"))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as its ``copies``."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")

