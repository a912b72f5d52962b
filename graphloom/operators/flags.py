"""Flags that persist from one projection to the next.

An item that failed or was rejected is flagged when source text that shares a term
with it changes, and stays so while it is in such a state, whatever else changes.
An edge with a verdict from a text is flagged when its span is found no more, and
stays so until the span is found again or the edge has another state. With the
sources as they were, only edges of changed notes are looked for in them again.

Items are told by ``kind`` and ``id``; flags have ``since``, the projection that
raised them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FAILURE
from .spans import span_verified

KEY = ["kind", "id"]
# The verdicts that stand on a span.
TEXT_VERDICTS = ("grounded", "failed")


def none(df: DataFrame) -> DataFrame:
    """No flags yet, for items keyed as in ``df``."""
    return df.select(*KEY, F.lit(0).cast("long").alias("since")).where("false")


def re_examinable(prior: DataFrame, items: DataFrame, changed_terms: DataFrame, now: int) -> DataFrame:
    """The flags after projection ``now``: ``items`` has ``kind, id,
    epistemic_state, terms`` (an array), ``changed_terms`` ``term``."""
    failed = items.where(F.col("epistemic_state").isin(*FAILURE))
    shared = failed.select(*KEY, F.explode(F.array_distinct("terms")).alias("term")).join(changed_terms.select("term").distinct(), "term", "left_semi")
    fresh = shared.select(*KEY, F.lit(now).cast("long").alias("since"))
    return prior.unionByName(fresh).groupBy(*KEY).agg(F.min("since").alias("since")).join(failed.select(*KEY), KEY, "left_semi")


def stale(prior: DataFrame, edges: DataFrame, sources: DataFrame, now: int, changed: DataFrame | None = None) -> DataFrame:
    """The flags after projection ``now``. ``edges`` has ``kind, id,
    epistemic_state, provenance, norm_span, source_file``, ``sources`` ``name,
    norm``. ``changed`` (``kind, id``) says that the sources are as before and only
    those edges are not; without it all edges are looked for again."""
    claims = edges.where(F.col("epistemic_state").isin(*TEXT_VERDICTS) & (F.col("provenance") == "span-present"))
    asked = claims if changed is None else claims.join(changed, KEY, "left_semi")
    lost = span_verified(asked, sources).where("not verified").select(*KEY)
    raised = lost.join(prior, KEY, "left").select(*KEY, F.coalesce("since", F.lit(now)).cast("long").alias("since"))
    if changed is None:
        return raised
    return prior.join(claims.select(*KEY), KEY, "left_semi").join(changed, KEY, "left_anti").unionByName(raised)
