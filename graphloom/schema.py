"""Vocabularies of the graph model and expressions that coerce to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVENANCE = ("span-present", "inferred", "hypothesized")
AUTHORS = ("deterministic", "agent", "human")
STATES = ("unverified", "grounded", "rejected", "failed", "obsolete")
CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
VERDICTS = ("grounded", "rejected", "failed")
GROUNDABLE = (*VERDICTS, "obsolete")
FAILURE = ("rejected", "failed")
NON_LIVE = (*FAILURE, "obsolete")
NO_COMMUNITY = -1


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """``value`` if it is one of ``allowed``, else ``default`` (nulls too)."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def clamped_confidence(value: Column) -> Column:
    """Confidence within 0 and 1; NaN and infinities are null."""
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~bad, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def is_live(state: str | Column = "epistemic_state") -> Column:
    s = F.col(state) if isinstance(state, str) else state
    return ~s.isin(*NON_LIVE)
