"""Connected components of a link table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 40


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select("b", "m").union(low).toDF("a", "b").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, comp``: each linked id with the smallest id it reaches.

    Alternates the large-star and small-star operations until the links are
    stars around the smallest ids; every round is written to the shared folder.
    """
    e = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        e = stored(_small_star(_large_star(e)), "links")
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())
