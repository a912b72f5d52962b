"""Registered queries through the streaming engine, and SQL over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoint import shared_dir
from ..sources import lift
from ..streaming import audit, ledger
from .registry import query
from .write_queries import CYCLES, _cycles


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex}"


def _streamed(rows: DataFrame, what: str, files: int = 3) -> DataFrame:
    """``rows`` as files of a folder that a stream reads, a file a batch."""
    path = _folder(rows.sparkSession, what)
    rows.coalesce(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(spark, d) -> DataFrame:
    return lift.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def _named(df: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.withColumns({"start": at("start"), "end": at("end")})


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_events(spark, d):
    s = audit.windowed(_streamed(_events(spark, d), "events"), "ts", "1 hour")
    return _named(audit.run_to_end(s, _folder(spark, "tumbling")))


@query("""WITH w AS (SELECT event_type, date_trunc('hour', ts) - to_hours(k) AS s FROM events, (VALUES (0), (1)) t(k)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_events(spark, d):
    s = audit.windowed(_streamed(_events(spark, d), "events"), "ts", "2 hours", "1 hour")
    return _named(audit.run_to_end(s, _folder(spark, "sliding")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    s = audit.sessions(_streamed(_events(spark, d), "events"), "ts", "6 hours", "user_id")
    return _named(audit.run_to_end(s, _folder(spark, "sessions")))


@query("SELECT DISTINCT user_id FROM events")
def replay_once(spark, d):
    """Requests by user: within a watermark of ten years each is answered once."""
    s = audit.once(_streamed(_events(spark, d), "events"), "user_id", "ts", "3650 days")
    return audit.run_to_end(s, _folder(spark, "once"), "append").select("user_id")


@query(CYCLES + """, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY cycle) AS i, count(novelty) OVER (PARTITION BY session ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS c FROM h),
v AS (SELECT session, c, novelty AS x FROM k WHERE novelty IS NOT NULL),
s AS (SELECT k.*, submitted < 0.6 * target AS under, (v4.x - v2.x) / 2 AS e, (v2.x - v0.x) / 2 AS r FROM k LEFT JOIN v v0 ON v0.session = k.session AND v0.c = k.c LEFT JOIN v v2 ON v2.session = k.session AND v2.c = k.c - 2 LEFT JOIN v v4 ON v4.session = k.session AND v4.c = k.c - 4),
q AS (SELECT *, coalesce(NOT under AND e IS NOT NULL AND r > 0.005 AND r >= 1.5 * greatest(e, 0.005), false) AS acc FROM s),
z AS (SELECT *, i - coalesce(max(CASE WHEN NOT acc THEN i END) OVER (PARTITION BY session ORDER BY cycle ROWS UNBOUNDED PRECEDING), 0) AS streak FROM q)
SELECT session, cycle, streak, streak >= 2 AS eroding FROM z""")
def erosion_stream(spark, d):
    """The cycles in three files, one after another in time."""
    c = _cycles(spark, d).repartitionByRange(3, "cycle").sortWithinPartitions("cycle")
    path = _folder(spark, "cycles")
    c.withColumn("_p", F.spark_partition_id()).write.parquet(f"{path}-all")
    for part in range(3):
        spark.read.parquet(f"{path}-all").where(F.col("_p") == part).drop("_p").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return audit.run_to_end(audit.erosion_loop(stream), _folder(spark, "erosion"), "append")


@query("""SELECT 'user-' || user_id AS key, event_type AS "to", count(*) AS have FROM events GROUP BY ALL""")
def ledger_folded(spark, d):
    """The events as a ledger of JSON lines that grows between two folds."""
    said = F.to_json(F.struct(F.concat(F.lit("user-"), "user_id").alias("key"), F.col("event_type").alias("to"), F.col("ts").cast("string").alias("at")))
    e = lift.table(spark, d, "events").select("event_id", said.alias("value"))
    path, folder = _folder(spark, "ledger"), _folder(spark, "ledger-folds")
    for part in range(2):
        e.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(path)
        out = ledger.fold(spark, path, folder)
    return out
