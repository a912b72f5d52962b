"""The audit ledger and the generation loop as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.measure import HEALTHY, LEAST_SLOPE, PERSIST, QUICKER, WINDOW

LEDGER = "key string, `from` string, `to` string, `by` string, at string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A directory of JSON lines as it grows; corrupt lines come as nulls in a
    column of their own and a last line without its end waits for the next file."""
    return spark.readStream.schema(LEDGER + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def records(ledger: DataFrame) -> DataFrame:
    """``key, to, have``: audit records by key and state, kept up to date."""
    return ledger.where("key is not null").groupBy("key", "to").agg(F.count("*").alias("have"))


def each_batch(df: DataFrame, checkpoint: str, cycle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a generation cycle for each micro-batch. The batch number is the
    cycle's: a batch that is replayed after a failure overwrites its own result."""
    q = df.writeStream.outputMode(mode).foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def run_to_end(df: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """What is there now, through the streaming engine, as a table under ``path``:
    in complete mode the last batch's rows, else those of all. The checkpoint
    beside it makes the next call go on where this one ended."""
    spark, out = df.sparkSession, f"{path}/rows"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    each_batch(df, f"{path}/checkpoint", put, mode)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(df.schema).parquet(out).select(*df.columns) if there else spark.createDataFrame([], df.schema)


def once(df: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Idempotent replay: the first row of each key within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _counted(df: DataFrame, window, by: list[str]) -> DataFrame:
    out = df.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def windowed(df: DataFrame, time: str, length: str, slide: str | None = None, delay: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """``start, end, by, n``: counts in tumbling windows, or sliding ones where
    ``slide`` is given; late rows beyond the delay go."""
    return _counted(df.withWatermark(time, delay), F.window(time, length, slide), list(by))


def sessions(df: DataFrame, time: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    """``start, end, by, n``: counts in sessions of ``by`` that a ``gap`` ends."""
    return _counted(df.withWatermark(time, delay), F.session_window(time, gap), [by])


def erosion_loop(cycles: DataFrame) -> DataFrame:
    """``session, cycle, streak, eroding`` as cycles ``session, cycle, novelty,
    submitted, target`` come in: what ``measure.erosion`` gives over all of them.

    The state of a session is its last novelties and its streak, whatever the
    number of cycles; cycles of one batch are taken in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, streak = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(batches).sort_values("cycle")
        out = []
        for r in rows.itertuples():
            if not pd.isna(r.novelty):
                recent = [*recent, float(r.novelty)][-WINDOW:]
            quick = False
            if len(recent) == WINDOW and not (r.target > 0 and r.submitted < HEALTHY * r.target):
                middle = WINDOW // 2
                early, late = (recent[0] - recent[middle]) / middle, (recent[middle] - recent[-1]) / (WINDOW - 1 - middle)
                quick = late > LEAST_SLOPE and late >= (1 + QUICKER) * max(early, LEAST_SLOPE)
            streak = streak + 1 if quick else 0
            out.append((key[0], int(r.cycle), streak, streak >= PERSIST))
        state.update((recent, streak))
        yield pd.DataFrame(out, columns=["session", "cycle", "streak", "eroding"])

    return cycles.groupBy("session").applyInPandasWithState(step, "session string, cycle long, streak long, eroding boolean", "recent array<double>, streak long", "append", GroupStateTimeout.NoTimeout)


def wipe(spark: SparkSession, path: str, session: str) -> None:
    """A session's end: its partition of a state table goes, all others stay."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/session={session}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
