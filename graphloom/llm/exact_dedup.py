"""Exact deduplication by a two-pass Bloom filter, in DataFrame operations only.

Pass one hashes every text and counts, slot by slot, how many rows fall on
each slot of a Bloom filter with two hash functions. A text can be repeated
only if both its slots were hit at least twice, so the filter of such slots is
all that is kept. Pass two reads the texts again: rows that miss the filter
are unique and pass straight through, and only the others shuffle, to be
grouped by the SHA-256 of their normalised text.

A filter has at most ``MAX_SLOTS`` bits (32 MB), which bounds what is broadcast.
More rows than these serve are taken in shards, ranges of the SHA-256 with a
filter each: the hashes are stored sorted, so a shard reads little more than
its own. Where the texts themselves are carried along, one filter serves all
rows, as reading all texts once a shard would cost more than it saves; beyond
what it can tell apart more rows shuffle, and the result is the same.

Texts with a thousandth of the rows or more, at most a thousand, are told to
all tasks, and their copies stay where they are; copies of other texts meet by
their hash.

Nulls count as empty text; an empty table gives an empty table; very long texts
count whole. Rows equal in text and id are ranked among
themselves, so exactly one row of a group stays. Rows with a null id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, new_path, stored

SLOTS_PER_ROW = 16
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 28
HASHES = 2
#: Texts with one in so many rows or more are hot.
HOT = 1000
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACE, " ")


def text_sha256(column: str = "text") -> Column:
    return F.sha2(normalised(column).cast("binary"), 256)


def _slots(sha: Column, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(m)) for i in range(HASHES)]


def repeated_slots(hashes: DataFrame, m: int) -> DataFrame:
    """One row, ``bits``: 64-bit words of the filter of slots hit twice or more."""
    hit = hashes.select(F.explode(F.array(*_slots(F.col("_sha"), m))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n >= 2")
    words = hit.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    full = hashes.sparkSession.range(0, m >> 6, 1, 8).withColumnRenamed("id", "word").join(words, "word", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits"))


def _marked(base: DataFrame, hashes: DataFrame, m: int) -> DataFrame:
    """``base`` with ``_maybe``: the filter has both slots of the row's hash."""
    bitmap = stored(repeated_slots(hashes, m), "dedup-filter").scalar()
    maybe = F.lit(True)
    for s in _slots(F.col("_sha"), m):
        maybe = maybe & (F.bit_get(F.get(bitmap, F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1)
    return base.withColumn("_maybe", maybe)


def _by_shard(base: DataFrame, m: int, shards: int) -> DataFrame:
    """The same, a range of hashes and its filter after another."""
    spark, path = base.sparkSession, new_path(base.sparkSession, "dedup-marked")
    ends = [f"{(k << 32) // shards:08x}" for k in range(shards)] + ["g"]
    for k in range(shards):
        mine = base.where((F.col("_sha") >= ends[k]) & (F.col("_sha") < ends[k + 1]))
        _marked(mine, mine, m).write.option("compression", "zstd").parquet(f"{path}/{k}")
    schema = base.schema.add("_maybe", "boolean")
    return spark.read.schema(schema).parquet(*[f"{path}/{k}" for k in range(shards)])


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default), ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256`` for every row, dropped ones too. Carried columns with
    the name of one of these give way to it."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in OUT]
    base = df.select(F.struct(*carry).alias("_row"), F.col(id_col).alias("_id"), text_sha256(text_col).alias("_sha"))
    whole = text_col in carry
    if whole:
        hashes = stored(base.select("_sha"), "dedup-hashes")
    else:
        base = hashes = stored(base.sortWithinPartitions("_sha"), "dedup-hashes")
    rows = hashes.count()
    shards = 1 if whole else max(1, -(-SLOTS_PER_ROW * rows // MAX_SLOTS))
    m = MIN_SLOTS
    while m < SLOTS_PER_ROW * rows // shards and m < MAX_SLOTS:
        m *= 2
    marked = _marked(base, hashes, m) if shards == 1 else _by_shard(base, m, shards)
    single = marked.where(~F.col("_maybe")).select("_row.*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    some = marked.where("_maybe").drop("_maybe")
    if whole:
        some = stored(some, "dedup-some")  # else their texts are read and hashed for every use
    each = some.groupBy("_sha", "_id").agg(F.count("*").alias("n")).groupBy("_sha")
    groups = each.agg(F.sum("n").alias("group_size"), F.min("_id").alias("keep_id"), F.min_by("n", "_id").alias("_ties"))
    groups = stored(groups.withColumn("_ties", F.coalesce("_ties", "group_size")), "dedup-groups")
    hot = F.broadcast(groups.where(F.col("group_size") * HOT >= rows))  # at most HOT rows
    cold = groups.where(F.col("group_size") * HOT < rows)
    joined = some.join(hot, "_sha").unionByName(some.join(hot, "_sha", "left_anti").join(cold, "_sha"))
    first = F.col("_id").eqNullSafe(F.col("keep_id"))
    grouped = joined.withColumn("kept", first)
    if (groups.agg(F.max("_ties")).first()[0] or 1) > 1:  # rows equal in text and id are ranked
        tied = joined.where(first).withColumn("kept", F.row_number().over(Window.partitionBy("_sha").orderBy(F.lit(1))) == 1)
        grouped = tied.unionByName(joined.where(~first).withColumn("kept", F.lit(False)))
    return single.unionByName(grouped.select("_row.*", "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256")))
