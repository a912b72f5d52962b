"""The queries of the training-data operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import alignment, language, mixing, packing, partenum, pii, quality, quantiles, rules, substring_dedup, toxicity, warc
from .common import fold, stored


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    out = mixing.mix(docs, carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = packing.pack(docs, tokenizer_path(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    out = language.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return dedup.exact_dedup(docs, carry=["doc_id"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, keep=["doc_id"])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(_docs(spark, sf_dir).select("doc_id", "text"))


#: Not a secret of anyone's; a deployment brings its own.
PII_KEY = "graphloom-demonstration-key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = pii.replace(docs, PII_KEY)
    return out.select("doc_id", *[F.col(f"pii.{t}").cast("long").alias(f"n_{t}") for t in pii.PATTERNS], "text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_docs(spark, sf_dir).select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = warc.round_trip(pages)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", warc.checked(F.col("valid"), F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 4) != 2)
    out = rules.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def shop_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream, grp, batch, x, times``: what op13 summarises, equal rows of one
    item and batch as one. Of the rows of one click_id the one that arrived
    first counts (then by client and value, nulls first); a NaN is no money, a
    null id counts as an empty one, money is bound to a hundred trillion."""

    def x(money: Column, batch: Column) -> Column:
        cents = F.floor(100 * F.greatest(F.lit(-1e14), F.least(F.lit(1e14), money)) + 0.5)
        return cents.cast("long") + 1000 * batch

    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", F.struct("arrived_at", "client_id", "value").alias("r"))
    one = clicks.groupBy("click_id").agg(F.min("r").alias("r")).select("click_id", "r.client_id", "r.value")
    batch = F.coalesce(fold("click_id", 8), F.lit(0)).cast("int")
    value = one.where("client_id is not null and value is not null and not isnan(value)")
    value = value.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch.alias("batch"), x(F.col("value"), batch).alias("x"), F.lit(1).cast("long").alias("times"))
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("item_id is not null")
    of = F.coalesce(fold("vendor_id", 8), F.lit(0))
    # A row an item with a count for each batch: one shuffle serves the sum and the join.
    sold = lines.groupBy("item_id").agg(*[F.sum((of == k).cast("long")).alias(f"n{k}") for k in range(8)])
    items = spark.read.parquet(f"{sf_dir}/items.parquet").where("brand is not null and price is not null and not isnan(price)").select("item_id", "brand", "price")
    each = sold.join(items, "item_id").select("brand", "price", F.posexplode(F.array(*[f"n{k}" for k in range(8)])).alias("batch", "times")).where("times > 0")
    price = each.select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", x(F.col("price"), F.col("batch")).alias("x"), "times")
    return value.unionByName(price)


def op13_quantiles(spark: SparkSession, sf_dir: str, error_permille: int = 50, quantile_count: int = 10, least_rows: int = 20) -> DataFrame:
    by = ["stream", "grp"]
    rows = stored(shop_values(spark, sf_dir), "values")
    hot = quantiles.hot_groups(rows, by, "times")
    summary = stored(quantiles.summaries(rows, hot, by, "batch", "x", "times", whole=-1), "summaries")
    asked = stored(quantiles.answers(summary.where(F.col("n") >= least_rows), [*by, "batch"], quantile_count), "answers")
    out = quantiles.exact(rows, asked, hot, by, "batch", "x", "times", whole=-1)
    error = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto")).cast("long")
    out = out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= error_permille * F.col("n"))
    return out.select(*by, "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_rule_ensemble": op12_rule_ensemble,
    "op13_quantiles": op13_quantiles,
}

OP4_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k
  FROM n
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
