"""Language identification by compression.

Per language a zstandard raw-content dictionary is cut from labelled texts. A
text is compressed with each dictionary, and the language whose dictionary
makes it smallest is the answer. Where the best two are closer than a margin,
``identify`` rejects the row.

A compressor finds its later matches in the text itself, so what a dictionary
saves does not grow with the text. Blocks that cover the text are compressed
on their own and their sizes added, and the margin is relative to the
compressed size: neither length nor repetition makes it smaller.

Texts that are null or have no letter get ``und`` with score 0. Rows equal in
text get equal answers; no other column is looked at. Of languages that tie the
first by name is the answer, with margin 0. Very long texts are compressed
whole, block by block. Columns that clash with those added give way to them. An
empty table gives an empty table; without any labelled text all are ``und``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

#: Bounds of the labelled sample: texts a language, characters taken of each, and
#: languages (those with the most labelled rows, then by name).
TEXTS_PER_LANGUAGE = 400
CHARS_PER_TEXT = 600
LANGUAGES = 256
LEVEL = 3
#: Longer texts are compressed in equal blocks of at most this many bytes.
BLOCK = 8192
#: Share of the second best size saved, below which a text counts as undecided.
MARGIN = 0.005


def fit(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries from a bounded sample: in each language the texts with the
    smallest hashes of their ids, of which ``CHARS_PER_TEXT`` from their middle.

    The sample has at most LANGUAGES * TEXTS_PER_LANGUAGE * CHARS_PER_TEXT
    characters, whatever the size of ``df``; repeated ids count once, with the
    least of their pieces. Samples that another language's
    dictionary compresses better are mislabelled or mixed and are left out.
    """
    rank = Window.partitionBy(lang_col).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    labelled = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    languages = labelled.groupBy(lang_col).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), lang_col).limit(LANGUAGES)
    known = labelled.select(lang_col, id_col).join(F.broadcast(languages.select(lang_col)), lang_col).distinct()
    picked = known.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= TEXTS_PER_LANGUAGE).select(lang_col, id_col)
    piece = F.expr(f"substring({text_col}, greatest(1, cast(length({text_col}) / 2 as int) - {CHARS_PER_TEXT // 2}), {CHARS_PER_TEXT})")
    sample = labelled.join(F.broadcast(picked), [lang_col, id_col]).groupBy(F.col(lang_col).alias("lang"), id_col)
    rows = sample.agg(F.min(piece).alias("piece")).collect()
    by: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], hashlib.sha1(str(r[id_col]).encode()).digest())):
        by.setdefault(r["lang"], []).append(r["piece"].encode())
    by = dict(sorted(by.items()))
    if len(by) < 2:
        return {k: b"\n".join(v) for k, v in by.items()}
    out = {}
    for lang, pieces in by.items():
        half = [compressors({k: b"\n".join(v if k != lang else [x for j, x in enumerate(v) if j % 2 != part]) for k, v in by.items()}) for part in (0, 1)]
        clean = [p for j, p in enumerate(pieces) if min(half[j % 2], key=lambda k: len(half[j % 2][k].compress(p))) == lang]
        out[lang] = b"\n".join(clean or pieces)
    return out


def compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def classify(text: bytes | None, coders: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """Language, score and margin of one text."""
    if not text or not any(c.isalpha() for c in text.decode("utf-8", "replace")):
        return "und", 0.0, 0.0
    if not coders:
        return "und", 0.0, 0.0
    n = -(-len(text) // BLOCK)
    blocks = [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]
    sizes = sorted((sum(len(z.compress(b)) for b in blocks), lang) for lang, z in coders.items())
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
    bits = [math.exp(-min(700.0, 8 * (s - sizes[0][0]) / 4)) for s, _ in sizes]
    return sizes[0][1], 1.0 / sum(bits), margin


def predict(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``lang_pred``, ``score`` and ``margin``."""
    spark = df.sparkSession
    small_batches(spark)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score", "margin")]  # clashing names give way
    model = spark.sparkContext.broadcast(dictionaries)  # bounded, see fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = compressors(model.value)
        for b in batches:
            got = [classify(t, coders) for t in b.column(b.num_columns - 1).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "lang_pred", "score", "margin"])

    source = df.select(*keep, text_bytes(text_col).alias("_graphloom_bytes"))
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("margin", "double")
    return source.mapInArrow(run, schema)


def identify(df: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """All rows with ``lang_pred``, ``score``, ``margin`` and ``rejected``: true
    for ``und`` and for texts whose best two languages are too close."""
    out = predict(df, fit(df, learn, text_col), text_col)
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < MARGIN))
