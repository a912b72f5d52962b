"""Text functions: slugs, ids, normalisation, terms, n-grams, sections, IDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Device names that a file may not have.
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9")
# Curly quotes, dashes and the no-break space with what they fold to.
FOLDS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug_signature(value: str | Column) -> Column:
    """A slug before its ends are trimmed; tells apart labels of one slug."""
    s = F.lower(F.trim(_col(value)))
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s-]", "-"), r"(?U)[\s_-]+", "-")


def slug(value: str | Column) -> Column:
    """A file-safe name. What is one already, nearly every id, costs one match."""
    plain = _col(value).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")
    s = F.regexp_replace(slug_signature(value), "^-+|-+$", "")
    device = lambda x: x.isin(*RESERVED)
    own = F.when(device(_col(value)), F.concat(_col(value), F.lit("-"))).otherwise(_col(value))
    return F.when(plain, own).when(s == "", "node").when(device(s), F.concat(s, F.lit("-"))).otherwise(s)


def edge_id(source: str | Column, relation: str | Column, target: str | Column) -> Column:
    return edge_id_of_slugs(slug(source), slug(relation), slug(target))


def edge_id_of_slugs(source: str | Column, relation: str | Column, target: str | Column) -> Column:
    return F.concat(F.lit("e_"), _col(source), F.lit("__"), _col(relation), F.lit("__"), _col(target))


def normalize_py(text: str | None) -> str | None:
    """NFC, format characters dropped, typographic quotes and dashes folded,
    white space collapsed, case folded."""
    if text is None:
        return None
    t = unicodedata.normalize("NFC", text).replace("İ", "i")
    t = "".join(FOLDS.get(c, c) for c in t if unicodedata.category(c) != "Cf")
    return " ".join(t.split()).casefold()


@F.pandas_udf(T.StringType())
def normalize_udf(s: pd.Series) -> pd.Series:
    return s.map(normalize_py)


def normalize(value: str | Column) -> Column:
    """Normalised text. Plain ASCII, nearly everything, stays in the JVM; the
    Python path runs only where normal forms and case folding need it."""
    c = _col(value)
    ascii_ = F.trim(F.lower(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")))
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), ascii_).otherwise(normalize_udf(F.when(~c.rlike(r"^[\x00-\x7f]*$"), c)))


def words(value: str | Column) -> Column:
    """Terms that keep ``-`` and ``_``, ASCII, lower case."""
    return F.regexp_extract_all(F.lower(_col(value)), F.lit(r"[a-z][a-z0-9_-]{1,}"), F.lit(0))


def terms(value: str | Column, least: int = 3) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(_col(value)), F.lit(r"[\p{L}\p{N}]{%d,}" % least), F.lit(0))


def ngrams(tokens: Column, n: int = 3) -> Column:
    """All n-grams of an array of words, joined by one space. The words are bound
    to a variable, else Spark makes them anew for each n-gram."""

    def grams(t: Column) -> Column:
        last = F.size(t) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), grams)[0]


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, section, title, body``: text split at level-2 headings outside
    fences; section 0 is what precedes the first. Blank sections go.

    Lines are numbered within their text by array functions, so no shuffle.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "^﻿", ""), "\r\n?", "\n")
    start = F.struct(F.array().cast("array<struct<title:string,body:string>>").alias("done"), F.lit("").alias("title"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("fenced"))

    def close(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["title"].alias("title"), F.array_join(acc["lines"], "\n").alias("body"))))

    def step(acc: Column, line: Column) -> Column:
        fence = F.ltrim(line).rlike("^(```|~~~)")
        head = ~acc["fenced"] & line.startswith("## ")
        return F.struct(F.when(head, close(acc)).otherwise(acc["done"]).alias("done"), F.when(head, F.trim(F.substring(line, F.lit(4), F.length(line)))).otherwise(acc["title"]).alias("title"), F.when(head, F.array().cast("array<string>")).otherwise(F.concat(acc["lines"], F.array(line))).alias("lines"), (acc["fenced"] != fence).alias("fenced"))

    plain = F.array(F.struct(F.lit("").alias("title"), text.alias("body")))
    parsed = F.when(text.rlike("(?m)^## "), F.aggregate(F.split(text, "\n"), start, step, close)).otherwise(plain)
    return df.select(id_col, F.posexplode(parsed).alias("section", "s")).select(id_col, "section", F.col("s.title").alias("title"), F.col("s.body").alias("body")).where("trim(concat(title, body)) <> ''")


def idf(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """``term, df, idf``: ln(n / (1 + df)) + 1 over distinct documents."""
    n = docs.agg(F.count("*").alias("n"))
    per = docs.select(doc_col, F.explode(F.array_distinct(words(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return per.crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))


def specificity(labels: DataFrame, id_col: str, label_col: str, seeds: DataFrame) -> DataFrame:
    """``id_col, specificity``: mean seed of a label's terms, repeats counted;
    unknown terms and labels without terms get the mean of all seeds."""
    default = seeds.agg(F.avg("seed").alias("default"))
    t = labels.select(id_col, F.explode_outer(words(label_col)).alias("term"))
    return t.join(seeds.select("term", "seed"), "term", "left").crossJoin(F.broadcast(default)).groupBy(id_col).agg(F.avg(F.coalesce("seed", "default")).alias("specificity"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")
