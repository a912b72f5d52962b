"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes. ``np.repeat`` of token indices over their
byte lengths says which token of A, and which of B, owns each byte. Wherever
the pair of owners changes a new overlap (a link) begins; where both change at
once both sides are cut, and the tokens between two cuts are a group.

A is a byte-level BPE (a JSON file of the ``tokenizers`` library), B a
sentencepiece model with byte fallback. A sees a space before the text, which B
adds itself. Both read strings of special tokens as plain text.

The count of a pair of ids is the number of documents that hold it linked.
Texts are tokenised once; each document's distinct pairs are stored, summed up
in the tasks and then by pair. The most frequent pairs, ``HOT_PAIRS`` at most,
are broadcast, with each A id's highest count (one number per id of A). All
other pairs are joined with their counts by a shuffle: none of them is in more
than a ``HOT_PAIRS``-th of all links, so none is a hot key.

Null and empty texts, those that are not UTF-8, and those whose tokens do not
give back the text's bytes have no tokens: zeros and an empty digest. Long
texts are cut at single spaces between letters or digits, where neither
tokenizer merges, so the ids are those of the whole text. Repeated rows and
repeated ids are documents of their own and count as such. Columns that clash
with the results give way. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import small_batches, stored, text_bytes

#: The most pairs that are broadcast, at 12 bytes each.
HOT_PAIRS = 1 << 22
#: Pairs that a task gathers before it passes their counts on.
FLUSH = 1 << 22
PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 22
#: The pattern that byte-level BPE of this family splits texts by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_TRIED = [" Don't we'll", " a  b\n\n c\t d ", " naïve ÉCOLE 12,345", " <|endoftext|>", " x　y 中文 \U0001f600", " \x00\r\n end "]


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level BPE writes the 256 bytes: printable
    ones stand for themselves, the others for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(text: str) -> list[str]:
    """``text`` in pieces of about PIECE_CHARS, without the spaces between."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        m = _CUT.search(text, at + PIECE_CHARS)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


class Tokenizers:
    """A and B with the bytes of their tokens, and how ids are written."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(a_path)
        self.plain.encode_special_tokens = True
        byte, special = byte_symbols(), set(self.plain.get_added_tokens_decoder())
        vocab = {i: t for t, i in self.plain.get_vocab().items()}
        self.a_bytes = [b"" if i in special or i not in vocab else bytes(byte[c] for c in vocab[i]) for i in range(max(vocab) + 1)]
        ranks = {t: i for i, t in enumerate(self.a_bytes) if t}
        # Merges are ordered by id, so a quicker library makes the same ones; tried first.
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if any(self.quick.encode_ordinary(t) != self.plain.encode(t, add_special_tokens=False).ids for t in _TRIED):
            self.quick = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.b_cut = not any(re.search("[^▁]▁", t) for t in names)  # else B merges over spaces, and texts stay whole
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.size_a, self.size_b = len(self.a_bytes), len(self.b_bytes)
        written = [b"%d%s" % (i, end) for n, ends in ((self.size_a, (b",", b"|")), (self.size_b, (b",", b";"))) for end in ends for i in range(n)]
        self.written = np.array(written, object)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B, or None where they do not give the bytes back."""
        try:
            s = text.decode()
        except UnicodeDecodeError:
            return None
        if not s:
            return None
        a: list[int] = []
        b: list[int] = []
        cut = pieces(s) if self.b_cut else [s]
        for p in cut:
            a += self.quick.encode_ordinary(" " + p) if self.quick else self.plain.encode(" " + p, add_special_tokens=False).ids
            b += self.b.encode(p, num_threads=1)
        whole = b" " + text
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Aligned:
    """Several encoded documents, aligned at once: both tokenizers end a token
    at the end of a document, so no group goes over it.

    ``a``, ``b``: the token indices of each link; ``group_a``, ``group_b``: of
    each token its group.
    """

    def __init__(self, t: Tokenizers, docs: list[tuple[np.ndarray, np.ndarray]]):
        self.ids_a, self.ids_b = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        self.ends_a, self.ends_b = (list(accumulate(len(d[k]) for d in docs)) for k in (0, 1))
        own_a = np.repeat(np.arange(len(self.ids_a), dtype=np.int32), t.a_len[self.ids_a])
        own_b = np.repeat(np.arange(len(self.ids_b), dtype=np.int32), t.b_len[self.ids_b])
        new_a, new_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
        new_a[1:], new_b[1:] = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        at = np.flatnonzero(new_a | new_b)
        self.a, self.b = own_a[at], own_b[at]
        group = np.cumsum(new_a[at] & new_b[at]) - 1
        self.group_a, self.group_b = group[new_a[at]], group[new_b[at]]
        self.links = np.searchsorted(self.a, self.ends_a)  # of each document, where its links end
        self.groups = self.group_a[np.array(self.ends_a) - 1] + 1

    def written(self, t: Tokenizers) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        key = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])
        code = np.concatenate([self.ids_a, self.ids_b + 2 * t.size_a])
        size = np.repeat([t.size_a, t.size_b], [len(self.ids_a), len(self.ids_b)])
        order = np.argsort(key, kind="stable")
        key, code, size = key[order], code[order], size[order]
        last = np.ones(len(key), bool)
        last[:-1] = key[1:] != key[:-1]
        text = t.written[code + size * last].tolist()
        at = 0
        for end in (x + y for x, y in zip(self.ends_a, self.ends_b, strict=True)):
            yield b"".join(text[at:end])[:-1]
            at = end


def _some(column: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
    """The non-empty texts of a batch with their places, some bytes at a time."""
    held, n = [], 0
    for k, text in enumerate(column):
        text = text.as_py()
        if text:
            held.append((k, text))
            n += len(text)
        if n >= BATCH_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _encoded(t: Tokenizers, column: pa.Array) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    for some in _some(column):
        got = [(k, e) for k, text in some if (e := t.encode(text)) is not None]
        if got:
            yield [k for k, _ in got], [e for _, e in got]


def _carried(df: DataFrame, keep: list[str] | None, new: list[str]) -> list[str]:
    return [c for c in (df.columns if keep is None else keep) if c not in new]


def groups(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``groups``: the ids of A and of B
    in each group, in order; null for a text without tokens."""
    small_batches(df.sparkSession)
    keep = _carried(df, keep, ["groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        for batch in batches:
            out: list[list[dict] | None] = [None] * batch.num_rows
            for places, docs in _encoded(t, batch.column(batch.num_columns - 1)):
                for k, doc in zip(places, docs, strict=True):
                    x = Aligned(t, [doc])
                    cut_a, cut_b = (np.flatnonzero(np.diff(g)) + 1 for g in (x.group_a, x.group_b))
                    out[k] = [{"a": a.tolist(), "b": b.tolist()} for a, b in zip(np.split(x.ids_a, cut_a), np.split(x.ids_b, cut_b), strict=True)]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "groups"])

    schema = df.select(*keep).withColumn("groups", F.lit(None).cast("array<struct<a:array<int>,b:array<int>>>")).schema
    return df.select(*keep, text_bytes(text_col).alias("_graphloom_bytes")).mapInArrow(run, schema)


def _linked(df: DataFrame, a_path: str, b_path: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` with the digest of each document, its distinct pairs (as a id *
    size of B + b id, sorted, 64 bits) and how often each is linked in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        for batch in batches:
            counts = np.zeros((4, batch.num_rows), np.int64)
            sha, pairs, times = [""] * batch.num_rows, [b""] * batch.num_rows, [b""] * batch.num_rows
            for places, docs in _encoded(t, batch.column(batch.num_columns - 1)):
                x = Aligned(t, docs)
                counts[:, places] = [np.diff(e, prepend=0) for e in (x.ends_a, x.ends_b, x.groups, x.links)]
                pair = x.ids_a[x.a] * t.size_b + x.ids_b[x.b]
                for k, text, start, end in zip(places, x.written(t), [0, *x.links[:-1].tolist()], x.links.tolist(), strict=True):
                    sha[k] = hashlib.sha256(text).hexdigest()
                    distinct, n = np.unique(pair[start:end], return_counts=True)
                    pairs[k] = np.diff(distinct, prepend=0).astype("<u4").tobytes()  # below 2**32: tokenizers of that size are refused
                    times[k] = n.astype("<u4").tobytes()
            made = [*map(pa.array, counts), pa.array(sha, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_times"])

    schema = df.select(*keep).schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("_pairs", "binary").add("_times", "binary")
    return df.select(*keep, text_bytes(text_col).alias("_graphloom_bytes")).mapInArrow(run, schema)


def _read(binary: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(binary, "<u4"), dtype=np.int64)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, docs``: in how many documents each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept, n, size = np.empty(0, np.int64), np.empty(0, np.int64), 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            all_pairs = np.concatenate([kept, *held])
            pairs, at = np.unique(all_pairs, return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n, np.ones(len(all_pairs) - len(kept), np.int64)])).astype(np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kept), pa.array(n)], names=["pair", "docs"])

        for batch in batches:
            for p in batch.column(0):
                if p := p.as_py():
                    held.append(_read(p))
                    size += len(held[-1])
                if size >= FLUSH:
                    kept, n = summed()
                    held, size = [], 0
                    if len(kept) >= FLUSH:
                        yield sent()
                        kept, n = kept[:0], n[:0]
        kept, n = summed()
        yield sent()

    return linked.select("_pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _threshold(counts: DataFrame) -> int:
    """The least power of two that no more than HOT_PAIRS pairs reach."""
    bits = F.length(F.bin("docs"))
    reached = 0
    for r in sorted(counts.groupBy(bits.alias("bits")).count().collect(), reverse=True):  # 63 rows at most
        reached += r["count"]
        if reached > HOT_PAIRS:
            return 1 << r["bits"]
    return 1


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``n_a``, ``n_b`` (tokens),
    ``n_groups``, ``n_links``, ``n_best`` (links whose pair's count is the
    highest of their A id), ``count_sum`` (of counts over links) and
    ``groups_sha256``."""
    spark = df.sparkSession
    small_batches(spark)
    t = tokenizers(a_path, b_path)
    size_b = t.size_b
    if t.size_a * size_b > 1 << 32:
        raise ValueError("pairs of these tokenizers' ids do not fit into 32 bits")
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    keep = _carried(df, keep, new)
    linked = stored(_linked(df, a_path, b_path, text_col, keep).withColumn("_row", F.monotonically_increasing_id()), "links")
    counts = stored(pair_counts(linked), "pair-counts")
    a_id = F.floor(F.col("pair") / size_b).cast("int")
    top = np.zeros(t.size_a, np.int64)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("best"))
    found = best.toPandas()  # a row for each id of A at most
    top[found["a"].to_numpy(np.int64)] = found["best"].to_numpy(np.int64)
    least = _threshold(counts)
    hot = counts.where(F.col("docs") >= least).toArrow() if least > 1 else counts.toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((hot["pair"].to_numpy()[order].astype(np.uint32), hot["docs"].to_numpy()[order], top))
    alone = least <= 2  # then every other pair is in one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_pairs, hot_docs, best_of = sent.value
        for batch in batches:
            n_best, total, rest, times = [], [], [], []
            for p, n in zip(batch.column("_pairs").to_pylist(), batch.column("_times").to_pylist(), strict=True):
                p, n = _read(p), np.frombuffer(n, "<u4").astype(np.int64)
                docs = np.ones(len(p), np.int64)
                known = np.zeros(len(p), bool)
                if len(hot_pairs) and len(p):
                    at = np.minimum(np.searchsorted(hot_pairs, p.astype(np.uint32)), len(hot_pairs) - 1)
                    known = hot_pairs[at] == p
                    docs[known] = hot_docs[at[known]]
                if alone:
                    known[:] = True
                n_best.append(int(n[known & (docs == best_of[p // size_b])].sum()))
                total.append(int((n * docs)[known].sum()))
                rest.append(p[~known])
                times.append(n[~known])
            carried = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("_pairs", "_times")]
            names = [name for name in batch.schema.names if name not in ("_pairs", "_times")]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names=[*names, "n_best", "count_sum", "_rest", "_n"])

    base = linked.drop("_pairs", "_times")
    schema = base.schema.add("n_best", "long").add("count_sum", "long").add("_rest", ArrayType(LongType())).add("_n", ArrayType(LongType()))
    out = linked.mapInArrow(run, schema)
    if not alone:
        out = stored(out, "hot-links")
        ranked = counts.where(F.col("docs") < least).join(F.broadcast(best), a_id == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("best")).alias("is_best"))
        rare = out.select("_row", F.explode(F.arrays_zip("_rest", "_n")).alias("x")).select("_row", F.col("x._rest").alias("pair"), F.col("x._n").alias("n"))
        more = rare.join(ranked, "pair").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("docs")).alias("_sum"))
        out = out.join(more, "_row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return out.select(*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
