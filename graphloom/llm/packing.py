"""Packing documents into sequences by cutting-stock column generation.

Documents are tokenised, and each gets an end token. Every full sequence's
worth of a long document is a sequence of its own; what remains, shorter than
a sequence, is an item. Items are counted in a histogram of length classes (at
most ``32 * 8`` of them, lengths rounded up by 3 % at most), which is all that
the driver sees. On it a linear program over patterns (how many items of each
class go into one sequence) is solved by column generation: the duals of the
restricted program price the items, and a knapsack dynamic program finds the
pattern of most value, until none is worth more than one sequence. Patterns
are used as often as their whole part says. The k-th item of a class, by rank,
goes to the k-th place that the patterns have for that class.

Items left over (fewer than one sequence's for each pattern) are laid end to
end and cut at every sequence. So each token lies in exactly one piece.
Sequences are padded to ``capacity`` except at a power of two, which is left.

Null texts count as empty: their only token is the end token. Rows with one id
are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_rank, small_batches, stored, text_bytes

CAPACITY = 4096
END = 2
ROUNDS = 4000
#: A pattern has to be worth this much more than its cost to enter.
WORTH = 1e-6
#: The program also ends this close to the bound that no cutting can beat.
CLOSE = 5e-4
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words of these characters alone take the fast path.
_ODD = re.compile("[^!-~À-ÖØ-öø-ÿ]|<\\|")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\n0-9a-zß-öø-ÿ]+")
_END, _LINE = "\0", "\n"
_TRIED = ["Don't", "we've", "'ll", "abc123", "ÉCOLE", "größe", "x--y!!", "a1b2", "!@#$%", "The", "straße", "1,234.56", "naïve", "(see)", "e-mail@x.org"]


class WordTokens(dict):
    """Words, as split at ASCII white space, to their ids as little-endian
    16-bit integers.

    For tokenizers that lower-case, drop white space, split at letters, digits
    and other characters, merge bytes within such pieces and mark their ends
    with ``</w>``. That is tried on some words at first: where it fails, words,
    or whole texts, go to the tokenizer itself. More than 65,536 ids are
    refused. The merges are ordered by id,
    so the same merges run in a quicker library, on all new words of a batch at
    once, with a null byte for the mark. Words with characters other than ASCII
    and Latin letters go to the tokenizer itself. A dictionary of the words
    seen, forgotten when it has grown to ``most``, does the rest.
    """

    def __init__(self, tokenizer, most: int = 700_000):
        super().__init__()
        import tiktoken

        self.tokenizer, self.most = tokenizer, most
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"the tokenizer has {tokenizer.get_vocab_size()} ids; they are stored in 16 bits")
        self.apart = self.ask(" ".join(_TRIED)) == b"".join(map(self.ask, _TRIED))
        self.quick = None
        if tokenizer.get_vocab().get("\u010a") is None:
            return
        byte = _byte_symbols()
        ranks: dict[bytes, int] = {}
        for token, i in tokenizer.get_vocab().items():
            if token.startswith("<|") and token.endswith("|>"):
                continue
            body = token.removesuffix("</w>")
            ranks[bytes(byte[c] for c in body) + (b"\0" if body != token else b"")] = i
        self.line = ranks[b"\n"]
        self.quick = tiktoken.Encoding("words", pat_str="[^\\x00\n]+\\x00|\n", mergeable_ranks=ranks, special_tokens={})

        self.learn([w.encode() for w in _TRIED])
        if any(self[w.encode()] != self.ask(w) for w in _TRIED):
            self.quick = None
        self.clear()

    def ask(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, words: list[bytes]) -> None:
        if self.quick is None:
            self.update((w, self.ask(w.decode("utf-8", "replace"))) for w in words)
            return
        lines = b"\n".join(words).decode("utf-8", "replace")
        if _ODD.search(lines.replace(_LINE, "")):
            plain = []
            for w in words:
                s = w.decode("utf-8", "replace")
                if _ODD.search(s):
                    self[w] = self.ask(s)
                else:
                    plain.append(w)
            words = plain
            lines = b"\n".join(words).decode()
        if not words:
            return
        ids = np.asarray(self.quick.encode_ordinary(_PIECES.sub("\\g<0>\0", lines.lower()) + _LINE), np.int64)
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(words):
            raise ValueError("a word was not tokenised on its own")
        packed, at = ids.astype("<u2").tobytes(), 0
        for w, e in zip(words, (2 * ends).tolist(), strict=True):
            self[w] = packed[at:e]
            at = e + 2

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self) > self.most:
            self.clear()
        if not self.apart:
            return [self.ask((t or b"").decode("utf-8", "replace")) for t in texts]
        split = [(t or b"").split() for t in texts]
        found = [list(map(self.get, words)) for words in split]
        holes = [[i for i, x in enumerate(got) if x is None] if None in got else [] for got in found]
        new = {words[i] for words, at in zip(split, holes, strict=True) for i in at}
        self.learn(list(new))
        for words, got, at in zip(split, found, holes, strict=True):
            for i in at:
                got[i] = self[words[i]]
        return [b"".join(got) for got in found]


def _byte_symbols() -> dict[str, int]:
    """The characters that byte-level tokenizers write bytes as: printable
    bytes as themselves, the others as the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: By path; a worker process keeps it from task to task.
_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(load_tokenizer(path))
    return _LOADED[path]


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenised(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, row, tokens, ids``: ids with the end token, 16-bit little-endian.
    ``row`` tells rows apart; it is fixed once the table is written."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_tokens(tokenizer_path), np.array([END], "<u2").tobytes()
        for b in batches:
            got = [x + end for x in words.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 2 for x in got], pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "tokens", "ids"])

    out = df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("_b")).mapInArrow(run, "doc_id long, tokens long, ids binary")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")


def class_sizes(capacity: int = CAPACITY) -> list[int]:
    """Upper ends of the length classes: steps of one up to 32, then 32 an octave."""
    out, step = list(range(1, 33)), 1
    while out[-1] < capacity:
        step *= 2
        out += range(out[-1] + step, min(2 * out[-1], capacity) + 1, step)
    return out if out[-1] == capacity else [*out, capacity]


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack: most value that fits, and how often each class is in it.

    Any number of a class is a sum of powers of two of it, each taken or not,
    so every step of the dynamic program is one comparison of whole arrays.
    """
    best, steps = np.zeros(capacity + 1), []
    for k in np.flatnonzero(values > 1e-12).tolist():
        n = 1
        while n * sizes[k] <= capacity:
            at = int(n * sizes[k])
            with_it = best[:-at] + n * values[k]
            better = with_it > best[at:] + 1e-15
            best[at:][better] = with_it[better]
            steps.append((k, n, at, better))
            n *= 2
    counts, c = np.zeros(len(sizes), np.int64), int(best.argmax())
    value = float(best[c])
    for k, n, at, better in reversed(steps):
        if c >= at and better[c - at]:
            counts[k] += n
            c -= at
    return value, counts


def column_generation(sizes: list[int], demand: list[int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, at most as ``demand`` allows.

    A revised simplex: it starts from one-class patterns, keeps the inverse of
    the basis, and lets the knapsack name the column to enter.
    """
    s, d = np.asarray(sizes), np.asarray(demand, float)
    m = len(s)
    if not m:
        return []
    basis = np.diag(capacity // s).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x, floor = inverse @ d, float(s @ d) / capacity
    for _ in range(rounds):
        value, column = _best_pattern(s, inverse.sum(0), capacity)
        if value <= 1 + WORTH or x.sum() <= floor * (1 + CLOSE):
            break
        way = inverse @ column
        ok = way > 1e-9
        ratios = np.where(ok, x / np.where(ok, way, 1.0), np.inf)
        r = int(ratios.argmin())
        if not np.isfinite(ratios[r]):
            break
        basis[:, r] = column
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
        x = np.maximum(inverse @ d, 0.0)
    used = [(basis[:, j].astype(np.int64), int(x[j] + 1e-9)) for j in range(m)]
    left = np.asarray(demand, np.int64)
    out = []
    for pattern, times in sorted(used, key=lambda u: -u[1]):
        need = pattern > 0
        if need.any():
            times = min(times, int((left[need] // pattern[need]).min()))
            if times > 0:
                left = left - pattern * times
                out.append((pattern, times))
    return out


def _places(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (class, first rank, last rank, places a sequence, first sequence)."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern).tolist():
            a, n = int(pattern[k]), seen.get(k, 0)
            rows.append((k, n + 1, n + a * times, a, sequence))
            seen[k] = n + a * times
        sequence += times
    return rows


def plan(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``row, start, length, sequence_id`` of documents ``row, tokens``.

    Sequence ids: 3k for patterns, 3k + 1 for whole sequences of long
    documents, 3k + 2 for the leftovers.
    """
    spark = lengths.sparkSession
    sizes = class_sizes(capacity)
    items = lengths.withColumn("whole", F.floor(F.col("tokens") / capacity)).withColumn("rest", F.col("tokens") % capacity)
    arr = F.array(*[F.lit(x) for x in sizes])
    bounds = items.where("rest > 0").withColumn("class", F.size(F.filter(arr, lambda x: x < F.col("rest"))))
    bounds = stored(bounds.select("row", "tokens", "rest", "class"), "pack-items")
    counted = {r["class"]: r["n"] for r in bounds.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most len(sizes) rows
    classes = sorted(counted)
    patterns = column_generation([sizes[c] for c in classes], [counted[c] for c in classes], capacity)
    places = [(classes[k], *rest) for k, *rest in _places(patterns)]
    table = spark.createDataFrame(places, "class int, low long, high long, per long, first long") if places else spark.createDataFrame([], "class int, low long, high long, per long, first long")
    ranked = stored(salted_rank(bounds, ["class"], [F.xxhash64("row"), F.col("row")], sum(counted.values())), "pack-ranked")
    # At most classes squared rows, whatever the number of documents.
    at = ranked.join(F.broadcast(table.withColumnRenamed("class", "_c")), (F.col("class") == F.col("_c")) & F.col("rank").between(F.col("low"), F.col("high")), "left")
    start = F.col("tokens") - F.col("rest")
    packed = at.where("first is not null").select("row", start.alias("start"), F.col("rest").alias("length"), (3 * (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("per")))).alias("sequence_id"))
    loose = stored(at.where("first is null").select("row", "tokens", "rest"), "pack-loose")
    # Fewer items than each class's pattern remainders; laid end to end.
    laid = loose.withColumn("at", F.sum("rest").over(Window.orderBy("row")) - F.col("rest"))
    cuts = laid.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("rest") - 1) / capacity))))
    low, high = F.greatest(F.col("at"), F.col("k") * capacity), F.least(F.col("at") + F.col("rest"), (F.col("k") + 1) * capacity)
    loose_pieces = cuts.select("row", (F.col("tokens") - F.col("rest") + low - F.col("at")).alias("start"), (high - low).alias("length"), (3 * F.col("k") + 2).alias("sequence_id"))
    # Whole sequences are numbered by their document's row and place in it.
    longs = items.where("whole > 0").select("row", "whole")
    longs = longs.withColumn("_p", F.shiftright("row", 33))
    per = longs.groupBy("_p").agg(F.sum("whole").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n")).select("_p", "before")
    own = F.sum("whole").over(Window.partitionBy("_p").orderBy("row")) - F.col("whole")
    numbered = longs.withColumn("own", own).join(per, "_p")
    wholes = numbered.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"), (F.col("own") + F.col("before")).alias("first"))
    wholes = wholes.select("row", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (3 * (F.col("first") + F.col("k")) + 1).alias("sequence_id"))
    return packed.unionByName(loose_pieces).unionByName(wholes)


def padded_length(used: int, capacity: int = CAPACITY) -> int:
    """A sequence's length with its padding."""
    return used if used & (used - 1) == 0 else capacity


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded (its sequence's length with padding) and, if
    asked for, the piece's ids (unsigned 16-bit, little-endian)."""
    tokens = tokenised(df, tokenizer_path, text_col, id_col)
    pieces = plan(tokens.select("row", "tokens"), capacity)
    within = Window.partitionBy("sequence_id").orderBy("row", "start")
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    pieces = pieces.withColumn("offset", F.sum("length").over(within) - F.col("length")).withColumn("used", used)
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    pieces = pieces.withColumn("padded", F.when(power, F.col("used")).otherwise(F.lit(capacity)).cast("long")).drop("used")
    per_row = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "padded"))).alias("pieces"))
    joined = tokens.join(per_row, "row").select("doc_id", "tokens", "ids", "pieces")
    schema = PIECE + ", padded long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, ids, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in cut:
                    piece = ids[2 * p["start"] : 2 * (p["start"] + p["length"])]
                    crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                    out.append((doc, p["start"], p["length"], crc, n, p["sequence_id"], p["offset"], p["padded"], *([piece] if with_ids else [])))
            types = [pa.int64()] * 8 + [pa.binary()] * with_ids
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return joined.mapInArrow(run, schema)


def report(packed: DataFrame) -> DataFrame:
    """Sequences, tokens and the share of padding."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.first("padded").alias("padded"))
    return per.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), (1 - F.sum("used") / F.sum("padded")).alias("padding"))
