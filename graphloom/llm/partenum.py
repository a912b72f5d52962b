"""Near-duplicate groups by an exact set-similarity join with PartEnum signatures.

Two documents link when the sets of their 5-word shingles have a Jaccard
similarity of 0.8 or more. Set sizes are divided into bands such that similar
sets lie in one band or in neighbours, so their symmetric difference is at
most some k. PartEnum hashes shingles to ``n1`` parts of three sub-parts each.
With n1 > k / 2 one part has at most one difference, so two of its sub-parts
agree: the three pairs of sub-parts, hashed, are a set's signatures for the
part, and similar sets share at least one.

More parts than that are used. Similar sets then share at least S = 2 * n1 - k
signatures, and in any order of all signatures each set may leave out its
first S - 1: the last one that two similar sets share has S - 1 shared ones
before it, so neither leaves it out. The order puts signatures of at most
``POOR`` shingles first and then the most frequent ones, so a passage that
many documents share brings nobody together by itself.

In a group of sets with one signature, up to ``SMALL`` give all their pairs.
Of larger ones a star around the smallest id is verified first, which merges
the copies among them. Only sets of groups that then still span several
components are taken up again: they leave out their most frequent signatures,
stars around the smallest component's first set are verified until a round
merges little, and the pairs across components are compared in tiles of a
bounded number of sets, each pair at the smallest signature that sketches of
the two show as shared. Histograms of the shingles' hashes bound the difference
from below and drop most of them unseen; in tiles, where pairs are many, they
have about as many bins as a set has shingles, so that little more than what
is similar becomes a row. Nothing is capped: each
pair that shares a signature which neither set may leave out is verified, or
already connected, or provably dissimilar.

Words are lower-cased in A-Z only. Fewer than five words make one shingle;
texts without a word, and null texts, have an empty set and link with nothing.
Repeated rows are one document. Of several texts under one id, the one with
the greatest hash of its set speaks for the id in links; each row still counts
its own shingles. A null id never links. An empty table gives an empty table.
Very long texts are worked on one at a time. Shingles are told apart by 64-bit
hashes, signatures and sets by 64-bit sums of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, mix64, small_batches, stored, text_bytes, windows, word_hashes
from .components import components
from .packed import by_bucket, groups, packed, partitions_for

SHINGLE = 5
#: Similarity as a ratio of whole numbers.
NUM, DEN = 4, 5
SLACK = 1.3
POOR = 1
SMALL = 4
HISTOGRAM = 64
#: Bins of the histograms in tiles, as powers of two: of small and of large sets.
BINS = 6, 12
SKETCH = 16
#: Sets of a tile; a pair of tiles' sets is compared in one task.
TILE, BLOCK = 1024, 512
#: A round of stars that merges fewer than one in so many of its pairs is the last.
FEW = 20


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a document's shingles, sorted."""
    h = word_hashes((text or b"").lower())
    if not len(h):
        return h
    return np.unique(windows(h, min(SHINGLE, len(h))) + np.uint64(min(SHINGLE, len(h))))


def band_ends(n: int) -> tuple[int, list[int]]:
    """The index of the band of size ``n`` and the upper ends of the bands up to the next."""
    ends, low = [], 1
    while not ends or ends[-1] < n:
        ends.append(low * DEN // NUM)
        low = ends[-1] + 1
    at = len(ends) - 1
    return at, [*ends, low * DEN // NUM]


def _shape(k: int) -> tuple[int, int]:
    """n1 and S for differences of up to k."""
    n1 = int(np.ceil((k + 1) / 2 * SLACK)) + 1
    return n1, 2 * n1 - k


def _signed(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For the joins of a set's band with the one before and the one after: its
    signatures without the poor ones it leaves out, and how many more may go."""
    n = len(s)
    if n == 0:
        return
    at, ends = band_ends(n)
    for low in (at - 1, at):
        r0 = ends[low] if low >= 0 else 0
        # |A ^ B| <= (1 - j) / (1 + j) * (|A| + |B|)
        k = (DEN - NUM) * (r0 + ends[low + 1]) // (DEN + NUM)
        if k == 0:
            continue  # only equal sets, which are grouped beforehand
        n1, shared = _shape(k)
        x = mix64(s ^ np.uint64(0x5851F42D4C957F2D + low + 1))
        sub = ((x >> np.uint64(32)) * np.uint64(3 * n1) >> np.uint64(32)).astype(np.int64)
        total, count = np.zeros(3 * n1, np.uint64), np.bincount(sub, minlength=3 * n1)
        np.add.at(total, sub, mix64(x))
        t, c = total.reshape(n1, 3), count.reshape(n1, 3)
        sizes = np.stack([c[:, 0] + c[:, 1], c[:, 0] + c[:, 2], c[:, 1] + c[:, 2]], 1).ravel()
        base = np.uint64(0x9E3779B97F4A7C15)
        sig = np.stack([t[:, 0] * base + t[:, 1], t[:, 0] * base + t[:, 2], t[:, 1] * base + t[:, 2]], 1).ravel()
        sig = mix64(sig + mix64(np.arange(3 * n1, dtype=np.uint64) + np.uint64((low + 2) << 40)))
        upto = np.cumsum(np.bincount(sizes, minlength=POOR + 1))
        least = min(POOR + 1, int((upto < shared).sum()))  # signatures of fewer shingles than this go
        more = shared - 1 - int(upto[POOR]) if least > POOR else 0
        yield sig[sizes >= least], more


def signatures(s: np.ndarray) -> np.ndarray:
    """The signatures of a set under which it is looked for."""
    return np.concatenate([np.empty(0, np.uint64), *(sig for sig, _ in _signed(s))])


def rarer(s: np.ndarray, sig: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those of ``sig``, sorted signatures of the set that ``rows`` rows have,
    that it does not leave out; signatures not given are rarer than these."""
    out = [np.empty(0, np.uint64)]
    for own, more in _signed(s):
        own = np.unique(own)
        at = np.flatnonzero(np.isin(sig, own, assume_unique=True))
        order = at[np.lexsort((sig[at], -rows[at]))]
        out.append(sig[order[more:]])
    return np.concatenate(out)


def set_hash(s: np.ndarray) -> int:
    return int(mix64(np.array([mix64(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame) -> DataFrame:
    """``id, n, set``: number of shingles and a hash of the set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key = [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                key.append(set_hash(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64())], names=["id", "n", "set"])

    return stored(docs.mapInArrow(run, "id long, n long, set long"), "near-sets")


def _candidates(docs: DataFrame, reps: DataFrame, partitions: int) -> DataFrame:
    """``kind, a, b, m`` from the sets of ``reps``: kind 0, a pair to verify;
    kind 1, b is one of the m rows of the large group of signature a; kind 2,
    the pair of b and the first of a large group."""
    bloom = Bloom(reps)
    sent = bloom.sent

    def emit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for doc, t, on in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), Bloom.has(sent, b.column(2)).tolist(), strict=True):
            if on and doc is not None and t:
                sig = signatures(shingles(t))
                keys.append(sig)
                ids.append(np.full(len(sig), doc, np.int64))
        return np.concatenate(keys), np.concatenate(ids)

    def use(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts, run = groups(keys)
        size = np.diff(np.append(starts, len(keys)))
        pairs = [np.empty((0, 2), np.int64)]
        for i in range(1, SMALL):  # the i-th after each, in groups of up to SMALL
            same = (run[i:] == run[:-i]) & (size[run[i:]] <= SMALL)
            pairs.append(np.stack([ids[:-i][same], ids[i:][same]], 1))
        pair = np.unique(np.concatenate(pairs), axis=0)
        large = size[run] > SMALL
        star = large & (np.arange(len(keys)) != starts[run])
        stars = np.unique(np.stack([ids[starts[run[star]]], ids[star]], 1), axis=0)
        n = [len(pair), int(large.sum()), len(stars)]
        kind = np.repeat(np.arange(3, dtype=np.int8), n)
        a = np.concatenate([pair[:, 0], keys[large].view(np.int64), stars[:, 0]])
        b = np.concatenate([pair[:, 1], ids[large], stars[:, 1]])
        m = np.concatenate([np.zeros(n[0], np.int64), size[run[large]], np.zeros(n[2], np.int64)])
        for i in range(0, len(kind), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (kind, a, b, m)], names=["kind", "a", "b", "m"])

    slotted = docs.select("id", "text", bloom.slot().alias("slot"))
    return stored(by_bucket(packed(slotted, emit, partitions), use, "kind byte, a long, b long, m long", partitions), "near-candidates")


def _loaded(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """``id, set, n, hist, s``: the sets of the wanted ids (and of a few more)."""
    bloom = Bloom(wanted)
    sent = bloom.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t, on in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), Bloom.has(sent, b.column(2)).tolist(), strict=True):
                s = shingles(t) if on and doc is not None and t else ()
                if len(s):
                    hist = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=HISTOGRAM).astype("<i4")
                    rows.append((doc, set_hash(s), len(s), hist.tobytes(), s.tobytes()))
            for i in range(0, len(rows), 100):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 100]], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["id", "set", "n", "hist", "s"])

    made = stored(docs.select("id", "text", bloom.slot().alias("slot")).mapInArrow(run, "id long, set long, n long, hist binary, s binary"), "near-loaded")
    return stored(made.dropDuplicates(["id", "set"]), "near-loaded-once") if repeats else made


def _verified(pairs: DataFrame, loaded: DataFrame) -> DataFrame:
    """Those ``a, b`` whose sets are similar; an exact intersection count."""
    sets = loaded.select("id", "s")
    with_a = pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("s", "sa"), "a")
    both = with_a.join(sets.withColumnRenamed("id", "b").withColumnRenamed("s", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                inter = len(np.intersect1d(p, q, assume_unique=True))
                if DEN * inter >= NUM * (len(p) + len(q) - inter):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return stored(both.mapInArrow(run, "a long, b long"), "near-links")


def _near(pairs: DataFrame, loaded: DataFrame) -> DataFrame:
    """Those ``a, b`` that sizes and histograms allow to be similar."""
    h = loaded.select("id", "n", "hist")
    both = pairs.join(h.toDF("a", "na", "ha"), "a").join(h.toDF("b", "nb", "hb"), "b").select("a", "b", "na", "nb", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ha, hb = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<i4").reshape(-1, HISTOGRAM) for i in (4, 5))
            ok = (DEN + NUM) * np.abs(ha - hb).sum(1) <= (DEN - NUM) * (na + nb)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _rare_members(members: DataFrame, loaded: DataFrame) -> DataFrame:
    """``sig, id``: of the rows ``id, sigs, ms`` (a set's large signatures and how
    many rows have them) those that sets do not leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for doc, pairs, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.array([(p["sig"], p["m"]) for p in pairs], np.int64)
                own = np.ascontiguousarray(x[:, 0]).view(np.uint64)
                order = np.argsort(own)
                kept = np.unique(rarer(np.frombuffer(s, np.uint64), own[order], x[order, 1])).view(np.int64)
                sig.append(kept)
                ids.append(np.full(len(kept), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(ids))], names=["sig", "id"])

    listed = members.groupBy("id").agg(F.collect_set(F.struct("sig", "m")).alias("sigs"))
    return stored(listed.join(loaded.select("id", "s"), "id").select("id", "sigs", "s").mapInArrow(run, "sig long, id long"), "near-members")


def _still_open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``sig, id, comp`` of the groups that span several components."""
    with_comp = members.join(comp, "id", "left").select("sig", "id", F.coalesce("comp", "id").alias("comp"))
    apart = with_comp.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return stored(with_comp.join(apart, "sig"), "near-open")


def fine_histogram(s: np.ndarray) -> np.ndarray:
    """Of a set, with as many bins as shingles, about; a bin counts to 255, which
    can only lower the difference of two."""
    bits = min(BINS[1], max(BINS[0], (len(s) - 1).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _close(fine: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b of ``fine`` have a difference of ``most`` at most,
    by the bins of the one with fewer."""
    ok, size = np.ones(len(a), bool), np.array([len(f) for f in fine])
    low = np.minimum(size[a], size[b])
    for bins in np.unique(low[low > HISTOGRAM]).tolist():
        on = np.flatnonzero(low == bins)
        who, code = np.unique(np.concatenate([a[on], b[on]]), return_inverse=True)
        h = np.stack([fine[w].reshape(bins, -1).sum(1, dtype=np.int32) for w in who])
        for k in range(0, len(on), 2_000_000 // bins):
            x, y = code[: len(on)][k : k + 2_000_000 // bins], code[len(on) :][k : k + 2_000_000 // bins]
            ok[on[k : k + len(x)]] = (DEN + NUM) * np.abs(h[x] - h[y]).sum(1) <= most[on[k : k + len(x)]]
    return ok


def _across(rest: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of one signature but different components that the sizes
    and histograms allow, from rows ``sig, i, j, x, id, comp, n, fine, sketch``
    sorted by tile (sig, i, j); x, the row's own block, is i or j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(tile: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            sig, first, second = tile
            x, i, c, z = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            fine = [np.frombuffer(r[4], np.uint8) for r in rows]
            h = np.stack([f.reshape(HISTOGRAM, -1).sum(1, dtype=np.int32) for f in fine])
            # Which smaller signatures each set has, of those that two of them have.
            row, value = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows]), np.array([v for r in rows for v in r[5]], np.int64)
            row, value = row[value < sig], value[value < sig]
            _, code, count = np.unique(value, return_inverse=True, return_counts=True)
            twice = count[code] > 1
            _, code = np.unique(code[twice], return_inverse=True)
            has = np.zeros((len(rows), int(code.max(initial=-1)) + 1), np.float32)
            has[row[twice], code] = 1
            left = np.flatnonzero(x == first)
            right = np.flatnonzero(x == second)
            for u in range(0, len(left), BLOCK):
                for v in range(u if first == second else 0, len(right), BLOCK):
                    p, q = left[u : u + BLOCK], right[v : v + BLOCK]
                    most = (DEN - NUM) * (z[p, None] + z[None, q])
                    ok = c[p, None] != c[None, q]
                    if first == second and u == v:
                        ok &= i[p, None] < i[None, q]
                    ok &= (DEN + NUM) * np.abs(z[p, None] - z[None, q]) <= most
                    if has.shape[1]:
                        ok &= has[p] @ has[q].T == 0
                    s, t = np.nonzero(ok)
                    for k in range(0, len(s), 20_000):
                        f, g = s[k : k + 20_000], t[k : k + 20_000]
                        near = (DEN + NUM) * np.abs(h[p[f]] - h[q[g]]).sum(1) <= most[f, g]
                        f, g = f[near], g[near]
                        near = _close(fine, p[f], q[g], most[f, g])
                        a, b = i[p[f[near]]], i[q[g[near]]]
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        at, held = None, []
        for b in batches:
            for sig, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (sig, i, j) != at:
                    if held:
                        yield from pairs(at, held)
                    at, held = (sig, i, j), []
                held.append(tuple(row))
        if held:
            yield from pairs(at, held)

    return rest.mapInArrow(run, "a long, b long").distinct()


def _tiles(open_: DataFrame, loaded: DataFrame) -> DataFrame:
    """The rows ``_across`` takes. A group of m sets is dealt to m / TILE blocks, and
    each set to the tiles of its block with every block."""
    blocks = open_.groupBy("sig").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    sketch = open_.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, SKETCH).alias("sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = [fine_histogram(np.frombuffer(s, np.uint64)).tobytes() for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fine, pa.binary()), b.column(3)], names=["id", "n", "fine", "sketch"])

    about = loaded.join(sketch, "id").select("id", "n", "s", "sketch").mapInArrow(run, "id long, n long, fine binary, sketch array<long>")
    about = stored(about, "near-fine")
    rows = open_.join(blocks, "sig").join(about, "id").withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "comp", "n", "fine", "sketch")
    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row: the smallest id that
    the document reaches over links, itself included."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    sets = _sets(docs)
    known = sets.where("set is not null and id is not null").groupBy("id").agg(F.max(F.struct("set", "n")).alias("x"), F.count("*").alias("rows"))
    known = stored(known.select("id", "x.set", "x.n", "rows"), "near-ids")
    # Equal sets are one node, their smallest id.
    same = stored(known.groupBy("set", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "near-classes")
    node = stored(known.join(same.where("copies > 1"), ["set", "n"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "set"), "near-nodes")
    total, repeats = same.agg(F.sum("n")).first()[0] or 0, known.agg(F.max("rows")).first()[0]
    found = _candidates(docs, same.select(F.col("rep").alias("id")), partitions_for(0.9 * total))
    ra, rb = node.select(F.col("id").alias("a"), F.col("rep").alias("ra")), node.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
    pairs = found.where("kind <> 1").select("kind", "a", "b").distinct().join(ra, "a").join(rb, "b").where("ra <> rb")
    pairs = stored(pairs.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("kind").alias("kind")), "near-pairs")
    large = found.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("id"), "m").join(node, "id").select("sig", F.col("rep").alias("id"), "m").distinct()
    loaded = _loaded(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), (repeats or 1) > 1)
    if (repeats or 1) > 1:
        loaded = loaded.join(node.select("id", "set"), ["id", "set"], "left_semi")
    # First each node with its smallest partner, which joins most of a group.
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-first")
    links = _verified(_near(first, loaded), loaded)
    comp = components(links)
    members = _rare_members(_still_open(large.select("sig", "id"), comp).select("id").distinct().join(large, "id"), loaded)
    open_ = _still_open(members, comp)
    # Then stars around the first set of a group's smallest component, another
    # group for each set in each round, as long as that merges many.
    tried, turn = first, 0
    while True:
        head = open_.groupBy("sig").agg(F.min(F.struct("comp", "id")).alias("head"))
        star = open_.join(head, "sig").where("comp <> head.comp").groupBy("id").agg(F.min_by("head.id", F.xxhash64("sig", F.lit(turn))).alias("head"))
        star = star.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        star = stored(star, "near-star")
        more = _verified(_near(star, loaded), loaded)
        tried, turn = tried.union(star), turn + 1
        new, of = more.count(), star.count()
        if new:
            links = links.union(more)
            comp = components(links)
            open_ = _still_open(members, comp)
        if FEW * new < of or not new:
            break
    # Then all else that is still apart.
    ca, cb = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    apart = pairs.where("kind = 0").select("a", "b").join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    second = _near(apart, loaded).union(_across(_tiles(open_, loaded))).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(_verified(stored(second, "near-second"), loaded))
    comp = components(links)
    reached = node.join(comp.withColumnRenamed("id", "rep"), "rep", "left").where("comp is not null or id <> rep")
    reached = reached.select("id", F.coalesce("comp", "rep").alias("component_id"))
    out = sets.join(reached, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
