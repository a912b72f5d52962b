"""Alignment against a walk over both token lists, pair by pair."""

import hashlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    None, "", " ", "\n\n", "a", "Don't we'll  go\t home", "naïve ÉCOLE 12,345 größe", "<|endoftext|> <s> </s> <unk>", "中文字符 \U0001f600\U0001f600", "x\x00y\r\nz",
    "▁ ▁▁ lower", " leading and trailing ", "a  b   c    d", "İstanbul ǅ ﬁ", "word " * 50, "nospaceatall" * 40, "é ‍​", "Is and the",
]


def brute(texts):
    """Of each text: (n_a, n_b, groups as text, links), or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    name = {i: w for w, i in a_tok.get_vocab().items()}
    byte = alignment.byte_symbols()
    out = []
    for text in texts:
        out.append(None)
        if not text:
            continue
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        ab = [bytes(byte[c] for c in name[i]) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            continue
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (ab, bb))
        links, groups, i, j, i0, j0 = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            ea, eb = ends_a[i], ends_b[j]
            i, j = i + (ea <= eb), j + (eb <= ea)
            if ea == eb:
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                i0, j0 = i, j
        out[-1] = (len(a), len(b), groups, links)
    return out


def expected(texts):
    found = brute(texts)
    docs = Counter(p for f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(docs[p] == best[p[0]] for p in f[3]), sum(docs[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


@pytest.mark.parametrize(("hot", "piece", "flush"), [(1 << 22, 1 << 16, 1 << 22), (40, 7, 50)])
def test_awkward_texts_repeated_rows_and_clashing_names(spark, monkeypatch, hot, piece, flush):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "PIECE_CHARS", piece)
    monkeypatch.setattr(alignment, "FLUSH", flush)
    texts = [*AWKWARD, *AWKWARD[3:8], "a", "a"]
    df = spark.createDataFrame([(k % 20, k, t, "mine", 1.5) for k, t in enumerate(texts)], "doc_id long, k long, text string, n_links string, _other double")
    rows = sorted(alignment.align(df, A, B).collect(), key=lambda r: r["k"])
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows] == expected(texts)
    assert [r["text"] for r in rows] == texts


def test_query_over_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op11_alignment(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == expected([d["text"] for d in docs])


def test_groups_give_the_tokens_back(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(AWKWARD)], "k long, text string")
    for r, f in zip(sorted(alignment.groups(df, A, B).collect(), key=lambda r: r["k"]), brute(AWKWARD), strict=True):
        assert (r["groups"] is None) == (f is None)
        if f:
            assert [",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in r["groups"]] == f[2]


def test_long_text_in_pieces_and_bytes_that_are_no_text(spark):
    long = "Theand thble reingwh thorin, and the. " * 6000
    df = spark.createDataFrame([(1, long), (2, None)], "k long, text string").withColumn("text", F.when(F.col("k") == 2, F.expr("cast(x'ff41' as string)")).otherwise(F.col("text")))
    rows = {r["k"]: r for r in alignment.align(df, A, B, keep=["k"]).collect()}
    assert (rows[1]["n_a"], rows[1]["n_b"]) == brute([long])[0][:2] and rows[2]["n_a"] == 0


def test_empty_table(spark):
    out = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and out.columns[0] == "doc_id"
