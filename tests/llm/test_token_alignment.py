"""The alignment against byte-by-byte counting with the libraries' own encoders."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, token_alignment

ODD = ["", " ", "  ", "x", "x ", "x  ", "  x", " x\n\n  y ", "a▁b", "<s> x </s>", "<0x41>", "a\x00b", "🙂‍ ok", "x" * 3000, " " * 500, "<|endoftext|> it's", "　a  b ", "\r\n\t ok", "ﷺ ﬁ", "\n", "�"]


@pytest.fixture(scope="module")
def libraries():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a, b = token_alignment.vocabularies()
    left = tokenizers.Tokenizer.from_file(a)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=b)


def plain(libraries, texts):
    """For each text: n_a, n_b, n_groups, n_links, n_best, count_sum and the groups, from the tokens that own each byte."""
    left, right = libraries
    letters = bpe.byte_letters()
    piece = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    out, corpus = [], Counter()
    for text in texts:
        a = left.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        raw_a, raw_b = [bytes(letters[c] for c in left.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append((0, 0, 0, [], ""))
            continue
        owner_a = [k for k, s in enumerate(raw_a) for _ in s]
        owner_b = [k for k, s in enumerate(raw_b) for _ in s]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, cur = [], ([], [])
        for i in range(len(owner_a)):
            last = i + 1 == len(owner_a)
            end_a, end_b = last or owner_a[i] != owner_a[i + 1], last or owner_b[i] != owner_b[i + 1]
            if end_a:
                cur[0].append(a[owner_a[i]])
            if end_b:
                cur[1].append(b[owner_b[i]])
            if end_a and end_b:
                groups.append(cur)
                cur = ([], [])
        pairs = [(a[i], b[j]) for i, j in links]
        corpus.update(pairs)
        out.append((len(a), len(b), len(groups), pairs, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    best = {}
    for (_, y), n in corpus.items():
        best[y] = max(n, best.get(y, 0))
    return [(n, m, g, len(p), sum(corpus[x] == best[x[1]] for x in p), sum(corpus[x] for x in p), s) for n, m, g, p, s in out]


def test_encoders(libraries, documents):
    a, b = token_alignment.coders(*token_alignment.vocabularies())
    for text in ODD + [r["text"] for r in documents.select("text").collect()]:
        assert a.encode(text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        if text and "▁" not in text:
            assert b.encode(text).tolist() == libraries[1].encode(text)


@pytest.mark.parametrize("most", [0, 10_000_000])
def test_odd_texts(spark, libraries, odd, most):
    texts = ODD + [r["text"] for r in odd.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("pairs", F.lit("clash")).repartition(3)
    found = token_alignment.aligned(df).checkpoint()
    got = token_alignment.with_counts(found, "row", most).orderBy("row").select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert [tuple(r) for r in got] == plain(libraries, texts)


def test_partial_counts(spark, documents):
    found = token_alignment.aligned(documents.select("doc_id", "text")).checkpoint()
    whole = token_alignment.pair_counts(found).select("pair", "n")
    assert sorted(whole.collect()) == sorted(token_alignment.pair_counts(found, held=50).select("pair", "n").collect())


def test_query(spark, small, libraries, documents):
    rows = documents.select("doc_id", "text").collect()
    want = {r["doc_id"]: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, plain(libraries, [r["text"] for r in rows]))}
    got = token_alignment.op12_token_alignment(spark, small).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_empty(spark, nothing, tmp_path):
    nothing.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert token_alignment.op12_token_alignment(spark, f"file://{tmp_path}").collect() == []
