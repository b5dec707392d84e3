"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def ids_of(codec, text, special=True):
    return np.frombuffer(codec.encode(text, special), "<i4").tolist()


def test_random_texts(library):
    codec, rng = bpe.Codec(bpe.vocabulary()), random.Random(1)
    letters = [*"ab'stre llvd  \n\t\x1c\x85　éß中🙂1½²٣_-!…​́", "<|endoftext|>", "<|endof", "'s", "'ll"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids, text
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False), ids
    assert codec.decode([-1, 10**9, 0]) == "!"


def test_stale_entries_and_long_pieces(library):
    codec = bpe.Codec(bpe.vocabulary())
    for text in ("a" * 3000, "abab" * 700, "ththth" * 300, "=" * 999, " " * 500):
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_special_strings_as_text(library):
    codec = bpe.Codec(bpe.vocabulary())
    assert 50256 in ids_of(codec, "a<|endoftext|>b") and 50256 not in ids_of(codec, "a<|endoftext|>b", special=False)


def test_table(spark, clashing, library):
    got = bpe.decode(bpe.encode(clashing)).select("doc_id", "text", "ids", "decoded", "words").collect()
    assert len(got) == clashing.count() and {r["words"] for r in got} == {"clash"}
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")


def test_decoded_in_the_same_pass(clashing):
    two = bpe.decode(bpe.encode(clashing)).select("doc_id", "text", "ids", "decoded").collect()
    one = bpe.encode(clashing, decoded="decoded").select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(one, key=repr) == sorted(two, key=repr)


def test_a_task_leaves_no_table_in_its_worker(spark, documents):
    """The next task in a worker, of any operator, finds no encoded pieces there."""

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe.codec(path).known)] * batch.num_rows})

    path = bpe.vocabulary()
    bpe.encode(documents.repartition(8)).count()
    bpe.encode(documents.repartition(8)).selectExpr("sum(size(ids))").collect()
    assert {r["n"] for r in spark.range(64).repartition(16).mapInArrow(left, "n long").collect()} == {0}


def test_null_ids_and_empty_table(spark, nothing):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, None, 99999])], "a int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df).orderBy("a").collect()] == ["", "", "!"]
    assert bpe.encode(nothing).count() == 0


def test_query(spark, small, documents, library):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = bpe.op1_bpe_round_trip(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
