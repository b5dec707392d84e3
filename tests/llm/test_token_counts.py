"""The separator scan against plain counting."""

import random

import numpy as np
import pytest

from textloom.llm import bpe, token_counts


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_blocks_and_chunks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_counts, "CHUNK_BLOCKS", 3)
    rng, want = random.Random(3), {}
    for k in range(9):
        lengths = [rng.choice([0, 0, 1, 2, 3, 50, 300]) for _ in range(rng.choice([0, 1, 5, 20]))]
        rest = rng.choice([0, 11, 400])
        ids = [x for n in lengths for x in [7] * n + [token_counts.END]] + [9] * rest
        (tmp_path / f"part-{k}.bin").write_bytes(np.array(ids, "<u2").tobytes() + b"\x01" * (k % 2))
        want[f"part-{k}.bin"] = lengths + [rest] * (rest > 0)
    got = {k: [] for k in want}
    for r in token_counts.count_tokens(token_counts.flat_files(spark, str(tmp_path)), block_tokens=block).orderBy("path", "ordinal").collect():
        name = r["path"].rsplit("/", 1)[-1]
        assert r["ordinal"] == len(got[name])
        got[name].append(r["n_tokens"])
    assert got == want


def test_documents(spark, small, documents):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    library.encode_special_tokens = True
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in documents.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.op10_token_counts(spark, small).collect()} == want


def test_odd_rows(spark, clashing, tmp_path):
    coded = bpe.encode(clashing, special=False).select("doc_id", "ids")
    places = token_counts.write_flat(coded, f"file://{tmp_path}/flat")
    counts = token_counts.count_tokens(token_counts.flat_files(spark, f"file://{tmp_path}/flat"))
    assert places.count() == counts.count() == clashing.count()
    total = sum(len(r["ids"]) for r in coded.collect())
    assert sum(r["n_tokens"] for r in counts.collect()) == total
