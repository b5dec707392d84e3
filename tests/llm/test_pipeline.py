"""The stages, one after the other, against their operators and brute force."""

import importlib.util
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_line_dedup import brute as removed_lines
from test_mixing import plain_targets
from test_quality import plain_score

import corpus_pipeline as cp
from textloom.llm import bpe, quality_classifier, registry
from textloom.llm.common import stored


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, small, documents):
    docs = documents
    for k, (name, stage) in enumerate(cp.STAGES):
        before, docs = docs, stored(stage(spark, docs, small), "test")
        if k + 1 < len(cp.STAGES):
            assert docs.columns == documents.columns, name
            ids = before.select("doc_id").distinct()
            assert docs.join(ids, "doc_id", "left_anti").count() == 0
    assert docs.count() and docs.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_stages_against_brute_force(spark, small, documents):
    """Each stage's rows from those of the stage before: scores, lines and similarities by brute force, ids by the library."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    model = quality_classifier.train(documents, spark.read.parquet(f"{small}/labels.parquet"))
    steps, docs = [[tuple(r) for r in documents.select("doc_id", "text", "source").collect()]], documents
    for _, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, small), "test")
        steps.append([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    given, good, lines, single, mixed = (sorted(x, key=repr) for x in steps)
    assert good == [r for r in given if plain_score(model, r[1]) >= quality_classifier.THRESHOLD]
    dead = removed_lines([r[:2] for r in good])
    cut = [(i, t, s, dead.get((i, t), ())) for i, t, s in good]
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t, s, gone) for i, t, s, gone in cut]
    assert lines == sorted(((i, t, s) for i, t, s, gone in left if not gone or words(t)), key=repr)
    component = components([r[:2] for r in lines])
    assert single == [r for r in lines if component[r[0]] == r[0]]
    assert set(mixed) <= set(single) and max(Counter(mixed).values()) <= 3
    sizes, taken = Counter(), Counter()
    for rows, out in ((single, sizes), (mixed, taken)):
        for _, t, s in rows:
            out[s] += len(words(t))
    longest = max(len(words(t)) for _, t, _ in single)
    assert all(abs(taken[s] - target) <= 0.01 * target + 40 + longest for s, target in plain_targets(sizes).items())
    coded = sorted((r["doc_id"], list(r["ids"])) for r in cp.encode_text(spark, docs, small).collect())
    assert coded == sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in mixed)


def test_near_copies_leave_one(spark, small):
    words = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, words), (2, words + " x"), (3, words), (4, "quite another text of seven words")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted(r["doc_id"] for r in cp.dedup_documents(spark, df, small).collect()) == [1, 4]


def test_odd_rows(spark, small, clashing, nothing):
    for name, stage in cp.STAGES:
        assert stage(spark, clashing, small).count() >= 0, name
        assert stage(spark, nothing, small).count() == 0, name


def test_every_query_is_registered():
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec and [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))


def test_lines_stay_where_nothing_repeats(spark, small):
    df = spark.createDataFrame([(1, "one two three four five\nsix seven eight nine ten"), (2, "x")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "7L AS n_chars")
    got = cp.dedup_lines(spark, df, small).orderBy("doc_id").select("text", F.col("n_chars")).collect()
    assert [tuple(r) for r in got] == [("one two three four five\nsix seven eight nine ten", 7), ("x", 7)]
