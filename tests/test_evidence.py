"""Ranges against point sets, rankings, selection, sources and indexes."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import evidence, retrieval, search
from textloom.sources import corpus, index


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_and_format(spark):
    spans = [("a", s, e) for s, e in ((1, 2), (1, 2), (2, 5), (7, 7), (9, 10), (11, 11))] + [("b", 3, 4)]
    df = spark.createDataFrame([("verified", *s) for s in spans], "kind string, path string, start_line long, end_line long")
    assert rows(evidence.formatted(evidence.merged(df))) == [("a", "1-5, 7, 9-10, 11"), ("b", "3-4")]


def test_verified_and_retrieved(spark):
    df = spark.createDataFrame([("retrieved", "a", 1, 5), ("verified", "a", 2, 3), ("retrieved", "b", 8, 9), ("verified", "c", 4, 4), ("verified", " ", 1, 1)], "kind string, path string, start_line long, end_line long")
    assert rows(evidence.cited(df)) == [("retrieved", "a", "1, 4-5"), ("retrieved", "b", "8-9"), ("verified", "a", "2-3"), ("verified", "c", "4")]


def test_ranges_as_points(spark):
    random.seed(5)
    data = [(k, str(p), *random.choices(range(-5, 21), k=2)) for p in range(60) for k in ("retrieved", "verified") for _ in range(random.randint(0, 6))]
    df = evidence.clamped(spark.createDataFrame(data, "kind string, path string, start_line long, end_line long"))
    points = {}
    for kind, path, s, e in data:
        s = max(1, s)
        points.setdefault((kind, path), set()).update(range(s, max(s, e) + 1))
    merged = evidence.merged(df).cache()
    got = {}
    for r in merged.collect():
        part = set(range(r["start_line"], r["end_line"] + 1))
        assert not part & got.setdefault((r["kind"], r["path"]), set())
        got[r["kind"], r["path"]] |= part
    assert got == points
    left = {}
    for r in evidence.subtracted(merged.where("kind = 'retrieved'"), merged.where("kind = 'verified'")).collect():
        left.setdefault(r["path"], set()).update(range(r["start_line"], r["end_line"] + 1))
    want = {p: x - points.get(("verified", p), set()) for (k, p), x in points.items() if k == "retrieved"}
    assert left == {p: x for p, x in want.items() if x}


def test_source_lists(spark):
    df = spark.createDataFrame([(1, "retrieved", "b", 1, 5), (1, "verified", "b", 2, 3), (1, "retrieved", "a", 8, 8), (2, "retrieved", "b", 4, 4)], "prompt_id int, kind string, path string, start_line long, end_line long")
    cited = evidence.cited(df, ("prompt_id",))
    assert rows(evidence.source_list(cited, "prompt_id")) == [(1, "Verified:\n\n- b:\n  2-3\n\nRetrieved:\n\n- a:\n  8\n- b:\n  1, 4-5"), (2, "Retrieved:\n\n- b:\n  4")]
    assert rows(evidence.source_list(cited.where("prompt_id = 2"), "prompt_id", headed=False)) == [(2, "- b:\n  4")]
    texts = spark.createDataFrame([(" yes ", None), ("no", ""), ("x", "- a:\n  1")], "a string, s string").select(evidence.with_sources(F.col("a"), F.col("s")))
    assert rows(texts) == [("no\n\nSources:\n\n- none",), ("x\n\nSources:\n\n- a:\n  1",), ("yes\n\nSources:\n\n- none",)]


def test_evidence_of_matches_reads_and_files(spark):
    df = spark.createDataFrame([("a", 3, 2, 9)], "path string, line_no long, read_start long, read_end long")
    assert rows(evidence.from_matches(df)) == [("verified", "a", 3, 3)] and rows(evidence.from_reads(df)) == [("verified", "a", 2, 9)]
    files = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", None), ("d", "one")], "path string, text string")
    assert rows(evidence.whole_files(files)) == [("retrieved", "a", 1, 3), ("retrieved", "d", 1, 1)]


def test_history_and_query_context(spark):
    turns = spark.createDataFrame([(1, 0, "first"), (1, 1, ""), (1, 2, "third"), (2, 0, "other")], "conv int, turn int, question string")
    got = retrieval.with_history(turns, "conv", "turn").select("conv", "turn", "history", retrieval.query_context(F.col("history"), F.col("question")))
    assert rows(got)[2] == (1, 2, ["first"], "Earlier questions:\n- first\n\nQuestion: third")
    assert [r[3] for r in rows(got.where("turn = 0"))] == ["first", "other"]


def test_novel(spark):
    seen = spark.createDataFrame([("a", 1)], "path string, line_no int")
    assert rows(evidence.novel(spark.createDataFrame([("a", 1), ("a", 2)], "path string, line_no int"), seen, ["path", "line_no"])) == [("a", 2)]


def picks(how, hits, most):
    frame = pd.DataFrame(hits, columns=["path", "chunk_id", "start_line", "end_line"]).assign(rank=range(len(hits)))
    return list(how(frame, most)[["path", "chunk_id"]].itertuples(index=False, name=None))


def test_selection():
    assert picks(retrieval.spread, [("a", 0, 1, 2), ("a", 1, 2, 3), ("a", 3, 8, 9)], 2) == [("a", 0), ("a", 3)]
    assert picks(retrieval.spread, [("a", 0, 1, 2), ("a", 1, 2, 3)], 2) == [("a", 0), ("a", 1)]
    hits = [("a", 0, 1, 5), ("a", 1, 4, 9), ("a", 2, 10, 12), ("b", 0, 1, 5)]
    assert picks(retrieval.apart, hits, 4) == [("a", 0), ("b", 0), ("a", 2)]


def test_fusion_and_weakness(spark):
    hits = spark.createDataFrame(
        [(0, 0, 0, "a", 1, 5, 9, "x", 0.1, 0.05), (0, 1, 1, " a ", 1, 3, 7, "", 0.05, 0.01), (0, 1, 0, "b", 0, 1, 2, "y", 0.05, 0.0), (0, 0, 1, " ", 0, 1, 2, "z", 0.9, 0.9)],
        "prompt_id int, query_ord int, rank int, path string, chunk_id int, start_line int, end_line int, text string, similarity double, overlap double",
    )
    fused = retrieval.fused(hits)
    assert [(r["path"], r["score"], r["start_line"], r["end_line"], r["text"]) for r in fused.orderBy("rank").collect()] == [("a", 1 / 61 + 1 / 62, 3, 9, "x"), ("b", 1 / 61, 1, 2, "y")]
    assert rows(retrieval.weak(fused)) == [(0, True)]
    assert rows(retrieval.weak(fused, spark.createDataFrame([(0,), (9,)], "prompt_id int"))) == [(0, True), (9, True)]
    assert rows(retrieval.weak(fused.withColumn("similarity", F.lit(0.2)))) == [(0, False)]


def test_folder(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a.txt").write_text("alpha\n")
    (tmp_path / "nested/b.md").write_text("# beta\n")
    (tmp_path / ".git/x.txt").write_text("no")
    (tmp_path / "c.bin").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x01")
    docs = corpus.read_folder(spark, str(tmp_path))
    parts = [r["part"] for r in corpus.corpus_parts(docs).orderBy("path").collect()]
    assert "\n".join(parts) == "=== file: a.txt ===\nalpha\n\n=== file: nested/b.md ===\n# beta\n"
    named = spark.createDataFrame([("a.txt", "/1"), ("a.txt", "/2")], "path string, full string")
    assert rows(corpus.disambiguated(named, "full").select("path")) == [("a.txt",), ("a.txt#2",)]
    assert corpus.content_hash(docs, 1) == corpus.content_hash(docs, 1) != corpus.content_hash(docs, 2)


def test_index(spark, tmp_path):
    base, chunks = str(tmp_path), spark.createDataFrame([("a", 0, "Retry  policy"), ("a", 1, "x")], "path string, chunk_id int, text string")
    embed = lambda texts: [[1.0, float(len(t))] for t in texts]
    built = index.build_or_load(spark, base, "h", lambda: index.embedded(chunks, embed), "m", 1800, 200)
    assert rows(built.select("chunk_id", F.col("vector")[1])) == [(0, 12.0), (1, 1.0)]
    with pytest.raises(index.IndexExists):
        index.write_index(chunks, base, "h", "m", 1800, 200)
    assert index.load_index(spark, base, "h").count() == 2
    assert index.load_index(spark, base, "h", timedelta(0)) is None and index.load_index(spark, base, "other") is None


def test_index_race_and_clearing(spark, tmp_path):
    base, chunks = str(tmp_path), spark.createDataFrame([("a", 0)], "path string, chunk_id int")

    def slower():
        index.write_index(chunks, base, "h", "m", 1800, 200)
        return chunks.union(chunks)

    assert index.build_or_load(spark, base, "h", slower, "m", 1800, 200).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["h"]
    (tmp_path / "own").mkdir()
    assert index.clear_indexes(spark, base) == [] and index.clear_indexes(spark, f"{base}/none") == []
    assert index.clear_indexes(spark, base, timedelta(seconds=-60)) == ["h"]
    assert [p.name for p in tmp_path.iterdir()] == ["own"]


def test_names_and_aliases(spark):
    named = lambda *paths: [r["path"] for r in corpus.disambiguated(spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, full int"), "full").orderBy("full").collect()]
    assert named("a", "a#2", "a", "b", "a") == ["a", "a#2", "a#3", "b", "a#4"]
    assert named("a", "a", "a#2") == ["a", "a#2", "a#2#2"]
    one = spark.createDataFrame([("notes.txt", "dir/notes.txt")], "path string, source string")
    known = lambda name: one.where(search.alias(name, F.col("path"), F.col("source"))).count()
    assert [known(n) for n in ("", " notes.txt ", "dir/notes.txt", "other", "dir")] == [1, 1, 1, 0, 0]
