"""Lines, searches, paging and chunks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import chunking, lines, retrieval, search

CYRILLIC = "первая строка\nвторая с текстом\nтретья строка\nчетвёртая с текстом\nпятая строка"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a.txt", CYRILLIC), ("b.txt", "zero\none match\ntwo\r\n"), ("c.txt", ""), ("d.txt", None)], "path string, text string").cache()


def found(df):
    return [(r["path"], r["line_no"]) for r in df.orderBy(F.col("score").desc(), "path", "line_no").collect()]


def test_lines(docs):
    got = lines.lines_with_offsets(docs).where("path = 'b.txt'").orderBy("line_no").collect()
    assert [(r["line_no"], r["text"], r["byte_start"], r["byte_len"]) for r in got] == [(1, "zero", 0, 4), (2, "one match", 5, 9), (3, "two\r", 15, 4)]
    assert lines.lines(docs).where("path IN ('c.txt', 'd.txt')").count() == 0


def test_offsets_of_many_lines(spark):
    texts = ["", "\n\nx\n", "äö\n" * 1000 + "end", "\n".join("w" * (k % 7) for k in range(513)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    want = [(k, i + 1, sum(len(x.encode()) + 1 for x in t.split("\n")[:i])) for k, t in enumerate(texts) if t for i, _ in enumerate(t.removesuffix("\n").split("\n"))]
    got = sorted((r["path"], r["line_no"], r["byte_start"]) for r in lines.lines_with_offsets(df).collect())
    assert [g for g in got if g[0] != 2] == [w for w in want if w[0] != 2] and [g for g in got if g[0] == 2] == [(2, i + 1, 5 * i) for i in range(1001)]


def test_regex_and_literal(docs):
    assert found(search.regex_matches(docs, "текстом$")) == [("a.txt", 2), ("a.txt", 4)]
    assert found(search.literal_matches(docs, "СТРОКА")) == [("a.txt", 1), ("a.txt", 3), ("a.txt", 5)]
    for broken in ("[текст", r"(a)\1", "(?=a)"):
        with pytest.raises(ValueError, match="invalid_arguments"):
            search.regex_matches(docs, broken)


def test_auto_prefers_literal_anywhere(spark):
    two = spark.createDataFrame([("a.txt", "retry only"), ("b.txt", "retry policy"), ("c.txt", "retry backoff policy")], "path string, text string")
    assert found(search.auto_matches(two, "retry policy")) == [("b.txt", 1)]
    assert found(search.auto_matches(two, "policy zz retry")) == [("b.txt", 1), ("c.txt", 1), ("a.txt", 1)]
    assert found(search.auto_matches(two, "[текст")) == []


def test_page(docs):
    rows = search.search(docs, "строка", "literal", limit=2).collect()
    assert [(r["line_no"], r["total_matches"], r["has_more"], r["next_offset"]) for r in rows] == [(1, 3, True, 2), (3, 3, True, 2)]
    last = search.search(docs, "строка", "literal", limit=2, offset=2).collect()
    assert [(r["line_no"], r["has_more"], r["next_offset"]) for r in last] == [(5, False, 0)]
    with pytest.raises(ValueError):
        search.search(docs, " ", only="a.txt")


def test_context(docs):
    r = search.with_context(docs, lambda x: F.contains(x, F.lit("match")), 1).first()
    assert (r["line_no"], r["context_before"], r["context_after"]) == (2, ["zero"], ["two"])


def test_reads(docs):
    one = docs.where("path = 'b.txt'")
    assert [r["content"] for r in lines.read_lines(one, 2, 9).collect()] == ["one match", "two"]
    assert lines.read_lines(one, 3, 2).count() == 0
    assert [r["line_no"] for r in lines.read_around(one, 1).collect()] == [1]
    assert [r["line_no"] for r in lines.read_around(one, 1, -1, -1).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        lines.read_around(one, 0)


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("line 1\nline 2 with more bytes\nline 3\nline 4\nline 5", 32, 8, [(1, 2, 0, "line 1\nline 2 with more bytes"), (2, 3, 7, "line 2 with more bytes\nline 3"), (4, 5, 37, "line 4\nline 5")]),
        ("one\ntwo\n", 64, 0, [(1, 2, 0, "one\ntwo")]),
        ("a" * 25 + "\n", 10, 0, [(1, 1, 0, "a" * 10), (1, 1, 10, "a" * 10), (1, 1, 20, "a" * 5)]),
        ("aaaa\nbbbb\ncccc\n" + "d" * 20 + "\neeee\n", 15, 5, [(1, 3, 0, "aaaa\nbbbb\ncccc"), (3, 3, 10, "cccc"), (4, 4, 15, "d" * 15), (4, 4, 25, "d" * 10), (5, 5, 36, "eeee")]),
        ("ж" * 10 + "\nx", 8, 2, [(1, 1, 0, "жжжж"), (1, 1, 6, "жжжж"), (1, 1, 12, "жжжж"), (2, 2, 21, "x")]),
        ("aaaa\nbbbb\ncccc\ndddddddddddd\n", 15, 6, [(1, 3, 0, "aaaa\nbbbb\ncccc"), (2, 3, 5, "bbbb\ncccc"), (4, 4, 15, "d" * 12)]),
        ("", 10, 0, []),
    ],
)
def test_byte_chunks(text, size, overlap, want):
    assert list(chunking.byte_chunks(text, size, overlap)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aж🙂\n\r ", max_size=80), st.integers(1, 30))
def test_chunks_without_overlap_give_the_text_back(text, size):
    parts = [t for *_, t in chunking.byte_chunks(text, size, 0)]
    assert "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert all(len(t.encode()) <= max(size, 4) for t in parts)


def test_budgets():
    assert [chunking.budget(n) for n in (0, 1, 5, 10, 30000)] == [0, 1, 3, 6, 18000]
    assert [chunking.approx(len(t)) for t in ("", "a", "abc", "abcd", "привет")] == [0, 1, 1, 2, 2]
    assert chunking.chunk_options(10, 5000) == (1000, 250) and chunking.chunk_options(1800, 200) == (1800, 200)


def test_token_chunks():
    assert list(chunking.token_chunks("a\nb\n", 10, 0)) == [("a\nb", 1)]
    assert list(chunking.token_chunks("abcdefgh\nx", 2, 0)) == [("abcdef", 2), ("gh", 1), ("x", 1)]
    assert list(chunking.token_chunks("\na", 2, 0)) == [("a", 1)]
    with pytest.raises(ValueError):
        list(chunking.token_chunks("a", 5, 5))


def test_chunk_table(docs):
    rows = chunking.chunk(docs, 40, 0).where("path = 'a.txt'").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and "\n".join(r["text"] for r in rows) == CYRILLIC
    tokens = chunking.chunk_by_tokens(docs, 60, 10).where("path = 'a.txt'").orderBy("chunk_id").collect()
    assert all(r["token_count"] + 10 == r["request_tokens"] <= 36 for r in tokens)


def test_java_patterns_are_taken(spark):
    docs = spark.createDataFrame([("a", "x1\n22\nнет")], "path string, text string")
    lines = lambda pattern: [r["line_no"] for r in search.regex_matches(docs, pattern).orderBy("line_no").collect()]
    assert lines(r"^\p{L}+\z") == [3] and lines(r"(?P<n>\d)\Q2\E") == [2]
    with pytest.raises(ValueError, match="invalid_arguments"):
        search.regex("[нет")


def test_unknown_path_and_context(spark):
    docs = spark.createDataFrame([("a", "zero\none match\ntwo"), ("b", "match")], "path string, text string")
    with pytest.raises(ValueError, match="unknown path"):
        search.search(docs, "match", only="c")
    got = search.search(docs, "match", context=1).orderBy("path").collect()
    assert [(r["path"], r["context_before"], r["context_after"]) for r in got] == [("a", ["zero"], ["two"]), ("b", [], [])]
    assert [r["path"] for r in search.search(docs, "match", only=" b ").collect()] == ["b"]


def test_totals_of_an_empty_page(spark):
    docs = spark.createDataFrame([("a", "match\nmatch")], "path string, text string")
    rows = search.literal_matches(docs, "match")
    assert [tuple(r) for r in lines.page_totals(rows, 1).collect()] == [(2, True, 1)]
    assert [tuple(r) for r in lines.page_totals(rows, 5, 99).collect()] == [(2, False, 0)]


def test_nearest_is_the_ranking_of_all_similarities(spark, monkeypatch):
    rng = random.Random(12)
    vector = lambda: rng.choice([None, [], [0.0] * 4, [1.0, 2.0, 3.0], *[[round(rng.gauss(0, 1), 1) for _ in range(4)] for _ in range(9)]])
    rows = [(rng.choice(["a", "b", "ä", None]), i, vector()) for i in range(300)] + [("z", 1000 + i, [1.0, 0.5, 0.25, 0.1]) for i in range(200)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "path string, chunk_id long, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(i, vector()) for i in range(40)] + [(50, [1.0, 0.5, 0.25, 0.1])], "query_id int, query_vector array<float>")
    pairs = asked.join(chunks).withColumn("similarity", tx.cosine(F.col("query_vector"), F.col("vector")))
    best = lambda rows: sorted(map(tuple, retrieval.top_k(rows).select("query_id", "rank", "path", "chunk_id", "similarity").collect()))
    want = best(pairs)
    own = asked.withColumn("path", F.when(F.col("query_id") % 3 > 0, F.element_at(F.array(F.lit("a"), F.lit("ä"), F.lit("z"), F.lit("none")), F.col("query_id") % 4 + 1)))
    inside = best(own.withColumnRenamed("path", "of").join(chunks).where("of IS NULL OR of = path").withColumn("similarity", tx.cosine(F.col("query_vector"), F.col("vector"))))
    monkeypatch.setattr(retrieval, "TOGETHER", 7)
    for most in (65_536, 10):
        monkeypatch.setattr(retrieval, "ASKED", most)
        got = retrieval.nearest(asked, chunks).select("query_id", "rank", "path", "chunk_id", "similarity").collect()
        assert sorted(map(tuple, got)) == want and len(want) == 41 * 8
        got = retrieval.nearest(own, chunks).select("query_id", "rank", "path", "chunk_id", "similarity").collect()
        assert sorted(map(tuple, got)) == inside and 0 < len(inside) < len(want)
    assert retrieval.nearest(asked.where("false"), chunks).count() == retrieval.nearest(asked, chunks.where("false")).count() == 0
