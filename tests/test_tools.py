"""Tools: calls in texts, envelopes, the registry, table functions of SQL, semantic pages."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import calls
from textloom.operators import evidence, lines, retrieval, search, semantic, tools


@pytest.fixture(scope="module")
def docs(spark):
    texts = {"a.txt": "Alpha one\nbeta two\r\nalpha three\n", "b.txt": "nothing\n\nbeta alpha gamma", "c.txt": "", "d.txt": None}
    return spark.createDataFrame(list(texts.items()), "path string, text string").cache()


def parsed(spark, text, turn=3):
    return spark.createDataFrame([(text, turn)], "t string, n int").select(calls.calls_in(F.col("t"), F.col("n")).alias("c")).first()["c"]


def test_calls_in_a_text(spark):
    got = parsed(spark, "## Plan: read on.\n<tool_call> <function=read_around> <parameter=Path> a.txt <parameter=line> 7 <parameter=before> 2 <parameter=after> 3 </tool_call>")
    assert (got["text"], got["detected"], got["error"]) == ("## Plan: read on.", True, None)
    assert [(c["id"], c["name"], json.loads(c["arguments"])) for c in got["calls"]] == [("text-tool-call-3-1", "read_around", {"path": "a.txt", "line": 7, "before": 2, "after": 3})]
    both = parsed(spark, "a <TOOL_CALL>\n<function=search_file><parameter=query> two\n  \"words\" <parameter=limit>+05<parameter=offset> x <parameter=deep> TRUE<parameter=mode> </tool_call> b <tool_call><function=list_files></tool_call> c")
    assert both["text"] == "a b c"
    assert [(c["id"], c["name"], c["arguments"]) for c in both["calls"]] == [
        ("text-tool-call-3-1", "search_file", '{"deep":true,"limit":5,"offset":"x","query":"two \\"words\\""}'), ("text-tool-call-3-2", "list_files", "{}")]
    assert json.loads(parsed(spark, "<tool_call><function=f><parameter=q>1<parameter=Q>2<parameter=line>99999999999999999999</tool_call>")["calls"][0]["arguments"]) == {"q": "2", "line": "99999999999999999999"}


@pytest.mark.parametrize("text,want", [
    (None, ("", False, None)), ("  plain text ", ("plain text", False, None)), ("x <tool_call> <function=read_around> <parameter=Path>\na.txt", ("x a.txt", True, calls.INCOMPLETE)),
    ("<tool_call><parameter=q>1</tool_call> y", ("y", True, calls.NAMELESS)), ("</tool_call> alone", ("</tool_call> alone", False, None)),
])
def test_texts_without_calls(spark, text, want):
    got = parsed(spark, text)
    assert (got["text"], got["detected"], got["error"]) == want and got["calls"] == []


def test_envelopes(spark):
    frame = spark.createDataFrame([(1, "a.txt", 4), (2, None, 0)], "i int, path string, n int")
    result = F.struct("path", calls.nonzero(F.col("n")).alias("next_offset"), F.col("i"))
    raw = frame.select("i", calls.envelope(result, cached=F.col("i") == 1, novel_lines=F.col("n"), hint=F.lit(""), next_offset=F.col("n")).alias("raw")).orderBy("i").collect()
    assert raw[0]["raw"] == '{"result":{"path":"a.txt","next_offset":4,"i":1},"meta":{"novel_lines":4,"cached":true,"suggested_next_offset":4}}'
    assert raw[1]["raw"] == '{"result":{"i":2},"meta":{"novel_lines":0}}'
    failed = spark.range(1).select(calls.error_envelope(F.lit("unknown_tool"), F.lit("no"), details=F.create_map(F.lit("tool"), F.lit("x"))).alias("raw")).first()["raw"]
    rows = spark.createDataFrame([(r,) for r in [raw[0]["raw"], raw[1]["raw"], failed, "no json", '{"meta":{}}', None]], "raw string")
    got = [r["o"] for r in rows.select(calls.opened(F.col("raw"), "struct<path:string,next_offset:int,i:int>").alias("o")).collect()]
    assert got[0]["result"].asDict() == {"path": "a.txt", "next_offset": 4, "i": 1} and got[0]["meta"]["cached"] and not got[0]["meta"]["duplicate"] and got[0]["corrupt"] is None
    assert got[1]["result"].asDict() == {"path": None, "next_offset": None, "i": 2} and got[1]["meta"]["novel_lines"] == 0
    assert got[2]["result"] is None and got[2]["error"].asDict() == {"code": "unknown_tool", "message": "no", "retryable": False, "details": {"tool": "x"}}
    assert [(g["result"], g["error"], g["corrupt"]) for g in got[3:]] == [(None, None, "no json"), (None, None, '{"meta":{}}'), (None, None, "")]


def test_registry(docs):
    other = tools.Tool("list_files", {}, (), lambda a: a, lambda corpus, a: corpus.docs.limit(0))
    own = tools.Registry((None, tools.LIST_FILES, other, tools.SEARCH_FILE, tools.READ_LINES, tools.READ_AROUND, tools.SEARCH_RAG))
    assert [d[0] for d in own.definitions()] == ["list_files", "search_file", "read_lines", "read_around", "search_rag"]
    c = tools.Corpus(docs)
    rows = lambda name, raw=None: own.call(c, name, raw)[0].collect()
    assert [r["path"] for r in rows("list_files", '{"limit": 2, "offset": 1}')] == ["b.txt", "c.txt"] and len(rows("list_files")) == 4
    assert [(r["line_no"], r["content"]) for r in rows("read_lines", '{"path": " a.txt ", "start_line": -3, "end_line": 2}')] == [(1, "Alpha one"), (2, "beta two")]
    around = rows("read_around", '{"path": "b.txt", "line": 3, "before": -1, "after": 0}')
    assert [(r["line_no"], r["start_line"], r["end_line"]) for r in around] == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert [(r["path"], r["line_no"]) for r in rows("search_file", '{"query": "ALPHA", "limit": 2}')] == [("a.txt", 1), ("a.txt", 3)]
    same, known = own.call(c, "search_file", '{"limit": 2, "mode": "any", "query": " ALPHA "}')
    assert known and same is own.call(c, "search_file", '{"query": "ALPHA", "limit": 2}')[0]
    assert own.call(c, "search_file", '{"query": "ALPHA", "limit": 2}', remember=False)[1] is False
    for name, raw, code in (("nope", None, "unknown_tool"), ("read_lines", '{"start_line": 1}', "invalid_arguments"), ("read_lines", "[", "invalid_arguments"), ("read_around", '{"line": 0}', "invalid_arguments"),
                            ("search_file", '{"query": "x", "path": "zz"}', "invalid_arguments"), ("search_file", '{"query": "", "path": "a.txt"}', "invalid_arguments"), ("search_file", '{"query": 4}', "invalid_arguments"),
                            ("search_file", '{"query": "(", "mode": "regex"}', "invalid_arguments"), ("search_rag", '{"query": "x"}', "tool_not_ready"), ("read_lines", '{"path": "x", "start_line": 1, "end_line": 2}', "invalid_arguments")):
        with pytest.raises(tools.ToolError) as e:
            own.call(c, name, raw)
        assert e.value.code == code, name


def test_names_of_a_single_file(docs):
    one = tools.Corpus(docs.where("path = 'a.txt'").withColumn("source", F.lit("dir/opened.txt")), source="source")
    for name in ("a.txt", "dir/opened.txt", "opened.txt", ""):
        assert tools.Registry().call(one, "read_lines", json.dumps({"path": name, "start_line": 1, "end_line": 1}))[0].count() == 1
    many = tools.Corpus(docs.withColumn("source", F.lit("dir/opened.txt")), source="source")
    with pytest.raises(tools.ToolError):
        tools.Registry().call(many, "read_lines", '{"path": "opened.txt", "start_line": 1, "end_line": 1}')


def test_table_functions(spark, docs):
    assert tools.Registry().register(spark) == ["search_file", "read_lines", "read_around", "match_ranges"]
    docs.createOrReplaceTempView("tool_docs")
    sql = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    columns = ["path", "line_no", "content", "score", "reason"]
    for query, mode, frame in (("alpha", "literal", search.literal_matches(docs, "alpha")), ("^b", "regex", search.regex_matches(docs, "^b")), ("gamma zeta two", "auto", search.auto_matches(docs, "gamma zeta two"))):
        assert sql(f"SELECT path, line_no, content, score, reason FROM search_file(TABLE(SELECT path, text FROM tool_docs), '{query}', '{mode}')") == sorted(map(tuple, frame.select(*columns).collect()))
    near = search.with_context(docs, lambda x: F.contains(F.lower(x), F.lit("beta")), 1)
    assert sql("SELECT path, line_no, content, context_before, context_after FROM search_file(TABLE(SELECT path, text FROM tool_docs), 'beta', mode => 'literal', context_lines => 1)") == sorted(map(tuple, near.collect()))
    assert sql("SELECT * FROM read_lines(TABLE(SELECT path, text FROM tool_docs), -1, 2)") == sorted(map(tuple, lines.read_lines(docs, -1, 2).collect()))
    assert sql("SELECT * FROM read_around(TABLE(SELECT path, text FROM tool_docs), 2, -1, 0)") == sorted(map(tuple, lines.read_around(docs, 2, -1, 0).collect()))
    for bad in ("read_around(TABLE(SELECT path, text FROM tool_docs), 0)", "search_file(TABLE(SELECT path, text FROM tool_docs), '(', 'regex')", "search_file('x', 'y')"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_match_ranges(spark):
    text = "\n".join("hit" if i in (2, 3, 9, 12, 30) else "miss" for i in range(1, 40))
    docs = spark.createDataFrame([(p, text) for p in "ab"] + [("c", "miss")], "path string, text string")
    tools.Registry().register(spark)
    lines.lines(docs).repartition(5).createOrReplaceTempView("tool_lines")
    got = sorted(map(tuple, spark.sql("SELECT path, start_line, end_line FROM match_ranges(TABLE(SELECT path, line_no, text FROM tool_lines), 'HIT', 'literal', 2)").collect()))
    found = search.literal_matches(docs, "hit")
    ranges = found.select(F.lit("verified").alias("kind"), "path", (F.col("line_no") - 2).alias("start_line"), (F.col("line_no") + 2).alias("end_line"))
    assert got == sorted(map(tuple, evidence.merged(evidence.clamped(ranges)).select("path", "start_line", "end_line").collect()))
    assert [r["n_matches"] for r in spark.sql("SELECT * FROM match_ranges(TABLE(SELECT path, line_no, text FROM tool_lines WHERE path = 'a'), 'hit', around => 2) ORDER BY start_line").collect()] == [2, 2, 1]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(p, i, i + 1, i + 3, f"{p} chunk {i}", [1.0, float(i) / 4]) for p in ("a.txt", "b.txt") for i in range(6)]
    return spark.createDataFrame(rows, "path string, chunk_id long, start_line long, end_line long, text string, vector array<float>").cache()


def ask(spark, chunks, rows, **more):
    frame = spark.createDataFrame(rows, "query_id int, query_vector array<float>, question string, path string, limit int, offset int")
    return {r["query_id"]: r for r in semantic.pages(frame, chunks, **more).collect()}


def test_semantic_pages(spark, chunks):
    got = ask(spark, chunks, [(1, [1.0, 0.0], "chunk", "a.txt", 2, 0), (2, [1.0, 0.0], "chunk", None, 0, -4), (3, [1.0, 0.0], " chunk ", " b.txt ", 99, 5), (4, [1.0, 0.0], "chunk", "", 3, 70)])
    one = got[1]
    assert [(m["path"], m["chunk_id"]) for m in one["matches"]] == [("a.txt", 0), ("a.txt", 1)] and (one["total_matches"], one["has_more"], one["next_offset"], one["match_count"]) == (6, True, 2, 2)
    assert (got[2]["limit"], got[2]["offset"], got[2]["total_matches"], got[2]["match_count"], got[2]["next_offset"]) == (5, 0, retrieval.TOP_K, 5, 5)
    assert (got[3]["limit"], got[3]["path"], got[3]["has_more"], got[3]["next_offset"]) == (20, "b.txt", False, None) and [m["chunk_id"] for m in got[3]["matches"]] == [5]
    assert (got[4]["offset"], got[4]["match_count"], got[4]["matches"]) == (8, 0, [])
    for bad in ((1, [1.0], "q", "zz", 1, 0), (1, [1.0], "  ", None, 1, 0)):
        with pytest.raises(ValueError, match="invalid_arguments"):
            ask(spark, chunks, [bad])


def test_semantic_tool_and_evidence(spark, docs, chunks):
    c = tools.Corpus(docs, chunks=chunks, embed=lambda texts: [[1.0, 0.0] for _ in texts])
    page, _ = tools.Registry().call(c, "search_rag", '{"query": "chunk", "path": "b.txt", "limit": 2}')
    assert [m["chunk_id"] for m in page.first()["matches"]] == [0, 1]
    assert sorted(map(tuple, semantic.progress(page).collect())) == [(0, "rag", "b.txt", 1, 3), (0, "rag", "b.txt", 2, 4)]
    hits = semantic.matched(page)
    assert evidence.merged(evidence.clamped(evidence.from_hits(hits))).select("path", "start_line", "end_line").collect() == [("b.txt", 1, 4)]

    def down(texts):
        raise OSError("down")

    for path, embed, code in (("zz", c.embed, "invalid_arguments"), ("", down, "tool_execution_failed")):
        with pytest.raises(tools.ToolError) as e:
            tools.Registry().call(tools.Corpus(docs, chunks=chunks, embed=embed), "search_rag", json.dumps({"query": "q", "path": path}))
        assert e.value.code == code
