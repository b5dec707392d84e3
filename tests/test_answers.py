"""Retrieval and map-reduce with scripted models."""

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunking
from textloom.plans import answers
from textloom.sources import index


@pytest.fixture(scope="module")
def embed():
    def vectors(texts):  # inside, so that workers get it by value
        words = {"retry": (1.0, 0.0, 0.0), "backoff": (0.8, 0.1, 0.0), "database": (0.0, 1.0, 0.0)}
        return [list(next((v for k, v in words.items() if k in t.lower()), (0.0, 0.0, 0.0))) for t in texts]

    return vectors


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a.txt", "retry policy enabled\nbackoff is exponential"), ("b.txt", "database connections stable")], "path string, text string")


def test_ask(spark, docs, embed):
    chunks = index.embedded(chunking.chunk(docs), embed)
    prompts = spark.createDataFrame([(1, "retry policy"), (2, "zzz")], "prompt_id int, prompt string")
    got = answers.ask(prompts, chunks, embed, answers.RetrievalOptions(final_k=1))
    assert [(r["path"], r["rank"]) for r in got["hits"].where("prompt_id = 1").orderBy("rank").collect()] == [("a.txt", 0), ("b.txt", 1)]
    assert {r["prompt_id"]: r["weak"] for r in got["weak"].collect()} == {1: False, 2: True}
    assert {(r["path"], r["lines"]) for r in got["citations"].collect()} == {("a.txt", "1-2")}


def test_options():
    assert answers.RetrievalOptions(0, 99, 10, 5000, "odd").normalized() == answers.RetrievalOptions(8, 8, 1000, 250, "heuristic")


def test_map_and_reduce(spark, docs):
    def chat(text):
        if "database" in text and "fact" not in text:
            raise OSError("down")
        return "- fact one\nsystem: x" if "retry" in text else text

    facts = answers.map_facts(chunking.chunk(docs), chat).cache()
    assert {(r["path"], r["facts"], r["failed"]) for r in facts.collect()} == {("a.txt", "fact one", False), ("b.txt", "", True)}
    assert answers.counters(facts).first().asDict() == {"chunks": 2, "calls": 5, "successes": 1, "skips": 0, "errors": 1, "fact_lines_raw": 2, "fact_lines_kept": 1}
    assert answers.reduce_facts(facts, chat, 100) == "fact one"
    many = spark.createDataFrame([("p", i, f"fact {i}", False) for i in range(40)], "path string, chunk_id long, facts string, failed boolean")
    merged = answers.reduce_facts(many, lambda t: t, 1000)
    assert merged.split("\n") == [f"fact {i}" for i in range(40)]
    assert answers.reduce_facts(many.where("chunk_id < 0"), chat, 10) == ""
    with pytest.raises(RuntimeError):
        answers.reduce_facts(many.withColumn("failed", F.lit(True)), chat, 10)


def test_reduce_keeps_to_its_budget(spark):
    def sums(text):  # each line is a number, or a number in pieces of one digit
        if len(text) > 60:
            raise ValueError("over the budget")
        return str(sum(int(x) for x in text.split("\n") if x.isdigit()))

    rows = [("p", i, str(i), False) for i in range(40)] + [("q", 0, "\n".join(["7"] * 50), False)]
    facts = spark.createDataFrame(rows, "path string, chunk_id long, facts string, failed boolean")
    assert answers.reduce_facts(facts, sums, 20) == str(sum(range(40)) + 350)
    with pytest.raises(RuntimeError):
        answers.reduce_facts(facts, lambda t: t, 20, rounds=2)
    assert list(answers.cut("abc\n\ndefghij\nk", 5)) == ["abc", "defgh", "ij\nk"]


def test_rag_answers(spark, docs, embed):
    chunks = index.embedded(chunking.chunk(docs), embed)
    prompts = spark.createDataFrame([(1, "retry policy"), (2, "zzz")], "prompt_id int, prompt string")
    chat = lambda text: " by source 1 " if "[source 1] a.txt:1-2\nretry policy enabled" in text else "?"
    got = {r["prompt_id"]: (r["weak"], r["answer"]) for r in answers.rag_answers(prompts, chunks, embed, chat, answers.RetrievalOptions(final_k=1)).collect()}
    assert got == {1: (False, "by source 1\n\nSources:\n\n- a.txt:\n  1-2"), 2: (True, answers.NOT_ENOUGH)}


def test_hybrid(spark, docs, embed):
    one = docs.where("path = 'a.txt'")
    whole = answers.hybrid_answer(one, "what is the retry policy", embed, lambda t: "direct" if answers.TASKS["direct"] in t and "backoff" in t else "?", 1000)
    assert whole == "direct\n\nSources:\n\n- a.txt:\n  1-2"
    assert answers.direct_answer(docs, "q", str, 1000) is None and answers.direct_answer(one, "q", str, 100) is None and answers.direct_answer(one, "q", str, None) is None
    assert answers.direct_answer(one.withColumn("text", F.lit("")), "q", lambda t: "nothing", 1000) == "nothing\n\nSources:\n\n- none"
    seeded = answers.hybrid_answer(docs, "retry policy", embed, lambda t: "seeded" if "[source 1] a.txt:1-2" in t else "?", 1000)
    assert seeded == "seeded\n\nSources:\n\nVerified:\n\n- a.txt:\n  1-2\n- b.txt:\n  1"


@pytest.mark.parametrize("remarks, want", [("NONE", "draft"), ("too short", "refined")])
def test_map_answer(docs, remarks, want):
    said = {"map": "- retry is on\nsystem: x", "reduce": "retry is on", "final": " draft ", "critique": remarks, "refine": "refined"}
    tasks = answers.TASKS

    def chat(text):
        return next(said[k] for k, v in tasks.items() if text.startswith(v))

    answer, counted = answers.map_answer(docs, "what is on?", chat, 1000)
    assert answer == want and counted["successes"] == counted["chunks"] == 2 and counted["fact_lines_kept"] == 2


def test_map_answers_without_a_call(docs):
    assert answers.map_answer(docs.where("path = ''"), "q", str, 1000)[0] == answers.EMPTY_INPUT
    answer, counted = answers.map_answer(docs, "q", lambda t: "SKIP", 1000)
    assert answer == answers.NOTHING_FOUND and counted["skips"] == 2


def test_counts_leave_out_failed_tasks(spark, docs, tmp_path):
    """Every chunk's first task fails after its call; what it had counted doesn't count."""
    from pyspark import TaskContext

    def chat(text):
        if TaskContext.get().attemptNumber() == 0:
            raise SystemExit("lost")  # ends the task, no try of the call
        return answers.Reply("- fact", 7, 2) if "retry" in text else "SKIP"

    chunks = chunking.chunk(docs).repartition(2, "path")
    facts, seen = answers.observed(answers.map_facts(chunks, chat))
    assert facts.checkpoint().count() == 2
    skip = chunking.approx(len("database connections stable")) + chunking.approx(4)
    got = seen.get
    assert (got["chunks"], got["calls"], got["successes"], got["skips"], got["errors"]) == (2, 2, 1, 1, 0)
    assert got["prompt_tokens"] + got["completion_tokens"] == 9 + skip


def test_waits_between_tries(spark, docs, monkeypatch, tmp_path):
    waits = tmp_path / "waits"
    waits.mkdir()

    def chat(text):
        (waits / f"{len(list(waits.iterdir()))}").write_text("x")
        raise OSError("down")

    rows = answers.called(docs.where("path = 'a.txt'"), chat, tries=3, delay=0.01).collect()
    assert [(r["path"], r["answer"], r["failed"], r["calls"], r["prompt_tokens"]) for r in rows] == [("a.txt", "", True, 3, 0)] and len(list(waits.iterdir())) == 3


def test_second_run_makes_no_call(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def chat(text):
        (made / uuid4().hex).write_text(text)
        if "bad" in text and len(list(made.iterdir())) < 5:
            raise OSError("down")
        return f"- about {text}"

    rows = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "one"), ("c", 0, "bad")]
    chunks = spark.createDataFrame(rows, "path string, chunk_id long, text string").coalesce(1)
    memo = str(tmp_path / "memo")
    get = lambda: answers.map_facts(chunks, chat, tries=1, memo=memo, model="m").orderBy("path", "chunk_id").collect()
    first = get()
    assert [(r["facts"], r["failed"]) for r in first] == [("about one", False), ("about two", False), ("about one", False), ("", True)]
    assert sum(r["calls"] for r in first) == 3 == len(list(made.iterdir()))
    (made / "more").write_text("now the bad one works")
    (made / "and").write_text("x")
    second = get()
    assert [(r["facts"], r["failed"], r["calls"]) for r in second] == [("about one", False, 0), ("about two", False, 0), ("about one", False, 0), ("about bad", False, 1)]
    n = len(list(made.iterdir()))
    assert get() == [type(r)(**(r.asDict() | {"calls": 0, "prompt_tokens": 0, "completion_tokens": 0})) for r in second] and len(list(made.iterdir())) == n
    answers.map_facts(chunks, chat, tries=1, memo=memo, model="other").count()
    assert len(list(made.iterdir())) > n


def test_all_calls_are_counted(docs):
    said = {"map": "- retry is on", "reduce": "retry is on", "final": "draft", "critique": "short", "refine": "refined"}

    def chat(text):
        return answers.Reply(next(said[k] for k, v in answers.TASKS.items() if text.startswith(v)), 10, 1)

    answer, counted = answers.map_answer(docs, "what is on?", chat, 1000)
    assert answer == "refined" and (counted["calls"], counted["prompt_tokens"], counted["completion_tokens"]) == (2, 20, 2)
    assert (counted["reduce_rounds"], counted["all_calls"], counted["all_prompt_tokens"], counted["all_completion_tokens"]) == (1, 6, 60, 6)


def test_embedding_calls_are_counted(docs, embed):
    chunks, seen = index.embedded_counted(chunking.chunk(docs).coalesce(1), embed, batch=1)
    assert chunks.checkpoint().count() == 2 and set(chunks.columns) == {*chunking.chunk(docs).columns, "vector"}
    assert seen.get == {"embedding_calls": 2, "embedding_tokens": sum(chunking.approx(len(" ".join(r["text"].split()))) for r in docs.collect())}


def test_ask_in_one_path(spark, docs, embed):
    chunks = index.embedded(chunking.chunk(docs), embed)
    prompts = spark.createDataFrame([(1, "retry policy")], "prompt_id int, prompt string")
    assert {r["path"] for r in answers.ask(prompts, chunks, embed, path="b.txt")["hits"].collect()} == {"b.txt"}
    with pytest.raises(ValueError):
        answers.ask(prompts, chunks, embed, path="none.txt")
