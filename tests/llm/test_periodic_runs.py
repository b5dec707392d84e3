"""Runs against all stretches of all periods, one by one, and the query against the same."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import periodic_runs
from textloom.llm.common import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """Maximal stretches that agree a period apart; a multiple of a smaller period is that period's run."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                found.add((i, j - i + q, q))
            i = j + 1
    return sorted(found)


def plain_lyndon(w):
    """The length of the longest Lyndon prefix of each suffix: up to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def words(rng):
    kind = rng.random()
    if kind < 0.4:
        return [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randrange(60))]
    if kind < 0.7:
        block = [rng.randrange(5) for _ in range(rng.randrange(1, 8))]
        return [rng.randrange(9) for _ in range(rng.randrange(9))] + (block * 9)[: rng.randrange(60)] + [rng.randrange(9) for _ in range(rng.randrange(9))]
    return sum(([rng.randrange(3)] * rng.randrange(1, 9) for _ in range(9)), [])


def test_lyndon_groups():
    rng = random.Random(1)
    for _ in range(1500):
        w = words(rng)
        if not w:
            continue
        x = np.unique(np.array(w), return_inverse=True)[1]
        for ranks in (x, x.max() - x):
            length, same = periodic_runs.lyndon_groups(ranks)
            assert length.tolist() == plain_lyndon(ranks.tolist())
            by = {}
            for i, (n, g) in enumerate(zip(length.tolist(), same.tolist())):
                by.setdefault(tuple(ranks[i : i + n].tolist()), set()).add(g)
            assert all(len(g) == 1 for g in by.values()) and len(set.union(*by.values())) == len(by)


def test_runs():
    rng, seen = random.Random(2), 0
    for _ in range(3000):
        w = words(rng)
        want = plain_runs(w)
        seen += len(want)
        assert periodic_runs.runs_of(np.array(w, dtype=np.int64)) == want if w else not want
    assert seen > 500


def test_long_stretches():
    fib = [0], [0, 1]
    while len(fib[1]) < 30_000:
        fib = fib[1], fib[1] + fib[0]
    one = np.zeros(200_000, dtype=np.int64)
    assert periodic_runs.runs_of(one) == [(0, 200_000, 1)]
    both = np.arange(200_000) % 50_000
    assert periodic_runs.runs_of(both) == [(0, 200_000, 50_000)]
    assert periodic_runs.runs_of(np.array(fib[1])) == []  # no power of four in it


def wanted(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, small, documents):
    got = sorted(map(tuple, periodic_runs.op13_periodic_runs(spark, small).collect()), key=repr)
    rows = documents.where("length(text) < 12000").select("doc_id", "text").collect()
    ids = {r["doc_id"] for r in rows}
    assert len(got) == documents.count() and sum(r[1] > 0 for r in got) > 10
    assert [r for r in got if r[0] in ids] == sorted((wanted(*r) for r in rows), key=repr)


def test_odd_rows(spark, clashing, nothing, tmp_path):
    for df in (clashing, nothing):
        df.write.parquet(f"file://{tmp_path}/{df.count()}/documents.parquet")
        got = periodic_runs.op13_periodic_runs(spark, f"file://{tmp_path}/{df.count()}").collect()
        assert sorted(map(tuple, got), key=repr) == sorted((wanted(*r) for r in df.select("doc_id", "text").collect()), key=repr)
    kept = periodic_runs.find_runs(clashing.withColumn("words", words_of()).withColumn("runs", F.lit(1)))
    assert kept.count() == clashing.count() and set(kept.columns) == {*clashing.columns, "runs", "collapsed"} - {"words"}


@pytest.mark.parametrize("text,runs,collapsed", [
    ("a a a a a", [], "a a a a a"), ("x a a a a a a y", [(1, 6, 1)], "x a y"), ("a b a b a b a b", [(0, 8, 2)], "a b"),
    ("a b a b a b a c", [], "a b a b a b a c"), ("a a a a a a b b b b b b", [(0, 6, 1), (6, 6, 1)], "a b"),
])
def test_known(spark, text, runs, collapsed):
    row = periodic_runs.find_runs(spark.createDataFrame([(text,)], "text string").select(words_of().alias("words"))).first()
    assert [tuple(r) for r in row["runs"]] == runs and row["collapsed"] == collapsed


def test_query_against_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    from textloom.llm.oracles import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = con.execute(ORACLES["op13_periodic_runs"])
    names = [d[0] for d in found.description]
    got = periodic_runs.op13_periodic_runs(spark, small).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
