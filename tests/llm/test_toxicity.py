"""Segments against the recursive definition, the law and the link against samples, the query against held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import toxicity


def plain_segments(scores, a=0):
    """The best stretch of a list, and those of what is left and right of it."""
    best = max(((sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[2]
    return [*plain_segments(scores[:i], a), (a + i, a + j - 1, best[0]), *plain_segments(scores[j:], a + j)]


def test_segments():
    rng = random.Random(4)
    for _ in range(1500):
        n, drift = rng.randrange(1, 25), rng.choice([0.05, 0.4, 1.1])
        gains = {i: rng.random() * 2 + 0.01 for i in range(n) if rng.random() < 0.4}
        want = plain_segments([gains.get(i, -drift) for i in range(n)])
        got = toxicity.segments(list(gains), list(gains.values()), drift)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_long_scan():
    n = 300_000
    assert len(toxicity.segments(list(range(0, 2 * n, 2)), [1.0] * n, 2.0)) == n
    assert len(toxicity.segments(list(range(0, 2 * n, 2)), [1.0] * n, 0.5)) == 1
    rising = [1.0 + k / n for k in range(n)]
    assert len(toxicity.segments(list(range(0, 2 * n, 2)), rising, 3.0)) == n


def test_weights():
    n = np.array([400, 400, 1, 1, 0, 4000])
    toxic, clean = np.array([100, 10, 1, 0, 0, 200]), np.array([2, 80, 0, 1, 0, 1600])
    w = toxicity.weights(n, clean, toxic)
    assert w[0] > 2 and not w[1:].any()  # rare tokens and those of clean text say nothing
    assert not toxicity.weights(n, clean * 0, toxic * 0).any()


def test_law_and_link():
    rng = np.random.default_rng(5)
    clean = []
    for _ in range(800):
        at = np.flatnonzero(rng.random(400) < 0.02)
        clean.append((0, 400, at.tolist(), rng.exponential(0.5, len(at)).tolist()))
    law = toxicity.fit_law([*clean, (1, 100, list(range(0, 100, 8)), [4.0] * 13)])
    tops = [max((s for *_, s in toxicity.segments(at, g, law.drift)), default=0) for _, n, at, g in clean]
    for level in (2.0, 3.0):  # the expected number of high segments is about the share of texts that have one
        assert 0.3 < (1 - math.exp(-law.expected(level, 400))) / max(1e-3, np.mean(np.array(tops) >= level)) < 3
    assert law.surprise([5.0, 5.0], 400) > law.surprise([5.0], 400) > law.surprise([], 400) == 0
    x = rng.random(4000) * 4
    y = (rng.random(4000) < 1 - np.exp(-np.exp(-4 + 1.5 * x))).astype(float)
    a, b = toxicity.fit_link(x, y)
    assert abs(a + 4) < 0.4 and abs(b - 1.5) < 0.15


def test_query(spark, small, labels):
    got = toxicity.op11_toxicity(spark, small).toPandas()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    again = toxicity.op11_toxicity(spark, small).toPandas()
    assert got.sort_values("doc_id")["score"].tolist() == again.sort_values("doc_id")["score"].tolist()


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    try:
        docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("the test tables aren't here")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    held = scored.join(labels, "doc_id").where(toxicity.in_fold()[0]).select("score", "toxic").toPandas()
    hit = held["score"] >= toxicity.THRESHOLD
    assert hit[held["toxic"] == 1].mean() > 0.6 and hit[held["toxic"] == 0].mean() < 0.02


def test_labels_teach_outside_the_fold(spark):
    ids = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    known = {r["labelled_id"] for r in toxicity.known_labels(ids.union(spark.createDataFrame([(4, 1), (None, 1)], "doc_id long, toxic int"))).collect()}
    held = {r["doc_id"] for r in ids.where(toxicity.in_fold()[0]).collect()}
    assert held and known == set(range(60)) - held - {4}


@pytest.mark.parametrize("most", [0, 1000])
def test_counts(spark, odd, most, monkeypatch):
    monkeypatch.setattr(toxicity.with_labels, "__defaults__", (most,))
    known = toxicity.known_labels(spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int"))
    got = {r["bucket"]: tuple(r)[1:] for r in toxicity.bucket_counts(odd.repartition(3), known).collect()}
    label = {r["labelled_id"]: (r["label"], r["half"]) for r in known.collect()}
    want, table = {}, toxicity.Buckets()
    for r in odd.collect():
        for b in {int(b) for w in toxicity.words_in(r["text"]) for b in table.rows[table.places([w])[0]]}:
            own = want.setdefault(b, [0] * 5)
            own[0] += 1
            if r["doc_id"] in label:
                y, half = label[r["doc_id"]]
                own[1 + 2 * half + y] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_odd_rows(spark, clashing, nothing):
    bad = "you utter fool and scoundrel " * 3
    rows = [(1000 + i, bad if i % 2 else "a kind and gentle word for everyone here", "en", "s", 1) for i in range(300)]
    docs = clashing.unionByName(spark.createDataFrame(rows, nothing.schema), allowMissingColumns=True)
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(300)] + [(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all((r["score"] > 0.7) == bool(r["doc_id"] and r["doc_id"] >= 1000 and r["doc_id"] % 2) for r in got)
    passages = {tuple(map(tuple, r["passages"])) for r in got if r["doc_id"] == 1001}
    assert len(passages) == 1 and all(p[0] <= p[1] < 15 and p[3] <= toxicity.EXPECTED for p in passages.pop())
    for few in (labels.where("false"), labels.where("toxic = 1")):
        same = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, few)).collect()}
        assert len(same) == 1 and 0 <= same.pop() <= 1
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).collect() == []
