"""Mixing against a plain Sainte-Laguë and plain targets."""

import random

from pyspark.sql import functions as F

from textloom.llm import mixing


def plain_seats(votes, total):
    got = dict.fromkeys(votes, 0)
    for _ in range(total):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * got[p] + 1))
        got[best] += 1
    return got


def test_seats(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(25):
        votes = {f"p{k:02}": float(rng.choice([1, 2, 5, 40, 1000, rng.randint(1, 300)])) for k in range(rng.randint(1, 12))}
        total = rng.randint(0, 60)
        rows += [(g, p, v, total) for p, v in votes.items()]
        want |= {(g, p): n for p, n in plain_seats(votes, total).items()}
    df = spark.createDataFrame(rows, "g int, p string, votes double, total long")
    assert {(r["g"], r["p"]): r["out"] for r in mixing.seats(df, ["g"], ["p"], "votes", "total", "out").collect()} == want


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        bound = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not bound:
            return target | {s: level * weight[s] for s in free}
        for s in bound:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= bound
    return target


def test_targets(spark):
    rng = random.Random(7)
    for _ in range(6):
        sizes = {rng.choice(["", "a", "b", "B", "é", "z", None, "s10", "s9", "s1"]): rng.choice([0, 1, 5, 100, 10_000]) for _ in range(7)}
        df = spark.createDataFrame([(s or "", s is None, n) for s, n in sizes.items()], "source_key string, no_source boolean, source_size long")
        got = {None if r["no_source"] else r["source_key"]: r["target"] for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want), (sizes, got, want)


def check(df, tolerance):
    rows = mixing.mix(mixing.sized(df)).collect()
    assert len(rows) == df.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken = {}
    for r in rows:
        key = (r["source_size"], r["target"])
        taken[key] = taken.get(key, 0) + r["taken"]
    assert all(abs(n - target) <= tolerance(target) for (_, target), n in taken.items()), taken
    again = mixing.mix(mixing.sized(df)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_documents(documents):
    check(documents, lambda t: 0.01 * t + 40)


def test_odd_rows(clashing):
    check(clashing, lambda t: 0.02 * t + 40)


def test_hot_source(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)], "doc_id long, text string, source string")
    check(df, lambda t: 0.005 * t + 40)


def test_copies_follow_the_mix(documents):
    taken = mixing.mix(mixing.sized(documents)).where("size > 0").select("doc_id", F.round(F.col("taken") / F.col("size") + 1e-9).alias("n"))
    want = {r["doc_id"]: r["n"] for r in taken.collect() if r["n"]}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(documents).groupBy("doc_id").count().collect()}
    assert got == want


def test_empty_table(nothing):
    assert mixing.mix(mixing.sized(nothing)).count() == 0 and mixing.mixed_documents(nothing).count() == 0
