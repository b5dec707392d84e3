"""Line dedup against brute force."""

import random
import re

import xxhash

from textloom.llm import line_dedup as ld


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def brute(rows):
    """The lines to remove of each (doc_id, text), comparing every two lines."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = lambda i, t: (i is None, i or 0, signed(xxhash.xxh64(t, seed=42).intdigest()))
    lines = []
    for i, t in {(i, t) for i, t in rows if t is not None}:
        for k, line in enumerate(t.split("\n")):
            words = tuple(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            if words:
                lines.append(((order(i, t), k), words, (i, t)))
    first = {}
    for place, words, _ in lines:
        first[words] = min(place, first.get(words, place))
    gone = {w for w, p in first.items() if len(w) >= ld.MIN_NEAR and any(q < p and len(v) >= ld.MIN_NEAR and one_apart(v, w) for v, q in first.items() if v != w)}
    dead = {}
    for place, words, doc in lines:
        if place != first[words] or words in gone:
            dead.setdefault(doc, set()).add(place[1])
    return dead


def check(df):
    rows = df.select("doc_id", "text").collect()
    dead = brute([tuple(r) for r in rows])
    want = []
    for i, t in rows:
        gone = dead.get((i, t), set())
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)))
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in ld.dedup_lines(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_random_lines(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(7, 12))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(words))
                words = rng.choice([words[:k] + words[k + 1 :], words[:k] + ["z"] + words[k:], words[:k] + ["y"] + words[k + 1 :]])
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(lines)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(clashing):
    check(clashing)
    assert {r["words"] for r in ld.dedup_lines(clashing).collect()} == {"clash"}


def test_documents(documents):
    check(documents)


def test_rows_that_share_an_id_or_have_none(spark):
    """A line that repeats nothing stays, whatever row has the id of another one; rows keep their own lines' order."""
    rng = random.Random(4)
    ten, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, ten), (5, ten.replace("d", "z")), (5, other), (5, other + "\n" + ten)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string")
        check(df)
        assert {r["text"] for r in ld.dedup_lines(df).collect() if r["n_removed"] == 0} >= {ten}
    lines = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    many = [(rng.choice([None, None, 3, 4, -2]), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 3)))) for _ in range(120)]
    check(spark.createDataFrame(many, "doc_id long, text string"))


def test_places_beyond_a_long(spark):
    rows = [(2**62, "one two three four five"), (-(2**62), "one two three four six"), (7, "one two three four five")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty_table(nothing):
    assert ld.dedup_lines(nothing).count() == 0


def test_variants_of_a_line():
    import numpy as np

    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 9).astype(np.uint64)
    got = ld.variants(words)
    assert all(got[k] == ld.variants(np.delete(words, k))[-1] for k in range(9))


def test_short_lines(spark):
    """Lines of one to three words go when they are repeated, lines of four also when a word differs; blank lines stay."""
    rows = [(1, "Yes\n\nAll rights reserved.\none two three four\na b c"), (2, "Yes\n\nAll rights  reserved.\none two 3 four\na b d"), (3, "Yes\nYes\none two three four five\nnew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["text"], r["n_near"]) for r in ld.dedup_lines(df).collect()} == {1: (rows[0][1], 0), 2: ("\na b d", 1), 3: ("new", 1)}
    check(df)
