"""The Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Component of each doc_id, by an index of all shingles."""
    parent, index, sets = {}, defaultdict(list), []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, t in rows:
        if i is None:
            continue
        parent.setdefault(i, i)
        s = shingles(t)
        common = Counter(k for x in s for k in index[x])
        for k, n in common.items():
            j, other = sets[k]
            if 100 * n >= 80 * (len(s) + len(other) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(len(sets))
        sets.append((i, s))
    return {i: find(i) for i in parent}


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    got = jaccard.jaccard_components(df).collect()
    assert sorted(((i, len(shingles(t)), want.get(i)) for i, t in rows), key=repr) == sorted(map(tuple, got), key=repr)


def edited(rng, words, rate):
    out = []
    for w in words:
        if rng.random() < rate:
            out += rng.choice([[], ["new"], [w, "more"]])
        else:
            out.append(w)
    return out


def test_random_near_copies(spark):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 15, 40, 120, 300]))]
        if rng.random() < 0.5:
            words += passage
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice([0, 0.01, 0.02, 0.04])))))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_open_groups_of_any_size(spark, monkeypatch):
    """Texts that share most shingles with many that they aren't linked with: groups stay open and are compared in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(9)
    common = [f"c{k}" for k in range(24)]
    rows = []
    for i in range(60):
        own = [f"u{i}_{k}" for k in range(rng.choice([3, 5, 7]))]
        rows.append((len(rows), " ".join(common + own)))
        if i % 4 == 0:
            rows.append((len(rows), " ".join(common + own + ["end"])))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with some words changed, most of them just below the similarity of a link, some just above."""
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 9000)
    rng = random.Random(12)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(500):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([2, 3])):
            words[k] = rng.choice(["x", f"y{i}"])
        rows.append((i, " ".join(words + ["end"] * rng.choice([0, 0, 30]))))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_block_links_join_what_brute_force_joins():
    rng = np.random.default_rng(13)
    common = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(common)[: int(rng.integers(78, 90))], rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64))) for _ in range(60)]
    for sides in (lambda i: False, lambda i: i % 2 == 1):
        rows = [(i, i // 3, x.tobytes(), sides(i), i % 5 == 0) for i, x in enumerate(sets)]
        links = jaccard.block_links(rows)
        wanted = [(i, j) for i in range(60) for j in range(i) if not (rows[i][4] and rows[j][4]) and (sides(0) == sides(1) or sides(i) != sides(j)) and jaccard.linked(sets[i], sets[j])]
        assert all((max(e), min(e)) in wanted for e in links) and len(links) < 60
        assert wanted and groups_of(60, links) == groups_of(60, wanted)


def groups_of(n, links):
    """The component of each set; three sets in a row are one component from the start."""
    label = [i // 3 for i in range(n)]
    for a, b in links:
        label = [label[b] if x == label[a] else x for x in label]
    return [label.index(x) for x in label]


def test_odd_rows(clashing):
    check(clashing)


def test_documents(documents):
    check(documents)


def test_empty_table(nothing):
    assert jaccard.jaccard_components(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0


def test_one_of_each(clashing):
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(clashing).collect() if r["doc_id"] is not None}
    got = [r["doc_id"] for r in jaccard.one_of_each(clashing).collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(found.values())) and got.count(None) == 2


def test_bounds():
    """Linked sets are plausible, share a key, and share as many keys as either needs."""
    rng = np.random.default_rng(10)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 31, 33, 63, 64, 100, 127, 129, 500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.append(a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)))
            if jaccard.linked(a, b):
                assert jaccard.plausible(len(a), len(b), jaccard.bit_sketch(a), jaccard.bit_sketch(b))
                shared = len(np.intersect1d(jaccard.sketch_keys(a), jaccard.sketch_keys(b)))
                assert shared >= 1 and shared >= max(jaccard.least_shared(a), 1) and shared >= jaccard.least_shared(b)


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch of long texts is bounded by bytes; the session's own setting comes back, a failure or not."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    def labelled(rows):
        seen.extend(r["n"] for r in rows.select("text").mapInArrow(sizes, "n long").collect())
        raise ValueError

    monkeypatch.setattr(jaccard, "labelled", labelled)
    with pytest.raises(ValueError):
        jaccard.jaccard_components(spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text"))
    assert len(seen) > 5 and max(seen) < 8 << 20 and spark.conf.get(name, None) == before


def test_copies_have_no_keys(spark, monkeypatch):
    """Only the first of exact copies is joined, whichever ids are few, so copies in many tasks cost nothing; without a filter the result is the same."""
    keys_of, seen = jaccard.keys_of, []
    monkeypatch.setattr(jaccard, "keys_of", lambda docs: seen.append(docs.count()) or keys_of(docs))
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(12)]
    texts += [t + " tail" for t in texts[:4]]
    copied = spark.createDataFrame([(i, texts[i % 16]) for i in range(128)], "doc_id long, text string").repartition(8, "doc_id")
    check(copied)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    check(copied)
    mostly = copied.where("doc_id < 20")
    check(mostly)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 8)
    check(mostly)
    assert seen == [16, 16, 20, 16]


@pytest.mark.parametrize("paired", [1, 16])
def test_whole_sets_go_to_blocks_of_near_copies_only(spark, monkeypatch, paired):
    """Texts that share a passage with many others, but are no near copies of them, are told apart by their bit sketches."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    linked_across, sent = jaccard.linked_across, set()

    def watched(clusters, roots, docs):
        sent.update(r["node"] for r in clusters.collect())
        return linked_across(clusters, roots, docs)

    monkeypatch.setattr(jaccard, "linked_across", watched)
    rng = random.Random(15)
    rows = []
    for i in range(80):
        words = [f"c{i % 3}_{k}" for k in range(24)] + [f"u{i}_{k}" for k in range(rng.choice([3, 5, 12, 20, 40]))]
        rows += [(len(rows) + k, " ".join(words + ["end", "of", "it"][:k])) for k in range(2 if i % 5 == 0 else 1)]
    sets = {i: jaccard.shingles(t) for i, t in rows}
    near = {x for a in sets for b in sets if a < b and jaccard.plausible(len(sets[a]), len(sets[b]), jaccard.bit_sketch(sets[a]), jaccard.bit_sketch(sets[b])) for x in (a, b)}
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sent <= near and len(near) < len(rows) - 20


def test_block_near_joins_what_plausible_pairs_join():
    rng = np.random.default_rng(16)
    common = rng.integers(0, 2**63, 110).astype(np.uint64)
    sets = [np.unique(np.append(rng.permutation(common)[: int(rng.integers(80, 110))], rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64))) for _ in range(60)]
    bits = [jaccard.bit_sketch(x) for x in sets]
    for sides in (lambda i: False, lambda i: i % 2 == 1):
        rows = [(i, i // 3, bits[i], sides(i), i % 5 == 0, len(x)) for i, x in enumerate(sets)]
        near = lambda i, j: jaccard.plausible(len(sets[i]), len(sets[j]), bits[i], bits[j])
        wanted = [(i, j) for i in range(60) for j in range(i) if i // 3 != j // 3 and not (rows[i][4] and rows[j][4]) and (sides(0) == sides(1) or sides(i) != sides(j)) and near(i, j)]
        found = jaccard.block_near(rows)
        assert all((max(e), min(e)) in wanted for e in found) and len(found) < 60
        joined = [range(60), range(60)]
        for k, links in enumerate((found, wanted)):
            label = list(range(60))
            for a, b in links:
                label = [label[b] if x == label[a] else x for x in label]
            joined[k] = [label.index(x) for x in label]
        assert wanted and joined[0] == joined[1]


def test_shuffle_files_go_with_their_table(spark, monkeypatch):
    """Inside, shuffle files don't wait for the driver's garbage collection; the session's own setting comes back."""
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(name, None)
    monkeypatch.setattr(jaccard, "labelled", lambda rows: seen.append(spark.conf.get(name, None)))
    jaccard.jaccard_components(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert seen == ["true"] and spark.conf.get(name, None) == before
