"""Sharding: groups stay together, loads are near equal, slots are gapless, and the deal is that of a plain heap."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

from textloom.llm import sharding


def shards_of(df, shards):
    rows = sharding.shard_documents(df, shards).collect()
    slots, homes, loads = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return rows, loads


def test_odd_rows(clashing):
    rows, _ = shards_of(clashing, 4)
    texts = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for (t,) in clashing.select("text").collect())
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == texts
    homes = defaultdict(set)
    for r in rows:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_equal_loads(documents):
    _, loads = shards_of(documents, 10)
    mean = sum(loads.values()) / 10
    assert len(loads) == 10 and max(loads.values()) <= 1.02 * mean


def test_hot_text(spark):
    df = spark.createDataFrame([(i, "hot " * 50 if i % 3 == 0 else f"text {i}") for i in range(600)], "doc_id long, text string")
    rows, loads = shards_of(df, 5)
    assert len({r["shard"] for r in rows if r["size"] == 216}) == 1 and len(loads) == 5


def test_deal_is_longest_processing_time():
    rng = random.Random(4)
    sizes = Counter(rng.choice([1000, 700, 64, 8, 1]) for _ in range(500))
    dealt = sharding.deal([(s, n, s * n) for s, n in sizes.items()], 7)
    assert all(sum(b - a for k, _, a, b in dealt if k == s) == n for s, n in sizes.items())
    heap = [(0, i) for i in range(7)]
    for s in sorted(sizes.elements(), reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, i))
    loads = Counter()
    for s, i, a, b in dealt:
        loads[i] += s * (b - a)
    assert sorted(loads.values()) == sorted(x for x, _ in heap)


def test_empty_table(nothing):
    assert sharding.shard_documents(nothing).count() == 0
