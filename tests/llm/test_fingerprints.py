"""Order MinHash against plain Python; the hash functions' values come from Spark."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import fingerprints as fp

xxhash = pytest.importorskip("xxhash")
MASK = (1 << 64) - 1
P = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def turned(x, n):
    return (x << n | x >> (64 - n)) & MASK


def hash_long(x, seed):
    h = (seed + P[4] + 8) & MASK
    h ^= turned(x * P[1] & MASK, 31) * P[0] & MASK
    return finished((turned(h, 27) * P[0] + P[3]) & MASK)


def hash_int(x, seed):
    h = (seed + P[4] + 4) & MASK
    h ^= (x & 0xFFFFFFFF) * P[0] & MASK
    return finished((turned(h, 23) * P[1] + P[2]) & MASK)


def finished(h):
    h = (h ^ h >> 33) * P[1] & MASK
    h = (h ^ h >> 29) * P[2] & MASK
    return h ^ h >> 32


def plain(text):
    """The fingerprint, from hashes of words as XXH64 chains them."""
    words = [w.encode() for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text).split(" ") if w]
    if not words:
        return ""
    runs = [words[i : i + fp.K_WORDS] for i in range(len(words) - fp.K_WORDS + 1)] or [words]
    seen, bins = Counter(), {}
    for place, run in enumerate(runs):
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w, h)
        number = seen[h]
        seen[h] += 1
        v = hash_int(number, hash_long(h, 42)) >> fp.PLACE_BITS << fp.PLACE_BITS | place
        bins.setdefault(v >> (64 - fp.BIN_BITS), []).append(v if v < 1 << 63 else v - (1 << 64))
    out, ring = [], sorted(v for found in bins.values() for v in found)
    for b, found in sorted(bins.items()):
        at = ring.index(min(found))
        chosen = sorted((ring + ring)[at : at + min(fp.PICKS, len(ring))], key=lambda v: v & ((1 << fp.PLACE_BITS) - 1))
        h = 42
        for v in chosen:
            h = hash_long((v >> fp.PLACE_BITS) & MASK, h)
        out.append(f"{b:x}:{h >> 32:x}")
    return " ".join(out)


def likeness(a, b):
    a, b = set(a.split()), set(b.split())
    used = {x.split(":")[0] for x in a | b}
    return len(a & b) / len(used) if used else 1.0


def check(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    tie = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = plain(text), plain(edited), plain(following)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in fp.fingerprints(df).collect())


def test_odd_rows(clashing):
    check(clashing)


def test_repeats_and_order(spark):
    rng = random.Random(12)
    words = "a b c d e".split()
    check(spark.createDataFrame([(rng.randrange(1000), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30, 200])))) for _ in range(80)], "doc_id long, text string"))


def test_documents(documents):
    check(documents)


def test_single_and_no_row(spark, nothing):
    check(spark.createDataFrame([(1, "only one document here")], "doc_id long, text string"))
    assert fp.fingerprints(nothing).count() == 0


def test_neighbours_need_no_python_workers(spark, small):
    """A list given to createDataFrame would be an RDD of Python workers in the executors."""
    plan = fp.fingerprints(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Window" in plan
