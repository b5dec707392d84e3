"""Novelty of sessions: the stream, across a restart, and the batch form against plain sets."""

import json
import random

from textloom.operators import evidence
from textloom.streaming import sessions

SHOWN = "session string, turn long, namespace string, path string, start long, end long, synthetic boolean"


def calls(rng, turns):
    rows = []
    for t in turns:
        for s in ("s1", "s2", "s3"):
            synthetic = rng.random() < 0.25
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(0, 30)
                rows.append((s, t, rng.choice(["files", "rag"]), rng.choice(["a", "b"]), a, a + rng.randrange(-1, 9), synthetic))
    return rows


def plain(rows):
    seen, out = {}, set()
    for s, t in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == (s, t)]
        keys = {(n, p, line) for _, _, n, p, a, b, _ in own for line in range(a, b + 1)}
        fresh = keys - seen.setdefault(s, set())
        if not own[0][6]:
            seen[s] |= keys
        out.add((s, t, len(fresh), not fresh))
    return out


def test_spans():
    rng = random.Random(6)
    for _ in range(300):
        spans, known = [], set()
        for _ in range(12):
            a = rng.randrange(40)
            b = a + rng.randrange(9)
            fresh, spans = sessions.added(spans, a, b)
            assert fresh == len(set(range(a, b + 1)) - known)
            known |= set(range(a, b + 1))
            assert {x for s, e in spans for x in range(s, e + 1)} == known and all(spans[i][1] + 1 < spans[i + 1][0] for i in range(len(spans) - 1))


def test_batch(spark):
    rows = calls(random.Random(7), range(12))
    got = evidence.novel_counts(spark.createDataFrame(rows, SHOWN)).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == 36


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows = calls(rng, range(9))
    sessions.keeps_maps(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run(part):
        with open(folder / f"{part}.json", "w") as f:
            for r in rows:
                if part * 3 <= r[1] < part * 3 + 3:
                    f.write(json.dumps(dict(zip([c.split()[0] for c in SHOWN.split(", ")], r))) + "\n")
        shown = spark.readStream.schema(SHOWN).json(str(folder))
        query = sessions.novel_counts(shown).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(240)
        assert query.exception() is None

    for part in range(3):  # a new query each time: what was seen comes from the checkpoint
        run(part)
    got = [tuple(r) for r in spark.read.schema(sessions.COUNTED).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == 27 and set(got) == plain(rows)
