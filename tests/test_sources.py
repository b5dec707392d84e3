"""Sources: kinds of content, folders, handles, hashes in order, and indexes that several writers write."""

import hashlib
import io
import os
import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from textloom.functions import media
from textloom.operators import lines, semantic
from textloom.sources import corpus, index, spool, walk

MP4 = b"\x00\x00\x00\x18ftypisom\x00\x00\x02\x00isommp42"
KINDS = [
    (b"", "text/plain; charset=utf-8"), (None, "text/plain; charset=utf-8"), (b"plain \t\r\n\x0c\x1b text", "text/plain; charset=utf-8"), ("Straße".encode(), "text/plain; charset=utf-8"),
    (b" \n<!doctype html>", "text/html; charset=utf-8"), (b"<P>x", "text/html; charset=utf-8"), (b"<Px", "text/plain; charset=utf-8"), (b"<!-- x", "text/html; charset=utf-8"), (b"\t<?xml version", "text/xml; charset=utf-8"),
    (b"\xfe\xff\x00a", "text/plain; charset=utf-16be"), (b"\xff\xfea\x00", "text/plain; charset=utf-16le"), (b"\xff\xfe", "text/plain; charset=utf-8"), (b"\xef\xbb\xbfa", "text/plain; charset=utf-8"),
    (b"%PDF-1.7", "application/pdf"), (b"GIF89a", "image/gif"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"RIFF\x01\x02\x03\x04WEBPVP8", "image/webp"), (b"RIFF\n\n\n\nWAVE", "audio/wave"),
    (b"FORM\x00\x00\x00\x01AIFF", "audio/aiff"), (b"ID3\x03", "audio/mpeg"), (b"OggS\x00", "application/ogg"), (b"MThd\x00\x00\x00\x06", "audio/midi"), (b"\x1aE\xdf\xa3", "video/webm"), (MP4, "video/mp4"), (MP4.replace(b"mp42", b"avc1"), media.BINARY),
    (MP4.replace(b"isom\x00", b"mp41\x00"), "video/mp4"), (MP4.replace(b"\x00\x00\x00\x18", b"\x00\x00\x00\x17"), media.BINARY), (b"x" * 34 + b"LP\x00", "application/vnd.ms-fontobject"), (b"OTTO\x00", "font/otf"), (b"wOF2\x00", "font/woff2"), (b"\x00\x01\x00\x00", "font/ttf"),
    (b"\x1f\x8b\x08", "application/x-gzip"), (b"PK\x03\x04", "application/zip"), (b"Rar!\x1a\x07\x01\x00", "application/x-rar-compressed"), (b"\x00asm", "application/wasm"), (b"a\x00b", media.BINARY), (b"\x7fELF\x02", media.BINARY), (b"ok" * 256 + b"\x00", "text/plain; charset=utf-8"),
]


def test_media_types(spark):
    rows = spark.createDataFrame(list(enumerate(k[0] for k in KINDS)), "i int, c binary").select("i", media.media_type(F.col("c")).alias("t"), media.is_text(F.col("c")).alias("x")).orderBy("i").collect()
    assert [(KINDS[r["i"]][0], r["t"]) for r in rows] == KINDS
    assert all(r["x"] == r["t"].startswith("text/") for r in rows)


@pytest.fixture
def folder(tmp_path):
    for name, data in {"b/z.txt": b"z\n", "b/.env": b"KEY=1", "a.txt": b"alpha", ".hidden/no.txt": b"no", "b/c/_under.md": b"# u", "b/c/bin.dat": b"\x00\x01", "b.txt": b"\xff broken", "deep/1/2/3/4/x": b"x", "empty": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "b", tmp_path / "linked")
    os.mkfifo(tmp_path / "pipe")
    return tmp_path


def test_walk(spark, folder):
    paths = [r["path"] for r in walk.walked(spark, str(folder)).collect()]
    assert paths == ["a.txt", "b.txt", "b/.env", "b/c/_under.md", "b/c/bin.dat", "b/z.txt", "deep/1/2/3/4/x", "empty"]
    texts = {r["path"]: r["text"] for r in corpus.read_folder(spark, f"file://{folder}").collect()}
    assert sorted(texts) == [p for p in paths if p != "b/c/bin.dat"] and texts["b.txt"] == "� broken" and texts["empty"] == "" and texts["b/.env"] == "KEY=1"


def test_open_input(spark, folder, tmp_path):
    kind, docs = corpus.open_input(spark, str(folder))
    assert kind == "directory" and docs.count() == 7
    kind, docs = corpus.open_input(spark, str(folder / "b/.env"))
    assert kind == "file" and docs.collect() == [(".env", "KEY=1", str(folder / "b/.env"))]
    kind, docs = corpus.open_input(spark, " ", io.BytesIO(b"one\ntwo"))
    assert kind == "stdin" and docs.collect() == [("stdin", "one\ntwo", "stdin")]
    (tmp_path / "none").mkdir()
    for bad, error in ((str(tmp_path / "none"), ValueError), (str(tmp_path / "lost"), FileNotFoundError)):
        with pytest.raises(error):
            corpus.open_input(spark, bad)


@pytest.mark.parametrize("data", [b"", b"one", b"one\n", b"\n\n", b"x\r\ny\n\nlast", "äö\n".encode() * 50_000, b"".join(b"%d " % i * (i % 90) + b"\n" for i in range(4000)), b"long" * 400_000])
@pytest.mark.parametrize("block", [7, 100_000])
def test_spooled_handle(spark, monkeypatch, data, block):
    monkeypatch.setattr(spool, "READ", 1 << 16)
    found = spool.spooled(spark, io.BytesIO(data), "in", block)
    assert found.sha256 == hashlib.sha256(data).hexdigest() and found.n_bytes == len(data)
    got = spool.lines(spark, found).collect()
    want = lines.lines_with_offsets(spark.createDataFrame([("in", data.decode())], "path string, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == found.n_lines
    assert len(data) < 300_000 or block > 7 or b"long" in data or len(found.blocks) > 2
    spool.discard(spark, found)
    assert not os.path.exists(found.full.removeprefix("file://"))


def test_a_handle_that_fails_leaves_nothing(spark):
    class Broken(io.BytesIO):
        def read(self, n=-1):
            raise OSError("gone")

    shared = index.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    with pytest.raises(OSError):
        spool.spooled(spark, Broken())
    assert {n for n in set(os.listdir(shared)) - before if n.startswith("spooled")} == set()


def plain_hash(rows, options, fan):
    sized = lambda s: str(len(s.encode())) + ":" + s
    level = [hashlib.sha256((sized(p) + sized(t or "")).encode()).hexdigest() for p, t in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    parts = [sized(str(o)) for o in options] + level if level else [sized(str(o)) for o in options] + ["none"]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def test_content_hash(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FAN", 4)
    rows = [(f"p{i:03d}", f"text {i}" if i % 7 else None) for i in range(70)]
    frame = lambda r, n=3: spark.createDataFrame(r, "path string, text string").repartition(n)
    want = corpus.content_hash(frame(rows), 1, "x")
    assert want == plain_hash(rows, (1, "x"), 4) == corpus.content_hash(frame(rows[::-1], 7), 1, "x")
    swapped = [(rows[0][0], rows[1][1]), (rows[1][0], rows[0][1]), *rows[2:]]
    assert len({want, corpus.content_hash(frame(swapped), 1, "x"), corpus.content_hash(frame(rows), 1, "y"), corpus.content_hash(frame(rows[1:]), 1, "x"), corpus.content_hash(frame([]), 1, "x")}) == 5
    placed = lambda order: spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(order)], "path string, text string, at int")
    assert corpus.content_hash(placed(rows), order=("at",)) != corpus.content_hash(placed([rows[1], rows[0], *rows[2:]]), order=("at",))
    assert corpus.content_hash(frame([("a", "1b")])) != corpus.content_hash(frame([("a1", "b")]))


def test_two_writers_at_once(spark, tmp_path):
    chunks = spark.createDataFrame([(f"p{i % 5}", i, f"t{i}") for i in range(50)], "path string, chunk_id long, text string")
    base, meet, got = str(tmp_path), threading.Barrier(2), []

    def write():
        def build():
            meet.wait(60)  # both have found nothing
            return chunks

        got.append(sorted(map(tuple, index.build_or_load(spark, base, "h", build, "m", 1800, 200).select("path", "chunk_id", "text").collect())))

    both = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in both]
    [t.join(120) for t in both]
    assert len(got) == 2 and got[0] == got[1] == sorted(map(tuple, chunks.collect()))
    names = [n for _, n in index.generations(spark, base, "h")]
    assert names and all((tmp_path / "h" / f"data-{n}" / "manifest").is_dir() for n in names)


def test_broken_and_stale_indexes(spark, tmp_path):
    chunks, base = spark.createDataFrame([("a", 0, "x")], "path string, chunk_id long, text string"), str(tmp_path)
    index.write_index(chunks, base, "h", "m", 1, 0)
    first = index.generations(spark, base, "h")[0][1]
    for part in (tmp_path / "h" / f"data-{first}" / "chunks").rglob("*.parquet"):
        part.unlink()
    assert index.load_index(spark, base, "h") is None
    assert index.build_or_load(spark, base, "h", lambda: chunks, "m", 1, 0).count() == 1
    assert [g for g, _ in index.generations(spark, base, "h")] == [2, 1]
    assert index.build_or_load(spark, base, "h", lambda: chunks.union(chunks), "m", 1, 0, timedelta(hours=1)).count() == 1
    (tmp_path / "h" / "data-00ff").mkdir()  # a draft that a writer is at work on
    os.utime(tmp_path / "h" / f"data-{first}", (0, 0))
    assert index.clear_indexes(spark, base) == ["h"]
    assert (tmp_path / "h" / "data-00ff").is_dir() and not (tmp_path / "h" / f"data-{first}").exists()
    assert index.load_index(spark, base, "h").count() == 1


def test_one_path_reads_its_part_alone(spark, tmp_path):
    chunks = spark.createDataFrame([(f"p{i % 40}", i, f"t{i}") for i in range(400)], "path string, chunk_id long, text string")
    index.write_index(chunks, str(tmp_path), "h", "m", 1, 0)
    own = semantic.in_path(index.load_index(spark, str(tmp_path), "h"), " p7 ", index.BUCKETS)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(path_bucket" in plan and own.count() == 10
    assert len({r["f"] for r in own.select(F.input_file_name().alias("f")).collect()}) == 1
    with pytest.raises(ValueError):
        semantic.in_path(chunks, "p70")
