"""Chunks of documents: by bytes with overlap, and by estimated tokens."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunk size and overlap in bytes, and the least size that options accept.
CHUNK_BYTES, OVERLAP_BYTES, LEAST_BYTES = 1800, 200, 1000
#: Characters for a token; tokens that a request and each of its messages add.
CHARS, REQUEST, MESSAGE = 3, 64, 12


def chunk_options(size: int, overlap: int) -> tuple[int, int]:
    """Sizes are at least 1000; an overlap that isn't below the size is a quarter of it."""
    size = max(size, LEAST_BYTES)
    return size, size // 4 if overlap >= size else max(0, overlap)


def windows(ends: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines packed into chunks; a range of one line over ``size`` is to be cut. ends: bytes before each line.

    A full chunk is followed by its shortest suffix of ``overlap`` bytes or more, unless that is the whole chunk; the
    suffix becomes a chunk of its own where the next line doesn't fit behind it.
    """
    start, n = 0, len(ends) - 1
    for k in range(n):
        while start < k and ends[k + 1] - ends[start] > size:
            yield start, k
            back = bisect_right(ends, ends[k] - overlap, 0, k + 1) - 1
            start = back if overlap > 0 and back > start else k
        if ends[k + 1] - ends[k] > size:
            yield k, k + 1
            start = k + 1
    if start < n:
        yield start, n


def cuts(line: bytes, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` bytes (a character at least) that start ``size - overlap`` apart, between characters."""
    size = max(1, size)
    step = size - overlap if overlap < size else size

    def boundary(start: int, ahead: int) -> int:
        end = min(start + ahead, len(line))
        while end > start and end < len(line) and line[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            end += 1
            while end < len(line) and line[end] & 0xC0 == 0x80:
                end += 1
        return end

    start = 0
    while start < len(line):
        end = boundary(start, size)
        yield start, end
        if end >= len(line):
            return
        start = boundary(start, step)


def byte_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """start_line, end_line, byte_offset and text of a document's chunks."""
    raw = text.encode()
    rows = [x + b"\n" for x in raw.split(b"\n")]
    rows[-1] = rows[-1][:-1]
    if not rows[-1]:
        rows.pop()
    ends = [0, *accumulate(map(len, rows))]
    for a, b in windows(ends, size, overlap):
        if b - a == 1 and len(rows[a]) > size:
            line = rows[a].removesuffix(b"\n")
            for i, j in cuts(line, size, overlap):
                yield a + 1, a + 1, ends[a] + i, line[i:j].decode("utf-8", "replace")
        else:
            yield a + 1, b, ends[a], b"".join(rows[a:b]).removesuffix(b"\n").decode("utf-8", "replace")


def approx(chars: int) -> int:
    return (chars + CHARS - 1) // CHARS if chars > 0 else 0


def budget(most: int, share: tuple[int, int] = (3, 5)) -> int:
    """A share of the tokens, 1 at least; 0 if there are none."""
    return max(1, most * share[0] // share[1]) if most > 0 else 0


def overhead(messages: list[tuple[str, str]]) -> int:
    """Estimated tokens of a request of (role, content) messages, without the one of its placeholder text."""
    return REQUEST + sum(MESSAGE + approx(len(r)) + approx(len(c)) for r, c in messages) - approx(1)


def token_chunks(text: str, most: int, request: int) -> Iterator[tuple[str, int]]:
    """Text and estimated tokens of chunks of whole lines within ``most`` tokens, ``request`` of which are taken.

    A longer line is cut. An empty line before a chunk's first text is lost.
    """
    room = (most - request) * CHARS
    held = ""
    for line in text.split("\n")[: -1 if text.endswith("\n") else None] if text else []:
        line = line.removesuffix("\r")
        if room < 1 and line:
            raise ValueError("the request leaves no room for text")
        grown = f"{held}\n{line}" if held else line
        if len(grown) <= room:
            held = grown
            continue
        if held:
            yield held, approx(len(held))
        held = line if len(line) <= room else ""
        if not held:
            for i in range(0, len(line), room):
                yield line[i : i + room], approx(len(line[i : i + room]))
    if held:
        yield held, approx(len(held))


def chunk(docs: DataFrame, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, path: str = "path", text: str = "text") -> DataFrame:
    """path, chunk_id (from 0 in each document), start_line, end_line, byte_offset, text. No shuffle: documents are rows."""
    kind = dict(docs.dtypes)[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if rows := list(byte_chunks(t or "", size, overlap)):
                    cols = list(zip(*rows, strict=True))
                    arrays = [pa.array([p.as_py()] * len(rows), p.type), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[path, "chunk_id", "start_line", "end_line", "byte_offset", "text"])

    return docs.select(path, text).mapInArrow(run, f"{path} {kind}, chunk_id long, start_line long, end_line long, byte_offset long, text string")


def chunk_by_tokens(docs: DataFrame, length: int, request: int, path: str = "path", text: str = "text") -> DataFrame:
    """path, chunk_id, token_count, byte_count, request_tokens, text of chunks for requests of ``length`` tokens."""
    kind, most = dict(docs.dtypes)[path], budget(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if rows := list(token_chunks(t or "", most, request)):
                    texts, counts = zip(*rows, strict=True)
                    numbers = [range(len(rows)), counts, [len(x.encode()) for x in texts], [request + c for c in counts]]
                    arrays = [pa.array([p.as_py()] * len(rows), p.type), *(pa.array(c, pa.int64()) for c in numbers), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[path, "chunk_id", "token_count", "byte_count", "request_tokens", "text"])

    return docs.select(path, text).mapInArrow(run, f"{path} {kind}, chunk_id long, token_count long, byte_count long, request_tokens long, text string")
