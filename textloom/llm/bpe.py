"""Byte-level BPE: encoding with a queue of merge ranks over a linked list of symbols, and decoding.

The text is cut at special tokens and by the pre-tokenizer's pattern. In each piece the bytes are symbols of a doubly
linked list; a priority queue holds (rank, position) of neighbouring pairs. The lowest rank is merged, its neighbours
are queued anew, and entries whose symbols have changed meanwhile are skipped as stale. Decoding concatenates the
vocabulary's byte strings. Each task keeps a bounded table of pieces already encoded.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import give_back, slices, table

#: The pre-tokenizer's pattern (fixed by the vocabulary), with Unicode's white space.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces that a task remembers before it starts its table anew, and the longest that it keeps.
REMEMBERED, LONGEST = 400_000, 64


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """The vocabulary at ``path``: a tokenizer file of a byte-level BPE without a normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {raw(k): v for k, v in vocab.items()}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for k, v in [*self.ids.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.strings[v] = k
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.ranks.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.singles = [self.ids[bytes([b])] for b in range(256)]
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.singles[b] for b in piece]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((made, ids[k])):
                    heapq.heappush(queue, (r[0], i, made, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], made))):
                heapq.heappush(queue, (r[0], h, ids[h], made, r[1]))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece as little-endian int32, remembered."""
        out = np.array(self.merged(piece.encode()), "<i4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str, special: bool = True) -> bytes:
        """The ids of a text as little-endian int32. special: the strings of special tokens are such tokens."""
        out, get, piece = [], self.known.get, self.piece
        for k, part in enumerate(self.cut.split(text) if special and self.cut else [text]):
            if k % 2:
                out.append(np.int32(self.special[part]).tobytes())
            else:
                out += [get(x) or piece(x) for x in self.pieces.findall(part)]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary are left out."""
        n, strings = len(self.strings), self.strings
        if ids and (min(ids) < 0 or max(ids) >= n):
            ids = [i for i in ids if 0 <= i < n]
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def appended(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, special: bool = True, decoded: str | None = None) -> DataFrame:
    """df with the array of token ids of each whole text; none for null and empty texts.

    Other columns are kept; one named like ``out`` is replaced. special=False takes the strings of special tokens in a
    text as ordinary text. decoded: a column for the text that ``decode`` gives for the ids, in the same pass.
    """
    path = path or vocabulary()
    kept = df.drop(out, decoded) if decoded else df.drop(out)
    extra = [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                texts = batch.column(at)
                sizes = np.array([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64)
                for a, b in slices(sizes):
                    ids = [c.encode(x, special) if x else b"" for x in texts[a:b].to_pylist()]
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                    coded = appended(batch.slice(a, b - a), out, pa.ListArray.from_arrays(pa.array(ends), values))
                    yield appended(coded, decoded, pa.array([c.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string())) if decoded else coded
        finally:
            c.known.clear()
            give_back()

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of each array of ids; an empty one for null or no ids. Other columns are kept."""
    path = path or vocabulary()
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for a, b in slices(4 * sizes):
                texts = [c.decode(values[ends[k] : ends[k + 1]].tolist()) for k in range(a, b)]
                yield appended(batch.slice(a, b - a), out, pa.array(texts, pa.string()))

    return kept.mapInArrow(run, schema)


def digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated ids included: its tokens' number, the digest of their ids, and that of the text
    decoded from them. Null and empty texts have no tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs).select("doc_id", "ids")
    return decode(coded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest().alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
