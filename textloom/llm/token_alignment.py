"""Alignment of two tokenizers over the same texts: which tokens cover the same bytes, and which pairs do so most often.

Inside the tasks everything is Arrow: a batch's token lists are flattened with their parents' indices, token lengths are
summed segment by segment into the places where tokens end, and a hash join of both sides on document and end tells where
both end (the cuts between groups) and which tokens overlap (each stretch between two neighbouring ends is one link).
Table.group_by counts the pairs of each document and of each batch; Spark merges the counts of all documents. A document
is encoded once: its pairs are stored, counted, and then looked up in the corpus's counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import bpe
from textloom.llm.common import scratch, slices, stored, table

#: Distinct pairs whose counts go to every worker, at most (17 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it gives its partial counts off.
HELD_PAIRS = 1_000_000
#: Stretches that a worker remembers the pieces of, before it starts anew, and the longest one.
REMEMBERED, LONGEST = 400_000, 64
#: Bits of the second token in a pair.
SHIFT = 32
COUNTED = [T.StructField(k, T.LongType(), False) for k in ("n_a", "n_b", "n_groups", "n_links")]
ALIGNED = [*COUNTED, T.StructField("groups", T.StringType(), False), T.StructField("pairs", T.ArrayType(T.LongType(), False), False), T.StructField("times", T.ArrayType(T.LongType(), False), False)]


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Bytes:
    """A byte-level BPE of a tokenizer file: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        codec = bpe.codec(path)
        made = [new for _, new in sorted(codec.ranks.values())]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.strings = pa.array(codec.strings, pa.binary())
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ids, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a space and the text; strings of special tokens are text."""
        return self.library.encode_to_numpy(" " + text, disallowed_special=())


class Pieces:
    """A SentencePiece model that puts a space before a text. No piece goes on beyond a word into the next space, so
    stretches of spaces and a word are encoded apart, and remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        raw = lambda i, s: bytes([int(s[3:5], 16)]) if self.library.is_byte(i) else s.replace("▁", " ").encode()
        self.strings = pa.array([raw(i, s) for i, s in enumerate(names)], pa.binary())
        apart = not any(re.search("[^▁]▁", s) for s in names)
        self.cut = re.compile(r" +[^ ]*" if apart else r"(?s).+")
        self.known: dict[str, np.ndarray] = {}

    def stretch(self, part: str) -> np.ndarray:
        out = np.array(self.library.encode(part[1:]) if len(part) > 1 else self.lone(), np.int32)
        if len(part) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = out
        return out

    def lone(self) -> list[int]:
        """A single space, which the library encodes only before other text."""
        return [self.library.piece_to_id("▁")]

    def encode(self, text: str) -> np.ndarray:
        get, stretch = self.known.get, self.stretch
        found = [x if (x := get(p)) is not None else stretch(p) for p in self.cut.findall(" " + text)]
        return np.concatenate(found) if found else np.empty(0, np.int32)


@cache
def coders(a: str, b: str) -> tuple[Bytes, Pieces]:
    """One pair for each worker process."""
    return Bytes(a), Pieces(b)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)))


def joined_bytes(ids: pa.ListArray, strings: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, strings.take(ids.values)), b"")


def ends_of(ids: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """A row for each token: the document and the byte at which it ends, as one key, and its number in the batch."""
    parents = pc.list_parent_indices(ids)
    total = pc.cumulative_sum(sizes.take(ids.flatten()))
    before = np.concatenate([[0], total.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    end = pc.subtract(total, pa.array(before).take(parents))
    key = pc.bit_wise_or(pc.shift_left(parents.cast(pa.int64()), pa.scalar(SHIFT, pa.int64())), end)
    return pa.table({"key": key, name: pa.array(np.arange(len(end)))})


def aligned_batch(a: pa.ListArray, b: pa.ListArray, sizes: tuple[pa.Array, pa.Array], names: tuple[pa.Array, pa.Array]) -> dict[str, pa.Array]:
    """The columns of ``ALIGNED`` for documents that both sides cover from the first to the last byte."""
    n = len(a)
    joined = ends_of(a, sizes[0], "i").join(ends_of(b, sizes[1], "j"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key, i, j = (joined.column(k).chunk(0) if joined.num_rows else pa.array([], pa.int64()) for k in ("key", "i", "j"))
    doc = pc.shift_right(key, pa.scalar(SHIFT, pa.int64()))
    cut = pc.and_(i.is_valid(), j.is_valid())
    first, second = a.flatten().take(pc.fill_null_backward(i)), b.flatten().take(pc.fill_null_backward(j))
    pair = pc.bit_wise_or(pc.shift_left(first.cast(pa.int64()), pa.scalar(SHIFT, pa.int64())), second.cast(pa.int64()))
    counted = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    column = lambda k: counted.column(k).chunk(0) if counted.num_rows else pa.array([], pa.int64())
    at = lambda docs: pa.array(np.searchsorted(docs.to_numpy(), np.arange(n + 1)).astype(np.int32))
    cut_docs, pair_at = doc.filter(cut), at(column("doc"))

    def side(ids: pa.ListArray, last: pa.Array, names: pa.Array) -> pa.Array:
        """The ids of each group, joined by commas."""
        ends = np.concatenate([[0], last.filter(cut).to_numpy() + 1]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(ids.flatten())), ",")

    groups = pc.binary_join_element_wise(side(a, i, names[0]), side(b, j, names[1]), "|")
    lengths = lambda x: pa.array(np.diff(x.to_numpy()).astype(np.int64))
    return {
        "n_a": lengths(a.offsets), "n_b": lengths(b.offsets), "n_groups": lengths(at(cut_docs)), "n_links": lengths(at(doc)),
        "groups": pc.binary_join(pa.ListArray.from_arrays(at(cut_docs), groups), ";"),
        "pairs": pa.ListArray.from_arrays(pair_at, column("pair")), "times": pa.ListArray.from_arrays(pair_at, column("count_all")),
    }


def aligned(df: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """df, without its text, with how both tokenizers cut each whole text after a space.

    n_a, n_b: tokens; n_groups: groups between places where both end; n_links: overlapping pairs of tokens; groups:
    'a1,a2|b1;a3|b2,b3', ids in order; pairs, times: the distinct pairs of linked ids (the first times 2^32 plus the
    second, in order) and how many links have them. Null and empty texts, and those that a tokenizer doesn't give back
    byte by byte, have no tokens: zeros, the empty text and no pairs. Other columns are kept; named like the new ones,
    they are replaced. a: a byte-level BPE's tokenizer file; b: a SentencePiece model.
    """
    paths = (a or vocabularies()[0], b or vocabularies()[1])
    kept = df.drop(*[f.name for f in ALIGNED])
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != text], *ALIGNED])
    empty = {f.name: "" if f.name == "groups" else [] if f.name in ("pairs", "times") else 0 for f in ALIGNED}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = coders(*paths)
        sizes = tuple(pc.binary_length(c.strings).cast(pa.int64()) for c in pair)
        names = tuple(pa.array([str(k) for k in range(len(c.strings))]) for c in pair)
        for whole in batches:
            at = whole.schema.get_field_index(text)
            lengths = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, e in slices(lengths, 4096, 2 << 20):
                batch = whole.slice(s, e - s)
                texts = pc.fill_null(batch.column(at), "").cast(pa.string())
                some = pc.greater(pc.binary_length(texts), 0)
                full = texts.filter(some)
                strings = full.to_pylist()
                ids = tuple(lists([c.encode(x) for x in strings]) for c in pair)
                wanted = pc.binary_join_element_wise(" ", full, "").cast(pa.binary())
                whole_texts = pc.and_(*(pc.equal(joined_bytes(x, c.strings), wanted) for x, c in zip(ids, pair, strict=True)))
                fine = np.flatnonzero(some.to_numpy(zero_copy_only=False))[whole_texts.to_numpy(zero_copy_only=False)]
                found = aligned_batch(*(lists_of(x.filter(whole_texts)) for x in ids), sizes, names)
                order = np.full(len(batch), len(fine), np.int64)
                order[fine] = np.arange(len(fine))
                columns = [pa.concat_arrays([found[f.name], pa.array([empty[f.name]], found[f.name].type)]).take(pa.array(order)) for f in ALIGNED]
                rest = batch.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *(f.name for f in ALIGNED)])

    return kept.mapInArrow(run, schema)


def lists_of(x: pa.ListArray) -> pa.ListArray:
    """The same lists with offsets from 0."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), x.flatten())


def pair_counts(found: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """pair, n (links of all documents that hold it) and best (whether no pair with its second id has more).

    Tasks count what they read and give partial counts off, ``held`` distinct pairs at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])

        parts: list[pa.Table] = []
        for batch in batches:
            parts.append(pa.table({"pair": batch.column(0).flatten(), "n": batch.column(1).flatten()}))
            if sum(p.num_rows for p in parts) > 2 * held:
                parts = [merged(parts)]
                if parts[0].num_rows > held:
                    yield from parts.pop().to_batches(max_chunksize=100_000)
        if parts:
            yield from merged(parts).to_batches(max_chunksize=100_000)

    partial = found.select("pairs", "times").mapInArrow(run, "pair long, n long")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(second)))


def with_counts(found: DataFrame, row: str, most: int = BROADCAST_PAIRS) -> DataFrame:
    """found (pairs, times, and a unique ``row``) with n_best and count_sum in place of pairs and times.

    n_best: links whose pair is the commonest of its second id in all of found, ties included; count_sum: the sum of the
    pairs' counts over all links. Counts of ``most`` pairs or fewer go to every worker; more are joined by a shuffle.
    """
    counts = stored(pair_counts(found), "pair-counts")
    rest = [c for c in found.columns if c not in ("pairs", "times")]
    if counts.count() > most:
        links = found.select(row, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
        sums = links.join(counts, "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return found.select(*rest).join(sums, row, "left").select(*rest, zero("n_best"), zero("count_sum"))
    known = counts.orderBy("pair").toArrow()
    shared = found.sparkSession.sparkContext.broadcast(tuple(known.column(k).to_numpy() for k in ("pair", "n", "best")))
    schema = T.StructType([*found.select(*rest).schema.fields, *[T.StructField(k, T.LongType(), False) for k in ("n_best", "count_sum")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            own, times = (batch.column(batch.schema.get_field_index(k)) for k in ("pairs", "times"))
            place = np.searchsorted(pairs, own.flatten().to_numpy())
            each = times.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy())])
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(each * v[place])])[ends])) for v in (best.astype(np.int64), n)]
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *sums], names=[*kept.schema.names, "n_best", "count_sum"])

    return found.mapInArrow(run, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated ids included: counts of its alignment and the digest of its groups."""
    with scratch("alignment", "pair-counts"):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        found = aligned(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times")
        counted = with_counts(stored(found.withColumn("row", F.monotonically_increasing_id()), "alignment"), "row")
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
