"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. Sets are handled in bands of sizes that double; a set near the
top of its band is also handled in the next one. In a band every token is XORed, as a 64-bit hash, into one of ``s``
symbols of a sketch, so the number of symbols in which two sketches differ is at most the size of the sets' symmetric
difference. Linked sets of sizes a and b differ in (a + b) / 9 tokens at most; ``s`` is so large that more symbols are
in use than can differ, so linked sets agree in a used symbol (pigeonhole), and used symbols are the join keys. The few
sets with too few used symbols also use every token as a key.

Equal sets are one class. In the group of a key, each set is paired with the set before it only. Pairs whose sizes or
bit sketches (one bit flipped for each token, a few bits a token, folded to one length) differ too much are no links; the
others are verified on the whole sets, best supported pair of each set first, and links become components.

A group whose members are still in several components is open. Linked sets that aren't in one component share open keys
only, and they share all used symbols but those that differ, so sets with fewer open keys than that are done. The rest
keep their rarest open keys: as many as one of those that two linked sets share must be among (a prefix filter), so keys
that chance or a common passage gives to many sets rarely count. Bit sketches sift the sets that share such a key, pair
by pair in small groups, in blocks in large ones; sets that are then still plausible pairs are one cluster, cut by size.
A cluster is compared in blocks of bounded members and tokens, each pair once: whole sets decide, and only links that
join components leave a block, fewer than it has members. So no pairs are made for copies and near copies in any number,
whole sets go to the blocks of their near copies only, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import brief_shuffles, give_back, scratch, slices, small_batches, stored, table
from textloom.llm.graphs import components

#: Words of a shingle, and the similarity (in percent) from which two sets are linked.
SHINGLE, PERCENT = 5, 80
#: Symbols of a sketch for each token of a band's largest set, and besides.
SYMBOLS, MORE = 0.24, 2
#: Members of a cluster, and their tokens, that a block compares with as many others.
BLOCK, BLOCK_TOKENS = 1024, 1 << 18
#: Members of a key's group of which pairs are made, at most; larger groups are compared in blocks of bit sketches.
PAIRED = 16
#: Sets whose sizes differ by a factor of less are in one step of sizes or in neighbouring ones; linked sets' differ by 1.25.
STEP = 1.26
#: Ids that are broadcast to filter a table, at most (8 MB); more go through a shuffle.
BROADCAST_IDS = 1_000_000
#: Keys in a batch.
BATCH_KEYS = 1 << 18

U = np.uint64
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A number for each byte, the same for both cases of an ASCII letter, and which bytes are white space.
LETTERS = mixed(np.arange(1, 257, dtype=U) * MULTIPLIERS[0])
LETTERS[65:91] = LETTERS[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = U(0xD1342543DE82EF95)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of a text that are hashed at a time; a part ends at white space.
PART = 1 << 18


class Powers:
    """The powers of a number modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, U)

    def first(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.append(U(1), np.multiply.accumulate(np.full(2 * n, self.base, U)))
        return self.known[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def word_hashes(raw: bytes) -> np.ndarray:
    """The hashes of the words of a part: polynomials of their bytes, as differences of one running sum."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(LETTERS[data] * UP.first(len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * DOWN.first(len(data) + 1)[starts] + (ends - starts).astype(U))


def parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts that end between words; a longer word is a longer part."""
    at = 0
    while len(raw) - at > PART:
        end = at + PART
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: of all its words if they are fewer than 5, none without words.

    Letters A-Z count as a-z; words end at ASCII white space.
    """
    h = np.concatenate([word_hashes(p) for p in parts((text or "").encode())])
    if not (n := len(h)):
        return h
    total = h[: max(1, n - SHINGLE + 1)] * MULTIPLIERS[0]
    for k in range(1, min(n, SHINGLE)):
        total = (total ^ (total >> U(29))) + h[k : k + len(total)] * MULTIPLIERS[k]
    if n < SHINGLE:
        total = total[:1] + U(n)
    total = np.sort(mixed(total))
    return total[np.append(True, total[1:] != total[:-1])]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def bands(n: int) -> list[tuple[int, int, int]]:
    """The bands that a set of n tokens is handled in: number, symbols, and the most symbols in which a linked set differs."""
    band, out = n.bit_length() - 1, []
    for k in (band, band + 1) if 100 * n >= PERCENT << (band + 1) else (band,):
        top = 2 << k
        differ = (n + min(top - 1, 100 * n // PERCENT)) * (100 - PERCENT) // (100 + PERCENT)
        out.append((k, int(np.ceil(SYMBOLS * top)) + MORE, differ))
    return out


def salted(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens ^ U(1))


def sketch_keys(tokens: np.ndarray) -> np.ndarray:
    """The join keys of a set: used symbols of its sketch in each of its bands, and tokens where those are too few."""
    if not (n := len(tokens)):
        return np.empty(0, U)
    out, hashes = [], salted(tokens)
    for k, s, differ in bands(n):
        place = (hashes % U(s)).astype(np.int64)
        symbols, used = np.zeros(s, U), np.bincount(place, minlength=s) > 0
        np.bitwise_xor.at(symbols, place, tokens)
        at = np.flatnonzero(used)
        out.append(mixed(symbols[at] ^ mixed(at.astype(U) + U((k + 1) << 40))))
        if len(at) <= differ:
            out.append(mixed(tokens ^ U((k + 1) * 0x517CC1)))
    return np.concatenate(out)


def least_shared(tokens: np.ndarray) -> int:
    """The least number of keys of the first sketch that a linked set shares with this one, 1 at least."""
    if not len(tokens):
        return 1
    hashes = salted(tokens)
    used = lambda s: np.count_nonzero(np.bincount((hashes % U(s)).astype(np.int64), minlength=s))
    return max(1, min((used(s) - differ for _, s, differ in bands(len(tokens))), default=1))


def bit_sketch(tokens: np.ndarray) -> bytes:
    """A bit for each of 2 to 4 places a token (a power of two, 64 at least), flipped by each token there."""
    m = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((mixed(tokens ^ U(0xB17)) % U(m)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def plausible(n_a: int, n_b: int, a: bytes, b: bytes) -> bool:
    """False only if the sets can't be linked: by their sizes, or by the bits in which their sketches differ."""
    if 100 * min(n_a, n_b) < PERCENT * max(n_a, n_b):
        return False
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):
        x = x.reshape(2, -1)[0] ^ x.reshape(2, -1)[1]
    while len(y) > len(x):
        y = y.reshape(2, -1)[0] ^ y.reshape(2, -1)[1]
    return int(np.bitwise_count(x ^ y).sum()) <= (n_a + n_b) * (100 - PERCENT) // (100 + PERCENT)


def sliced(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and bytes of their texts (column 1 if none is named); free memory goes back at the end."""
    for batch in batches:
        sizes = sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or (1,))
        for a, b in slices(sizes):
            yield batch.slice(a, b - a)
    give_back()


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits; null for the empty set), shared (least_shared) and bits (the sketch) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(x) for x in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            columns = [pa.array(map(len, found), pa.int64()), pa.array(keys, pa.binary()), pa.array(map(least_shared, found), pa.int64()), pa.array(map(bit_sketch, found), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_shingles", "set_key", "shared", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, shared long, bits binary")


def keys_of(docs: DataFrame) -> DataFrame:
    """(key, node) for each join key of each row (node, text). A task skips sets that it has had, so copies cost a key for each task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = set()
        keys, nodes, n = [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])
        for batch in sliced(batches):
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingles(text)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                if digest in had or not len(tokens):
                    continue
                had.add(digest)
                found = sketch_keys(tokens)
                keys.append(found)
                nodes.append(np.full(len(found), node, np.int64))
                if (n := n + len(found)) >= BATCH_KEYS:
                    yield flush()
                    keys, nodes, n = [], [], 0
        if n:
            yield flush()

    return docs.select("node", "text").mapInArrow(run, "key long, node long")


def neighbours(keys: DataFrame) -> DataFrame:
    """(key, a, b): each member of a key's group with the member before it."""
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    return keys.withColumn("a", before).where("a <> node").select("key", "a", F.col("node").alias("b"))


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (node, text) whose node is in ids (stored, distinct): a filter while the ids are few, else a join."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "node", "left_semi")


def sifted(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The plausible ones of the pairs (a, b, n). info: node, n_shingles, bits of each class."""
    end = lambda e: info.select(F.col("node").alias(e), F.col("n_shingles").alias(f"n_{e}"), F.col("bits").alias(f"bits_{e}"))
    sized = pairs.join(end("a"), "a").join(end("b"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    sized = sized.select("a", "b", "n", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [plausible(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    return sized.mapInArrow(run, "a long, b long, n long").dropDuplicates(["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked. texts: (node, text)."""
    left = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 3):
            texts_a, texts_b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [linked(shingles(x), shingles(y)) for x, y in zip(texts_a, texts_b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (with their other columns) whose ends aren't in one component yet, with the components as ra, rb."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.select(*pairs.columns, F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of old roots and new links, stored."""
    return stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links.select("a", "b"))), "roots")


def linked_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among the pairs (stored); only the texts of their ends are read."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    return verified(pairs, stored(with_ids(docs, nodes), "texts"))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) folded to a shorter length."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def near_in_block(upper: np.ndarray, guest: np.ndarray, n: np.ndarray, bits: list[np.ndarray], apart: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a block, the later ones that are apart from it and may be linked with it by sizes and bits.

    Members of the lower side, which come first, are compared with those of the upper one, or all with each other if
    there is one side only; guests, of the next smaller step of sizes, aren't compared with guests.
    """
    size, two = min(x.shape[1] for x in bits), bool(upper.any() and not upper.all())
    bits = np.concatenate([folded(x, size) for x in bits])
    for i in range(len(n) - 1):
        if two and upper[i]:
            break
        at = np.arange(i + 1, len(n))
        good = apart(i, at) & (100 * np.minimum(n[at], n[i]) >= PERCENT * np.maximum(n[at], n[i])) & ~(guest[at] & guest[i])
        at = at[good & upper[at] if two else good]
        if len(at):
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            at = at[differ <= (n[at] + n[i]) * (100 - PERCENT) // (100 + PERCENT)]
        if len(at):
            yield i, at


def block_links(rows: list[tuple[int, int, bytes, bool, bool]]) -> list[tuple[int, int]]:
    """Links that join components among the members (node, root, tokens, upper, guest) of a block; no more are needed."""
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    sets = [np.frombuffer(r[2], U) for r in rows]
    node, n = np.array([r[0] for r in rows]), np.array([len(x) for x in sets])
    upper, guest = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    component = np.unique([r[1] for r in rows], return_inverse=True)[1]
    bits = [np.frombuffer(bit_sketch(x), np.uint8)[None] for x in sets]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([0, *n])
    held, out = np.zeros(int(ids.max()) + 1, bool), []
    for i, at in near_in_block(upper, guest, n, bits, lambda i, at: component[at] != component[i]):
        own = ids[ends[i] : ends[i + 1]]
        held[own] = True
        both = np.array([np.count_nonzero(held[ids[ends[j] : ends[j + 1]]]) for j in at])
        held[own] = False
        for j in at[100 * both >= PERCENT * (n[at] + n[i] - both)]:
            if component[j] != component[i]:
                component[component == component[j]] = component[i]
                out.append((int(node[i]), int(node[j])))
    return out


def block_near(rows: list[tuple[int, int, bytes, bool, bool, int]]) -> list[tuple[int, int]]:
    """Plausible pairs among the members (node, root, bits, upper, guest, size) of a block whose components differ.

    As many as join all members that such pairs join. Components aren't joined by a pair, since it may be no link.
    """
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    node, root, upper, guest, n = (np.array([r[k] for r in rows]) for k in (0, 1, 3, 4, 5))
    bits = [np.frombuffer(r[2], np.uint8)[None] for r in rows]
    group, out = np.arange(len(rows)), []
    for i, at in near_in_block(upper, guest, n, bits, lambda i, at: (root[at] != root[i]) & (group[at] != group[i])):
        for j in at:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((int(node[i]), int(node[j])))
    return out


def tokens_of(docs: DataFrame) -> DataFrame:
    """node and tokens (the sorted set, 8 bytes each) of each row of docs (node, text) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(x) for x in batch.column(1).to_pylist()]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "tokens"])
            yield rows.filter(pa.array([len(x) > 0 for x in found]))

    return docs.select("node", "text").mapInArrow(run, "node long, tokens binary")


def in_blocks(sets: DataFrame, block: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """The pairs (a, b) that block finds among the sets (node, root, cluster, data, n; stored) of each cluster.

    A cluster's sets are cut into steps of sizes, and each step, with the step below as guests, into parts; a block is
    two parts. A block's rows (node, root, data, upper, guest, n) are bounded by its members and the bytes of their data.
    """
    own_step = F.floor(F.log("n") / float(np.log(STEP)))
    at = F.explode(F.array(F.struct(own_step.alias("step"), F.lit(False).alias("guest")), F.struct((own_step + 1).alias("step"), F.lit(True).alias("guest"))))
    seats = sets.select("*", at.alias("at")).select("*", "at.*").drop("at")
    sizes = seats.groupBy("cluster", "step").agg(F.count("*").alias("m"), (F.sum(F.octet_length("data")) / 8).alias("t"), F.min("root").alias("x"), F.max("root").alias("y"), F.min("guest").alias("alone"))
    sizes = sizes.where("x <> y AND NOT alone").select("cluster", "step", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).alias("parts"))
    sizes = stored(sizes, "cluster-sizes")
    parts = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    own = seats.join(parts, ["cluster", "step"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    rows = placed.select("cluster", "step", low, high, "node", "root", "data", (F.col("own") > F.col("other")).alias("upper"), "guest", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda links: pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema=LINKS)
        of, held = None, []
        for batch in sliced(batches, 6):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != of:
                    if len(held) > 1 and (links := block(held)):
                        yield made(links)
                    of, held = row[:4], []
                held.append(row[4:])
        if len(held) > 1 and (links := block(held)):
            yield made(links)

    blocks = rows.repartition("cluster", "step", "low", "high").sortWithinPartitions("cluster", "step", "low", "high")
    return blocks.mapInArrow(run, "a long, b long")


def linked_across(clusters: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join all linked sets of a cluster; clusters: (node, cluster), stored; roots: the components so far."""
    sets = tokens_of(with_ids(docs, clusters.select("node"))).join(clusters, "node").join(roots, "node", "left")
    sets = sets.select("node", F.coalesce("root", "node").alias("root"), "cluster", F.col("tokens").alias("data"), (F.octet_length("tokens") / 8).cast("long").alias("n"))
    return in_blocks(stored(sets, "cluster-sets"), lambda rows: block_links([r[:5] for r in rows]))


def near_across(clusters: DataFrame, roots: DataFrame, info: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) that join all sets of a cluster which such pairs of different components join; as linked_across, by the bits of info."""
    sets = info.join(clusters, "node").join(roots, "node", "left")
    sets = sets.select("node", F.coalesce("root", "node").alias("root"), "cluster", F.col("bits").alias("data"), F.col("n_shingles").alias("n"))
    return in_blocks(stored(sets, "near-sets"), block_near)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def rarest(members: DataFrame, info: DataFrame) -> DataFrame:
    """(key, node): the rarest keys of each node of members (key, node; stored, distinct), all but ``shared`` - 1 of them.

    Linked sets share ``shared`` of their keys or more, and the rarest key that they share is among these of both. Keys
    of one member don't count.
    """
    shared = info.groupBy("node").agg(F.min("shared").alias("shared"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select((F.col("key") + 0).alias("key"), "size")
    own = Window.partitionBy("node")
    ranked = members.join(sizes, "key").select("key", "node", F.row_number().over(own.orderBy("size", "key")).alias("place"), F.count("*").over(own).alias("of"))
    return ranked.join(shared, "node").where("place <= of - shared + 1").select("key", "node")


def still_near(members: DataFrame, roots: DataFrame, info: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) that join all linked sets of different components. members: the open keys (key, node) of the sets that aren't settled, stored."""
    rare = stored(rarest(members, info), "rare")
    sizes = rare.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select((F.col("key") + 0).alias("key"), "size")
    rare = stored(rare.join(sizes, "key").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "size"), "rarest")
    end = lambda e: rare.where(f"size <= {PAIRED}").select("key", F.col("node").alias(e), F.col("root").alias(f"r{e}"))
    pairs = end("a").join(end("b"), "key").where("a < b AND ra <> rb").select("a", "b", F.lit(1).cast("long").alias("n")).distinct()
    near = sifted(pairs, info).select("a", "b")
    common = rare.where(f"size > {PAIRED}").select("key", "node")
    if common.isEmpty():
        return near
    firsts = common.groupBy("key").agg(F.min("node").alias("first")).select((F.col("key") + 0).alias("key"), "first")
    clusters = components(common.join(firsts, "key").select(F.col("node").alias("a"), F.col("first").alias("b")))
    return near.union(near_across(stored(clusters.select("node", F.col("root").alias("cluster")), "common"), roots, info))


def resolve(candidates: DataFrame, docs: DataFrame, info: DataFrame) -> DataFrame:
    """The components after the groups of candidates (key, a, b: neighbours in a group, as classes) are settled."""
    pairs = sifted(candidates.groupBy("a", "b").agg(F.count("*").alias("n")), info)
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "best")
    roots = joined(best.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), linked_pairs(best, docs))
    open_keys = stored(apart(candidates, roots).select("key").distinct(), "open")
    if open_keys.isEmpty():
        return roots
    members = candidates.join(open_keys, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    members = stored(members, "members")
    counts = members.groupBy("node").agg(F.count("*").alias("n"))
    unsettled = counts.join(info.groupBy("node").agg(F.min("shared").alias("shared")), "node").where("n >= shared").select((F.col("node") + 0).alias("node"))
    near = stored(still_near(stored(members.join(unsettled, "node", "left_semi"), "unsettled"), roots, info), "near")
    if near.isEmpty():
        return roots
    clusters = stored(components(near).select("node", F.col("root").alias("cluster")), "clusters")
    across = stored(linked_across(clusters, roots, docs), "across")
    return roots if across.isEmpty() else joined(roots, across)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links of similarity 0.8 or more.

    Only doc_id and text are used. Null and empty texts, and texts without words, have no shingle and are linked with
    nothing; rows with a null doc_id are linked with nothing and have no component. Rows that share a doc_id are one
    document for links. Copies are linked with each other. An empty table gives an empty table.
    """
    with scratch("sets", "components"), small_batches(docs.sparkSession), brief_shuffles(docs.sparkSession):
        return labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def without_copies(texts: DataFrame, classes: DataFrame, firsts: DataFrame) -> DataFrame:
    """texts (node, text) without those that are copies only; firsts: the nodes that are the first of a class, stored.

    A filter while the firsts or the copies are few. If both are many, texts go through a shuffle where that saves more
    than it takes, for copies that are half of the texts or more; else copies stay, and are named as their firsts later.
    """
    if (kept := firsts.count()) <= BROADCAST_IDS:
        return texts.join(F.broadcast(firsts), "node", "left_semi")
    copies = stored(classes.select(F.col("doc_id").alias("node")).distinct().join(firsts, "node", "left_anti"), "copies")
    if (gone := copies.count()) <= BROADCAST_IDS:
        return texts.join(F.broadcast(copies), "node", "left_anti")
    return texts.join(firsts, "node", "left_semi") if gone >= kept else texts


def labelled(rows: DataFrame) -> DataFrame:
    """jaccard_components of rows (doc_id, text)."""
    sets = stored(sets_of(rows), "sets")
    usable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key")
    firsts = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    # The key is computed anew, so that the join's sides are both exchanged and hot classes can be split.
    classes = stored(usable.join(firsts.select(F.concat("set_key", F.lit(b"")).alias("set_key"), "rep"), "set_key"), "classes")
    reps = classes.where("doc_id = rep").distinct().select(F.col("doc_id"), "set_key")
    info = sets.join(reps, ["doc_id", "set_key"]).select(F.col("doc_id").alias("node"), "n_shingles", "shared", "bits").dropDuplicates(["node", "n_shingles", "bits"])
    info = stored(info, "info")
    firsts = stored(reps.select(F.col("doc_id").alias("node")).distinct(), "firsts")
    rep = classes.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("node"), "text")
    whole = without_copies(texts, classes, firsts)
    moved = rep.where("doc_id <> rep").select(F.col("doc_id").alias("node"), "rep")
    moved = stored(moved if whole is texts else moved.join(firsts, "node", "left_semi"), "moved")
    few, raw = moved.count() <= BROADCAST_IDS, neighbours(keys_of(whole))
    named = lambda end: (F.broadcast(moved) if few else moved).select(F.col("node").alias(end), F.col("rep").alias(f"r{end}"))
    as_reps = (raw if few else stored(raw, "neighbours")).join(named("a"), "a", "left").join(named("b"), "b", "left")
    x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    candidates = as_reps.select("key", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b")
    same = rep.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = resolve(stored(candidates, "candidates"), texts, info)
    roots = stored(joined(roots, same), "components")
    return sets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.coalesce("root", "doc_id")).alias("component_id")
    )


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids (stored)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, and one row of each doc_id; columns unchanged.

    Rows without doc_id all stay.
    """
    found = stored(jaccard_components(docs).select("doc_id", "component_id"), "components")
    copies = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    again = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    left = without(docs, copies)
    if again.isEmpty():
        return left
    return without(left, again).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, see ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"))
