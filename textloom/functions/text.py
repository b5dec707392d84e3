"""Text as columns: case, white space, tokens, overlap, token estimates and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search query's content leaves out (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from how if in is it of on or that the to what when where which with about "
    "есть или как какая какие какой когда где для что это про по из на и в во не ли а"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) for a value that it names several times: the value is computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lowered(x: Column) -> Column:
    """Lower case letter by letter: the two letters whose full mapping differs are mapped first."""
    return F.lower(F.translate(x, "İΣ", "iσ"))


def trimmed(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def folded(x: Column) -> Column:
    """Runs of white space as one space, none at the ends: what is sent to an embedder."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def pieces(x: Column) -> Column:
    """Lower-cased runs of letters and numbers, in order."""
    return F.array_remove(F.split(lowered(x), r"[^\p{L}\p{N}]+"), "")


def tokens(x: Column) -> Column:
    """The distinct pieces of two characters or more, in order of their first occurrence."""
    return F.array_distinct(F.filter(pieces(x), lambda t: F.length(t) >= 2))


def content_tokens(x: Column) -> Column:
    return F.array_except(tokens(x), F.array(*map(F.lit, STOP_WORDS)))


def contained(query_tokens: Column, text: Column) -> Column:
    """How many of the tokens occur anywhere in the text, also inside words."""
    return let(lowered(text), lambda low: F.size(F.filter(query_tokens, lambda t: F.contains(low, t))))


def overlap_ratio(query_tokens: Column, text: Column) -> Column:
    """The share of the tokens that occur in the text; 0 without tokens."""
    n = F.size(query_tokens)
    return F.when(n > 0, contained(query_tokens, text) / n).otherwise(0.0)


def overlap_score(query_tokens: Column, text: Column) -> Column:
    return F.round(overlap_ratio(query_tokens, text) * 1000) / 1000


def approx_tokens(x: Column) -> Column:
    """A third of the characters, rounded up."""
    return F.floor((F.length(x) + 2) / 3)


def seed_queries(prompt: Column) -> Column:
    """Up to five search queries for a prompt, without blank and repeated ones.

    The prompt, its pieces, its content tokens, the first eight of those, and the five longest (ties by text).
    """
    content = content_tokens(prompt)
    by_length = F.array_sort(F.transform(content, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    longest = F.transform(F.slice(by_length, 1, 5), lambda s: s["t"])
    joined = [F.array_join(x, " ") for x in (pieces(prompt), content, F.slice(content, 1, 8), longest)]
    return F.array_distinct(F.array_remove(F.array(trimmed(prompt), *joined), ""))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x * x).cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two float vectors: products in single precision, summed left to right in double precision.

    0 for empty vectors, unequal lengths and zero norms.
    """
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(usable, dot / (na * nb)).otherwise(0.0)
