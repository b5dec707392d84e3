"""Calls of tools as columns: calls written into a text, canonical signatures, and the JSON envelopes of their results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let, trimmed

#: The marks of a call in a text, in any case, and the arguments that are whole numbers.
BLOCK, FUNCTION, PARAMETER = r"(?is)<tool_call>(.*?)</tool_call>", r"(?is)<function=([a-z0-9_]+)>", r"(?is)<parameter=([a-z0-9_]+)>"
RESIDUE = r"(?is)</?tool_call>|<function=[^>]+>|<parameter=[^>]+>"
WHOLE = ("line", "start_line", "end_line", "before", "after", "limit", "offset", "context_lines")
#: Errors of a text's calls.
INCOMPLETE, NAMELESS = "no complete call", "a call without a function"
PARSED = "struct<text:string,detected:boolean,error:string,calls:array<struct<id:string,name:string,arguments:string>>>"

single_spaced = lambda x: F.regexp_replace(x, r"\s+", " ")


def quoted(x: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def literal(name: Column, value: Column) -> Column:
    """An argument's value as JSON: a number where the name wants one, true and false in any case, else a string."""
    number = F.when(name.isin(*WHOLE) & value.rlike("^[+-]?[0-9]+$"), F.expr("1") * value.try_cast("bigint"))
    return F.coalesce(number.cast("string"), F.when(F.lower(value).isin("true", "false"), F.lower(value)), quoted(value))


def arguments(block: Column) -> Column:
    """The parameters of a block as a JSON object, by name; of one name the last value counts, and blank ones are left out."""

    def listed(b: Column) -> Column:
        names = F.regexp_extract_all(b, F.lit(PARAMETER), F.lit(1))
        pairs = F.zip_with(names, F.slice(F.split(b, PARAMETER), 2, F.size(names)), lambda n, v: F.struct(F.lower(n).alias("n"), single_spaced(trimmed(v)).alias("v")))
        filled = F.filter(pairs, lambda p: p["v"] != "")
        last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["n"] == p["n"]))
        members = F.transform(F.array_sort(let(filled, last)), lambda p: F.concat(quoted(p["n"]), F.lit(":"), literal(p["n"], p["v"])))
        return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))

    return let(block, listed)


def without_calls(content: Column) -> Column:
    """A text without its calls and without what is left of broken ones, its white space single."""
    bare = F.regexp_replace(F.regexp_replace(content, BLOCK, " "), RESIDUE, " ")
    return trimmed(single_spaced(bare))


def calls_in(content: Column, turn: Column) -> Column:
    """What a text calls, as ``PARSED``: the text without calls, whether it has a mark of one, what is wrong, and the calls
    in order (id text-tool-call-turn-number, name, arguments as JSON).

    A text without a mark is only trimmed. With marks but no complete call, or with a call that names no function, there
    are no calls and an error. A null text is an empty one.
    """

    def parsed(text: Column) -> Column:
        marked = F.contains(F.lower(text), F.lit("<tool_call>"))
        blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), trimmed)
        call = lambda b, i: F.struct(
            F.concat(F.lit("text-tool-call-"), turn.cast("string"), F.lit("-"), (i + 1).cast("string")).alias("id"), F.regexp_extract(b, FUNCTION, 1).alias("name"), arguments(b).alias("arguments")
        )

        def judged(calls: Column) -> Column:
            error = F.when(~marked, F.lit(None)).when(F.size(calls) == 0, INCOMPLETE).when(F.exists(calls, lambda c: c["name"] == ""), NAMELESS)
            none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
            return F.struct(F.when(marked, without_calls(text)).otherwise(text).alias("text"), marked.alias("detected"), error.alias("error"), F.when(marked & error.isNull(), calls).otherwise(none).alias("calls"))

        return let(F.transform(blocks, call), judged)

    return let(trimmed(F.coalesce(content, F.lit(""))), parsed).cast(PARSED)


def signature(name: Column, normalized: Column) -> Column:
    """A call's name and its normalized arguments (a struct) as canonical JSON: fields in the struct's order, nulls left out."""
    return F.concat(name, F.lit(":"), F.to_json(normalized))


def nonzero(x: Column) -> Column:
    """A value, or null where it is zero, false or the empty string, so that JSON leaves it out."""
    return F.when(x.cast("string").isin("0", "0.0", "false", ""), F.lit(None)).otherwise(x)


def envelope(result: Column, cached: Column | None = None, duplicate: Column | None = None, already_seen: Column | None = None, novel_lines: Column | None = None, hint: Column | None = None, next_offset: Column | None = None) -> Column:
    """A result (a struct) with what is known of its call, as JSON. Zeros, false and empty texts are left out, but novel_lines."""
    given = [("cached", cached), ("duplicate", duplicate), ("already_seen", already_seen), ("progress_hint", hint), ("suggested_next_offset", next_offset)]
    meta = F.struct(F.coalesce(novel_lines if novel_lines is not None else F.lit(0), F.lit(0)).cast("long").alias("novel_lines"), *[nonzero(c).alias(k) for k, c in given if c is not None])
    return F.to_json(F.struct(result.alias("result"), meta.alias("meta")))


def error_envelope(code: Column, message: Column, retryable: Column | None = None, details: Column | None = None) -> Column:
    """An error as JSON: its code and message, whether it may be tried again, and details, a map, unless it is empty."""
    more = [F.when(F.size(details) > 0, details).alias("details")] if details is not None else []
    error = F.struct(code.alias("code"), message.alias("message"), (retryable if retryable is not None else F.lit(False)).alias("retryable"), *more)
    return F.to_json(F.struct(error.alias("error")))


META = "struct<cached:boolean,duplicate:boolean,already_seen:boolean,novel_lines:bigint,progress_hint:string,suggested_next_offset:bigint>"
ERROR = "struct<code:string,message:string,retryable:boolean,details:map<string,string>>"


def opened(raw: Column, result: str) -> Column:
    """An envelope as a struct: result (of the given type, null beside an error), meta with its defaults, error, and corrupt,
    the raw text where it is no envelope: no JSON object, or one with neither result nor error."""
    read = F.from_json(raw, f"struct<result:{result},meta:{META},error:{ERROR},corrupt:string>", {"columnNameOfCorruptRecord": "corrupt", "mode": "PERMISSIVE"})

    def told(e: Column) -> Column:
        fine = e["corrupt"].isNull() & (e["result"].isNotNull() | e["error"].isNotNull())
        lost = F.when(~F.coalesce(fine, F.lit(False)), F.coalesce(raw, F.lit("")))
        value = lambda k, default: F.coalesce(e["meta"][k], F.lit(default)).alias(k)
        meta = F.struct(value("cached", False), value("duplicate", False), value("already_seen", False), value("novel_lines", 0), value("progress_hint", ""), value("suggested_next_offset", 0))
        return F.struct(F.when(lost.isNull() & e["error"].isNull(), e["result"]).alias("result"), meta.alias("meta"), F.when(lost.isNull(), e["error"]).alias("error"), lost.alias("corrupt"))

    return let(read, told)
