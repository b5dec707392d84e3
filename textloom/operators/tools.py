"""Tools over a corpus: named functions of JSON arguments, run as DataFrames, and table functions for SQL.

In SQL a tool takes a table: ``SELECT * FROM search_file(TABLE(SELECT doc_id, text FROM documents), 'query', 'literal')``.
A table function sees a document at a time; ``match_ranges`` sees the lines of a path in order and holds one range.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from textloom.operators import lines, search, semantic

#: Files of a list unless asked and at most, lines around one where a negative number is asked.
FILES, MOST_FILES, AROUND = 50, 200, 3


class ToolError(ValueError):
    """A call that can't be run: a code, a message, whether it may be tried again, and details."""

    def __init__(self, code: str, message: str, retryable: bool = False, **details: object):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.retryable, self.details = code, message, retryable, details


@dataclass(frozen=True)
class Corpus:
    """What tools read: documents with the names of their columns, and for search_rag chunks with vectors and an embedder.

    source: the column of the name a single file was opened by; buckets: the parts of an index laid out by path.
    """

    docs: DataFrame
    path: str = "path"
    text: str = "text"
    source: str | None = None
    chunks: DataFrame | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    buckets: int = 0

    def one(self, path: str, tool: str) -> DataFrame:
        """The documents of a path, a single file also by its other names; all of them for no path."""
        try:
            return search.restricted(self.docs, path, self.path, self.source)
        except ValueError as e:
            raise ToolError("invalid_arguments", "the corpus has no such path", tool=tool, path=path) from e


@dataclass(frozen=True)
class Tool:
    """arguments: names and kinds; required ones must be given; normalize puts them into range; function: the table function."""

    name: str
    arguments: dict[str, type]
    required: tuple[str, ...]
    normalize: Callable[[dict], dict]
    run: Callable[[Corpus, dict], DataFrame]
    function: type | None = None

    def parsed(self, raw: str | None) -> dict:
        """Normalized arguments of a JSON object; unknown ones are left out, and no text at all is an empty object."""
        try:
            given = json.loads(raw) if raw and raw.strip() else {}
        except ValueError as e:
            raise ToolError("invalid_arguments", f"{self.name} can't take these arguments", tool=self.name, error=str(e)) from e
        wrong = [k for k, kind in self.arguments.items() if isinstance(given, dict) and given.get(k) is not None and (not isinstance(given[k], kind) or isinstance(given[k], bool))]
        if not isinstance(given, dict) or wrong:
            raise ToolError("invalid_arguments", f"{self.name} can't take these arguments", tool=self.name, fields=wrong)
        for k in self.required:
            if k not in given:
                raise ToolError("invalid_arguments", f"{self.name} needs {k}", tool=self.name, field=k)
        return self.normalize({k: given[k] if given.get(k) is not None else kind() for k, kind in self.arguments.items()})

    def signature(self, raw: str | None) -> str:
        """The same for all arguments that mean the same."""
        return f"{self.name}:{json.dumps(self.parsed(raw), sort_keys=True, ensure_ascii=False)}"


def in_range(value: int, usual: int, most: int) -> int:
    return min(value, most) if value > 0 else usual


def page_of(a: dict, usual: int, most: int) -> dict:
    return a | {"limit": in_range(a["limit"], usual, most), "offset": max(0, a["offset"])}


def search_file(corpus: Corpus, a: dict) -> DataFrame:
    if a["path"] and not a["query"]:
        raise ToolError("invalid_arguments", "the query is empty", tool="search_file", field="query")
    docs = corpus.one(a["path"], "search_file")
    try:
        return search.search(docs, a["query"], a["mode"], a["limit"], a["offset"], None, corpus.path, corpus.text, a["context_lines"])
    except ValueError as e:
        raise ToolError("invalid_arguments", str(e).partition(": ")[2], tool="search_file") from e


def read_lines(corpus: Corpus, a: dict) -> DataFrame:
    """The lines of a range, each with the range that was asked for."""
    found = lines.read_lines(corpus.one(a["path"], "read_lines"), a["start_line"], a["end_line"], corpus.path, corpus.text)
    return found.select("*", F.lit(a["start_line"]).cast("long").alias("start_line"), F.lit(a["end_line"]).cast("long").alias("end_line"))


def read_around(corpus: Corpus, a: dict) -> DataFrame:
    """The lines around one, each with the range that was asked for: from line 1 at least, and beyond the file's end."""
    if a["line"] < 1:
        raise ToolError("invalid_arguments", "lines count from 1", tool="read_around", field="line")
    bounds = {"start_line": max(1, a["line"] - a["before"]), "end_line": a["line"] + a["after"]}
    return read_lines(corpus, a | bounds)


def list_files(corpus: Corpus, a: dict) -> DataFrame:
    return lines.list_files(corpus.docs, a["limit"], a["offset"], corpus.path)


def search_rag(corpus: Corpus, a: dict) -> DataFrame:
    """One row: a page of the corpus's chunks, as ``semantic.pages`` gives it."""
    if corpus.chunks is None or corpus.embed is None:
        raise ToolError("tool_not_ready", "there is no index yet" if corpus.chunks is None else "there is no embedder", tool="search_rag")
    if not a["query"]:
        raise ToolError("invalid_arguments", "the query is empty", tool="search_rag", field="query")
    try:
        vector = corpus.embed([" ".join(a["query"].split())])[0]
    except Exception as e:
        raise ToolError("tool_execution_failed", "the question couldn't be embedded", tool="search_rag", error=str(e)) from e
    row = (0, [float(x) for x in vector], a["query"], a["path"], a["limit"], a["offset"])
    asked = corpus.docs.sparkSession.createDataFrame([row], "query_id int, query_vector array<float>, question string, path string, limit int, offset int")
    try:
        return semantic.pages(asked, corpus.chunks, buckets=corpus.buckets)
    except ValueError as e:
        raise ToolError("invalid_arguments", "the corpus has no such path", tool="search_rag", field="path", value=a["path"]) from e


def path_field(table: AnalyzeArgument) -> T.StructField:
    """The first column of a table argument: what tells documents apart."""
    if not table.isTable:
        raise ValueError("invalid_arguments: the first argument must be a table of a path and a text")
    return table.dataType.fields[0]


def given(argument: AnalyzeArgument, name: str):
    if argument.value is None:
        raise ValueError(f"invalid_arguments: {name} must be a constant")
    return argument.value


def own_lines(text: str | None) -> list[str]:
    """The lines of a text as ``lines.line_array`` and ``lines.content`` have them."""
    parts = (text or "").split("\n")
    return [x.rstrip("\r") for x in (parts[:-1] if parts[-1] == "" else parts)]


def matcher(query: str, mode: str) -> Callable[[str], tuple[float, str] | None]:
    """What a line scores, and why, in one mode; None for no match. Patterns are Python's."""
    low = lambda s: s.replace("İ", "i").replace("Σ", "σ").lower()
    if mode == "literal":
        wanted = low(query)
        return lambda line: (1.0, "literal_match") if wanted in low(line) else None
    if mode == "regex":
        pattern = re.compile(query, re.IGNORECASE)
        return lambda line: (1.0, "regex_match") if pattern.search(line) else None
    tokens = search.query_tokens(query)

    def overlap(line: str) -> tuple[float, str] | None:
        n = sum(t in low(line) for t in tokens) if len(tokens) > 1 else 0
        return (math.floor(n / len(tokens) * 1000 + 0.5) / 1000, f"token_overlap:{n}/{len(tokens)}") if n else None

    return overlap


class SearchFile:
    """search_file(TABLE(path, text), query [, mode [, context_lines]]): matching lines with their context, document by
    document. In auto mode, a document without a literal match is searched by token overlap."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, query: AnalyzeArgument, mode: AnalyzeArgument | None = None, context_lines: AnalyzeArgument | None = None) -> AnalyzeResult:
        if mode is not None and given(mode, "mode") == "regex":
            re.compile(given(query, "query"))
        rest = [("line_no", T.LongType()), ("content", T.StringType()), ("score", T.DoubleType()), ("reason", T.StringType()), ("context_before", T.ArrayType(T.StringType())), ("context_after", T.ArrayType(T.StringType()))]
        return AnalyzeResult(T.StructType([path_field(docs), *[T.StructField(k, t) for k, t in rest]]))

    def eval(self, row: Row, query: str, mode: str = "auto", context_lines: int = 0) -> Iterator[tuple]:
        own, k = own_lines(row[1]), max(0, context_lines)
        mode, *_ = search.normalized(mode, 0, 0, 0)
        for one in ("literal", "overlap") if mode == "auto" else (mode,):
            test, some = matcher(query.strip(), one), False
            for i, line in enumerate(own):
                if hit := test(line):
                    some = True
                    yield (row[0], i + 1, line, *hit, own[max(0, i - k) : i], own[i + 1 : i + 1 + k])
            if some:
                return


class ReadLines:
    """read_lines(TABLE(path, text), start_line, end_line): those lines of every document."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, start_line: AnalyzeArgument, end_line: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(T.StructType([path_field(docs), T.StructField("line_no", T.LongType()), T.StructField("content", T.StringType())]))

    def eval(self, row: Row, start_line: int, end_line: int) -> Iterator[tuple]:
        first = max(1, start_line)
        for i, line in enumerate(own_lines(row[1])[first - 1 : max(first - 1, end_line)]):
            yield row[0], first + i, line


class ReadAround:
    """read_around(TABLE(path, text), line [, before [, after]]): the lines around one; negative distances mean 3."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, line: AnalyzeArgument, before: AnalyzeArgument | None = None, after: AnalyzeArgument | None = None) -> AnalyzeResult:
        if given(line, "line") < 1:
            raise ValueError("invalid_arguments: lines count from 1")
        return ReadLines.analyze(docs, line, line)

    def eval(self, row: Row, line: int, before: int = 0, after: int = 0) -> Iterator[tuple]:
        yield from ReadLines().eval(row, line - (AROUND if before < 0 else before), line + (AROUND if after < 0 else after))


class MatchRanges:
    """match_ranges(TABLE(path, line_no, text), query [, mode [, around]]): ranges of lines around matches of a path,
    overlapping ones as one, with how many matches they hold. Lines are dealt by path and read in order; one range is held."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, query: AnalyzeArgument, mode: AnalyzeArgument | None = None, around: AnalyzeArgument | None = None) -> AnalyzeResult:
        path, place = path_field(rows), rows.dataType.fields[1]
        schema = T.StructType([path, *[T.StructField(k, T.LongType()) for k in ("start_line", "end_line", "n_matches")]])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(path.name)], orderBy=[OrderingColumn(place.name)])

    def __init__(self) -> None:
        self.held: list | None = None
        self.test: Callable | None = None

    def eval(self, row: Row, query: str, mode: str = "literal", around: int = 0) -> Iterator[tuple]:
        self.test = self.test or matcher(query.strip(), "overlap" if mode == "auto" else mode)
        if not self.test(row[2].rstrip("\r") if row[2] else ""):
            return
        start, end = max(1, row[1] - around), row[1] + around
        if self.held and start <= self.held[2]:
            self.held[2:] = [end, self.held[3] + 1]
        else:
            yield from self.terminate()
            self.held = [row[0], start, end, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield tuple(self.held)
        self.held = None


trimmed = lambda a, *names: a | {k: a[k].strip() for k in names}
away = lambda n: AROUND if n < 0 else n
LIST_FILES = Tool("list_files", {"limit": int, "offset": int}, (), lambda a: page_of(a, FILES, MOST_FILES), list_files)
SEARCH_FILE = Tool(
    "search_file", {"query": str, "path": str, "mode": str, "limit": int, "offset": int, "context_lines": int}, ("query",),
    lambda a: page_of(trimmed(a, "query", "path"), search.PAGE, search.MOST) | {"mode": a["mode"] if a["mode"] in ("literal", "regex") else "auto", "context_lines": max(0, a["context_lines"])}, search_file, SearchFile,
)
READ_LINES = Tool("read_lines", {"path": str, "start_line": int, "end_line": int}, ("start_line", "end_line"), lambda a: trimmed(a, "path") | {"start_line": max(1, a["start_line"])}, read_lines, ReadLines)
READ_AROUND = Tool("read_around", {"path": str, "line": int, "before": int, "after": int}, ("line",), lambda a: trimmed(a, "path") | {"before": away(a["before"]), "after": away(a["after"])}, read_around, ReadAround)
SEARCH_RAG = Tool("search_rag", {"query": str, "path": str, "limit": int, "offset": int}, ("query",), lambda a: page_of(trimmed(a, "query", "path"), search.PAGE, search.MOST), search_rag)
#: Table functions that aren't tools of a session.
FUNCTIONS = {"match_ranges": MatchRanges}
#: The tools of a corpus of several files; that of a single one has no list.
ALL = (LIST_FILES, SEARCH_FILE, READ_LINES, READ_AROUND, SEARCH_RAG)


@dataclass
class Registry:
    """Tools in order; of two with one name the first counts. A session's calls with the same meaning run once."""

    tools: tuple[Tool | None, ...] = ALL
    results: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        named: dict[str, Tool] = {}
        for tool in self.tools:
            if tool is not None:
                named.setdefault(tool.name, tool)
        self.named = named

    def definitions(self) -> list[tuple[str, dict[str, str], tuple[str, ...]]]:
        """Each tool's name, its arguments' kinds, and the required ones."""
        return [(t.name, {k: kind.__name__ for k, kind in t.arguments.items()}, t.required) for t in self.named.values()]

    def tool(self, name: str) -> Tool:
        if name not in self.named:
            raise ToolError("unknown_tool", "there is no such tool", tool=name)
        return self.named[name]

    def call(self, corpus: Corpus, name: str, arguments: str | None = None, remember: bool = True) -> tuple[DataFrame, bool]:
        """A call's rows, and whether an earlier call had them. Without ``remember`` the call runs anew and leaves nothing behind.

        Rows are written once, to the shared folder, so that a repeated call reads them.
        """
        tool = self.tool(name)
        signature = tool.signature(arguments)
        if remember and signature in self.results:
            return self.results[signature], True
        rows = tool.run(corpus, tool.parsed(arguments))
        if remember:
            rows = self.results[signature] = rows.checkpoint()
        return rows, False

    def register(self, spark: SparkSession) -> list[str]:
        """Makes the tools that have one table functions of SQL; returns their names."""
        known = {t.name: t.function for t in self.named.values() if t.function is not None} | FUNCTIONS
        for name, function in known.items():
            spark.udtf.register(name, F.udtf(function))
        return list(known)
