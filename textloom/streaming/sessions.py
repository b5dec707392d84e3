"""What each call of a session shows for the first time: a stream of shown lines with an interval set for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps a map for each session.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "session string, turn long, novel_lines long, already_seen boolean"


def added(spans: list[tuple[int, int]], start: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """How many lines of start to end no span has, and the spans with them. Spans are disjoint and in order; those that
    meet are one."""
    fresh, low, high, rest = end - start + 1, start, end, []
    for a, b in spans:
        fresh -= max(0, min(b, end) - max(a, start) + 1)
        if b < start - 1 or a > end + 1:
            rest.append((a, b))
        else:
            low, high = min(low, a), max(high, b)
    return fresh, sorted([*rest, (low, high)])


class Novelty(StatefulProcessor):
    """A session's state: for each namespace and path the spans of lines that it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "namespace string, path string", "starts array<long>, ends array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shown = pd.concat(list(rows)).sort_values(["turn", "namespace", "path", "start", "end"])
        known: dict[tuple[str, str], list[tuple[int, int]]] = {}
        out = []
        for turn, own in shown.groupby("turn", sort=True):
            novel, synthetic = 0, bool(own["synthetic"].any())
            after: dict[tuple[str, str], list[tuple[int, int]]] = {}
            for r in own.itertuples():
                at = (r.namespace, r.path)
                if at not in known:
                    found = self.seen.getValue(at) if self.seen.containsKey(at) else None
                    known[at] = list(zip(*found, strict=True)) if found else []
                if r.start <= r.end:
                    fresh, after[at] = added(after.get(at, known[at]), int(r.start), int(r.end))
                    novel += fresh
            if not synthetic:
                known |= after
                for at, spans in after.items():
                    self.seen.updateValue(at, tuple(map(list, zip(*spans, strict=True))))
            out.append((str(key[0]), int(turn), novel, novel == 0))
        yield pd.DataFrame(out, columns=["session", "turn", "novel_lines", "already_seen"])

    def close(self) -> None:
        pass


def keeps_maps(spark: SparkSession) -> None:
    """Sets the session's state store to one that novelty can use; it must be set before a stream begins."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def novel_counts(shown: DataFrame) -> DataFrame:
    """For each call of each session (turn) the lines it shows that no earlier call of the session had shown.

    shown: a stream of ranges (session, turn, namespace, path, start, end, synthetic), all of a call in one batch and the
    calls of a session in order; a file as such is line 0. Namespaces don't know of each other. Synthetic calls, those
    that a session makes for itself, are counted but mark nothing as seen. A call that shows nothing new is already_seen.
    """
    keyed = shown.selectExpr("cast(session as string) session", "cast(turn as bigint) turn", "namespace", "path", "cast(start as bigint) start", "cast(end as bigint) end", "synthetic")
    return keyed.groupBy("session").transformWithStateInPandas(Novelty(), COUNTED, "append", "none")
