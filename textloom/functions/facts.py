"""Lines of model output as facts: cleaning, distinct facts, ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let, lowered, trimmed

#: Lines that start so are instructions, not text.
INSTRUCTION_PREFIXES = (
    "ignore previous instructions",
    "ignore all previous instructions",
    "disregard previous instructions",
    "follow these instructions",
    "system:",
    "assistant:",
    "user:",
    "tool:",
    "developer:",
)
#: Facts that start so, or hold such a phrase, rank lower.
LEAD_INS = ("в тексте", "в материале", "в документе", "автор считает", "автор отмечает", "автор пишет", "источник показывает", "источник указывает")
REPORTING = ("считает, что", "отмечает, что", "указывает, что")
LEAD_IN_PENALTY, REPORTING_PENALTY = 100, 25
#: Facts kept of a chunk, a bullet or number before a fact, the answer that stands for no fact.
MOST_FACTS = 7
BULLET = r"^(?U)\s*(?:[-*•]|[0-9]+[.)])\s*"
SKIP = "SKIP"


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def instruction_like(line: Column) -> Column:
    return let(lowered(trimmed(line)), lambda low: any_of([low.startswith(p) for p in INSTRUCTION_PREFIXES]))


def fact_line(line: Column) -> Column:
    """A line without its bullet; empty for blank and instruction lines."""
    bare = trimmed(F.regexp_replace(trimmed(line), BULLET, ""))
    return let(bare, lambda x: F.when(instruction_like(x), "").otherwise(x))


def fact_lines(raw: Column, drop_rules: bool = False) -> Column:
    """The fact lines of a text in order; drop_rules: without '---' lines, as for merging."""
    kept = F.array_remove(F.transform(F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n"), fact_line), "")
    return F.array_remove(kept, "---") if drop_rules else kept


def penalty(fact: Column) -> Column:
    def of(low: Column) -> Column:
        lead = F.when(any_of([low.startswith(p) for p in LEAD_INS]), LEAD_IN_PENALTY).otherwise(0)
        return lead + F.when(any_of([F.contains(low, F.lit(p)) for p in REPORTING]), REPORTING_PENALTY).otherwise(0)

    return let(lowered(trimmed(fact)), of)


def distinct_facts(facts: Column) -> Column:
    """Facts whose lower case is new, in order; the first spelling stays. Equal facts meet in a sort."""
    keyed = F.array_sort(F.transform(facts, lambda f, i: F.struct(lowered(f).alias("k"), i.alias("i"), f.alias("f"))))
    first = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, F.greatest(j - 1, F.lit(0)))["k"] != x["k"]))
    ordered = F.array_sort(F.transform(let(keyed, first), lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f"))))
    return F.transform(ordered, lambda x: x["f"])


def best_facts(facts: Column, most: int = MOST_FACTS) -> Column:
    """All distinct facts in order if they are few, else the best ``most``: by penalty, length, text."""

    def best(kept: Column) -> Column:
        ranked = F.array_sort(F.transform(kept, lambda f: F.struct(penalty(f).alias("p"), F.length(f).alias("n"), f.alias("f"))))
        return F.when(F.size(kept) <= most, kept).otherwise(F.transform(F.slice(ranked, 1, most), lambda s: s["f"]))

    return let(distinct_facts(facts), best)


def mapped_facts(raw: Column) -> Column:
    """A chunk's answer as its facts joined by newlines; SKIP and blank answers pass through."""
    bare = trimmed(raw)
    return F.when(bare == "", "").when(F.upper(bare) == SKIP, SKIP).otherwise(F.array_join(best_facts(fact_lines(raw)), "\n"))


def fact_output(raw: Column, most: int = 0) -> Column:
    """A text's first ``most`` fact lines (all, if 0) joined by newlines; SKIP and blank texts pass through."""
    bare, lines = trimmed(raw), fact_lines(raw)
    return F.when(bare == "", "").when(F.upper(bare) == SKIP, SKIP).otherwise(F.array_join(F.slice(lines, 1, most) if most > 0 else lines, "\n"))


def sanitized(raw: Column) -> Column:
    """A block without instruction lines, with runs of blank lines as one and none at the ends; lines are trimmed."""
    lines = F.transform(F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n"), trimmed)
    kept = F.filter(lines, lambda x: ~instruction_like(x))
    single = let(kept, lambda k: F.filter(k, lambda x, i: (x != "") | ((i > 0) & (F.get(k, F.greatest(i - 1, F.lit(0))) != ""))))
    return trimmed(F.array_join(single, "\n"))
