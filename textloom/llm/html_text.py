"""HTML extraction by template deduction from equivalence classes of tokens.

The tokens of a page are its structural tags and its paragraphs' texts, each with the path of containers that it stands
in. Over the pages of one host, tokens that occur equally often on every page share an occurrence vector and are one
equivalence class. Classes of several tokens that span enough pages are valid; nested by their paths, they are the host's
template. A text in a class with tags is the template's, so it is boilerplate wherever it stands; a text whose vector
no tag has is a page's own. A slot is the article's if it is marked as such (article, main), or else it is the smallest
container of all text that isn't boilerplate. Pages are then read again: the text of the host's article slot is kept,
without the template's texts and the slots for menus, forms and the like in it. A page with nothing else in the slot
keeps the texts.

What vectors can't tell, comments and adverts that differ from page to page, is told by the names of the template's
containers (SLOT_NAMES); a name that only some pages have, inside their articles, says nothing.

Vectors are never gathered: a class is known by the sum of the hashes of (page, count). Pages alike in html count once,
so copies of a page don't make its text a template. A host's table has the tags of its pages, and of texts those that
enough of its pages repeat. Pages of hosts with too few pages for classes, and pages that don't follow their host's
template, are judged by their own structure.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored, table, text_of

#: Pages that a host needs for a template, and the share of them that a valid class spans.
MIN_PAGES, MIN_SHARE = 3, 0.3
#: The share of the text outside boilerplate that the unmarked article of a page without a template holds.
MAIN_SHARE = 0.9
#: Pages handled at a time.
BATCH_ROWS = 256

RAW = frozenset(["script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"])
CONTAINERS = frozenset(["html", "body", "head", "div", "section", "article", "main", "aside", "nav", "header", "footer", "ul", "ol", "dl", "table", "form", "fieldset", "figure", "blockquote", "menu", "dialog", "details", "select", "button", "center"])
LEAVES = frozenset(["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "tr", "td", "th", "dt", "dd", "pre", "address", "caption", "figcaption", "summary", "legend", "tbody", "thead", "tfoot", "option"])
BOILERPLATE_TAGS = frozenset(["head", "nav", "aside", "footer", "form", "menu", "dialog", "select", "button"])
SLOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay"
    " newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar"
    " comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations pagination pager toolbar search".split()
)
BOILERPLATE_ROLES = frozenset(["navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "dialog", "menu", "menubar"])
MARKED = frozenset(["article", "main"])
#: The first character of tokens that are texts; the text's hash in 16 digits and its path follow.
TEXT = "\x01"

#: Containers deeper than this count as the one at this depth, as in browsers; their texts stay.
MOST_DEEP = 256

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Za-z]+")


class Block:
    """A run of text between structural tags."""

    __slots__ = ("path", "bad", "marked", "parts")

    def __init__(self, path: str, bad: bool, marked: bool):
        self.path, self.bad, self.marked, self.parts = path, bad, marked, []


def boilerplate(tag: str, attributes: str, inside_marked: bool) -> tuple[str, bool]:
    """The element's name with its class words, and whether its tag, role or state makes it boilerplate.

    Attributes count by their whole names: hidden, whatever its value, and aria-hidden="true" hide an element.
    """
    named, bad = [], tag in BOILERPLATE_TAGS or (tag == "header" and not inside_marked)
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).strip().lower()
        if name == "role":
            bad |= value in BOILERPLATE_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            bad = True
        elif name in ("class", "id"):
            named += WORDS.findall(value)
    return ".".join([tag, *dict.fromkeys(named)]), bad and tag not in ("html", "body", "article", "main")


@lru_cache(256)
def parents(path: str) -> list[str]:
    """The paths of the containers of a path, from the outermost to itself."""
    return [path[:i] for i in (m.start() for m in re.finditer(">", path)) if i] + [path] * bool(path)


def named_slot(path: str) -> bool:
    """Whether a container's own class words name it as something else than an article."""
    tag, *words = path.rpartition(">")[2].split(".")
    return tag not in ("html", "body", "article", "main") and not SLOT_NAMES.isdisjoint(words)


def parsed(page: str) -> tuple[list[str], list[Block]]:
    """The structural tokens in page order, and the blocks of text with the path that each stands in.

    Missing end tags are made up at the container's end; end tags that nothing opened are skipped. What begins like a tag
    and isn't ended before the next one is text. The work is linear in the page's length.
    """
    tokens: list[str] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, boilerplate, marked
    opened: dict[str, int] = {}
    path, bad, marked = "", False, False
    block = Block("", False, False)
    blocks = [block]
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last:  # no tag can end any more
            rest = page[at:]
            block.parts.append(rest.partition("<!--")[0])
            break
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                block.parts.append(m[0])
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in CONTAINERS:
            if m[1]:
                if opened.get(tag):
                    ended = ""
                    while ended != tag:
                        ended = stack.pop()[0]
                        opened[ended] -= 1
                    path, bad, marked = stack[-1][1:] if stack else ("", False, False)
            else:
                name, own = boilerplate(tag, m[3], marked)
                path, bad, marked = f"{path}>{name}" if len(stack) < MOST_DEEP else path, bad or own, marked or tag in MARKED
                stack.append((tag, path, bad, marked))
                opened[tag] = opened.get(tag, 0) + 1
                tokens.append(path)
            block = Block(path, bad, marked)
            blocks.append(block)
        elif tag == "br":  # within a paragraph
            if not m[1]:
                tokens.append(f"{path}>{boilerplate(tag, m[3], marked)[0]}")
            block.parts.append(" ")
        elif tag in LEAVES:
            own = False
            if not m[1]:
                name, own = boilerplate(tag, m[3], marked)
                tokens.append(f"{path}>{name}")
            block = Block(path, bad or own, marked)
            blocks.append(block)
    return tokens, blocks


def text_in(block: Block) -> str:
    return " ".join(html.unescape("".join(block.parts)).split())


def text_key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") - (1 << 63)


def main_path(sizes: dict[str, int], marked: list[str], share: float = 1.0) -> str:
    """The path of the article: the topmost marked container with most text, or the deepest that holds that share of it."""
    inside: dict[str, int] = {}
    for q, n in sizes.items():
        for p in parents(q):
            inside[p] = inside.get(p, 0) + n
    if tops := topmost(marked):
        return max(tops, key=lambda p: (inside.get(p, 0), -len(p), p))
    total = sum(sizes.values())
    good = [p for p, n in inside.items() if total and n >= share * total]
    return max(good, key=lambda p: (p.count(">"), inside[p], p), default="")


def topmost(paths: list[str]) -> list[str]:
    """Those of the paths that stand in no other one of them."""
    known = set(paths)
    return [p for p in paths if known.isdisjoint(parents(p)[:-1])]


def is_marked(path: str) -> bool:
    return path.rpartition(">")[2].partition(".")[0] in MARKED


def extracted(page: str, mains: list[str], same: frozenset[int] = frozenset(), others: frozenset[str] = frozenset()) -> str:
    """The article's text: of the host's article paths that the page has, else of the path that the page itself shows.

    same: the keys of the template's texts, which go unless nothing else is there. others: the template's slots that
    their names tell from the article; a page that is judged by itself has those that its own names tell.
    """
    tokens, blocks = parsed(page)
    found = set(tokens)
    mains = [p for p in mains if p in found or p == ""]
    own = not mains
    other = cache(lambda path: any(named_slot(p) if own else p in others for p in parents(path)))
    good = [b for b in blocks if not b.bad and not other(b.path)]
    if own:
        sizes: dict[str, int] = {}
        for b in good:
            if size := len("".join(b.parts).strip()):
                sizes[b.path] = sizes.get(b.path, 0) + size
        mains = [main_path(sizes, [p for p in dict.fromkeys(tokens) if is_marked(p)], MAIN_SHARE)]
    within = cache(lambda path: any(not p or path == p or path.startswith(p + ">") for p in mains))
    kept = [b for b in good if within(b.path)]
    texts = [(b.path, t) for b in kept if (t := text_in(b))]
    return " ".join([t for p, t in texts if text_key(p, t) not in same] or [t for _, t in texts])


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def token_table(pages: DataFrame) -> DataFrame:
    """host, token, vector, count, chars of each token of each page; chars: text outside boilerplate right in it.

    The token '' stands for the page. Texts in boilerplate are no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_ROWS):
                batch, rows = whole.slice(a, BATCH_ROWS), []
                for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    tokens, blocks = parsed(text)
                    counts, chars = {"": 1}, {}
                    for t in tokens:
                        counts[t] = counts.get(t, 0) + 1
                    for b in blocks:
                        if not b.bad and b.parts:
                            size = len("".join(b.parts).strip())
                            chars[b.path] = chars.get(b.path, 0) + size
                            if own := text_in(b):
                                t = f"{TEXT}{text_key(b.path, own) + (1 << 63):016x}{b.path}"
                                counts[t], chars[t] = counts.get(t, 0) + 1, chars.get(t, 0) + size
                    for t, c in counts.items():
                        vector = xxhash.xxh3_64_intdigest(f"{page} {c}") - (1 << 63)
                        rows.append((host, t, vector, c, chars.get(t, 0)))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(x, pa.int64()) for x in cols[2:])], names=["host", "token", "vector", "count", "chars"])

    return pages.select("host", "page", "html").mapInArrow(run, "host string, token string, vector long, count long, chars long")


def templates(pages: DataFrame) -> DataFrame:
    """host, mains, same, others: the paths of the article slots in each host's template, the keys of its texts, and the
    paths of slots with other names; hosts without a template have no row.

    pages: host, page (a number of its own for each html), html.
    """
    vectors = F.sum(F.col("vector").cast("decimal(38,0)"))
    once = token_table(pages).groupBy("host", "token", "vector").agg(F.max("count").alias("count"), F.max("chars").alias("chars"))
    tokens = once.groupBy("host", "token").agg(F.count("*").alias("n_pages"), F.sum("count").alias("n"), vectors.alias("vector"), F.sum("chars").alias("chars"))
    tokens = tokens.where(f"n_pages >= {MIN_PAGES} OR token = ''")
    of_host = F.max(F.when(F.col("token") == "", F.col("n_pages"))).over(Window.partitionBy("host"))
    tokens = tokens.withColumn("most", of_host).where(~F.col("token").startswith(TEXT) | (F.col("n_pages") >= MIN_SHARE * F.col("most"))).drop("most")
    # A class: the tokens of a host with one occurrence vector. Its size tells the template from chance.
    schema = "host string, mains array<string>, same array<long>, others array<string>"

    def deduce(t: pd.DataFrame) -> pd.DataFrame:
        host, whole = t["host"].iloc[0], t[t["token"] == ""]
        n = int(whole["n_pages"].iloc[0]) if len(whole) else 0
        if n < MIN_PAGES:
            return pd.DataFrame({"host": [], "mains": [], "same": [], "others": []}, dtype=object)
        classes = t[(t["token"] != "") & (t["n_pages"] >= max(MIN_PAGES, MIN_SHARE * n))].groupby(["n_pages", "n", "vector"])["token"].agg(list)
        template, texts = set(), set()
        for group in classes:
            tags = [p for p in group if p[0] != TEXT]
            if tags and len(group) > 1:
                template.update(tags)
                texts.update(p for p in group if p[0] == TEXT)
            template.update(p for p in tags if is_marked(p))  # says itself what it is
        nested = {p for p in template if all(q in template for q in parents(p))}
        others = {p for p in nested if named_slot(p)}
        texts = {p for p in texts if p[17:] in nested or not p[17:]}
        sizes: dict[str, int] = {}
        for path, chars in zip(t["token"], t["chars"], strict=True):
            at = path
            if path[:1] == TEXT:  # counted with its container, too
                if path not in texts:
                    continue
                at, chars = path[17:], -chars
            while at and at not in nested:  # text in what isn't of the template belongs to the slot around it
                at = at.rpartition(">")[0]
            if others.isdisjoint(parents(at)):
                sizes[at] = sizes.get(at, 0) + int(chars)
        marked = [p for p in nested if is_marked(p)]
        mains = sorted(topmost(marked)) or [main_path({p: c for p, c in sizes.items() if c}, [])]
        return pd.DataFrame({"host": [host], "mains": [mains], "same": [sorted(int(p[1:17], 16) - (1 << 63) for p in texts)], "others": [sorted(others)]})

    return tokens.groupBy("host").applyInPandas(deduce, schema)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's text; empty for null and empty html.

    Entities are decoded, white space is folded, blocks are joined by a space in page order. A null or odd url counts to
    the host ''. Repeated rows give repeated rows; extra columns are ignored.
    """
    rows = pages.select("page_id", "url", host_of("url").alias("host"), text_of("html").alias("html"))
    known = stored(templates(rows.select("host", F.xxhash64("html").alias("page"), "html")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(a, BATCH_ROWS)
                texts = [extracted(x, m or [], frozenset(s or ()), frozenset(o or ())) for x, m, s, o in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    with_main = rows.join(known, "host", "left").select("page_id", "url", "html", "mains", "same", "others")
    schema = pages.select("page_id", "url", F.lit("").alias("text")).schema
    return with_main.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page, see ``extract_text``."""
    return extract_text(table(spark, sf_dir, "pages"))
