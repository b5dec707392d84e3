"""The queries over the given tables, each with the SQL that a DuckDB engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import calls as cx
from textloom.functions import facts as fx
from textloom.functions import media
from textloom.functions import text as tx
from textloom.operators import chunking, evidence, lines, retrieval, search, semantic, tools
from textloom.plans import answers
from textloom.sources import corpus, index

#: What the registered searches look for.
LITERAL, PATTERN, OVERLAP, FALLBACK = "the of", r"\bth[a-z]*tion\b", "from what is that", "zzqx from the missing"
CONTEXT, AROUND, FIRST, LAST = 2, 3, 2, 4
ONE_PATH = r"(?P<start>\p{L}+)"
#: Tokens of a model's context, and of a request without its chunk.
TOKENS_MOST, TOKENS_REQUEST = 1000, 80
#: Every row whose id this divides is a query, against all rows.
QUERIES_OF = 50


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_with_offsets(docs(spark, sf_dir), "doc_id")


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal_matches(docs(spark, sf_dir), LITERAL, "doc_id")


def search_literal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(docs(spark, sf_dir), LITERAL, "literal", limit=10, offset=5, path="doc_id")


def search_overlap_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of an auto search that falls back to overlap, with a line of context on both sides."""
    found = search.search(docs(spark, sf_dir), FALLBACK, limit=10, offset=10, path="doc_id", context=1)
    return found.select("doc_id", "line_no", "content", "score", "reason", "total_matches", "has_more", "next_offset", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


def search_one_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in one document: that of the smallest id."""
    own = docs(spark, sf_dir)
    first = own.agg(F.min("doc_id")).first()[0]
    return search.search(own, ONE_PATH, "regex", limit=20, only=str(first), path="doc_id")


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of a page beyond the last match."""
    return lines.page_totals(search.literal_matches(docs(spark, sf_dir), LITERAL, "doc_id"), 10, 10**9)


def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex_matches(docs(spark, sf_dir), PATTERN, "doc_id")


def search_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.overlap_matches(docs(spark, sf_dir), OVERLAP, "doc_id")


def search_auto_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.auto_matches(docs(spark, sf_dir), LITERAL, "doc_id")


def search_auto_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.auto_matches(docs(spark, sf_dir), FALLBACK, "doc_id")


def search_context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.with_context(docs(spark, sf_dir), lambda x: F.contains(tx.lowered(x), F.lit(LITERAL)), CONTEXT, "doc_id")
    return found.select("doc_id", "line_no", "content", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.read_lines(docs(spark, sf_dir), FIRST, LAST, "doc_id")


def read_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.read_around(docs(spark, sf_dir), AROUND, -1, 1, "doc_id")


def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.list_files(docs(spark, sf_dir), 0, 20, "doc_id")


def tokenize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.approx_tokens(F.col("text")).cast("long").alias("tokens"), F.octet_length("text").cast("long").alias("bytes"))


def seed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.seed_queries(F.col("text"))).alias("query_ord", "query"))


def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of the benchmark items whose id 50 divides with every document; the items go to every task, block by block."""
    asked = table(spark, sf_dir, "benchmark").where(F.col("item_id") % QUERIES_OF == 0).select("item_id", tx.tokens(F.col("text")).alias("wanted"))
    out = None
    for block in retrieval.blocks(asked, "item_id"):
        scored = docs(spark, sf_dir).join(F.broadcast(block)).select("item_id", "doc_id", tx.overlap_ratio(F.col("wanted"), F.col("text")).alias("overlap"))
        out = scored if out is None else out.unionByName(scored)
    return out.where("overlap > 0")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: a document with the vector of its id; its source is the path."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    d = docs(spark, sf_dir).withColumnRenamed("source", "path")
    start = (F.col("vec_id") % 3 + 1).cast("long")
    return e.join(d, e.vec_id == d.doc_id).select("path", F.col("vec_id").alias("chunk_id"), start.alias("start_line"), (start + 5).alias("end_line"), "text", "vector")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id 50 divides as queries, five to a prompt; a query's question is a benchmark item's text."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % QUERIES_OF == 0)
    n, items = (F.col("vec_id") / QUERIES_OF).cast("long"), max(1, table(spark, sf_dir, "benchmark").count())
    asked = e.select(F.col("vec_id").alias("query_id"), F.floor(n / 5).alias("prompt_id"), (n % 5).alias("query_ord"), F.col("embedding").alias("query_vector"), (n % items).alias("item_id"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return asked.join(b, "item_id").drop("item_id")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").select(F.lit("").alias("path"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % QUERIES_OF == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.nearest(asked, chunks).select("query_id", "chunk_id", "similarity", F.col("rank").cast("long").alias("rank"))


def hits(spark: SparkSession, sf_dir: str, mode: str = "heuristic") -> DataFrame:
    """Each query's top-k: ranked on vectors alone, then joined with the texts of the few that are left, then reranked."""
    chunks, asked = vectors(spark, sf_dir), questions(spark, sf_dir)
    best = retrieval.nearest(asked, chunks).join(asked.drop("query_vector"), "query_id")
    return retrieval.reranked(best.join(chunks.drop("vector"), ["path", "chunk_id"]), mode=mode)


def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "path", "chunk_id", "similarity", "overlap", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def shown(found: DataFrame) -> DataFrame:
    """Pages as rows: a request's envelope with each of its matches, or with none."""
    some = lambda c, none: F.coalesce(c, F.lit(none))
    rows = found.select("*", F.posexplode_outer("matches").alias("place", "m"))
    return rows.select(
        "query_id", some(F.col("path"), "").alias("path"), "limit", "offset", "match_count", "total_matches", "has_more", some(F.col("next_offset"), 0).alias("next_offset"), some(F.col("place"), -1).cast("long").alias("place"),
        some(F.col("m.chunk_id"), -1).alias("chunk_id"), some(F.col("m.path"), "").alias("chunk_path"), some(F.col("m.similarity"), 0.0).alias("similarity"), some(F.col("m.overlap"), 0.0).alias("overlap"), some(F.round("m.score", 9), 0.0).alias("score"),
    )


def semantic_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question as a request: every other one in the path of its own vector's document, with limits and offsets of all kinds."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("source").alias("own"))
    asked = questions(spark, sf_dir).join(d, "query_id", "left")
    n = (F.col("query_id") / QUERIES_OF).cast("long")
    offset = F.when(n % 5 == 4, 50).otherwise((n % 3) * 2 - 1)
    requests = asked.select("query_id", "question", "query_vector", F.when(n % 2 == 1, F.col("own")).alias("path"), (n % 4).alias("limit"), offset.alias("offset"))
    return shown(semantic.pages(requests, vectors(spark, sf_dir)))


def semantic_search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question in the first path, over an index laid out by path in the shared folder."""
    chunks = vectors(spark, sf_dir)
    parts = chunks.select(F.concat_ws(":", "path", F.col("chunk_id").cast("string")).alias("path"), F.concat_ws("\n", "text", F.array_join(F.col("vector").cast("array<string>"), ",")).alias("text"))
    found = index.build_or_load(spark, f"{index.shared_folder(spark)}/indexes", corpus.content_hash(parts), lambda: chunks, "given", 0, 0)
    first = found.agg(F.min("path").alias("path"))
    requests = questions(spark, sf_dir).join(F.broadcast(first)).select("query_id", "question", "query_vector", "path", F.lit(6).alias("limit"), F.lit(1).alias("offset"))
    return shown(semantic.pages(requests, found, buckets=index.BUCKETS))


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused(hits(spark, sf_dir))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf(spark, sf_dir).select("prompt_id", "path", "chunk_id", F.round("score", 12).alias("score"), "similarity", "overlap", "start_line", "end_line", F.col("rank").cast("long").alias("rank"))


def weak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of all questions, and one that found nothing."""
    prompts = questions(spark, sf_dir).select("prompt_id")
    return retrieval.weak(rrf(spark, sf_dir), prompts.union(prompts.agg(F.lit(-1).cast(prompts.schema["prompt_id"].dataType))))


def select_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.selected(rrf(spark, sf_dir), retrieval.spread).select("prompt_id", "path", "chunk_id", "pick")


def verification_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = retrieval.selected(rrf(spark, sf_dir), retrieval.apart, retrieval.VERIFIED_READS)
    return retrieval.planned_reads(picked).select("prompt_id", "path", "chunk_id", "pick", "tool", "read_start", "read_end")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from searches: lines around literal matches are retrieved, matches of the pattern and their next line verified."""
    found = search.literal_matches(docs(spark, sf_dir), LITERAL, "doc_id")
    path = F.col("doc_id").cast("string").alias("path")
    retrieved = found.select(F.lit("retrieved").alias("kind"), path, (F.col("line_no") - 2).alias("start_line"), (F.col("line_no") + 2).alias("end_line"))
    seen = search.regex_matches(docs(spark, sf_dir), PATTERN, "doc_id").select(F.lit("verified").alias("kind"), path, F.col("line_no").alias("start_line"), (F.col("line_no") + 1).alias("end_line"))
    return evidence.clamped(retrieved.unionByName(seen))


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merged(ranges(spark, sf_dir))


def subtract_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = evidence.merged(ranges(spark, sf_dir))
    return evidence.subtracted(all_.where("kind = 'retrieved'"), all_.where("kind = 'verified'"))


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.cited(ranges(spark, sf_dir))


def instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as lines, without those that look like instructions."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.select("conv_id", "turn", F.posexplode(lines.line_array(F.concat(F.col("role"), F.lit(": "), F.col("text"), F.lit("\n"), F.col("text")))).alias("line_no", "line"))
    return said.where(~fx.instruction_like(F.col("line"))).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), "line")


def fact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as facts: the distinct ones, the best seven where there are more."""
    facts = fx.best_facts(fx.fact_lines(F.col("text")))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(facts).alias("pos", "fact"))


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question of a conversation with the questions before it, in order."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", tx.trimmed(F.col("text")).alias("question"))
    return retrieval.with_history(asked, "conv_id", "turn").select("conv_id", "turn", "question", F.array_join("history", "\n- ").alias("history"))


def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(docs(spark, sf_dir), path="doc_id").select("doc_id", "chunk_id", "start_line", "end_line", "byte_offset", F.sha2("text", 256).alias("text_sha256"))


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_by_tokens(docs(spark, sf_dir), TOKENS_MOST, TOKENS_REQUEST, path="doc_id").select("doc_id", "chunk_id", "token_count", "byte_count", "request_tokens", F.sha2("text", 256).alias("text_sha256"))


def tool_search_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search tool called from SQL."""
    tools.Registry().register(spark)
    found = spark.sql(f"SELECT * FROM search_file(TABLE({{d}}), '{LITERAL}', 'literal', {CONTEXT})", d=docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "line_no", "content", "score", "reason", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


def tool_ranges_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of lines around matches, from SQL over lines that are dealt by document and read in order."""
    tools.Registry().register(spark)
    return spark.sql(f"SELECT * FROM match_ranges(TABLE({{d}}), '{LITERAL}', 'literal', {CONTEXT})", d=lines.lines(docs(spark, sf_dir), "doc_id"))


def session_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn of a conversation shows first, were its text's length the lines of a file that it reads."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    start = F.col("n") % 40 + 1
    spans = F.array(F.struct(F.col("role").alias("path"), start.alias("start"), (start + F.col("n") % 23 - 1).alias("end")), F.struct(F.lit("all").alias("path"), (F.col("turn") * 5).alias("start"), (F.col("turn") * 5 + 9).alias("end")))
    shown = turns.select(F.col("conv_id").alias("session"), "turn", F.when(F.col("turn") % 2 == 0, "files").otherwise("rag").alias("namespace"), (F.col("turn") % 5 == 3).alias("synthetic"), F.inline(spans))
    return evidence.novel_counts(shown)


def tool_calls_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text with a call written behind it, and some with a broken one: what is called, and the text without."""
    head = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 30)
    name = F.element_at(F.array(*map(F.lit, ("search_file", "read_around", "list_files"))), (F.col("turn") % 3 + 1).cast("int"))
    call = F.concat(F.lit("\n<tool_call> <function="), name, F.lit("> <parameter=Query>\n"), head, F.lit("\n<parameter=line> "), (F.col("turn") + 1).cast("string"), F.lit(" <parameter=deep>TRUE</tool_call>"))
    broken = F.when(F.col("turn") % 5 == 4, " <Tool_Call> <parameter=x> 1 </tool_call>").otherwise("")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", cx.calls_in(F.concat("text", call, broken, F.lit(" tail")), F.col("turn")).alias("c"))
    return turns.select("conv_id", "turn", "c.text", "c.detected", "c.error", F.explode_outer("c.calls").alias("call")).select("conv_id", "turn", "text", "detected", "error", F.col("call.id").alias("call_id"), "call.name", "call.arguments")


def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.content_hash(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text"), "texts", 1)
    return spark.createDataFrame([(found,)], "content_hash string")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a part of a corpus text, as an embedder's input, without instructions, as facts, and what kind of
    content its bytes are behind the first bytes of some formats."""
    heads = F.array(*[F.lit(h) for h in (b"", b"\xef\xbb\xbf", b"GIF89a", b"RIFF\x01\x02\x03\x04WAVE", b"\x00", b"<!-- ", b" <?xml ")])
    content = F.concat(F.element_at(heads, (F.col("doc_id") % 7 + 1).cast("int")), F.col("text").cast("binary"))
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return docs(spark, sf_dir).select(
        "doc_id", sha(corpus.entry(F.col("doc_id").cast("string"), F.col("text")), "part_sha256"), sha(tx.folded(F.col("text")), "input_sha256"), sha(fx.sanitized(F.col("text")), "sanitized_sha256"),
        sha(fx.fact_output(F.col("text"), 3), "first_facts_sha256"), sha(F.array_join(fx.fact_lines(F.col("text"), True), "\n"), "merged_facts_sha256"), media.media_type(content).alias("kind"),
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the name of its source, repeated names told apart in the ids' order."""
    named = docs(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("none")).alias("path"))
    return corpus.disambiguated(named, "doc_id").select("doc_id", "path")


def rerank_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's hits in the order of their similarity alone."""
    return hits(spark, sf_dir, "off").select("query_id", "path", "chunk_id", "similarity", "overlap", "score", F.col("rank").cast("long").alias("rank"))


def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each prompt as a text: its hits' lines as retrieved evidence, what would be read of its first hit as
    verified, matches of the pattern in that hit's document as verified, and the document as a whole file."""
    found = rrf(spark, sf_dir).checkpoint()
    picked = retrieval.planned_reads(found.where("rank = 0"))
    top = found.where("rank = 0").select("prompt_id", F.col("chunk_id").alias("doc_id"))
    texts = docs(spark, sf_dir).join(F.broadcast(top), "doc_id")
    lines_of = search.regex_matches(texts.withColumn("of", F.struct("prompt_id", "doc_id")), PATTERN, "of").select("of.*", "line_no")
    whole = evidence.whole_files(texts.withColumn("of", F.concat_ws(":", "prompt_id", "doc_id")), "of")
    whole = whole.select(F.split("path", ":")[0].cast("long").alias("prompt_id"), "kind", F.split("path", ":")[1].alias("path"), "start_line", "end_line")
    by = ("prompt_id",)
    all_ = evidence.from_hits(found, by).unionByName(evidence.from_reads(picked, by)).unionByName(evidence.from_matches(lines_of, "doc_id", by)).unionByName(whole)
    return evidence.source_list(evidence.cited(all_, by), "prompt_id")


def novel_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the pattern matches and the literal search had not shown."""
    own = docs(spark, sf_dir)
    return evidence.novel(search.regex_matches(own, PATTERN, "doc_id").select("doc_id", "line_no"), search.literal_matches(own, LITERAL, "doc_id"), ["doc_id", "line_no"])


def scripted(text: str) -> answers.Reply:
    """A model's part in the map queries: a text's first line twice, as a list, and its tokens; short texts are skipped."""
    if len(text) < 200:
        return answers.Reply("SKIP", len(text), 1)
    first = text.split("\n")[0]
    return answers.Reply(f"- {first}\n* {first}\n---\n", len(text), 2)


def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_by_tokens(docs(spark, sf_dir), TOKENS_MOST, TOKENS_REQUEST, path="doc_id").withColumnRenamed("doc_id", "path")
    return answers.map_facts(chunks, scripted)


def scripted_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scripted model says to every chunk, as facts, with what the call took."""
    return chunk_facts(spark, sf_dir).select(F.col("path").alias("doc_id"), "chunk_id", F.sha2("facts", 256).alias("facts_sha256"), "failed", "calls", "raw_lines", "prompt_tokens", "completion_tokens")


def scripted_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the same calls, observed while they are made."""
    facts, seen = answers.observed(chunk_facts(spark, sf_dir))
    facts.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get.values())], ", ".join(f"{k} long" for k in seen.get))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lines_with_offsets, search_literal, search_literal_page, search_overlap_page, search_one_path, search_totals, search_regex, search_token_overlap, search_auto_hit, search_auto_fallback, search_context_lines,
        read_lines, read_around, list_documents_page, tokenize_distinct, approx_tokens, seed_queries, overlap_ratio, cosine_topk, heuristic_rerank, semantic_search_pages, semantic_search_path, rrf_fusion, weak_gate,
        select_evidence, verification_reads, merge_ranges, subtract_ranges, evidence_sources, instruction_lines, fact_ranking, conversation_context, chunk_bytes, chunk_tokens, tool_search_sql, tool_ranges_sql, session_novelty, tool_calls_in_text, corpus_hash, text_forms, file_names, rerank_off, evidence_kinds, novel_matches, scripted_map, scripted_counters,
    )
}
