"""The retrieval-and-answer patterns, each one plan over all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.providers import LLM, Embedder, MockEmbedder, MockLLM, MockReranker, Prefix, Reranker
from lodesift.functions.text import fill, parse_action, parse_filter, parse_next_query, parse_subqueries, parse_typed_filter, python_repr, strip
from lodesift.operators import ranking
from lodesift.operators.dense import VectorIndex, dense_search
from lodesift.operators.lexical import Bm25Index, query_blocks
from lodesift.runtime import cut
from lodesift.schema import TRACE_STEP

POOL, SUBQUERY_K, HOP_K, MAX_HOPS, TOOL_K, MAX_STEPS = 20, 10, 5, 2, 5, 4
MOST_CONTEXT_CHARS = 4_000_000
PROMPTS = {
    "generate": "Answer the question from the context alone and cite sources as [chunk_id]. If the context does not hold the "
    "answer, say that you do not have enough information.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:\n",
    "hyde": "Write a short passage of a research paper that would answer this question.\n\nQuestion: {question}\n\nPassage:",
    "multi_query": "Rewrite the question as up to three search queries.\n\nQuestion: {question}\n\n"
    'Reply with JSON only: {{"queries": ["..."]}}',
    "self_query": "Which of the fields category and year does the question name? Reply with a JSON object of those only.\n\nQuestion: {question}",
    "multi_hop": "Decide whether one more search is needed.\n\nQuestion: {question}\n\nContext so far:\n{context}\n\n"
    'Reply with JSON only: {{"next_query": "..." or null}}',
    "agentic": "Search for context with the tools search_dense(query), search_bm25(query) and finish().\n\nQuestion: {question}\n\n"
    'So far:\n{transcript}\n\nReply with JSON only: {{"thought": "...", "action": "...", "action_input": "..."}}',
    "prefix": "Write one or two sentences that place a chunk within its paper.\n\nPaper:\n{document}",
    "chunk": "Chunk:\n{text}\n\nSentences:",
}
_COUNTS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens", "latency_ms")


@dataclass
class Collection:
    """Chunks with their indexes and providers. ``chunks`` has chunk_id, ord, text and metadata columns."""

    chunks: DataFrame
    llm: LLM = field(default_factory=MockLLM)
    embedder: Embedder = field(default_factory=MockEmbedder)
    reranker: Reranker = field(default_factory=MockReranker)
    prompts: dict[str, str] = field(default_factory=lambda: dict(PROMPTS))

    @cached_property
    def bm25(self) -> Bm25Index:
        return Bm25Index().build(self.chunks)

    @cached_property
    def vectors(self) -> VectorIndex:
        return VectorIndex.of_texts(self.chunks, "text", self.embedder)

    def lexical(self, queries: DataFrame, k: int) -> DataFrame:
        return self.bm25.search(queries, k)

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        return dense_search(self.vectors, queries, k, self.embedder)

    def ask(self, df: DataFrame, prompt: str, **values: Column) -> DataFrame:
        return self.llm.ask(df.withColumn("__p", fill(self.prompts[prompt], **values)), "__p", "r").drop("__p")


def _costs(df: DataFrame, response: str = "r") -> DataFrame:
    return df.select("qid", *(F.col(f"{response}.{c}").alias(c) for c in _COUNTS), F.col(f"{response}.error").alias("error"))


def answer(
    col: Collection, questions: DataFrame, ranked: DataFrame | None, spent: DataFrame | None = None, filters: DataFrame | None = None, traces: DataFrame | None = None
) -> DataFrame:
    """Context, final call and the answer row of every question; ``spent`` are the costs of earlier calls.

    A question one of whose calls failed has the error and neither an answer nor ids.
    """
    if ranked is None:
        rows = questions.select("qid", "question", F.lit("").alias("context"), F.array().cast("array<string>").alias("ids"))
    else:
        rows = ranking.contexts(ranked, col.chunks, questions)
    # read twice: written, so that contexts are built and models called once
    rows = cut(col.ask(rows, "generate", context=F.col("context"), question=F.col("question")).select("qid", "question", "ids", "r"))
    costs = _costs(rows)
    if spent is not None:
        costs = costs.unionByName(spent)
    total = costs.groupBy("qid").agg(*(F.sum(c).alias(c) for c in _COUNTS), F.max("error").alias("error"))
    out = rows.select("qid", "question", F.col("r.text").alias("answer"), F.col("ids").alias("retrieved_chunk_ids")).join(total, "qid")
    out = out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("answer", "retrieved_chunk_ids")})
    empty_filter = F.lit(None).cast("map<string,string>")
    out = out.join(filters, "qid", "left") if filters is not None else out.withColumn("extracted_filter", empty_filter)
    if traces is not None:
        return out.join(traces, "qid", "left")
    return out.withColumn("tool_call_trace", F.array().cast(f"array<{TRACE_STEP}>"))


def no_rag(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    return answer(col, questions, None)


def long_context(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    """Every chunk, in order, is the context. Raises where that exceeds ``MOST_CONTEXT_CHARS``: no model takes it."""
    size = col.chunks.agg(F.sum(F.length("text") + F.length("chunk_id") + 5)).first()[0] or 0
    if size > MOST_CONTEXT_CHARS:
        raise ValueError(f"a context of {size} characters exceeds {MOST_CONTEXT_CHARS}")
    rows = [(r["chunk_id"], r["text"] or "") for r in col.chunks.select("ord", "chunk_id", "text").orderBy("ord").collect()]
    context = "\n\n".join(f"[{c}] {t}" for c, t in rows)
    asked = questions.select("qid", "question")
    asked = col.ask(asked, "generate", context=F.lit(context), question=F.col("question"))
    return _context_answers(asked, [c for c, _ in rows[:k]])


def long_context_by_size(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    """:func:`long_context` whatever the size, for models that need only the size of the shared context.

    The prompt up to the end of the context is the cacheable prefix of all questions; its text is put
    together only for providers that send it, which have their own limit. Chunks without text count as empty.
    """
    head, tail = col.prompts["generate"].split("{context}")
    fixed = len(head.replace("{{", "{").replace("}}", "}"))
    line = F.concat(F.lit("["), "chunk_id", F.lit("] "), F.coalesce("text", F.lit("")))
    size = col.chunks.agg((F.coalesce(F.sum(F.length(line) + 2) - 2, F.lit(0)) + fixed).alias("chars"))
    asked = questions.select("qid", "question", F.lit(0).alias("__all"))
    sizes = size.crossJoin(asked.agg(F.min("qid").alias("first"))).select(F.lit(0).alias("key"), "chars", "first")

    def texts() -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
        whole = F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n")
        return col.chunks.agg(whole.alias("d")).select(F.lit(0).alias("key"), fill(head + "{context}", context=F.col("d")).alias("text"))

    asked = asked.withColumn("__p", fill(tail, question=F.col("question")))
    asked = col.llm.ask(asked, "__p", "r", Prefix("__all", "qid", sizes, texts)).drop("__p", "__all")
    return _context_answers(asked, [r["chunk_id"] for r in col.chunks.select("ord", "chunk_id").orderBy("ord").limit(k).collect()])


def _context_answers(asked: DataFrame, first: list[str]) -> DataFrame:
    ids = F.array(*(F.lit(c) for c in first)).cast("array<string>")
    return asked.select(
        "qid",
        "question",
        F.col("r.text").alias("answer"),
        ids.alias("retrieved_chunk_ids"),
        *(F.col(f"r.{c}").alias(c) for c in _COUNTS),
        F.col("r.error").alias("error"),
        F.lit(None).cast("map<string,string>").alias("extracted_filter"),
        F.array().cast(f"array<{TRACE_STEP}>").alias("tool_call_trace"),
    )


def naive_dense(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    return answer(col, questions, col.dense(questions, k))


def bm25(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    return answer(col, questions, col.lexical(questions, k))


def _fused(col: Collection, questions: DataFrame, k: int) -> list[tuple[DataFrame, DataFrame]]:
    """Both pools fused, (q, ord, score, rank), and the questions (q, qid, question), for each block of them.

    Names and texts stay behind until only the best are left. Written once, since callers may read it more than once.
    """
    out = []
    embedded = col.embedder.embed(questions.select("qid", "question"), "question", "vec")
    for block in query_blocks(embedded.select("qid", F.struct("question", F.col("vec").cast("array<double>").alias("vec")).alias("a")), "a"):
        lexical, kinds = col.bm25.found([(qid, a["question"]) for qid, a in block], POOL)
        dense = col.vectors.found([(qid, a["vec"]) for qid, a in block], POOL)
        columns = (list(range(len(block))), pa.int32()), ([p[1] for p in kinds], pa.int32()), ([b[0] for b in block], pa.string()), ([b[1]["question"] for b in block], pa.string())
        asked = col.chunks.sparkSession.createDataFrame(pa.table({name: pa.array(c, kind) for name, (c, kind) in zip(("q", "kind", "qid", "question"), columns)}))
        lexical = lexical.withColumnRenamed("q", "kind").join(F.broadcast(asked.select("q", "kind")), "kind")
        lists = [one.select("q", "ord", "rank", F.lit(src).alias("src")) for src, one in enumerate((dense, lexical))]
        out.append((cut(ranking.rrf_numbered(lists[0].unionByName(lists[1]), k)), asked.select("q", "qid", "question")))
    return out


def hybrid_ranked(col: Collection, questions: DataFrame, k: int, lexical: DataFrame | None = None) -> DataFrame:
    """Both pools fused; ``lexical`` is the lexical pool where it is known already."""
    parts = _fused(col, questions, k) if lexical is None else []
    if not parts:
        return ranking.rrf(ranking.stack(col.dense(questions, POOL), col.lexical(questions, POOL) if lexical is None else lexical), k)
    named = (f.join(col.chunks.select("ord", "chunk_id"), "ord").join(F.broadcast(asked), "q").select("qid", "chunk_id", "ord", "score", "rank") for f, asked in parts)
    return reduce(DataFrame.unionByName, named)


def hybrid(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    return answer(col, questions, hybrid_ranked(col, questions, k))


def rerank_ranked(col: Collection, questions: DataFrame, k: int) -> DataFrame:
    return ranking.rerank(col.lexical(questions, POOL), questions, col.chunks, k, col.reranker)


def rerank(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    return answer(col, questions, rerank_ranked(col, questions, k))


def hybrid_rerank(col: Collection, questions: DataFrame, k: int = 10, lexical: DataFrame | None = None) -> DataFrame:
    """The retriever of the studies: both rankers' pools, fused, reranked; no model call."""
    parts = _fused(col, questions, POOL) if lexical is None else []
    if not parts:
        return ranking.rerank(hybrid_ranked(col, questions, POOL, lexical), questions, col.chunks, k, col.reranker)
    return reduce(DataFrame.unionByName, (ranking.rerank_numbered(f, asked, col.chunks, k, col.reranker) for f, asked in parts))


def hyde(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    passages = cut(col.ask(questions.select("qid", "question"), "hyde", question=F.col("question")))
    ranked = col.dense(passages.select("qid", F.col("r.text").alias("question")), k)
    return answer(col, questions, ranked, _costs(passages))


_PART = "\u0001"


def searched(search: Callable[[DataFrame, int], DataFrame], subs: DataFrame, k: int) -> DataFrame:
    """Stacked lists (qid, chunk_id, ord, rank, src) of several queries a question (qid, sub, question) in one search; src is sub."""
    found = search(subs.select(F.concat_ws(_PART, "qid", "sub").alias("qid"), "question"), k)
    parts = F.split("qid", _PART)
    return found.select(F.get(parts, F.lit(0)).alias("qid"), "chunk_id", "ord", "rank", F.get(parts, F.lit(1)).cast("int").alias("src"))


def multi_query(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    asked = cut(col.ask(questions.select("qid", "question"), "multi_query", question=F.col("question")))
    subs = asked.select("qid", F.posexplode(parse_subqueries(F.col("r.text"), F.col("question"))).alias("sub", "question"))
    return answer(col, questions, ranking.best_rank(searched(col.dense, subs, SUBQUERY_K), k), _costs(asked))


def contextual_chunks(col: Collection) -> DataFrame:
    """Chunks with ``embed_text`` = blurb, blank line, text, and the costs of writing the blurbs.

    The paper's text is the cacheable prefix: its first chunk (by ord) writes the cache, the others read
    it. Only the prefix's size goes along with the chunks; its text is put together (one row a paper) only
    for providers that send it. Rows without a paper are papers of their own.
    """
    paper = F.coalesce("paper_id", F.col("chunk_id"))
    base = col.chunks.select("chunk_id", "ord", F.coalesce("text", F.lit("")).alias("text"), paper.alias("paper"))
    head = col.prompts["prefix"]
    fixed = len(head.replace("{{", "{").replace("}}", "}")) - len("{document}")
    sizes = base.groupBy(F.col("paper").alias("key")).agg(
        (F.sum(F.length("text")) + 2 * (F.count("*") - 1) + fixed).alias("chars"), F.min("ord").alias("first")
    )

    def texts() -> DataFrame:
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
        return base.groupBy(F.col("paper").alias("key")).agg(whole.alias("d")).select("key", fill(head, document=F.col("d")).alias("text"))

    asked = base.withColumn("__p", fill(col.prompts["chunk"], text=F.col("text")))
    asked = col.llm.ask(asked, "__p", "r", Prefix("paper", "ord", sizes, texts)).drop("__p")
    return asked.withColumn("embed_text", F.concat(strip(F.col("r.text")), F.lit("\n\n"), F.col("text")))


def contextual(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    """Dense search over blurb and text; the answer sees the original text only."""
    index = VectorIndex.of_texts(cut(contextual_chunks(col).select("chunk_id", "ord", "embed_text")), "embed_text", col.embedder)
    return answer(col, questions, dense_search(index, questions, k, col.embedder))


def self_query(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    """Dense search among the chunks that match the filter the model reads from the question.

    Filters are typed, stand below the ranking, and share one pass over the chunks. The answer has the filter as
    a map of text (``extracted_filter``) and as a map of JSON literals (``extracted_typed``).
    """
    asked = cut(col.ask(questions.select("qid", "question"), "self_query", question=F.col("question")))
    wanted = asked.select("qid", "question", parse_filter(F.col("r.text")).alias("extracted_filter"), parse_typed_filter(F.col("r.text")).alias("extracted_typed"))
    embedded = col.embedder.embed(wanted.select("qid", "question", F.col("extracted_typed").alias("wanted")), "question", "vec")
    ranked = col.vectors.search_where(embedded, k)
    return answer(col, questions, ranked, _costs(asked), wanted.select("qid", "extracted_filter", "extracted_typed"))


def multi_hop(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    """Up to two searches; after the first the model may name the next query. Chunks in order of first sight."""
    now = questions.select("qid", "question", F.col("question").alias("query"))
    lists, spent = None, None
    for hop in range(MAX_HOPS):
        found = col.dense(now.select("qid", F.col("query").alias("question")), HOP_K)
        part = found.select("qid", "chunk_id", "ord", "rank", F.lit(hop).alias("src"))
        lists = cut(part if lists is None else lists.unionByName(part))
        if hop == MAX_HOPS - 1:
            break
        seen = ranking.first_seen(lists, HOP_K * MAX_HOPS)
        rows = ranking.contexts(seen, col.chunks, now.select("qid", "question"))
        asked = cut(col.ask(rows, "multi_hop", question=F.col("question"), context=F.col("context")).withColumn("next", parse_next_query(F.col("r.text"))))
        spent = _costs(asked) if spent is None else spent.unionByName(_costs(asked))
        now = asked.where("next is not null").select("qid", "question", F.col("next").alias("query"))
    return answer(col, questions, ranking.first_seen(lists, k), spent)


def agentic(col: Collection, questions: DataFrame, k: int = 10) -> DataFrame:
    """Up to four steps in which the model searches with either tool or finishes; observations name ids only."""
    empty = F.array().cast(f"array<{TRACE_STEP}>")
    state = cut(questions.select("qid", "question", empty.alias("trace"), F.lit(True).alias("active")))
    spent, lists = None, None
    for step in range(MAX_STEPS):
        live = state.where("active")
        lines = F.transform(
            "trace",
            lambda s: F.concat(
                F.lit("Thought: "), s["thought"], F.lit("\nAction: "), s["action"], F.lit("("), python_repr(s["action_input"]), F.lit(")"),
                F.coalesce(F.concat(F.lit("\nObservation: "), s["observation"]), F.lit("")),
            ),
        )
        told = F.when(F.size("trace") == 0, F.lit("(none yet)")).otherwise(F.array_join(lines, "\n"))
        asked = cut(col.ask(live, "agentic", question=F.col("question"), transcript=told).withColumn("a", parse_action(F.col("r.text"))))
        spent = _costs(asked) if spent is None else spent.unionByName(_costs(asked))
        tool = lambda name: asked.where(F.col("a.action") == name).select("qid", F.col("a.action_input").alias("question"))  # noqa: E731, B023
        found = cut(
            col.dense(tool("search_dense"), TOOL_K).select("qid", "chunk_id", "ord", "rank").unionByName(
                col.lexical(tool("search_bm25"), TOOL_K).select("qid", "chunk_id", "ord", "rank")
            )
        )
        part = found.withColumn("src", F.lit(step))
        lists = part if lists is None else lists.unionByName(part)
        ids = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("f"))
        seen = F.concat(F.lit("Retrieved: ["), F.array_join(F.transform(F.coalesce("f", F.array().cast("array<struct<rank: bigint, chunk_id: string>>")), lambda x: python_repr(x["chunk_id"])), ", "), F.lit("]"))
        ended = F.col("a.action") == "finish"
        done = asked.join(ids, "qid", "left").select(
            "qid",
            "question",
            F.concat("trace", F.array(F.struct("a.thought", "a.action", "a.action_input", F.when(~ended, seen).alias("observation")))).alias("trace"),
            (~ended).alias("active"),
        )
        state = cut(done.unionByName(state.where("not active")))
    return answer(col, questions, ranking.first_seen(lists, k), spent, traces=state.select("qid", F.col("trace").alias("tool_call_trace")))


PATTERNS = {
    "01_naive_dense": naive_dense,
    "02_bm25": bm25,
    "03_hybrid_rrf": hybrid,
    "04_rerank": rerank,
    "05_hyde": hyde,
    "06_multi_query": multi_query,
    "07_contextual": contextual,
    "08_self_query": self_query,
    "09_multi_hop": multi_hop,
    "10_agentic": agentic,
    "00b_long_context": long_context,
    "00_no_rag": no_rag,
}
