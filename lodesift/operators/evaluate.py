"""Scoring answers: metrics per question, model-graded scores with a cache, and one summary row a pattern."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.providers import LLM, MockLLM
from lodesift.functions.text import fill, parse_judgement
from lodesift.operators import metrics
from lodesift.operators.ranking import contexts
from lodesift.runtime import BROADCAST_ROWS, cut
from lodesift.schema import TRACE_STEP
from lodesift.sources.jsonl import write_traces

JUDGE_MODEL = "gpt-5.4-mini-2026-03-17"
TEMPLATES = {
    "faithfulness": "Grade whether every claim of the answer is supported by the context (1) or not (0).\n\nContext:\n{context}\n\n"
    'Question:\n{question}\n\nAnswer:\n{answer}\n\nReply with JSON only: {{"score": 0 or 1, "reasoning": "one sentence"}}',
    "relevance": "Grade whether the answer addresses the whole question (1) or not (0), right or wrong.\n\nQuestion:\n{question}\n\n"
    'Answer:\n{answer}\n\nReply with JSON only: {{"score": 0 or 1, "reasoning": "one sentence"}}',
    "citation": "Grade which share of the bracketed chunk ids in the answer support the claim beside them. No citations at all: 0.\n\n"
    'Chunks:\n{context}\n\nAnswer:\n{answer}\n\nReply with JSON only: {{"score": 0..1, "reasoning": "one sentence"}}',
}
JUDGES = tuple(TEMPLATES)
_TEXTS = ("question", "answer", "context")

#: What answers questions: (collection, questions, k) -> answers, as in :mod:`lodesift.plans.patterns`.
Recipe = Callable[..., DataFrame]


def cache_key(kind: str, template: str, fields: list[str], model: str = JUDGE_MODEL) -> Column:
    """A digest of everything a grade depends on, the wording of the prompt included."""
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(template).alias("template"), *fields)), 256)


def read_cache(spark, path: str | None) -> DataFrame:
    """(key, score, reasoning) of earlier grades; damaged files count as misses, of repeated keys one is kept."""
    schema = "key string, score double, reasoning string"
    nothing = spark.createDataFrame(pa.schema([("key", pa.string()), ("score", pa.float64()), ("reasoning", pa.string())]).empty_table())
    if path is None:
        return nothing
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return nothing
    kept = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    return kept.where(F.col("key").isNotNull() & F.col("score").isNotNull()).dropDuplicates(["key"])


def judge(rows: DataFrame, kind: str, llm: LLM, cache: str | None = None, template: str | None = None, asking: Column | None = None) -> DataFrame:
    """Adds ``{kind}`` (score), ``{kind}_usd`` and ``{kind}_cached`` to rows with question, answer and context.

    A cached grade costs nothing. A reply that is no valid grade leaves score and cost null. New grades are
    appended to the parquet table ``cache``; equal prompts are asked once. Rows for which ``asking`` is not true
    are not graded at all.
    """
    template = template or TEMPLATES[kind]
    rest, texts = _parted(rows.withColumn("__key", F.when(F.lit(True) if asking is None else asking, cache_key(kind, template, _fields(template)))))
    out = _grade(rest, texts, kind, llm, cache, template).join(texts, "__row")
    return out.select(*rows.columns, kind, f"{kind}_usd", f"{kind}_cached")


def _fields(template: str) -> list[str]:
    return [f for f in _TEXTS if "{" + f + "}" in template]


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without their texts, and the texts, both with the number ``__row``; written once."""
    numbered = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    texts = [c for c in _TEXTS if c in rows.columns]
    return numbered.drop(*texts), numbered.select("__row", *texts)


def _grade(keyed: DataFrame, texts: DataFrame, kind: str, llm: LLM, cache: str | None, template: str) -> DataFrame:
    """Grades of the rows (__row, __key) whose key is not null; of equal keys one is asked. Texts never move with the rows."""
    known = cut(read_cache(keyed.sparkSession, cache))
    missing = keyed.where(F.col("__key").isNotNull()).join(known.select(F.col("key").alias("__key")), "__key", "left_anti")
    missing = cut(missing.groupBy("__key").agg(F.min("__row").alias("__row")))
    if missing.count() <= BROADCAST_ROWS:
        missing = F.broadcast(missing)
    prompt = fill(template, **{f: F.coalesce(F.col(f), F.lit("")) for f in _fields(template)})
    asked = texts.join(missing, "__row").select("__key", prompt.alias("prompt"))
    replied = llm.ask(asked, "prompt", "r").withColumn("model", F.lit(JUDGE_MODEL))
    calls = replied.select("__key", "model", parse_judgement(F.col("r.text")).alias("g"), "r.input_tokens", "r.output_tokens", "r.cached_input_tokens")
    # cache-creation tokens are not priced here
    graded = metrics.price_calls(calls.withColumn("cache_creation_input_tokens", F.lit(0)))
    score = F.col("g.score")
    graded = cut(graded.select("__key", score.alias("score"), F.col("g.reasoning").alias("reasoning"), F.when(score.isNotNull(), F.col("usd")).alias("usd")))
    if cache is not None:
        graded.where("score is not null").select(F.col("__key").alias("key"), "score", "reasoning").write.mode("append").parquet(cache)
    every = graded.select("__key", "score", "usd", F.lit(False).alias("hit")).unionByName(
        known.select(F.col("key").alias("__key"), "score", F.lit(0.0).alias("usd"), F.lit(True).alias("hit"))
    )
    every = every.withColumnsRenamed({"score": kind, "usd": f"{kind}_usd", "hit": f"{kind}_cached"})
    return keyed.join(every, "__key", "left").drop("__key")


def score_answers(answers: DataFrame, questions: DataFrame, model: str) -> DataFrame:
    """One row a question: hit3, hit10, mrr, filter_accuracy, usd and the two error columns.

    ``answers`` has the answer schema (and may have pattern_id); a question without an answer row, or with
    a null id list, is a retrieval error and has null metrics. A question with an accounting error keeps its
    retrieval scores and has neither cost nor filter score. Filters are compared with their types where
    both sides have them (``requires_typed``, ``extracted_typed``).
    """
    by = ["pattern_id"] if "pattern_id" in answers.columns else []
    typed = "requires_typed" in questions.columns and "extracted_typed" in answers.columns
    wanted, given = ("requires_typed", "extracted_typed") if typed else ("requires_filter", "extracted_filter")
    base = questions.select("qid", "relevant_chunk_ids", F.col(wanted).alias("__wanted"))
    if by:
        base = answers.select("pattern_id", "qid").distinct().join(base, "qid")
    df = base.join(answers.drop("question"), [*by, "qid"], "left").withColumn("model", F.lit(model))
    df = metrics.price_calls(df)
    ids, relevant = F.col("retrieved_chunk_ids"), F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))
    ok = ids.isNotNull()
    booked = ok & F.col("accounting_error").isNull()
    return df.select(
        *by,
        "qid",
        (~ok).alias("retrieval_error"),
        F.when(ok, metrics.hit_at_k(ids, relevant, 3)).alias("hit3"),
        F.when(ok, metrics.hit_at_k(ids, relevant, 10)).alias("hit10"),
        F.when(ok, metrics.mrr(ids, relevant)).alias("mrr"),
        F.when(ok, F.col("latency_ms")).alias("latency_ms"),
        F.when(booked, metrics.filter_accuracy(F.col("__wanted"), F.col(given))).alias("filter_accuracy"),
        F.when(ok, F.col("usd")).alias("usd"),
        F.when(ok, F.col("accounting_error")).alias("accounting_error"),
    )


def summarise(scores: DataFrame, *by: str) -> DataFrame:
    """One row a group: means with bootstrap bounds, p50/p95, dollars and error counts.

    Dollars a question are divided by all questions, those with errors included; metrics by the scored ones.
    ``eval_usd`` is the sum. The filter score is null where no question has one; grades are zero where
    all of them failed and absent where none were asked for.
    """
    scores = cut(scores.withColumn("__all", F.lit(1)) if not by else scores)
    keys = list(by) or ["__all"]
    judged = [j for j in JUDGES if j in scores.columns]
    spent = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ["usd", *(f"{j}_usd" for j in judged)]), F.lit(0.0))
    stage = F.col("judge_error_stage") if "judge_error_stage" in scores.columns else F.lit(None)
    out = scores.groupBy(*keys).agg(
        F.count("*").alias("n_questions"),
        F.count_if("retrieval_error").alias("n_errors"),
        F.count_if(F.col("accounting_error").isNotNull()).alias("n_accounting_errors"),
        F.count_if(stage.isNotNull()).alias("n_judge_errors"),
        (F.sum(spent) / F.count("*")).alias("usd_per_query"),
        F.sum(spent).alias("eval_usd"),
        F.count("filter_accuracy").alias("__filters"),
    )
    out = out.join(metrics.latency_percentiles(scores, "latency_ms", *keys), keys)
    # all metrics in long form: one bootstrap, not one each
    wanted = ["hit3", "hit10", "mrr", "filter_accuracy", *judged]
    long = scores.select(*keys, "qid", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("s")) for m in wanted))).alias("x"))
    ci = metrics.bootstrap_ci(long.select(*keys, "qid", F.col("x.m").alias("__m"), F.col("x.s").alias("__v")), "__v", "qid", *keys, "__m")
    names = {m: (m, f"{m}_lower", f"{m}_upper") for m in wanted}
    wide = ci.groupBy(*keys).agg(*(F.max(F.when(F.col("__m") == m, F.col(c))).alias(n) for m in wanted for c, n in zip(("mean", "lower", "upper"), names[m])))
    out = out.join(wide, keys)
    some = F.col("__filters") > 0
    out = out.withColumns({c: F.when(some, F.col(c)) for c in ("filter_accuracy", "filter_accuracy_lower", "filter_accuracy_upper")})
    return out.drop("__all", "__filters")


def judge_answers(scored: DataFrame, llm: LLM | None = None, cache: str | None = None) -> DataFrame:
    """The three grades one after the other; ``judge_error_stage`` names the first that failed.

    Grades before a failure stay; the failed one costs nothing, and later judges are not asked. Retrieval
    errors are not graded.
    """
    graded, texts = _graded(scored, llm, cache)
    return graded.join(texts, "__row").drop("__row")


def _graded(scored: DataFrame, llm: LLM | None, cache: str | None) -> tuple[DataFrame, DataFrame]:
    """:func:`judge_answers` without texts, and the texts; both have ``__row``."""
    llm = llm or MockLLM(default='{"score": 1, "reasoning": "mock"}')
    fine = ~F.col("retrieval_error") if "retrieval_error" in scored.columns else F.lit(True)
    # the keys of all judges are made where the texts are
    df, texts = _parted(scored.withColumns({f"__key_{kind}": cache_key(kind, t, _fields(t)) for kind, t in TEMPLATES.items()}))
    df = df.withColumn("judge_error_stage", F.lit(None).cast("string"))
    for kind, template in TEMPLATES.items():
        asking = fine & F.col("judge_error_stage").isNull()
        df = _grade(df.withColumn("__key", F.when(asking, F.col(f"__key_{kind}"))).drop(f"__key_{kind}"), texts, kind, llm, cache, template)
        failed = asking & F.col(kind).isNull()
        df = cut(df.withColumn("judge_error_stage", F.when(failed, F.lit(kind)).otherwise(F.col("judge_error_stage"))))
    return df, texts


def run_pattern(
    recipe: Recipe,
    col,
    questions: DataFrame,
    model: str,
    name: str = "pattern",
    k: int = 10,
    judges: LLM | None = None,
    cache: str | None = None,
    traces: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run ``recipe(col, questions, k)`` over all questions and score it: (one row a question, one summary row).

    A question whose calls fail is a retrieval error, and so are all of them if the recipe itself raises.
    ``judges`` grades the answers (none without it); ``traces`` is where the agent's steps are written.
    """
    try:
        answers = cut(recipe(col, questions, k))
    except Exception as e:  # noqa: BLE001 - told in the error column
        reason = F.lit(f"{type(e).__name__}: {e}"[:500])
        nothing = {"answer": "string", "retrieved_chunk_ids": "array<string>", "latency_ms": "double", "extracted_filter": "map<string,string>"}
        counts = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens")
        answers = cut(
            questions.select(
                "qid", "question", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), *(F.lit(0).cast("bigint").alias(c) for c in counts),
                F.array().cast(f"array<{TRACE_STEP}>").alias("tool_call_trace"), reason.alias("error"),
            )
        )
    scores = score_answers(answers, questions, model).join(answers.select("qid", F.col("error").alias("error")), "qid", "left")
    if judges is not None:
        ranked = answers.select("qid", F.posexplode("retrieved_chunk_ids").alias("rank", "chunk_id"))
        context = contexts(ranked, col.chunks, questions).select("qid", "question", "context")
        scores, texts = _graded(scores.join(context, "qid").join(answers.select("qid", "answer"), "qid"), judges, cache)
    if traces is not None:
        write_traces(answers, traces)
    if judges is None:
        scores = cut(scores)
        return scores, summarise(scores).withColumn("pattern_id", F.lit(name))
    # written already; the summary needs no texts
    return scores.join(texts, "__row").drop("__row"), summarise(scores.drop("__row")).withColumn("pattern_id", F.lit(name))


def leaderboard(summary: DataFrame) -> DataFrame:
    """Patterns by hit10, best first, ties in the order of ``ord``."""
    return summary.orderBy(F.desc("hit10"), "ord")


_NAMES = {"hit3": "hit@3", "hit10": "hit@10", "mrr": "MRR", "faithfulness": "faithfulness", "relevance": "relevance", "citation": "citation", "filter_accuracy": "filter"}


def _interval(r: dict, m: str) -> str:
    return "n/a" if r.get(m) is None else f"{r[m]:.3f} [{r[m + '_lower']:.3f}, {r[m + '_upper']:.3f}]"


def table_rows(summary: DataFrame) -> tuple[list[str], list[list[str]]]:
    """Header and cells of the leaderboard; grades and sums only where the summary has them."""
    rows = [r.asDict() for r in leaderboard(summary).limit(1000).collect()]
    have = [m for m in _NAMES if m in summary.columns]
    total = "eval_usd" in summary.columns
    head = ["pattern", *(_NAMES[m] for m in have), "p50 ms", "p95 ms", "usd/query", *(["eval usd"] if total else [])]
    cells = [
        [r["pattern_id"], *(_interval(r, m) for m in have), f"{r['p50']:.1f}", f"{r['p95']:.1f}", f"${r['usd_per_query']:.5f}", *([f"${r['eval_usd']:.4f}"] if total else [])]
        for r in rows
    ]
    return head, cells


def markdown(summary: DataFrame) -> str:
    """The leaderboard (a few rows) as a markdown table."""
    head, cells = table_rows(summary)
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(c) + " |" for c in cells]) + "\n"


def picture(summary: DataFrame, path: str) -> None:
    """The leaderboard as an image. Needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    head, cells = table_rows(summary)
    figure, axes = pyplot.subplots(figsize=(2 * len(head), 0.5 * (len(cells) + 2)))
    axes.axis("off")
    axes.table(cellText=cells, colLabels=head, loc="center").auto_set_font_size(False)
    figure.savefig(path, bbox_inches="tight", dpi=150)
    pyplot.close(figure)


def report(summary: DataFrame) -> str:
    """The summary of one or more patterns as text, with a warning for every kind of error that occurred."""
    lines = []
    for r in (x.asDict() for x in summary.limit(1000).collect()):
        lines.append(f"{r['pattern_id']}: {r['n_questions']} questions")
        lines += [f"  {_NAMES[m]:<13} {_interval(r, m)}" for m in _NAMES if m in r]
        lines.append(f"  latency       p50 {r['p50']:.1f} ms, p95 {r['p95']:.1f} ms")
        lines.append(f"  cost          ${r['usd_per_query']:.5f} a question, ${r['eval_usd']:.4f} in all")
        told = (("n_errors", "failed in retrieval or answering"), ("n_accounting_errors", "have no cost"), ("n_judge_errors", "are not fully graded"))
        lines += [f"  warning: {r[c]} questions {what}" for c, what in told if r.get(c)]
    return "\n".join(lines) + "\n"
