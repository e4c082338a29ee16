"""Model providers: language models, embedders and rerankers.

A provider adds columns to a DataFrame. The stand-ins are native expressions and need no network. Any
Python callable can be plugged in; it then runs in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.text import estimate_tokens
from lodesift.functions.vectors import mock_score, mock_vector

RESPONSE = (
    "struct<text: string, input_tokens: bigint, output_tokens: bigint, cached_input_tokens: bigint, "
    "cache_creation_input_tokens: bigint, latency_ms: double, error: string>"
)


#: Longest shared prefix that is sent to a model.
MOST_PREFIX_CHARS = 4_000_000


@dataclass
class Prefix:
    """A prompt prefix shared by many calls, which a provider may cache: the first call writes, later ones read.

    ``sizes`` has key, chars and first (the least ``order`` of its calls). ``key`` and ``order`` name columns
    of the calls. ``texts`` builds (key, text) and is asked only by providers that send it.
    """

    key: str
    order: str
    sizes: DataFrame
    texts: Callable[[], DataFrame]

    @classmethod
    def of_column(cls, df: DataFrame, text: str, order: str) -> Prefix:
        sizes = df.groupBy(F.col(text).alias("key")).agg(F.length(F.first(text)).alias("chars"), F.min(order).alias("first"))
        return cls(text, order, sizes, lambda: df.select(F.col(text).alias("key"), F.col(text).alias("text")).distinct())


class LLM(Protocol):
    def ask(self, df: DataFrame, prompt: str, out: str, prefix: Prefix | None = None) -> DataFrame:
        """Add the struct column ``out`` (:data:`RESPONSE`) with the answer to column ``prompt``."""


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class Reranker(Protocol):
    def score(self, df: DataFrame, query: str, text: str, out: str) -> DataFrame: ...


class MockLLM:
    """Answers with the first canned text whose key occurs in the prompt, else with a default.

    Tokens are a quarter of the characters. Of a prefix only the size is needed, so no text is copied to
    the calls that share it.
    """

    def __init__(self, default: str = "This is a mock response.", canned: dict[str, str] | None = None) -> None:
        self.default, self.canned = default, canned or {}

    def _text(self, prompt: Column) -> Column:
        text = None
        for key, value in self.canned.items():
            hit = F.contains(prompt, F.lit(key))
            text = F.when(hit, F.lit(value)) if text is None else text.when(hit, F.lit(value))
        return F.lit(self.default) if text is None else text.otherwise(F.lit(self.default))

    def _answer(self, df: DataFrame, prompt: str, out: str, reads: Column, writes: Column, more: Column) -> DataFrame:
        text = self._text(F.col(prompt))
        answer = F.struct(
            text.alias("text"),
            (estimate_tokens(F.col(prompt)).cast("bigint") + more).alias("input_tokens"),
            estimate_tokens(text).cast("bigint").alias("output_tokens"),
            reads.alias("cached_input_tokens"),
            writes.alias("cache_creation_input_tokens"),
            F.lit(0.1).alias("latency_ms"),
            F.lit(None).cast("string").alias("error"),
        )
        return df.withColumn(out, answer)

    def ask(self, df: DataFrame, prompt: str, out: str, prefix: Prefix | None = None) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        if prefix is None:
            return self._answer(df, prompt, out, zero, zero, zero)
        known = prefix.sizes.select(F.col("key").alias("__key"), F.col("chars").alias("__chars"), F.col("first").alias("__first"))
        df = df.join(known, F.col(prefix.key) == F.col("__key"), "left")
        used = F.coalesce(F.col("__chars"), F.lit(0)) > 0
        share = F.greatest(F.lit(1), F.floor(F.col("__chars") / 4)).cast("bigint")
        first = F.col(prefix.order) == F.col("__first")
        writes = F.when(used & first, share).otherwise(zero)
        reads = F.when(used & ~first, share).otherwise(zero)
        return self._answer(df, prompt, out, reads, writes, F.when(used, share).otherwise(zero)).drop("__key", "__chars", "__first")


class CallableLLM:
    """A Python function prompt -> (text, input tokens, output tokens, cache reads, cache writes, ms).

    With ``parts`` it is called with (prompt, prefix) instead, for models that cache a marked prefix. A call
    that raises gives a null text and its message in ``error``; the other calls go on.
    """

    def __init__(self, make: Callable[[], Callable[..., tuple]], parts: bool = False) -> None:
        self.make, self.parts = make, parts

    def ask(self, df: DataFrame, prompt: str, out: str, prefix: Prefix | None = None) -> DataFrame:
        make, parts = self.make, self.parts

        @F.pandas_udf(RESPONSE)
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            call = make()  # once per task: clients and models are loaded here
            names = ["text", "input_tokens", "output_tokens", "cached_input_tokens", "cache_creation_input_tokens", "latency_ms", "error"]

            def one(p: str, shared: str) -> tuple:
                try:
                    return (*(call(p, shared) if parts else call(shared + p)), None)
                except Exception as e:  # noqa: BLE001 - one failed call must not end the others
                    return None, 0, 0, 0, 0, 0.0, f"{type(e).__name__}: {e}"

            for prompts, shared in batches:
                yield pd.DataFrame([one(p, x) for p, x in zip(prompts, shared)], columns=names)

        if prefix is None:
            return df.withColumn(out, run(F.col(prompt), F.lit("")))
        longest = prefix.sizes.agg(F.max("chars")).first()[0] or 0
        if longest > MOST_PREFIX_CHARS:
            raise ValueError(f"a prefix of {longest} characters exceeds {MOST_PREFIX_CHARS}")
        texts = prefix.texts().select(F.col("key").alias("__key"), F.col("text").alias("__prefix"))
        df = df.join(texts, F.col(prefix.key) == F.col("__key"), "left")
        return df.withColumn(out, run(F.col(prompt), F.coalesce("__prefix", F.lit("")))).drop("__key", "__prefix")


class MockEmbedder:
    def __init__(self, dim: int = 16) -> None:
        self.dim = dim

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, mock_vector(F.coalesce(F.col(text), F.lit("")), self.dim))


def budgeted(texts: list[str], budget: int) -> Iterator[list[str]]:
    """The texts in order, in lists of at most ``budget`` estimated tokens; a larger text stands alone."""
    held: list[str] = []
    used = 0
    for t in texts:
        n = max(1, len(t) // 4)
        if held and used + n > budget:
            yield held
            held, used = [], 0
        held.append(t)
        used += n
    if held:
        yield held


class CallableEmbedder:
    """A Python function list of texts -> list of vectors, loaded once per task and called with lists within ``budget`` tokens."""

    def __init__(self, make: Callable[[], Callable[[list[str]], list[list[float]]]], budget: int = 250_000) -> None:
        self.make, self.budget = make, budget

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        make, budget = self.make, self.budget

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            embed = make()
            for texts in batches:
                yield pd.Series([v for some in budgeted(texts.fillna("").tolist(), budget) for v in embed(some)], dtype=object)

        return df.withColumn(out, run(F.col(text)))


class MockReranker:
    def score(self, df: DataFrame, query: str, text: str, out: str) -> DataFrame:
        return df.withColumn(out, mock_score(F.col(query), F.col(text)))


class CallableReranker:
    """A Python function (queries, texts) -> scores, loaded once per task."""

    def __init__(self, make: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> None:
        self.make = make

    def score(self, df: DataFrame, query: str, text: str, out: str) -> DataFrame:
        make = self.make

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            score = make()
            for queries, texts in batches:
                yield pd.Series(score(queries.tolist(), texts.tolist()), dtype=float)

        return df.withColumn(out, run(F.col(query), F.col(text)))
