"""Chunkers as column expressions: text -> array of chunks.

The greedy ones run in Arrow batches, one pass over each text. Tokens are words between white space unless
another tokenizer is given: a function without arguments that returns (encode, decode), called once a task.
Null and empty texts give an empty array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, OVERLAP = 512, 64
LEAST_SEMANTIC, MOST_SEMANTIC, BREAK_PERCENTILE = 100, 1024, 0.20
WINDOW_CHARS = 400


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def split_oversized(paragraph: Column, budget: int = BUDGET, overlap: int = OVERLAP) -> Column:
    """One paragraph within the budget as it is; else windows of ``budget`` words, ``budget - overlap`` apart.

    The last window may lie wholly inside the one before.
    """

    def cut(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(budget - overlap))
        return F.when(F.size(ws) <= budget, F.array(paragraph)).otherwise(
            F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, budget), " "))
        )

    return F.flatten(F.transform(F.array(words(paragraph)), cut))


Tokenizer = Callable[[], tuple[Callable[[str], list], Callable[[list], str]]]


def by_words() -> tuple[Callable[[str], list], Callable[[list], str]]:
    return str.split, " ".join


def pack_paragraphs(text: str, budget: int, overlap: int, encode: Callable[[str], list], decode: Callable[[list], str]) -> list[str]:
    """Paragraphs of one text packed greedily up to ``budget`` tokens, see :func:`chunk_text`."""
    done: list[str] = []
    held: list[tuple[str, int]] = []
    size = 0
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        tokens = encode(paragraph)
        if len(tokens) <= budget:
            parts = [(paragraph, len(tokens))]
        else:
            windows = (tokens[at : at + budget] for at in range(0, len(tokens), budget - overlap))
            parts = [(decode(w), len(w)) for w in windows]
        for part, n in parts:
            if held and size + n > budget:
                done.append("\n\n".join(t for t, _ in held))
                held = held[-1:] if held[-1][1] <= overlap else []
                size = sum(m for _, m in held)
            held.append((part, n))
            size += n
    return [*done, "\n\n".join(t for t, _ in held)] if held else done


def chunk_text(text: Column, budget: int = BUDGET, overlap: int = OVERLAP, tokenizer: Tokenizer = by_words) -> Column:
    """Paragraphs packed greedily up to ``budget`` tokens; a short last paragraph is carried as overlap.

    The carried paragraph is not counted against the paragraph that follows, so a chunk may reach
    ``budget + overlap``.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = tokenizer()
        for texts in batches:
            yield pd.Series([pack_paragraphs(t, budget, overlap, encode, decode) if t else [] for t in texts], dtype=object)

    return run(text)


def chunk_fixed(text: Column, budget: int, tokenizer: Tokenizer = by_words) -> Column:
    return chunk_text(text, budget, OVERLAP, tokenizer)


def hashed_vectors(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """The stand-in embedding of :func:`lodesift.functions.vectors.mock_vector`, for use inside a task."""

    def embed(texts: list[str]) -> np.ndarray:
        digests = b"".join((sha256(t.encode("utf-8", "surrogatepass")).digest() * (dim // 32 + 1))[:dim] for t in texts)
        return np.frombuffer(digests, np.uint8).reshape(len(texts), dim) / 127.5 - 1.0

    return embed


def group_sentences(text: str, embed: Callable[[list[str]], np.ndarray], encode: Callable[[str], list], decode: Callable[[list], str]) -> list[str]:
    """The semantic chunks of one text, see :func:`chunk_semantic`."""
    parts = [p for p in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if p]
    if len(parts) <= 1:
        return [text] if text else []
    v = np.asarray(embed(parts), float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    alike = (v[:-1] * v[1:]).sum(axis=1)
    ends = np.flatnonzero(alike < np.percentile(alike, 100 * BREAK_PERCENTILE)) + 1
    bounds = [0, *ends.tolist(), len(parts)]
    done: list[list[str]] = []
    for a, b in zip(bounds, bounds[1:]):
        group = " ".join(parts[a:b])
        n = len(encode(group))
        if n > MOST_SEMANTIC:
            done += [[c] for c in pack_paragraphs(group, MOST_SEMANTIC, OVERLAP, encode, decode)]
        elif n < LEAST_SEMANTIC and done:
            done[-1].append(group)
        else:
            done.append([group])
    return [" ".join(d) for d in done]


def chunk_semantic(text: Column, vectors: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_vectors, tokenizer: Tokenizer = by_words) -> Column:
    """Sentences grouped at dips of the similarity of neighbours, below its 20th percentile over the text.

    Groups over 1,024 tokens are packed again at that budget; groups under 100 tokens join the chunk
    before them, if there is one. A text of at most one sentence stays whole. ``vectors`` gives, once a task, a
    function from texts to vectors.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed, (encode, decode) = vectors(), tokenizer()
        for texts in batches:
            yield pd.Series([group_sentences(t, embed, encode, decode) if t else [] for t in texts], dtype=object)

    return run(text)


def chunk_late(text: Column, budget: int = BUDGET, window: int = WINDOW_CHARS, tokenizer: Tokenizer = by_words) -> Column:
    """array<struct(text, embed_text)>: fixed chunks, with ``window`` characters around each for embedding.

    Each chunk is looked for after the place of the one before; a chunk that is not found is embedded alone.
    """

    def widened(t: str, encode: Callable[[str], list], decode: Callable[[list], str]) -> list[tuple[str, str]]:
        out, begin = [], 0
        for chunk in pack_paragraphs(t, budget, OVERLAP, encode, decode):
            at = t.find(chunk, begin)
            out.append((chunk, t[max(0, at - window) : at + len(chunk) + window] if at >= 0 else chunk))
            begin = at + 1 if at >= 0 else begin
        return out

    @F.pandas_udf("array<struct<text: string, embed_text: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = tokenizer()
        for texts in batches:
            yield pd.Series([[{"text": c, "embed_text": e} for c, e in widened(t, encode, decode)] if t else [] for t in texts], dtype=object)

    return run(text)


def chunk_document_aware(chunks: DataFrame) -> DataFrame:
    """(paper_id, section, piece, text): a paper's chunks joined by section, in order of first appearance."""
    row = F.struct("chunk_index", "ord", F.coalesce("text", F.lit("")).alias("text"))
    by = chunks.groupBy("paper_id", "section").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    order = Window.partitionBy("paper_id").orderBy(F.get("rows", F.lit(0))["chunk_index"], F.get("rows", F.lit(0))["ord"])
    return by.select(
        "paper_id",
        "section",
        (F.row_number().over(order) - 1).alias("piece"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"),
    )


def token_batches(sizes: Column, budget: int = 250_000) -> Column:
    """Batch number of each size: greedy in order up to ``budget`` in sum; a larger one stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("b"), F.lit(0).alias("now"), F.lit(0).cast("bigint").alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        over = (acc["sum"] + n > budget) & (acc["sum"] > 0)
        now = F.when(over, acc["now"] + 1).otherwise(acc["now"])
        total = F.when(over, n.cast("bigint")).otherwise(acc["sum"] + n)
        return F.struct(F.concat(acc["b"], F.array(now)).alias("b"), now.alias("now"), total.alias("sum"))

    return F.aggregate(sizes, start, step, lambda acc: acc["b"])


def budget_batches(df: DataFrame, by: str, order: str, size: str, budget: int = 250_000) -> DataFrame:
    """Adds ``batch``: within each group of ``by``, in ``order``, greedy batches of up to ``budget`` in sum.

    Rows stream through sorted partitions and only a running sum is held, so a group may have any size. A null
    size counts as 0.
    """
    names = df.columns
    src = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{by}`").cast("string").alias("__by"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("__n"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: object = run  # no group yet
        now = total = 0
        for batch in batches:
            out = []
            for g, n in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                if g != group:
                    group, now, total = g, 0, 0
                if total > 0 and total + n > budget:
                    now, total = now + 1, 0
                total += n
                out.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.int32())], names=[*names, "batch"])

    return src.repartition("__by").sortWithinPartitions("__by", order).mapInArrow(run, f"{kinds}, batch int")
