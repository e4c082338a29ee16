"""Fusing, merging, filtering and reranking ranked lists (qid, chunk_id, ord, rank), and building contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions.providers import MockReranker, Reranker


def _ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def stack(*lists: DataFrame) -> DataFrame:
    """Ranked lists behind each other, with ``src`` numbering them from 0."""
    out = None
    for i, one in enumerate(lists):
        part = one.select("qid", "chunk_id", "ord", "rank", F.lit(i).alias("src"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(lists: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of stacked lists; ties go to whoever came first by list, then rank."""
    # contributions are summed in list order, so that the sum does not depend on the shuffle
    terms = F.array_sort(F.collect_list(F.struct("src", (1.0 / (rrf_k + F.col("rank"))).alias("v"))))
    fused = lists.groupBy("qid", "chunk_id").agg(
        F.min("ord").alias("ord"),
        F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["v"]).alias("score"),
        F.min(F.struct("src", "rank")).alias("first"),
    )
    return _ranked(fused, k, F.round("score", 12).desc(), F.col("first")).drop("first")


def rrf_numbered(lists: DataFrame, k: int, rrf_k: int = 60, group: int = 256) -> DataFrame:
    """:func:`rrf` of lists (q, ord, rank, src) whose queries are numbered: (q, ord, score, rank), without names on the way."""

    def run(table: pa.Table) -> pa.Table:
        q, ords, rank, src = (table.column(c).to_numpy() for c in ("q", "ord", "rank", "src"))
        # contributions are summed in list order, so that the sum does not depend on the shuffle
        at = np.lexsort((src, ords, q))
        q, ords, rank, src = q[at], ords[at], rank[at], src[at]
        new = np.append(True, (q[1:] != q[:-1]) | (ords[1:] != ords[:-1]))
        first, nth = np.flatnonzero(new), np.cumsum(new) - 1
        score = np.zeros(len(first))
        np.add.at(score, nth, 1.0 / (rrf_k + rank))
        q, ords = q[first], ords[first]
        # a list names a chunk once, so the first contribution has the least (src, rank)
        at = np.lexsort((rank[first], src[first], -np.rint(1e12 * score), q))
        q, ords, score = q[at], ords[at], score[at]
        place = np.arange(len(q)) - np.searchsorted(q, q) + 1
        top = place <= k
        columns = ((q, pa.int32()), (ords, pa.int64()), (score, pa.float64()), (place, pa.int64()))
        return pa.table({name: pa.array(c[top], kind) for name, (c, kind) in zip(("q", "ord", "score", "rank"), columns)})

    grouped = lists.groupBy(F.floor(F.col("q") / group).alias("g"))
    return grouped.applyInArrow(run, "q int, ord bigint, score double, rank bigint")


def best_rank(lists: DataFrame, k: int) -> DataFrame:
    """Each chunk at its best rank over the stacked lists; ties to whoever came first by list, then rank."""
    merged = lists.groupBy("qid", "chunk_id").agg(
        F.min("ord").alias("ord"), F.min("rank").alias("best"), F.min(F.struct("src", "rank")).alias("first")
    )
    return _ranked(merged, k, F.col("best"), F.col("first")).drop("first")


def first_seen(lists: DataFrame, k: int) -> DataFrame:
    """Chunks in the order in which the stacked lists first name them."""
    merged = lists.groupBy("qid", "chunk_id").agg(F.min("ord").alias("ord"), F.min(F.struct("src", "rank")).alias("first"))
    return _ranked(merged, k, F.col("first")).drop("first")


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, reranker: Reranker | None = None) -> DataFrame:
    """The candidates of each query by the reranker's score, ties by their old rank."""
    pool = ranked.select("qid", "chunk_id", "ord", F.col("rank").alias("old"))
    # texts last: they move once, and none moves with the pool
    pool = pool.join(queries.select("qid", "question"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
    return _reranked(pool, k, reranker)


def rerank_numbered(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, reranker: Reranker | None = None) -> DataFrame:
    """:func:`rerank` of candidates (q, ord, rank) of numbered ``queries`` (q, qid, question), a block of them, which is broadcast."""
    pool = ranked.select("q", "ord", F.col("rank").alias("old")).join(chunks.select("ord", "chunk_id", "text"), "ord")
    return _reranked(pool.join(F.broadcast(queries), "q"), k, reranker)


def _reranked(pool: DataFrame, k: int, reranker: Reranker | None) -> DataFrame:
    scored = (reranker or MockReranker()).score(pool, "question", "text", "score")
    return _ranked(scored, k, F.col("score").desc(), F.col("old")).select("qid", "chunk_id", "ord", "score", "rank")


def matches(df: DataFrame, wanted: dict[str, object]) -> Column:
    """The predicate of a metadata filter: every field equals its value, typed, null equal to null.

    A field that ``df`` lacks counts as null. An empty filter matches everything. Values of another type
    than the field never match.
    """
    test = F.lit(True)
    kinds = dict(df.dtypes)
    for field, value in wanted.items():
        if field not in kinds:
            test = test & F.lit(value is None)
        elif value is None:
            test = test & F.col(f"`{field}`").isNull()
        else:
            number = kinds[field] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[field].startswith("decimal")
            typed = isinstance(value, (int, float)) if number else isinstance(value, bool) if kinds[field] == "boolean" else isinstance(value, str)
            test = test & (F.col(f"`{field}`").eqNullSafe(F.lit(value)) if typed else F.lit(False))
    return test


def join_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with the text of their chunk; ids without a chunk are dropped."""
    return ranked.join(chunks.select("chunk_id", "text"), "chunk_id")


def contexts(ranked: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, question, context, ids) for every query: ``[id] text`` by rank, parted by blank lines."""
    block = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), F.coalesce("text", F.lit("")))
    rows = join_text(ranked, chunks).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", block.alias("block")))).alias("r"))
    rows = rows.select(
        "qid", F.array_join(F.transform("r", lambda x: x["block"]), "\n\n").alias("context"), F.transform("r", lambda x: x["chunk_id"]).alias("ids")
    )
    return queries.select("qid", "question").join(rows, "qid", "left").select(
        "qid", "question", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    )
