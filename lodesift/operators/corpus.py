"""Building a chunk table from papers: selection per category, sections, order and repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions.text import section_of, strip
from lodesift.operators.chunking import chunk_text
from lodesift.runtime import BROADCAST_ROWS, cut

LARGE_BYTES = 32_000_000
LEAST_CHARS, CHUNKS_PER_PAPER, PAPERS_PER_CATEGORY = 500, 3, 6


def last_delivery(rows: DataFrame, key: str = "chunk_id", order: str = "ord", least: int = LARGE_BYTES) -> DataFrame:
    """One row per key: the content of its last delivery at the place of its first.

    Only (order) moves through the window twice; of a hot key the rows are reduced before the shuffle. Of tables of
    ``least`` bytes or more, in files enough for all cores, only the rows of repeated keys move: keys are counted by themselves first.
    """
    rest = [c for c in rows.columns if c not in (key, order)]

    def last(some: DataFrame) -> DataFrame:
        kept = some.groupBy(key).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("__r"))
        return kept.select(key, order, *(F.col(f"__r.`{c}`").alias(c) for c in rest))

    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < least or len(rows.inputFiles()) < rows.sparkSession.sparkContext.defaultParallelism:
        return last(rows)
    again = cut(rows.groupBy(F.col(key).alias("__again")).count().where("count > 1").select("__again"))
    if again.count() > BROADCAST_ROWS:
        return last(rows)
    same = F.col(key).eqNullSafe(F.col("__again"))
    once = rows.join(F.broadcast(again), same, "left_anti").select(key, order, *rest)
    return once.unionByName(last(rows.join(F.broadcast(again), same, "left_semi")))


def select_papers(candidates: DataFrame, categories: list[str], quota: int = PAPERS_PER_CATEGORY, least: int = LEAST_CHARS) -> DataFrame:
    """Up to ``quota`` papers of each category, from its first 2 ``quota`` candidates.

    ``candidates`` has category, paper_id, place (order within the category) and full_text; of a repeated
    paper the row of least place counts. Categories are served in the given order; a candidate that was
    chosen before or has fewer than ``least`` characters is passed over. A paper that fails in one
    category may still be chosen in the next.
    """
    taken: list[DataFrame] = []
    for c in categories:
        mine = candidates.where(F.col("category") == c).groupBy("category", "paper_id")
        mine = mine.agg(F.min("place").alias("place"), F.min_by("full_text", "place").alias("full_text"))
        mine = mine.orderBy("place", "paper_id").limit(2 * quota)
        for earlier in taken:
            mine = mine.join(earlier.select("paper_id"), "paper_id", "left_anti")
        mine = mine.where(F.length(strip(F.col("full_text"))) >= least)
        # the window sees 2 quota rows only
        order = Window.orderBy("place", "paper_id")
        first = mine.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= quota)
        taken.append(cut(first.select("category", "paper_id", "place", "full_text", "nth")))
    return reduce(DataFrame.unionByName, taken)


def chunk_papers(papers: DataFrame, most: int = CHUNKS_PER_PAPER) -> DataFrame:
    """(chunk_id, paper_id, category, section, chunk_index, text, n_tokens): the first chunks of each paper."""
    cs = papers.withColumn("cs", F.slice(chunk_text(F.col("full_text")), 1, most))
    rows = cs.select("paper_id", "category", F.size("cs").alias("total"), F.posexplode("cs").alias("chunk_index", "text"))
    return rows.select(
        F.concat_ws("#", "paper_id", "chunk_index").alias("chunk_id"),
        "paper_id",
        "category",
        section_of(F.col("chunk_index"), F.col("total")).alias("section"),
        "chunk_index",
        "text",
        F.size(F.split("text", r"\s+")).alias("n_tokens"),
    )


def usable_full_texts(papers: DataFrame, texts: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(paper_id, full_text) of the distinct papers that have a text of ``least`` characters or more."""
    want = papers.select("paper_id").where(F.col("paper_id").isNotNull()).distinct()
    return texts.where(F.length(strip(F.col("full_text"))) >= least).join(want, "paper_id", "left_semi")
