"""Building a chunk file from papers: ``python -m lodesift.sources.build --papers papers.jsonl --output chunks.jsonl``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from lodesift.operators.corpus import PAPERS_PER_CATEGORY, chunk_papers, select_papers
from lodesift.runtime import session
from lodesift.sources.jsonl import write_lines

#: A paper as the builder reads it; ``place`` is its order within the category.
PAPERS = "category STRING, paper_id STRING, place BIGINT, full_text STRING"


def build_corpus(papers: DataFrame, categories: list[str], quota: int = PAPERS_PER_CATEGORY) -> DataFrame:
    """Chunks of the chosen papers, see :func:`select_papers` and :func:`chunk_papers`."""
    return chunk_papers(select_papers(papers, categories, quota))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--papers", required=True, help="JSON lines with category, paper_id, place and full_text")
    parser.add_argument("--categories", nargs="+", default=["cs.CL", "cs.IR", "cs.LG", "cs.AI"])
    parser.add_argument("--papers-per-category", type=int, default=PAPERS_PER_CATEGORY)
    parser.add_argument("--output", default="chunks.jsonl")
    parser.add_argument("--dry-run", action="store_true", help="count only, write nothing")
    given = parser.parse_args(arguments)
    papers = session("build").read.schema(PAPERS).json(given.papers)
    chunks = build_corpus(papers, given.categories, given.papers_per_category)
    print(f"{chunks.count()} chunks")
    write_lines(chunks, given.output, given.dry_run)


if __name__ == "__main__":
    main()
