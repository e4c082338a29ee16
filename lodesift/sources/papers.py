"""Papers from an Atom search feed and from PDF files. Nothing here opens a connection by itself."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAPER = "array<struct<paper_id: string, title: string, authors: array<string>, year: int, pdf_url: string>>"


def search_url(base: str, category: str, date_from: str, date_to: str, start: int = 0, most: int = 50) -> str:
    """The request of one page: a category between two dates (yyyymmddhhmm), newest first."""
    terms = f"cat:{category} AND submittedDate:[{date_from} TO {date_to}]"
    return f"{base}?" + urlencode({"search_query": terms, "start": start, "max_results": most, "sortBy": "submittedDate", "sortOrder": "descending"})


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row a paper of the Atom feeds in column ``xml``; other columns stay.

    The id loses its version, the year is that of ``published``, entries without a PDF link are dropped,
    and a damaged feed gives no rows.
    """

    @F.pandas_udf(PAPER)
    def papers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import xml.etree.ElementTree as et

        ns = {"a": "http://www.w3.org/2005/Atom"}

        def one(text):
            if not text or "<!DOCTYPE" in text or "<!ENTITY" in text:
                return []
            try:
                root = et.fromstring(text)
            except et.ParseError:
                return []
            rows = []
            for e in root.findall("a:entry", ns):
                link = next((x.get("href") for x in e.findall("a:link", ns) if x.get("title") == "pdf"), None)
                where, when = e.findtext("a:id", "", ns), e.findtext("a:published", "", ns)
                if link and where:
                    name = re.sub(r"v\d+$", "", where.rstrip("/").rsplit("/abs/")[-1])
                    rows.append(
                        {
                            "paper_id": f"arxiv:{name}",
                            "title": " ".join((e.findtext("a:title", "", ns)).split()),
                            "authors": [x.findtext("a:name", "", ns) for x in e.findall("a:author", ns)],
                            "year": int(when[:4]) if when[:4].isdigit() else None,
                            "pdf_url": link,
                        }
                    )
            return rows

        for texts in batches:
            yield texts.map(one)

    rest = [c for c in feeds.columns if c != xml]
    return feeds.select(*rest, F.explode(papers(F.col(xml))).alias("p")).select(*rest, "p.*")


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, text) of a ``binaryFile`` table; pages are joined by blank lines. Needs pypdf on the executors.

    A file that cannot be read has a null text.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import io

        from pypdf import PdfReader

        def one(content: bytes) -> str | None:
            try:
                return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
            except Exception:  # noqa: BLE001 - damaged files differ in what they raise
                return None

        for contents in batches:
            yield contents.map(one)

    return files.select("path", text(F.col("content")).alias("text"))


class FeedSource(DataSource):
    """A paged Atom search as a batch source: ``spark.dataSource.register(FeedSource)``, then ``format("papers")``.

    Options: base (address), category, date_from, date_to, most (papers), page (papers a request). Every page
    is one task; the rows have page and xml, for :func:`parse_feeds`. ``file:`` addresses are read as they are.
    """

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return "page int, xml string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        page, most = int(self.options.get("page", 50)), int(self.options.get("most", 50))
        return [InputPartition(n) for n in range(-(-most // page))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.request

        o = self.options
        page, most = int(o.get("page", 50)), int(o.get("most", 50))
        at = partition.value * page
        base = o["base"]
        url = base if base.startswith("file:") else search_url(base, o["category"], o["date_from"], o["date_to"], at, min(page, most - at))
        with urllib.request.urlopen(url, timeout=60) as reply:
            yield partition.value, reply.read().decode("utf-8", "replace")
