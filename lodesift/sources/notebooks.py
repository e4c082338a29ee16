"""Checking the numbered sections of notebooks (JSON files with markdown cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"(?m)^##\s+(\d+)\.\s+(.+)$"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(notebook, place, number, title) of every numbered second-level header in a markdown cell."""
    schema = "cells ARRAY<STRUCT<cell_type: STRING, source: ARRAY<STRING>>>"
    books = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.input_file_name().alias("notebook"), F.posexplode("cells").alias("cell", "c"))
    texts = books.where(F.col("c.cell_type") == "markdown").select("notebook", "cell", F.array_join("c.source", "").alias("text"))
    found = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(HEADER), F.lit(1)).alias("number"), F.regexp_extract_all("text", F.lit(HEADER), F.lit(2)).alias("title")
    )
    rows = texts.select("notebook", "cell", F.posexplode(found).alias("at", "h"))
    return rows.select(
        F.regexp_extract("notebook", r"([^/]+)$", 1).alias("notebook"),
        (F.col("cell").cast("bigint") * 10_000 + F.col("at")).alias("place"),
        F.col("h.number").cast("int").alias("number"),
        F.trim("h.title").alias("title"),
    )


def problems(heads: DataFrame, notebooks: DataFrame, required: list[tuple[int, str]]) -> DataFrame:
    """(notebook, problem): sections out of order or repeated, and required ones missing or titled otherwise.

    ``notebooks`` (notebook) lists all files, those without a header too; of a repeated number the last
    title counts.
    """
    lists = heads.groupBy("notebook").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "number"))), lambda x: x["number"]).alias("seen"))
    order = lists.where(F.col("seen") != F.array_sort("seen")).select("notebook", F.concat(F.lit("section numbers out of order: "), F.to_json("seen")).alias("problem"))
    twice = F.array_sort(F.array_distinct(F.filter("seen", lambda n: F.size(F.filter("seen", lambda m: m == n)) > 1)))
    repeated = lists.where(F.size(twice) > 0).select("notebook", F.concat(F.lit("duplicate section numbers: "), F.to_json(twice)).alias("problem"))
    wanted = F.array(*(F.struct(F.lit(n).alias("number"), F.lit(k).alias("keyword")) for n, k in required))
    titles = heads.groupBy("notebook", "number").agg(F.max_by("title", "place").alias("title"))
    every = notebooks.select("notebook").distinct().select("notebook", F.explode(wanted).alias("w")).select("notebook", "w.*").join(titles, ["notebook", "number"], "left")
    missing = every.where("title IS NULL").select("notebook", F.format_string("missing section %d (%s)", "number", "keyword").alias("problem"))
    odd = every.where("title IS NOT NULL AND NOT contains(lower(title), lower(keyword))")
    odd = odd.select("notebook", F.format_string("section %d is titled '%s', without '%s'", "number", "title", "keyword").alias("problem"))
    return order.unionByName(repeated).unionByName(missing).unionByName(odd)
