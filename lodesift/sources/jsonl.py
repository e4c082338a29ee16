"""JSON-lines and text sources and sinks. Blank lines are skipped; a sink replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.text import parse_filter, parse_typed_filter
from lodesift.operators.corpus import last_delivery
from lodesift.schema import CHUNK, FULL_TEXT, QA


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions; ``requires_typed`` has the required filter as JSON literals, so that text and numbers stay apart."""
    raw = spark.read.schema(QA.replace("requires_filter MAP<STRING,STRING>", "requires_filter STRING")).json(path)
    wanted = F.col("requires_filter")
    return raw.withColumn("requires_typed", F.when(wanted.isNotNull(), parse_typed_filter(wanted))).withColumn(
        "requires_filter", F.when(wanted.isNotNull(), parse_filter(wanted))
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``ord`` in file order; of a repeated chunk_id the last content at the first place."""
    rows = spark.read.schema(CHUNK).json(path).withColumn("ord", F.monotonically_increasing_id())
    return last_delivery(rows)


def read_full_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FULL_TEXT).json(path)


def write_lines(rows: DataFrame, path: str, dry_run: bool = False) -> None:
    if not dry_run:
        rows.write.mode("overwrite").json(path)


def write_traces(answers: DataFrame, path: str) -> None:
    """(qid, question, trace) of the answers that have one."""
    rows = answers.where(F.size("tool_call_trace") > 0)
    rows.select("qid", "question", F.col("tool_call_trace").alias("trace")).write.mode("overwrite").json(path)


def read_template(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
