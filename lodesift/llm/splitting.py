"""Splitting oversized texts at natural boundaries.

One bounded-quantifier regular expression consumes a text from left to right. Its alternatives are
ordered by boundary strength (rest of the text, paragraph, line, sentence, clause, white space, a run
that still fits, single characters), so ``regexp_extract_all`` returns the cores of all pieces without
overlap or gap. Array functions then put up to ``overlap`` characters of lookback before each core.
Everything runs inside the JVM on one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2400
OVERLAP = 200

# The characters after which a text may be cut without harm.
BREAKS = r"\t-\r 。！？"


def core_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The Java pattern whose successive matches tile a text; ``.`` and quantifiers count code points.

    A core has at most ``limit - overlap`` characters, except where no break lies in that stretch but
    one lies within ``limit``: then the core runs up to it and takes less lookback. Only if ``limit``
    characters hold no break at all is the core cut between two ordinary characters.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must lie between 0 and half of the limit")
    if limit < 64:
        raise ValueError("limit must be at least 64 characters")
    room = limit - overlap
    least = room // 2
    tail = 8
    return (
        "(?s)"
        rf".{{1,{room}}}\z"
        rf"|.{{{least},{room - tail}}}\n[ \t\r]{{0,3}}\n[ \t\r\n]{{0,{tail - 5}}}"
        rf"|.{{{least},{room - 1}}}[\n\r]"
        rf"|.{{{least},{room - 3}}}(?:[.!?][\"'”’»)\]]?[{BREAKS}]|[。！？])"
        rf"|.{{{least},{room - 2}}}[;:,，；、][{BREAKS}]"
        rf"|.{{0,{room - 1}}}[{BREAKS}]"
        rf"|.{{{room},{limit}}}(?=[{BREAKS}]|\z)"
        rf"|.{{{room}}}"
    )


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of pieces of ``text``: struct(piece_index, start, n_overlap, n_chars, boundary, piece).

    ``start`` is the 0-based character offset of the piece and ``n_overlap`` how many of its first
    characters repeat the end of the piece before. ``boundary`` names where the piece ends:
    ``end``, ``paragraph``, ``line``, ``sentence``, ``clause``, ``space`` or ``forced`` (between two
    characters neither of which is a break). Cutting off the overlaps and joining the rest gives the
    text back. Texts up to ``limit`` come back as one piece; null and empty texts give an empty array.
    """
    n = F.length(text)
    cores = F.when(text.isNull() | (n == 0), F.array().cast("array<string>"))
    cores = cores.when(n <= limit, F.array(text))
    cores = cores.otherwise(F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(0)))
    ends = F.aggregate(
        cores,
        F.array(F.lit(0)),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(c))),
    )

    def boundary(core: Column, following: Column) -> Column:
        last = F.right(core, F.lit(6))
        return (
            F.when(following.isNull(), F.lit("end"))
            .when(last.rlike(r"\n[ \t\r]*\n[ \t\r\n]*\z"), F.lit("paragraph"))
            .when(last.rlike(r"[\n\r]\z"), F.lit("line"))
            .when(last.rlike(rf"(?:[.!?][\"'”’»)\]]?[{BREAKS}]|[。！？])\z"), F.lit("sentence"))
            .when(last.rlike(rf"[;:,，；、][{BREAKS}]\z"), F.lit("clause"))
            .when(last.rlike(rf"[{BREAKS}]\z") | F.left(following, F.lit(1)).rlike(rf"[{BREAKS}]"), F.lit("space"))
            .otherwise(F.lit("forced"))
        )

    def lookback(core: Column, before: Column, earlier: Column) -> Column:
        # two cores reach back far enough: a core shorter than the overlap always follows a long one
        reach = F.concat(F.coalesce(earlier, F.lit("")), before)
        size = F.least(F.lit(overlap), F.lit(limit) - F.length(core))
        back = F.right(reach, size)
        # start at a word where that costs less than half of the overlap
        trimmed = F.regexp_replace(back, rf"(?s)\A.{{0,{overlap // 2}}}?[{BREAKS}](?=[^{BREAKS}])", "")
        return F.when(before.isNull() | (size <= 0), F.lit("")).otherwise(trimmed)

    def piece(core: Column, i: Column, cs: Column, es: Column) -> Column:
        back = lookback(core, F.get(cs, i - 1), F.get(cs, i - 2))
        return F.struct(
            i.alias("piece_index"),
            (F.get(es, i) - F.length(back)).alias("start"),
            F.length(back).alias("n_overlap"),
            (F.length(core) + F.length(back)).alias("n_chars"),
            boundary(core, F.get(cs, i + 1)).alias("boundary"),
            F.concat(back, core).alias("piece"),
        )

    both = F.array(F.struct(cores.alias("cs"), ends.alias("es")))
    # the one-element array binds cores and ends to a variable, so each is evaluated once
    return F.flatten(F.transform(both, lambda b: F.transform(b["cs"], lambda c, i: piece(c, i, b["cs"], b["es"]))))


def split_texts(
    df: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = True
) -> DataFrame:
    """One row per piece, with all columns of ``df`` but the text, then the fields of :func:`pieces`.

    Null and empty texts give no row. With ``only_oversized`` texts within ``limit`` give none either.
    A column of ``df`` that shares a name with a piece field gets the suffix ``_in``.
    """
    fields = ("piece_index", "start", "n_overlap", "n_chars", "boundary", "piece")
    if only_oversized:
        df = df.where(F.length(text_col) > limit)
    keep = [F.col(f"`{c}`").alias(f"{c}_in" if c in fields or c == "__p" else c) for c in df.columns if c != text_col]
    out = df.select(*keep, F.explode(pieces(F.col(f"`{text_col}`"), limit, overlap)).alias("__p"))
    return out.select(*[c for c in out.columns if c != "__p"], *[F.col(f"__p.{f}").alias(f) for f in fields])


def cut_kind(df: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows of ``df`` over the limit, with ``cut``: ``forced`` if any piece had to end inside a run."""
    parts = pieces(F.col(f"`{text_col}`"), limit, overlap)
    forced = F.exists(parts, lambda p: p["boundary"] == "forced")
    keep = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    return df.where(F.length(text_col) > limit).select(
        *keep, F.when(forced, F.lit("forced")).otherwise(F.lit("natural")).alias("cut")
    )
