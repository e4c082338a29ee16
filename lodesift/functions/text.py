"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers; accented letters split words. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def citations(text: Column) -> Column:
    """Distinct bracketed ids in order of first appearance; any bracketed word counts."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\[([\w:.\-#/]+)\]"), F.lit(1))
    return F.array_distinct(found)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def strip_fence(reply: Column) -> Column:
    """A model's reply without the code fence and language name around it."""
    bare = strip(reply)
    inner = strip(F.regexp_replace(bare, r"\A`+|`+\z", ""))
    inner = strip(F.regexp_replace(inner, r"(?i)\Ajson", ""))
    return F.when(bare.startswith("```"), inner).otherwise(bare)


_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def parse_judgement(reply: Column) -> Column:
    """struct(score, reasoning), null unless both are present and the score is a number. Its range is not checked."""
    raw = F.from_json(strip_fence(reply), "score STRING, reasoning STRING", _STRICT)
    score = raw["score"].try_cast("double")
    return F.when(score.isNotNull() & raw["reasoning"].isNotNull(), F.struct(score.alias("score"), raw["reasoning"].alias("reasoning")))


def parse_subqueries(reply: Column, question: Column) -> Column:
    """The reply's non-empty list ``queries``, else the question alone. Their number is not limited."""
    found = F.from_json(strip_fence(reply), "queries ARRAY<STRING>", _STRICT)["queries"]
    return F.when(F.size(found) > 0, found).otherwise(F.array(question))


def parse_filter(reply: Column) -> Column:
    """The reply as a map of field to value; an empty map if it is no JSON object."""
    bare = strip_fence(reply)
    found = F.from_json(bare, "MAP<STRING,STRING>", _STRICT)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(bare.startswith("{"), F.coalesce(found, empty)).otherwise(empty)


def parse_typed_filter(reply: Column) -> Column:
    """The reply as a map of field to JSON literal, so that ``"2025"`` and ``2025`` stay apart; empty if no object."""
    found = F.from_json(strip_fence(reply), "MAP<STRING,VARIANT>", _STRICT)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.transform_values(found, lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))), empty)


def literals(plain: Column) -> Column:
    """A map of strings as a map of JSON literals."""
    quoted = lambda v: F.coalesce(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    return F.transform_values(plain, lambda _, v: F.when(v.isNull(), F.lit("null")).otherwise(quoted(v)))


def parse_next_query(reply: Column) -> Column:
    """The reply's ``next_query``, null if absent, empty or not JSON."""
    return F.nullif(F.from_json(strip_fence(reply), "next_query STRING", _STRICT)["next_query"], F.lit(""))


def parse_action(reply: Column) -> Column:
    """struct(thought, action, action_input); anything but the three known actions means ``finish``, which says why.

    A reply that is no JSON object and one with another action keep their text as the thought.
    """
    raw = F.from_json(strip_fence(reply), "thought STRING, action STRING, action_input STRING", _STRICT)
    known = raw["action"].isin("search_dense", "search_bm25", "finish")
    blank = F.lit("")
    return F.when(
        F.coalesce(known, F.lit(False)),
        F.struct(
            F.coalesce(raw["thought"], blank).alias("thought"),
            raw["action"].alias("action"),
            F.coalesce(raw["action_input"], blank).alias("action_input"),
        ),
    ).otherwise(
        F.struct(F.coalesce(raw["thought"], strip_fence(reply), blank).alias("thought"), F.lit("finish").alias("action"), blank.alias("action_input"))
    )


def python_repr(text: Column) -> Column:
    """A string as Python shows it: in single quotes (double ones if it holds only single ones), line breaks and such escaped."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.contains(text, F.lit("'"))
    double = F.contains(text, F.lit('"'))
    plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places filled in one pass, so that inserted text is never filled again.

    Doubled braces stand for single ones.
    """
    out: list[Column] = []
    rest = template
    while rest:
        at = min((i for i in (rest.find("{"), rest.find("}")) if i >= 0), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        if rest[at : at + 2] in ("{{", "}}"):
            out.append(F.lit(rest[: at + 1]))
            rest = rest[at + 2 :]
            continue
        end = rest.index("}", at)
        out.append(F.lit(rest[:at]))
        out.append(values[rest[at + 1 : end]])
        rest = rest[end + 1 :]
    return F.concat(*out) if out else F.lit("")


def section_of(index: Column, total: Column) -> Column:
    """A guess of the section from a chunk's place in its paper (fixed bounds .15, .45 and .75)."""
    at = index / F.greatest(F.lit(1), total)
    return F.when(at < 0.15, "abstract").when(at < 0.45, "introduction").when(at < 0.75, "methods").otherwise("results")


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs: parts between blank lines, stripped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n"), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Non-blank sentences: parts after a full stop, exclamation or question mark and white space."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda p: p != "")


def paper_url(paper_id: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), F.regexp_replace(paper_id, "^arxiv:", ""))
