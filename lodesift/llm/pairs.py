"""Broken question-answer pairs: empty, copied, refused, foreign-language and truncated answers.

Refusals are found from the collection itself. The opening words of every sentence (names and figures
masked) are clustered by MinHash, verified on the exact sets. A cluster that recurs across unrelated
prompts, shares no words with them and mostly stands in answers without anything of the prompt is a refusal template; no listed
phrase is needed. A sentence that hardly ever stands without a template is padding. An answer of nothing
but templates and padding is a refusal. A declining phrase only lowers how often a cluster must recur. Copies,
languages and endings are checked pair by pair; whether a text without a final stop is finished is
decided by counts over all answers of how often the same (masked) ending closes a sentence and how often
it goes on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm import neardup
from lodesift.runtime import cut

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and to in is are was were that which with for on by as from it its this these not no than only "
    "but while because since how why what does do did when where who whose each every both between into over under "
    "their they we our be been has have had can could may might should would will there here more most less least "
    "without even if after before against about such rather so either neither nor i you your my yes then them one two",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht kein keine ist sind war wird werden "
    "wurde mit von vom zu zum zur auf aus bei für im in an am als auch nur dass weil wenn wie warum welche welcher "
    "welches welchen wir ich sie er es ihre sich über unter durch nach vor bevor sobald obwohl während statt hat haben "
    "kann können dafür dazu jede jeder jedes zwischen da leider mir mich dabei ja nein noch selten häufiger",
    "fr": "le la les un une des du de et ou à au aux en dans sur sous pour par avec sans est sont était ne pas que qui "
    "quoi quel quelle quels quelles pourquoi comment ce cette ces cet il elle ils elles nous vous je se sa son ses leur "
    "dont où mais car parce lorsque si plus moins comme entre alors tandis avant après chaque aucun aucune dès plutôt "
    "même bien été être avoir ont peut issue oui non peux sais suis",
    "es": "el la los las un una unos unas del de y o a al en con sin por para que qué quién cuál cuáles cómo cuándo dónde "
    "es son era se su sus no ni más menos como pero porque ya si cuando donde entre sobre hasta desde cada esta este "
    "estos estas ese esa esos esas lo le les nos fue ser está están ha han puede solo mientras aunque antes después ante "
    "según usa sí yo esto tan rara vez siendo",
}
_LANG = {name: frozenset(words.split()) for name, words in FUNCTION_WORDS.items()}
_FUNCTION = frozenset().union(*_LANG.values())

# What stands in place of an answer.
STAND_INS = frozenset(
    "n/a n.a. na n/d nan null none nil nul void undefined unknown empty blank missing tbd tba todo - k.a. s/o ninguno ninguna "
    "aucun aucune keine keiner entfällt <na> no_answer not_available #n/a".split()
) | {"no answer", "not available", "no value", "no data", "not applicable", "keine angabe", "sin respuesta", "pas de réponse"}

# Phrases by which an answer declines, in six languages.
DECLINING = re.compile(
    r"""
    \b(?:i|we)\s(?:really\s|also\s)?(?:can(?:no|')?t|can\snot|could\snot|couldn't|am\s(?:not\sable|unable)|are\s(?:not\sable|unable)
        |will\snot|won't|do\snot\s(?:know|have)|don't\s(?:know|have)|would\srather\snot|must\sdecline|have\sto\sdecline|prefer\snot|refuse\sto)\b
    |\bi'd\srather\snot\b|\bi'm\s(?:not\sable|unable|sorry|afraid)\b|\bi\sam\s(?:sorry|afraid)\b|\bas\san\sai\b
    |\bno\sanswer\scan\sbe\b|\bnot\smentioned\sin\s(?:the|any)\b|\b(?:not\senough|insufficient|no)\s(?:information|context|evidence)\b
    |\b(?:context|passages?|excerpts?|chunks?|documents?|text|sources?)\s(?:does|do)(?:\snot|n't)\s(?:contain|mention|provide|include|say|tell|allow)\b
    |\bnone\sof\sthe\s(?:excerpts|passages|chunks|documents|sources)\b|\brefrain\sfrom\b|\bagainst\smy\sguidelines\b|\bmust\sdecline\b
    |\bunable\sto\s(?:answer|verify|determine|find|help|provide)\b|\bcannot\sbe\s(?:answered|determined)\b
    |\btut\smir\sleid\b|\b(?:kann|können)\s(?:ich|wir|man)?\b.*\b(?:nicht|leider)\b.*\b(?:beantworten|helfen|sagen|antworten)\b
    |\bnicht\s(?:äußern|beantworten)\b|\benthalten\b.*\bkeine\s(?:angaben|informationen)\b|\benthält\b.*\bkeine\s(?:angaben|informationen)\b
    |\bich\sweiß\b.*\bnicht\b|\bweiß\sich\s(?:leider\s)?nicht\b|\bkeine\s(?:antwort|ausreichenden\sinformationen)\b
    |\bdésolée?\b|\bje\sne\s(?:peux|sais|suis|dispose|souhaite)\b|\bpréfère\sne\spas\b|\bne\s(?:contient|contiennent|permet|permettent)\b.*\b(?:aucune?|pas)\b
    |\bimpossible\sde\srépondre\b|\bpas\sen\smesure\b|\bn'est\spas\smentionnée?\b
    |\blo\ssiento\b|\bno\spuedo\b|\bno\ses\sposible\b|\bno\scontienen?\b.*\binformación\b|\bprefiero\sno\b|\bno\s(?:lo\s)?sé\b|\bno\shay\b.*\binformación\b
    |\bno\sse\smenciona\b|\bno\sdispongo\b
    |抱歉|无法回答|不知道|извините|не\sмогу|не\sзнаю
    """,
    re.X,
)

#: Words of a sentence that are its opening.
OPENING = 6
#: A cluster of openings recurs from so many prompts on, or from fewer where most of it declines.
PROMPTS, PROMPTS_DECLINING = 3, 1
#: Of a cluster's occurrences at most this part may share words with the prompt or hold figures, and this
#: part of its prompts may begin alike (or half more than all prompts do).
ECHO, ALIKE = 0.3, 0.75
#: This part of a template's occurrences stands in answers without any figure or word of the prompt.
WHOLE = 0.5
#: A sentence seen so often, and in this part of its occurrences beside a template, is padding.
PADS, BESIDE = 3, 0.6

#: A word that ends so many answers without a stop is a word, and no cut-off piece of one.
OFTEN = 3

_CITATION = re.compile(r"\s*\[arxiv:[^\]\s]*\]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;|```\w*|\\n|\\t")
_INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠋-᠎​-‏ -  -⁯　ㅤ︀-️﻿\x00-\x1f\x7f-\x9f]+")
_LETTERS = re.compile(r"[^\W\d_]+", re.U)
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W_]+(?:[-'’][^\W_]+)*", re.U)
_NAME = re.compile(r"^[^\W\d_]+[A-Z]\w*$|^[A-Z]\w*-\w+$|^\w*[a-z][A-Z]\w*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]]*\s+|(?<=[。！？])|\n+")
_CLOSED = re.compile(r"[.!?。！？][\"'”’»«)\]*`_]*$")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|»[^«]*«|«[^»]*»|`[^`]*`")
_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")
_LISTED = re.compile(r"\n\s*(?:[-*•]|\d+[.)])\s+\S[^\n]*$")
_HAN = re.compile(r"[一-鿿぀-ヿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LEAD = re.compile(r"^\W*(?:question|q|frage|pregunta|you asked|your question(?: was)?|the question(?: is)?)\s*[:：]\s*", re.I)


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but white space, invisible characters, punctuation, bare markup or a stand-in."""
    if answer is None:
        return True
    bare = _INVISIBLE.sub(" ", _TAG.sub(" ", answer)).strip().lower()
    if bare in STAND_INS or bare.strip(" .,;:!?*_#`'\"()[]{}<>|~-–—") in STAND_INS:
        return True
    return not re.search(r"[^\W_]", bare, re.U)


def language(text: str, least: int) -> tuple[str | None, dict[str, int]]:
    """The language with the most function words (or its own script), if there are at least ``least``."""
    letters = len(re.findall(r"[^\W\d_]", text))
    for name, script in (("zh", _HAN), ("ru", _CYRILLIC)):
        n = len(script.findall(text))
        if n >= 4 and n * 10 >= letters * 3:
            return name, {name: n}
    words = [w.lower() for w in _LETTERS.findall(text)]
    hits = {name: sum(w in known for w in words) for name, known in _LANG.items()}
    best = max(hits, key=hits.get)
    second = max(v for k, v in hits.items() if k != best)
    return (best if hits[best] >= least and hits[best] > second else None), hits


def other_language(question: str, answer: str) -> bool:
    """The answer is clearly in one language, the question in another; names and numbers decide nothing."""
    asked, _ = language(question, 1)
    given, hits = language(_CITATION.sub(" ", answer), 2)
    if asked is None or given is None or asked == given:
        return False
    return given in ("zh", "ru") or hits.get(asked, 0) * 2 <= hits[given]


def copies(question: str, answer: str) -> bool:
    """The answer gives back the question's words and adds none but the most trivial."""
    q = Counter(w.lower() for w in _WORD.findall(question))
    a = Counter(w.lower() for w in _WORD.findall(_LEAD.sub("", _CITATION.sub(" ", answer))))
    n, m, shared = sum(q.values()), sum(a.values()), sum((q & a).values())
    return n > 0 and m > 0 and shared >= 0.75 * n and m - shared <= max(1, 0.12 * m)


def mask(word: str) -> str:
    """Names as X, numbers as 9, function words as they are, other words as w."""
    if word[0].isdigit():
        return "9"
    if _NAME.match(word):
        return "X"
    low = word.lower()
    return low if low in _FUNCTION else "w"


def _masked(sentence: str, words: list[str]) -> list[str]:
    """A sentence's masked words behind a mark of its start, which differs for items of a list."""
    return ["<li>" if _ITEM.match(sentence) else "<s>", *(mask(w) for w in words)]


def _token(word: str) -> str:
    """A word in ASCII letters and digits, so that every script can be shingled."""
    return word if word.isascii() else "u" + word.encode("utf-8", "surrogatepass").hex()


def _said(text: str) -> list[str]:
    """The masked words of a stretch of text; scripts without spaces give single characters."""
    out = []
    for w in _WORD.findall(text):
        if w[0].isdigit():
            out.append("9")
        elif _HAN.match(w):
            out += w
        else:
            out.append("X" if _NAME.match(w) else w.lower())
    return out


def opening(words: list[str]) -> str:
    """The key of a sentence: a mark of its start and its first words, in ASCII."""
    return " ".join(["0", *(_token(w) for w in words[:OPENING])])


def sentences(answer: str) -> list[tuple[str, list[str]]]:
    """The sentences of an answer that have words, with their masked words."""
    out = []
    for s in _SENTENCE.split(_CITATION.sub("", answer).replace("’", "'")):
        words = _said(s)
        if words:
            out.append((s, words))
    return out


def declines(sentence: str) -> bool:
    """The sentence says itself, outside quotation marks and without figures, that it gives no answer."""
    bare = _QUOTED.sub(" ", sentence).lower()
    return bool(DECLINING.search(bare)) and not re.search(r"\d", re.sub(r"\S*[a-z]\S*\d\S*", " ", bare))


def ending(answer: str) -> tuple[str, list[str], str]:
    """How a text ends: state (``closed``, ``broken`` or ``open``), its last masked n-grams, its last word."""
    text = _INVISIBLE.sub(" ", answer).rstrip()
    raw = answer.rstrip()
    if raw.count("```") % 2 or len(re.findall(r"\[(?:arxiv:)?[^\]\s]*$", raw)) or raw.count("**") % 2:
        return "broken", [], ""
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$", raw) or re.search(r"\([^()]*$", _SENTENCE.split(raw)[-1]):
        return "broken", [], ""
    text = _CITATION.sub("", text).rstrip()
    if re.search(r"[,;:([{/&+=–—-]$|\.\.\.$|…$", text):
        return "broken", [], ""
    if _CLOSED.search(text) or not text:
        return "closed", [], ""
    last = _SENTENCE.split(_CITATION.sub("", raw))[-1]
    words = _WORD.findall(last)
    if not words:
        return "closed", [], ""
    masked = _masked(last, words)
    # a name or a figure may be seen here only; its being known says nothing
    known = "" if masked[-1] in ("X", "9") else words[-1].lower()
    return "open", [" ".join(masked[-n:]) for n in (5, 4, 3, 2)], known


_FEATURES = (
    "src string, pair_key string, empty boolean, copied boolean, foreign boolean, state string, grams array<string>, "
    "last_word string, listed boolean, sentences int, prompt bigint, kind string, plain boolean, "
    "units array<struct<key: string, figure: boolean, echo: boolean, cue: boolean>>"
)
_UNITS = pa.list_(pa.struct([("key", pa.string()), ("figure", pa.bool_()), ("echo", pa.bool_()), ("cue", pa.bool_())]))
_TYPES = [pa.string()] * 2 + [pa.bool_()] * 3 + [pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), _UNITS]


def features(pairs: DataFrame) -> DataFrame:
    """What is seen in each pair (src, pair_key, question, answer) by itself.

    ``units`` has the opening of every sentence, whether the sentence holds a figure, whether it shares
    words with the prompt, and whether it declines; ``plain`` answers hold no figures at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, key, question, answer in zip(*(c.to_pylist() for c in batch.columns)):
                if is_empty(answer):
                    rows.append((src, key, True, False, False, "closed", [], "", False, 0, 0, "", False, []))
                    continue
                asked = _said(question)
                kind = asked[0] if asked else ""
                prompt = int.from_bytes(blake2b(" ".join(asked).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                content = set(asked) - _FUNCTION - {"X", "9"}
                state, grams, last = ending(answer)
                parts = sentences(answer)
                plain = not any("9" in words for _, words in parts)
                said = [
                    {"key": opening(words), "figure": "9" in words, "echo": not content.isdisjoint(words), "cue": plain and declines(s)} for s, words in parts
                ]
                rows.append(
                    (src, key, False, copies(question, answer), other_language(question, answer), state, grams, last, bool(_LISTED.search(answer)), len(said), prompt, kind, plain, said)
                )
            if rows:
                names = re.findall(r"(?:^|, )(\w+) (?=string|boolean|array|int|bigint)", _FEATURES)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], names=names)

    return pairs.select("src", "pair_key", "question", "answer").mapInArrow(run, _FEATURES)


def ending_counts(pairs: DataFrame) -> DataFrame:
    """(kind, item, ends, goes_on) over all answers: masked n-grams (kind g) and words (kind v).

    For an n-gram: how often a sentence or answer ends with it and how often it continues; for a word:
    how often it stands anywhere but at the open end of an answer, and how often there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, goes, seen, left = Counter(), Counter(), Counter(), Counter()
            for answer in batch.column(0).to_pylist():
                if not answer:
                    continue
                sentences = [s for s in _SENTENCE.split(_CITATION.sub("", answer)) if s.strip()]
                for k, s in enumerate(sentences):
                    words = _WORD.findall(s)
                    open_end = k == len(sentences) - 1 and not _CLOSED.search(s.rstrip())
                    seen.update(w.lower() for w in (words[:-1] if open_end else words))
                    if open_end and words:
                        left[words[-1].lower()] += 1
                    masked = _masked(s, words)
                    for i in range(1, len(masked)):
                        into = ends if i == len(masked) - 1 else goes
                        for n in (5, 4, 3, 2):
                            if n <= i + 1:
                                into[" ".join(masked[i + 1 - n : i + 1])] += 1
            keys = list(ends.keys() | goes.keys())
            words = list(seen.keys() | left.keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["g"] * len(keys) + ["v"] * len(words), pa.string()),
                    pa.array(keys + words, pa.string()),
                    pa.array([ends[x] for x in keys] + [seen[x] for x in words], pa.int64()),
                    pa.array([goes[x] for x in keys] + [left[x] for x in words], pa.int64()),
                ],
                names=["kind", "item", "ends", "goes_on"],
            )

    counted = pairs.select("answer").mapInArrow(run, "kind string, item string, ends bigint, goes_on bigint")
    return counted.groupBy("kind", "item").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def refusing_answers(seen: DataFrame, similarity: float = 0.6) -> DataFrame:
    """(src, pair_key) of the answers that only refuse, from a cut table of :func:`features`.

    Only openings of answers without figures are clustered (an answer with one is no refusal), but the
    counts of a cluster are over all answers. Nothing is compared but distinct openings.
    """
    # an answer says something of its own if it holds a figure or a word of the prompt, which cannot be
    # told of one in another language
    idle = F.col("plain") & ~F.col("foreign") & ~F.exists("units", lambda u: u["echo"])
    said = seen.select("src", "pair_key", "prompt", "kind", "plain", "sentences", idle.alias("idle"), F.explode("units").alias("u"))
    said = said.select("src", "pair_key", "prompt", "kind", "plain", "sentences", "idle", "u.*")
    sums = ("n", "figures", "echoes", "cues", "idle")
    counted = cut(
        said.groupBy("key", "kind", "prompt").agg(
            F.count("*").alias("n"),
            F.count_if("figure").alias("figures"),
            F.count_if("echo").alias("echoes"),
            F.count_if("cue").alias("cues"),
            F.count_if("idle").alias("idle"),
            F.max("plain").alias("plain"),
        )
    )
    keys = counted.where("plain").select("key").distinct()
    groups = cut(neardup.near_duplicates(keys, "key", "key", words=2, similarity=similarity).select("key", F.col("group_id").alias("grp")))
    by_prompt = counted.join(groups, "key").groupBy("grp", "kind", "prompt").agg(*(F.sum(c).alias(c) for c in sums))
    by_kind = by_prompt.groupBy("grp", "kind").agg(F.count("*").alias("prompts"), *(F.sum(c).alias(c) for c in sums))
    # how many of all prompts begin alike
    kinds = cut(seen.select("kind", "prompt").distinct().groupBy("kind").agg(F.count("*").alias("alike")))
    every = kinds.agg(F.sum("alike").alias("every"))
    share = kinds.crossJoin(F.broadcast(every)).select("kind", (1.5 * F.col("alike") / F.col("every")).alias("usual"))  # one row
    by_group = by_kind.join(share, "kind").groupBy("grp").agg(
        F.sum("prompts").alias("p"), F.max(F.struct("prompts", "usual")).alias("top"), *(F.sum(c).alias(c) for c in sums)
    )
    varied = F.col("top.prompts") <= F.greatest(F.lit(ALIKE), F.col("top.usual")) * F.col("p")
    recurs = ((F.col("p") >= PROMPTS) & varied & (F.col("echoes") <= ECHO * F.col("n"))) | (
        (2 * F.col("cues") >= F.col("n")) & (F.col("p") >= PROMPTS_DECLINING)
    )
    chosen = by_group.where(recurs & (F.col("figures") <= ECHO * F.col("n")) & (F.col("idle") >= WHOLE * F.col("n"))).select("grp")
    templates = cut(groups.join(chosen, "grp", "left_semi").select("key").withColumn("refuses", F.lit(1)))
    marked = said.select("src", "pair_key", "sentences", "plain", "key").join(templates, "key", "left")
    beside = marked.groupBy("src", "pair_key").agg(F.count("refuses").alias("refusals")).where("refusals > 0")
    near = marked.where("refuses is null").join(beside, ["src", "pair_key"], "left").groupBy("key").agg(F.count("*").alias("c"), F.count("refusals").alias("with"))
    padding = near.where((F.col("c") >= PADS) & (F.col("with") >= BESIDE * F.col("c"))).select("key").withColumn("pads", F.lit(1))
    judged = marked.where("plain").join(padding, "key", "left").groupBy("src", "pair_key").agg(
        F.count("refuses").alias("refusals"), F.count(F.coalesce("refuses", "pads")).alias("spent"), F.max("sentences").alias("n")
    )
    return judged.where("refusals > 0 and spent = n").select("src", "pair_key").distinct()


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(src, pair_key, defect) of every broken pair; at most one row per src and pair_key.

    ``pairs`` has src, pair_key, qid, question and answer. Pairs with a null or blank question are no
    case. Where several defects hold, the first of empty, copies_question, refusal, other_language and
    truncated is given; of repeated keys the first in that order.
    """
    asked = cut(pairs.where(F.col("question").isNotNull() & F.col("question").rlike(r"\S")))
    seen = cut(features(asked))
    refused = refusing_answers(seen).withColumn("refused", F.lit(True))
    # endings
    counts = cut(ending_counts(asked))
    open_ = seen.where("state = 'open'")
    grams = open_.select("src", "pair_key", F.posexplode("grams").alias("at", "item"))
    stats = grams.join(counts.where("kind = 'g'").drop("kind"), "item")
    # the longest n-gram that was seen often enough besides this once
    chosen = stats.where("ends + goes_on >= 4").groupBy("src", "pair_key").agg(F.min_by(F.struct("ends", "goes_on"), "at").alias("s"))
    words = counts.where("kind = 'v'").select(F.col("item").alias("last_word"), (F.col("ends") + F.floor(F.col("goes_on") / OFTEN)).alias("word_n"))
    finished = open_.select("src", "pair_key", "last_word", "sentences", "listed").join(words, "last_word", "left").join(chosen, ["src", "pair_key"], "left")
    share = F.coalesce(F.col("s.ends") / (F.col("s.ends") + F.col("s.goes_on")), F.lit(0.0))
    cut_off = ((F.col("last_word") != "") & (F.coalesce("word_n", F.lit(0)) == 0)) | (share < F.when((F.col("sentences") > 1) & ~F.col("listed"), 0.5).otherwise(0.2))
    stopped = finished.where(cut_off).select("src", "pair_key").distinct().withColumn("stopped", F.lit(True))
    all_ = seen.select("src", "pair_key", "empty", "copied", "foreign", "state").join(refused, ["src", "pair_key"], "left").join(stopped, ["src", "pair_key"], "left")
    order: Column = (
        F.when(F.col("empty"), 0)
        .when(F.col("copied"), 1)
        .when(F.col("refused"), 2)
        .when(F.col("foreign"), 3)
        .when((F.col("state") == "broken") | F.col("stopped"), 4)
    )
    names = F.array(*(F.lit(x) for x in ("empty", "copies_question", "refusal", "other_language", "truncated")))
    found = all_.withColumn("which", order).where("which is not null").groupBy("src", "pair_key").agg(F.min("which").alias("which"))
    return found.select("src", "pair_key", F.element_at(names, F.col("which") + 1).alias("defect"))
