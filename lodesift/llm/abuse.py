"""Scores for abusive, hateful or sexual content, from the nearest labelled examples.

Texts are folded (look-alike letters, letter-for-digit spellings, spread or repeated letters, accents and
invisible characters go) and cut into short segments; a segment is the bag of character 5-grams of its
words, weighted by TF-IDF with counts over all documents. Labelled documents give labelled
segments. A segment of a flagged document that its own neighbourhood in other documents calls clean is
ordinary text next to the offence and is dropped (Wilson editing). Every segment of every document is
then compared by exact cosine with the examples, through an inverted index in blocks: the largest weight
of each term, first over the whole index and then by block, bounds what a segment could reach, and only
blocks that could reach the floor are evaluated. Neighbours vote with the cube of their cosine, but never
a document's own label for itself; the document's score is its worst segment's vote, calibrated on the
votes that the labelled documents get.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.runtime import cut

#: Size of the hashed term space and of the table of document counts.
DIMS = 1 << 18
GRAM = 5
BLOCK = 64
#: At most so many labelled documents serve as examples, taken in the order of a hash of their id.
MOST_LABELLED = 8_000
FLOOR = 0.35
NEIGHBOURS = 15
SEGMENT_WORDS, STEP_WORDS = 26, 13
SEED_WEIGHT = 0.02
#: Segments of flagged documents stay examples if their neighbours elsewhere vote so, or, without
#: neighbours, if three of their terms are in fewer than one segment in a thousand.
EDIT, EDIT_FLOOR, RARE = 0.5, 0.25, 6.9
#: An example is dropped if its flags are less than this part (ENOUGH) of the labels to be expected for
#: wording of as many documents as have its rarer terms (percentile RARER of their counts),
#: unless small numbers fall that short by a chance of UNLIKELY or more.
RARER, ENOUGH, UNLIKELY = 30, 0.5, 0.1
#: Terms of this inverse frequency (in fewer than one segment in 150) count as rare.
RARE_TERM = 5.0
#: Offensive examples are kept in tiers by the length of their common part.
TIERS = (0.0, 0.1, 0.18, 0.25, 0.31, 0.45, 0.65, 1.01)

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOK_ALIKES = str.maketrans(
    "аАвВсСеЕнНкКмМоОрРтТхХуУіІјЈѕЅԁһӏαΑβΒεΕηΗιΙκΚμΜνΝοΟρΡτΤυΥχΧ",
    "aabbcceehhkkmmooppttxxyyiijjssdhlaabbeehhiikkmmnnoopptt" + "yyxx",
)
_SIGNS = str.maketrans("@431!0$57€", "aaeiiosste")
_SIGN_WORD = re.compile(r"[^\W\d_][@4310$57€]|[@4310$57€!][^\W\d_]", re.U)
_ODD = re.compile("[\u00ad\u0300-\u036f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_NAMES = re.compile(r"\b[A-Z][a-z]{2,}[A-Z]\w+|\b[A-Z]\w+-(?:\d+k|Eval)\b|\[[\w:.#/-]+\]")
_ENDS = re.compile(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])")
_REPEATS = re.compile(r"([^\W\d_])\1+", re.U)
_SPREAD = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*·]{1,2}){3,}[^\W\d_](?![^\W\d_])", re.U)
_GAPS = re.compile(r"[ .\-_*·]+")
_HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff]{2,}")
_NOT_LETTERS = re.compile(r"[\W\d_]+", re.U)


def fold(segment: str) -> str:
    """The lower-case words of a segment, each between spaces, spelling tricks undone, repeats collapsed."""
    s = _NAMES.sub(" ", segment)
    if not s.isascii():
        s = _ODD.sub("", unicodedata.normalize("NFKD", s)).translate(_LOOK_ALIKES)
    s = s.lower()
    if _SIGN_WORD.search(s):
        s = " ".join(w.translate(_SIGNS) if _SIGN_WORD.search(w) else w for w in s.split(" "))
    s = _SPREAD.sub(lambda m: _GAPS.sub("", m.group(0)), s)
    s = _REPEATS.sub(r"\1", s.replace("*", "").replace("'", " "))
    words = _NOT_LETTERS.sub(" ", s).strip()
    if not s.isascii():
        # scripts without spaces: every pair of characters is a word
        words = _HAN.sub(lambda m: " ".join(["", *(a + b + a for a, b in zip(m.group(0), m.group(0)[1:])), ""]), words).strip()
    return f" {words} " if words else ""


def segments(text: str | None) -> list[str]:
    """Sentences, and of sentences over ``SEGMENT_WORDS`` words the windows of that size, half overlapping."""
    out = []
    # letters set apart are drawn together first, so that they do not count as words
    text = _SPREAD.sub(lambda m: _GAPS.sub("", m.group(0)), text or "")
    for sentence in _ENDS.split(text):
        words = sentence.split()
        if len(words) <= SEGMENT_WORDS:
            if words:
                out.append(sentence)
        else:
            for i in range(0, len(words) - STEP_WORDS, STEP_WORDS):
                out.append(" ".join(words[i : i + SEGMENT_WORDS]))
    return out


@dataclass
class Bags:
    """Sparse rows: row r has terms[ptr[r]:ptr[r + 1]] with counts; owner names the text of each row."""

    ptr: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    owner: np.ndarray


def bags(texts: list[str | None]) -> Bags:
    """The 5-gram bags of all segments that have a word of three letters or more."""
    folded, owner = [], []
    for i, text in enumerate(texts):
        for s in segments(text):
            f = fold(s)
            if len(f) >= GRAM:
                folded.append(f)
                owner.append(i)
    if not folded:
        return Bags(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(f) for f in folded])
    row = np.repeat(np.arange(len(folded)), lengths)
    n = len(codes) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ codes[k : n + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    gap = codes == 32
    inside = row[:n] == row[GRAM - 1 :]
    for k in range(1, GRAM - 1):
        inside &= ~gap[k : n + k]  # a gram lies within one word and may touch its ends
    key = row[:n][inside].astype(np.int64) * DIMS + (h[inside] % np.uint64(DIMS)).astype(np.int64)
    if not len(key):
        return Bags(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    key, counts = np.unique(key, return_counts=True)
    has, first = np.unique(key // DIMS, return_index=True)
    return Bags(np.r_[first, len(key)].astype(np.int64), key % DIMS, counts, np.array(owner)[has])


def documents_with(b: Bags) -> np.ndarray:
    """How many texts have each term."""
    return np.bincount(np.unique(np.repeat(b.owner, np.diff(b.ptr)) * DIMS + b.terms) % DIMS, minlength=DIMS)


def weights(b: Bags, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each row of length 1."""
    w = (1 + np.log(b.counts)) * idf[b.terms]
    norm = np.sqrt(np.add.reduceat(w * w, b.ptr[:-1])) if len(w) else np.zeros(0)
    return (w / np.repeat(np.where(norm == 0, 1, norm), np.diff(b.ptr))).astype(np.float32)


class BlockMaxIndex:
    """Exact search of all rows with cosine at or above a floor; rows are grouped in blocks of 64."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, w: np.ndarray) -> None:
        rows = len(ptr) - 1
        # similar rows get close numbers, so that blocks are bounded tightly
        mixed = (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        order = np.argsort(np.minimum.reduceat(mixed, ptr[:-1]), kind="stable") if rows else np.zeros(0, np.int64)
        self.row = order
        sizes = np.diff(ptr)[order]
        self.ptr = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        take = np.repeat(ptr[:-1][order] - self.ptr[:-1], sizes) + np.arange(len(terms))
        self.terms, self.w = terms[take].astype(np.int32), w[take]
        block = np.repeat(np.arange(rows) // BLOCK, sizes).astype(np.int64)
        self.blocks = -(-rows // BLOCK)
        key = self.terms.astype(np.int64) * max(self.blocks, 1) + block
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0]) if len(key) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(self.w[by], first) if len(first) else np.zeros(0, np.float32)
        at = key[by][first] if len(first) else np.zeros(0, np.int64)
        self.bm_block, self.bm_top = (at % max(self.blocks, 1)).astype(np.int32), top
        self.bm_ptr = np.searchsorted(at // max(self.blocks, 1), np.arange(DIMS + 1)).astype(np.int64)
        self.top = np.zeros(DIMS, np.float32)
        np.maximum.at(self.top, self.terms, self.w)

    def bounds(self, b: Bags, w: np.ndarray) -> np.ndarray:
        """What each row of ``b`` could reach at most with any row of the index."""
        return np.add.reduceat(w * self.top[b.terms], b.ptr[:-1]) if len(w) else np.zeros(0)

    def search(self, terms: np.ndarray, w: np.ndarray, floor: float, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of all rows at or above the floor."""
        lo, hi = self.bm_ptr[terms], self.bm_ptr[terms + 1]
        sizes = hi - lo
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0)
        take = np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(total)
        bound = np.bincount(self.bm_block[take], np.repeat(w, sizes) * self.bm_top[take], self.blocks)
        scratch[terms] = w
        rows, cosines = [], []
        for blk in np.flatnonzero(bound >= floor - 1e-6).tolist():
            r0, r1 = blk * BLOCK, min((blk + 1) * BLOCK, len(self.row))
            p0, p1 = self.ptr[r0], self.ptr[r1]
            dots = np.add.reduceat(self.w[p0:p1] * scratch[self.terms[p0:p1]], self.ptr[r0:r1] - p0)
            good = np.flatnonzero(dots >= floor)
            rows.append(self.row[r0:r1][good])
            cosines.append(dots[good])
        scratch[terms] = 0
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(cosines)


class Offences:
    """The offensive examples, split by what their common terms alone could contribute.

    An example whose common part is shorter than the floor can only be reached over a rare term, since
    the common parts of two unit rows have at most the product of their lengths in common. Its index
    is asked only by segments that share rare terms with it; the others have their own index.
    """

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, w: np.ndarray, idf: np.ndarray) -> None:
        self.rare = idf >= RARE_TERM
        part = np.where(self.rare[terms], 0, w).astype(float)
        size = np.sqrt(np.add.reduceat(part * part, ptr[:-1])) if len(w) else np.zeros(0)
        self.indexes, self.common = [], []
        bag = Bags(ptr, terms, np.zeros(0), np.zeros(0))
        for low, high in zip(TIERS, TIERS[1:]):
            rows = np.flatnonzero((size >= low) & (size < high))
            if len(rows):
                self.indexes.append(BlockMaxIndex(*_pick(bag, w, rows)))
                self.common.append(float(size[rows].max()))

    def reachable(self, b: Bags, w: np.ndarray) -> np.ndarray:
        """For each row of ``b`` and each tier, whether a bound allows it to reach the floor."""
        out = np.zeros((len(b.owner), len(self.indexes)), bool)
        if not len(w):
            return out
        rare = self.rare[b.terms]
        start = b.ptr[:-1]
        common = np.sqrt(np.add.reduceat(np.where(rare, 0, w).astype(float) ** 2, start))
        for k, (index, most) in enumerate(zip(self.indexes, self.common)):
            by_rare = np.add.reduceat(np.where(rare, w * index.top[b.terms], 0), start)
            by_common = np.add.reduceat(np.where(rare, 0, w * index.top[b.terms]), start)
            out[:, k] = by_rare + np.minimum(by_common, common * most) >= FLOOR - 1e-6
        return out

    def near(self, terms: np.ndarray, w: np.ndarray, scratch: np.ndarray, tiers: np.ndarray) -> bool:
        return any(len(self.indexes[k].search(terms, w, FLOOR, scratch)[0]) for k in np.flatnonzero(tiers).tolist())


def _pick(b: Bags, w: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(b.ptr)[rows]
    ptr = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    take = np.repeat(b.ptr[:-1][rows] - ptr[:-1], sizes) + np.arange(ptr[-1])
    return ptr, b.terms[take], w[take]


def _vote(cos: np.ndarray, y: np.ndarray, doc: np.ndarray) -> tuple[float, np.ndarray]:
    """Distance-weighted share of flagged examples among the nearest, one vote a document; their order."""
    order = np.argsort(-cos, kind="stable")
    _, first = np.unique(doc[order], return_index=True)
    order = order[np.sort(first)][:NEIGHBOURS]
    v = cos[order].astype(float) ** 3
    return float((v * y[order]).sum() / (v.sum() + SEED_WEIGHT)), order


def _poisson_below(count: int, mean: float) -> float:
    """Chance of at most ``count`` events where ``mean`` are expected; the terms are summed as logarithms."""
    if mean <= 0:
        return 1.0
    i = np.arange(1, count + 1)
    logs = np.r_[0.0, np.cumsum(np.log(mean / i))] - mean
    return float(np.exp(logs).sum())


class Examples:
    """The segments of the labelled documents, before editing."""

    def __init__(self, docs: list[int], texts: list[str], y: list[float], counts: Counts) -> None:
        self.idf, self.held = counts.idf, counts.held
        self.labelled = len(texts) / max(1, counts.documents)
        self.bags = b = bags(texts)
        self.w = weights(b, self.idf)
        self.y = np.array(y, float)[b.owner] if len(b.owner) else np.zeros(0)
        self.doc = np.array(docs, np.int64)[b.owner] if len(b.owner) else np.zeros(0, np.int64)
        self.index = BlockMaxIndex(b.ptr, b.terms, self.w)

    def keeps(self, rows: np.ndarray) -> np.ndarray:
        """Which of these segments of flagged documents stay offensive examples."""
        b, w, idf = self.bags, self.w, self.idf
        scratch = np.zeros(DIMS, np.float32)
        out = np.zeros(len(rows), bool)
        for i, r in enumerate(rows.tolist()):
            terms = b.terms[b.ptr[r] : b.ptr[r + 1]]
            near, cos = self.index.search(terms, w[b.ptr[r] : b.ptr[r + 1]], EDIT_FLOOR, scratch)
            other = b.owner[near] != b.owner[r]
            near, cos = near[other], cos[other]
            # with no neighbour elsewhere the label of the own document stands, if the words are rare
            if len(near):
                keep = _vote(cos, self.y[near], b.owner[near])[0] >= EDIT
            else:
                keep = int((idf[terms] >= RARE).sum()) >= 3
            # reviewers meet offences at least half as often as other wording of as many documents, however many
            flagged = 1 + len(np.unique(b.owner[near[self.y[near] >= 0.5]]))
            expected = self.labelled * float(np.percentile(self.held[terms], RARER))
            out[i] = keep and (flagged >= ENOUGH * expected or _poisson_below(flagged, expected) >= UNLIKELY)
        return out


class Model:
    """The edited examples and their index; votes are calibrated by :func:`calibrate`."""

    def __init__(self, examples: Examples, keep: np.ndarray) -> None:
        rows = np.flatnonzero(keep)
        self.idf = examples.idf
        self.y, self.doc = examples.y[rows], examples.doc[rows]
        self.index = BlockMaxIndex(*_pick(examples.bags, examples.w, rows))
        self.offence = Offences(*_pick(examples.bags, examples.w, rows[self.y >= 0.5]), self.idf)

    def segment(self, terms: np.ndarray, w: np.ndarray, scratch: np.ndarray, tiers: np.ndarray, without: int | None = None) -> tuple[float, np.ndarray]:
        """Vote and nearest example documents of one segment; 0 without an offensive neighbour."""
        if not self.offence.near(terms, w, scratch, tiers):
            return 0.0, np.zeros(0, np.int64)
        rows, cos = self.index.search(terms, w, FLOOR, scratch)
        if without is not None:
            other = self.doc[rows] != without
            rows, cos = rows[other], cos[other]
        if not len(rows):
            return 0.0, np.zeros(0, np.int64)
        v, order = _vote(cos, self.y[rows], self.doc[rows])
        return v, self.doc[rows[order]]

    def score(self, docs: list[int | None], texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        """Raw vote and evidence (up to three example documents) of each text, without the document's own label."""
        raw = np.zeros(len(texts))
        evidence: list[list[int]] = [[] for _ in texts]
        b = bags(texts)
        if not len(b.owner) or not len(self.y):
            return raw, evidence
        w = weights(b, self.idf)
        scratch = np.zeros(DIMS, np.float32)
        could = self.offence.reachable(b, w)
        for r in np.flatnonzero(could.any(axis=1)).tolist():
            v, near = self.segment(b.terms[b.ptr[r] : b.ptr[r + 1]], w[b.ptr[r] : b.ptr[r + 1]], scratch, could[r], docs[b.owner[r]])
            if v > raw[b.owner[r]]:
                raw[b.owner[r]] = v
                evidence[b.owner[r]] = near[:3].tolist()
        return raw, evidence


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit (slope, offset) with a weak pull to a slope of 8 around one half."""
    a, c = 8.0, -4.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * raw + c)))
        g = np.array([((p - y) * raw).sum() + 0.5 * (a - 8), (p - y).sum() + 0.5 * (c + 4)])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * raw * raw).sum() + 0.5, (q * raw).sum()], [(q * raw).sum(), q.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.5)), float(c)


def best_threshold(raw: np.ndarray, y: np.ndarray) -> float:
    """The vote with the best F1 over the held-out documents, from one half to 0.7."""
    best, at = -1.0, 0.5
    for t in np.arange(0.50, 0.701, 0.05):
        hit = raw >= t
        f1 = 2 * (hit & y).sum() / max(1, hit.sum() + y.sum())
        if f1 > best + 1e-12:
            best, at = f1, float(t)
    return at


def _stretches(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Counts:
    """Over all documents: the segments and the documents that have each hashed term, all segments, all documents."""

    df: np.ndarray
    held: np.ndarray
    segments: int
    documents: int

    @property
    def idf(self) -> np.ndarray:
        return np.log((self.segments + 1) / (self.df + 1)).astype(np.float32)


def count_terms(docs: DataFrame) -> Counts:
    """Two tables of ``DIMS`` counts, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, segments_, documents = np.zeros(2 * DIMS, np.int64), 0, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            documents += len(texts)
            for lo, hi in _stretches(texts):
                b = bags(texts[lo:hi])
                seen[:DIMS] += np.bincount(b.terms, minlength=DIMS)
                seen[DIMS:] += documents_with(b)
                segments_ += len(b.owner)
        term = np.r_[np.flatnonzero(seen), 2 * DIMS, 2 * DIMS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.r_[seen[seen > 0], segments_, documents])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most 2 * DIMS + 2 rows, whatever the input
    all_ = np.zeros(2 * DIMS + 2, np.int64)
    all_[table["term"].to_numpy()] = table["n"].to_numpy()
    return Counts(all_[:DIMS], all_[DIMS : 2 * DIMS], int(all_[2 * DIMS]), int(all_[2 * DIMS + 1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Model, DataFrame]:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, flagged in 0..1), and the labels used, at most ``most``."""
    spark = docs.sparkSession
    some = cut(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "flagged").collect()  # bounded by most
    rows.sort(key=lambda r: r["doc_id"])
    examples = Examples([r["doc_id"] for r in rows], [r["text"] or "" for r in rows], [r["flagged"] for r in rows], count_terms(docs))
    flagged = np.flatnonzero(examples.y >= 0.5)
    keep = examples.y < 0.5
    if len(flagged):
        shared = spark.sparkContext.broadcast(examples)  # bounded by the labelled sample and DIMS
        tasks = max(1, min(len(flagged), 4 * spark.sparkContext.defaultParallelism))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    mine = flagged[at::tasks]
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(shared.value.keeps(mine))], names=["at", "keep"])

        edited = spark.range(0, tasks, 1, tasks).mapInArrow(run, "at bigint, keep boolean").toArrow()  # one row a flagged segment
        keep[edited.column("at").to_numpy()] = edited.column("keep").to_numpy(zero_copy_only=False)
    return Model(examples, keep), some


def label_shares(labels: DataFrame) -> DataFrame:
    """(doc_id, flagged): the share of flagged among the flagged and clean verdicts of each document."""
    verdict = F.lower(F.trim("verdict"))
    told = labels.where(F.col("doc_id").isNotNull() & verdict.isin("flagged", "clean"))
    return told.groupBy("doc_id").agg(F.avg((verdict == "flagged").cast("double")).alias("flagged"))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, keep: str | None = None) -> DataFrame:
    """(doc_id, score, flagged, evidence) of every document, and the string column ``keep`` of ``docs`` if one is named.

    ``docs`` has doc_id and text, ``labels`` doc_id and verdict (flagged, clean, others ignored). ``score``
    is a calibrated probability, ``flagged`` whether the vote reaches the threshold that is best on the
    held-out labelled documents, ``evidence`` up to three labelled documents nearest to the worst segment.
    Null, empty and letterless texts get the score of no evidence.
    """
    also = [keep] if keep else []
    docs = docs.select("doc_id", "text", *also)
    model, labelled = fit(docs, label_shares(labels), most)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the labelled sample and DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _stretches(texts):
                raw, evidence = m.score(ids[lo:hi], texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(raw),
                        pa.array(evidence, pa.list_(pa.int64())),
                        *(batch.column(2 + k).slice(lo, hi - lo) for k in range(len(also))),
                    ],
                    names=["doc_id", "raw", "evidence", *also],
                )

    schema = "doc_id bigint, raw double, evidence array<bigint>"
    voted = cut(docs.mapInArrow(run, schema + "".join(f", `{c}` string" for c in also)))
    # the labelled documents' votes, without their own labels, calibrate all of them
    told = voted.join(F.broadcast(labelled), "doc_id").select("doc_id", "raw", "flagged").dropDuplicates(["doc_id"]).collect()
    told.sort(key=lambda r: r["doc_id"])
    raw, y = np.array([r["raw"] for r in told]), np.array([r["flagged"] for r in told]) >= 0.5
    a, c = calibrate(raw, y.astype(float))
    score = 1 / (1 + F.exp(-(a * F.col("raw") + c)))
    flagged = (F.col("raw") > 0) & (F.col("raw") >= best_threshold(raw, y))
    return voted.select("doc_id", score.alias("score"), flagged.alias("flagged"), "evidence", *also)
