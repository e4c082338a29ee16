"""BM25 ranking of every query against every document.

Documents and their texts never move. Each task reads its documents in blocks and keeps one list of the best
``k`` a query over all of them, so what is shuffled is at most k (ord, score) pairs per query and task, packed
into binary rows. Queries with the same terms are scored once. A query's terms are of two kinds: frequent terms
are added up as dense columns of single precision, most frequent first, and queries in the order of their terms
share the sums of the terms that they begin with; rare terms touch only the documents on their inverted lists.
A document on no rare list can only be among the best if its dense sum is, so no other is looked at. Single
precision only tells who may be among the best (within its error); those are scored in double precision.
Queries with fewer than ``k`` hits are filled up with the first documents (all scored 0).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.runtime import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
QUERY_BLOCK = 131_072
#: Documents (and words) that a task holds at a time, terms it counts at a time, and queries of one packed row.
BLOCK_DOCS, BLOCK_WORDS, MOST_TERMS, GROUP = 131_072, 16_000_000, 500_000, 256
#: Documents of which one maximum is kept while the best of a block are looked for, in blocks that have as many thousands.
STRIPES = 64
#: Most terms that are dense columns, and their cells in a block (6 bytes each); candidates that wait to be merged.
MOST_DENSE, MOST_CELLS, MOST_WAITING = 512, 48_000_000, 500_000
PACKED = "g int, q binary, ord binary, key binary"
_WORDS = re.compile("[a-z0-9]+")
#: Each byte lowered where it is part of a word, else 0.
_LOWERED = np.array([c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], np.uint8)


def query_blocks(queries: DataFrame, column: str, size: int = QUERY_BLOCK) -> Iterator[list[tuple]]:
    """(qid, column) rows of ``queries`` in blocks of about ``size``, each collected by itself."""
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = [(r[0], r[1]) for r in block.select("qid", column).collect()]
        if rows:
            yield rows


class Best:
    """The best ``k`` rows of each of ``n`` queries by a key rounded to nine decimals, ties by ord."""

    def __init__(self, n: int, k: int, descending: bool) -> None:
        self.k, self.sign = k, -1e9 if descending else 1e9
        self.order = np.full((n, k), np.inf)
        self.key = np.zeros((n, k))
        self.ords = np.zeros((n, k), np.int64)
        self.size = np.zeros(n, np.int64)

    def worst(self, q: int | np.ndarray) -> float | np.ndarray:
        """The key that another row has to reach (within 1e-9), endless where a list has room."""
        return self.order[q, self.k - 1] / self.sign

    def offer(self, q: np.ndarray, key: np.ndarray, ords: np.ndarray) -> None:
        """Rows ``ords`` with their keys for the queries ``q``; none twice, none that is held already."""
        order = np.rint(self.sign * key)
        fits = order <= self.order[q, self.k - 1]
        if not fits.any():
            return
        q, order, key, ords = q[fits], order[fits], key[fits], ords[fits]
        asked = np.unique(q)
        i, j = np.nonzero(np.arange(self.k) < self.size[asked, None])
        i = asked[i]
        q, order, key, ords = (np.concatenate(c) for c in ((i, q), (self.order[i, j], order), (self.key[i, j], key), (self.ords[i, j], ords)))
        at = _ranked(np.searchsorted(asked, q), order, ords)
        q = q[at]
        first = np.searchsorted(q, asked)
        count = np.diff(np.append(first, len(q)))
        rank = np.arange(len(q)) - np.repeat(first, count)
        top = rank < self.k
        q, rank, at = q[top], rank[top], at[top]
        self.order[q, rank], self.key[q, rank], self.ords[q, rank] = order[at], key[at], ords[at]
        self.size[asked] = np.minimum(count, self.k)

    def packed(self) -> Iterator[pa.RecordBatch]:
        """Everything held, one row (:data:`PACKED`) for each group of queries."""
        full = np.arange(self.k) < self.size[:, None]
        for lo in range(0, len(full), GROUP):
            some = full[lo : lo + GROUP]
            q = (np.nonzero(some)[0] + lo).astype(np.int32)
            values = (q, self.ords[lo : lo + GROUP][some], self.key[lo : lo + GROUP][some])
            yield pa.RecordBatch.from_arrays([pa.array([lo // GROUP], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["g", "q", "ord", "key"])


def _ranked(q: np.ndarray, order: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """``np.lexsort((ords, order, q))``, where ``q`` counts from 0; ``ords`` are looked at in ties only."""
    at = np.argsort(order)
    at = at[np.argsort(q[at].astype(np.uint16) if q.max(initial=0) < 65_536 else q[at], kind="stable")]
    same = (q[at[1:]] == q[at[:-1]]) & (order[at[1:]] == order[at[:-1]])
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        some = at[tied]
        at[tied] = some[np.lexsort((ords[some], order[some], q[some]))]
    return at


def merged(packed: DataFrame, n: int, k: int, descending: bool, value: str, fill: list[int] = ()) -> DataFrame:
    """(q, ord, ``value``, rank) of the best ``k`` of each of ``n`` queries over all packed lists.

    Queries with fewer than ``k`` rows get the documents ``fill`` that they lack, in order, with value 0.
    """
    sign = -1e9 if descending else 1e9
    first = np.array(fill, np.int64)

    def run(table: pa.Table) -> pa.Table:
        q, ords, key = (np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()]) for c, kind in (("q", np.int32), ("ord", np.int64), ("key", np.float64)))
        at = np.lexsort((ords, np.rint(sign * key), q))
        q, ords, key = q[at], ords[at], key[at]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        top = rank <= k
        q, ords, key, rank = q[top], ords[top], key[top], rank[top]
        lo = table.column("g")[0].as_py() * GROUP
        ids = np.arange(lo, min(n, lo + GROUP))
        begin, end = np.searchsorted(q, ids), np.searchsorted(q, ids, "right")
        more = [(q, ords, key, rank)]
        for i in np.flatnonzero(end - begin < k) if len(first) else ():
            have = ords[begin[i] : end[i]]
            new = first[~np.isin(first, have)][: k - len(have)]
            more.append((np.full(len(new), ids[i], np.int32), new, np.zeros(len(new)), len(have) + 1 + np.arange(len(new))))
        columns = (np.concatenate(c) for c in zip(*more))
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("q", "ord", value, "rank"), columns, (pa.int32(), pa.int64(), pa.float64(), pa.int64()))})

    return packed.groupBy("g").applyInArrow(run, f"q int, ord bigint, {value} double, rank bigint")


def named(found: DataFrame, places: list[tuple[str, int]], docs: DataFrame, value: str) -> DataFrame:
    """(qid, chunk_id, ord, ``value``, rank): rows of :func:`merged` with the ids of queries and documents."""
    spark = docs.sparkSession
    asked = spark.createDataFrame(pa.table({"qid": pa.array([p[0] for p in places], pa.string()), "q": pa.array([p[1] for p in places], pa.int32())}))
    return found.join(docs.select("ord", "chunk_id"), "ord").join(asked, "q").select("qid", "chunk_id", "ord", value, "rank")


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in a task for each core: every task keeps a list of its own for every query."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lowered words (runs of ASCII letters and digits) of all texts behind each other, and how many each text has."""
    # besides A to Z only these become ASCII letters when lowered
    for odd, plain in (("\u0130", "i\u0307"), ("\u212a", "k")):
        if pc.any(pc.match_substring(texts, odd)).as_py():
            texts = pc.replace_substring(texts, pattern=odd, replacement=plain)
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(len(texts) + 1, np.int64)
    low = _LOWERED[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = ends[(ends > 0) & (ends < len(low))]
    word = np.zeros(len(low) + 2, bool)
    word[1:-1] = low != 0
    starts, stops = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    # no word goes on in the next text
    starts[inside], stops[inside - 1] = word[1:-1][inside], word[1:-1][inside - 1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts + 1, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[low != 0])])
    return words, np.diff(np.searchsorted(starts, ends))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, words): in how many texts each term is; the row without a term has the number of texts and of words."""

    def rows() -> pa.RecordBatch:
        terms, counts = [None, *df], [n, *df.values()]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], names=["term", "n", "words"])

    df: Counter[str] = Counter()
    n = total = 0
    for batch in batches:
        words, sizes = words_of(batch.column(0))
        coded = words.dictionary_encode()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.sort(coded.indices.to_numpy().astype(np.int64) * max(1, len(sizes)) + doc)
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        counts = np.bincount(pairs // max(1, len(sizes)), minlength=len(coded.dictionary))
        n += len(sizes)
        total += len(words)
        df.update(dict(zip(coded.dictionary.to_pylist(), counts.tolist())))
        if len(df) > MOST_TERMS:
            yield rows()
            df.clear()
            n = total = 0
    yield rows()


class Bm25Index:
    """Okapi BM25 with k1 1.5, b 0.75 and negative inverse frequencies raised to a quarter of their mean."""

    def __init__(self) -> None:
        self.docs: DataFrame | None = None

    def build(self, docs: DataFrame) -> Bm25Index:
        """``docs`` has chunk_id, ord (unique) and text; null texts count as empty."""
        self.docs = docs.select("chunk_id", "ord", F.coalesce("text", F.lit("")).alias("text"))
        counts = self.docs.select("text").mapInArrow(_counted, "term string, n bigint, words bigint")
        counts = cut(counts.groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words")))
        head = counts.where("term IS NULL").first()
        self.n = head["df"] if head else 0
        self.avgdl = head["words"] / self.n if self.n else 0.0
        raw = F.log(F.lit(float(self.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        self.terms = counts.where("term IS NOT NULL").select("term", "df", raw.alias("raw"))
        mean = self.terms.agg(F.avg("raw")).first()[0] or 0.0
        # terms that most documents have may score below those that share none; then every score is ranked
        self.below_zero = mean < 0
        self.idf = self.terms.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
        return self

    def search(self, queries: DataFrame, k: int = 5, docs: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, ord, score, rank) for ``queries`` (qid, question); ``docs`` restricts what is ranked.

        Documents that share no term with a query rank last with score 0, by ord; a repeated query term
        counts every time. Raises if the index is not built.
        """
        if self.docs is None:
            raise RuntimeError("search() before build()")
        spark = self.docs.sparkSession
        docs = self.docs if docs is None else docs
        parts = []
        for rows in query_blocks(queries, "question"):
            found, places = self.found(rows, k, docs)
            # written once, since callers read it more than once
            parts.append(cut(named(found, places, docs, "score")))
        if not parts:
            return spark.createDataFrame([], "qid string, chunk_id string, ord bigint, score double, rank bigint")
        return reduce(DataFrame.unionByName, parts)

    def found(self, rows: list[tuple], k: int, docs: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
        """(q, ord, score, rank) for the queries ``rows`` (qid, question), and the q of each qid: those with the same terms share one."""
        if self.docs is None:
            raise RuntimeError("search() before build()")
        spark = self.docs.sparkSession
        docs = self.docs if docs is None else docs
        asked = [(q, sorted(_WORDS.findall((t or "").lower()))) for q, t in rows]
        vocabulary = sorted({w for _, ws in asked for w in ws})
        known = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string())}))
        terms = {r["term"]: (r["idf"], r["df"]) for r in self.idf.join(F.broadcast(known), "term").collect()} if vocabulary else {}
        # a query with fewer than k hits lacks at least k of these
        first = [r[0] for r in docs.select("ord").orderBy("ord").limit(2 * k).collect()]
        kinds: dict[tuple[str, ...], int] = {}
        places = [(q, kinds.setdefault(tuple(w for w in ws if w in terms), len(kinds))) for q, ws in asked]
        return merged(few_tasks(docs).mapInArrow(self._scorer(list(kinds), terms, k), PACKED), len(kinds), k, True, "score", first), places

    def _scorer(self, asked: list[tuple[str, ...]], terms: dict[str, tuple[float, int]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        avgdl, below_zero, size = self.avgdl or 1.0, self.below_zero, len(asked)
        counted = [Counter(ws) for ws in asked]
        # a term with its number of times in a query is an item; items by falling frequency
        items = sorted({x for c in counted for x in c.items()}, key=lambda x: (-terms[x[0]][1], x))
        place = {x: i for i, x in enumerate(items)}
        number = {w: i for i, w in enumerate(terms)}
        idf = np.array([v[0] for v in terms.values()])
        term_of, times = np.array([number[w] for w, _ in items], np.int64), np.array([m for _, m in items], float)
        df = np.array([terms[w][1] for w, _ in items], np.int64)
        wanted = sorted((tuple(sorted(place[x] for x in c.items())), q) for q, c in enumerate(counted))
        dense = len(items) if below_zero else _dense_items([ws for ws, _ in wanted], df, self.n)
        # what single precision may be off by: a rounding error a term, of the greatest sum
        reach = np.abs(idf[term_of]) * times * (K1 + 1)
        # sets of dense items in order: how many they share with the set before, and (query, rare items, error) of their queries
        sets: list[tuple[int, tuple[int, ...], list[tuple[int, tuple[int, ...], float]]]] = []
        longest = 0
        for ws, q in wanted:
            cut_at = bisect_left(ws, dense)
            frequent, rare = ws[:cut_at], ws[cut_at:]
            if not sets or sets[-1][1] != frequent:
                before = sets[-1][1] if sets else ()
                same = next((i for i, (a, b) in enumerate(zip(before, frequent)) if a != b), min(len(before), len(frequent)))
                sets.append((same, frequent, []))
                longest = max(longest, cut_at)
            sets[-1][2].append((q, rare, float(reach[list(ws)].sum()) * 1.2e-7 * (len(ws) + 2)))
        block_docs = max(1, min(BLOCK_DOCS, MOST_CELLS // max(1, dense)))
        # the dense items of each query behind each other, with their number and where they begin
        of_query: list[tuple[int, ...]] = [()] * size
        for _, frequent, members in sets:
            for q, _, _ in members:
                of_query[q] = frequent
        many = np.array([len(x) for x in of_query], np.int64)
        frequent_of = np.array([i for x in of_query for i in x], np.int32), many, np.cumsum(many) - many
        floor = -np.inf if below_zero else 4e-10

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = Best(size, k, True)
            for ords, lengths, term, doc, tf in _postings(batches, list(number), block_docs):
                n, norm = len(ords), K1 * (1 - B + B * lengths / avgdl)
                value = idf[term] * (tf * (K1 + 1) / (tf + norm[doc]))
                ends = np.searchsorted(term, np.arange(len(number) + 1)).tolist()
                # columns are laid out as stripes of one width, the rest of the last is no document
                stripes = max(1, min(STRIPES, n // 1024))
                width = -(-n // stripes)
                rough = np.zeros((dense, stripes * width), np.float32)
                most_tf = tf.max(initial=0)
                counts = np.zeros((dense, n), np.uint8 if most_tf < 256 else np.uint16 if most_tf < 65_536 else float)
                for i in range(dense):
                    lo, hi = ends[term_of[i]], ends[term_of[i] + 1]
                    rough[i, doc[lo:hi]] = value[lo:hi] * times[i]
                    counts[i, doc[lo:hi]] = tf[lo:hi]

                def exact(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
                    f = counts[item, doc].astype(float)
                    return idf[term_of[item]] * (f * (K1 + 1) / (f + norm[doc])) * times[item]

                spans = {}
                for i in range(dense, len(items)):
                    lo, hi = ends[term_of[i]], ends[term_of[i] + 1]
                    if lo < hi:
                        spans[i] = doc[lo:hi], value[lo:hi] * times[i]
                del term, doc, tf, value
                sums = np.zeros(n)
                stack = np.zeros((longest + 1, stripes * width), np.float32)
                stack[0, n:] = -np.inf
                bounds = lists.worst(np.arange(size)).tolist()
                waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
                held = 0
                for same, frequent, members in sets:
                    for j in range(same, len(frequent)):
                        np.add(stack[j], rough[frequent[j]], out=stack[j + 1])
                    base = stack[len(frequent)]
                    highs = base.reshape(stripes, width).max(axis=0)
                    highest = highs.max()
                    tops: dict[float, np.ndarray] = {}
                    for q, rare, error in members:
                        least = max(floor, bounds[q] - 1e-8 - error)
                        found = [spans[i] for i in rare if i in spans]
                        some = None
                        if found:
                            for d, v in found:
                                sums[d] += v
                            listed = found[0][0] if len(found) == 1 else np.concatenate([d for d, _ in found])
                            whole = base[listed] + sums[listed]
                            # a document is there once for every term at most
                            most = k * len(found)
                            if len(whole) > most:
                                least = max(least, np.partition(whole, len(whole) - most)[len(whole) - most] - 1e-8 - 2 * error)
                            some = listed[whole >= least]
                        if highest >= least:
                            if len(members) > 1 or least <= floor:
                                key = error
                                if key not in tops:
                                    tops[key] = _top(base, highs, k, floor, 1e-8 + 2 * error)
                                top = tops[key]
                                top = top[base[top] >= least]
                            else:
                                top = _top(base, highs, k, least, 1e-8 + 2 * error)
                            some = top if some is None else np.concatenate([some, top])
                        if some is not None and len(some):
                            waiting.append((q, some, sums[some]))
                            held += len(some)
                        if found:
                            sums[listed] = 0
                    if held > MOST_WAITING:
                        _offered(lists, waiting, exact, frequent_of, ords, floor)
                        waiting, held = [], 0
                if waiting:
                    _offered(lists, waiting, exact, frequent_of, ords, floor)
                # not held while the next block is read
                del rough, counts, exact, stack, spans, waiting
            yield from lists.packed()

        return run


def _offered(lists: Best, waiting: list[tuple[int, np.ndarray, np.ndarray]], exact: Callable[[np.ndarray, np.ndarray], np.ndarray], frequent_of: tuple[np.ndarray, ...], ords: np.ndarray, floor: float) -> None:
    """Offers (query, documents, what rare items add to them), scored in double precision; a document may be there twice."""
    q = np.repeat([w[0] for w in waiting], [len(w[1]) for w in waiting])
    doc, score = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
    _, once = np.unique(q * len(ords) + doc, return_index=True)
    q, doc, score = q[once], doc[once], score[once]
    items, many, begin = frequent_of
    dense, at = np.zeros(len(q)), np.arange(len(q))
    for j in range(int(many[q].max())):
        at = at[many[q[at]] > j]
        dense[at] += exact(items[begin[q[at]] + j], doc[at])
    score = dense + score
    some = score >= (floor if floor == -np.inf else 5e-10)
    lists.offer(q[some], score[some], ords[doc[some]])


def _top(base: np.ndarray, highs: np.ndarray, k: int, least: float, error: float) -> np.ndarray:
    """The places of all documents that may be among the best ``k`` by ``base`` and reach ``least``.

    ``highs`` are the maxima of ``base`` over documents a whole number of ``len(highs)`` apart.
    """
    if len(highs) > k:
        # as many documents as maxima reach the k-th greatest maximum
        least = max(least, np.partition(highs, len(highs) - k)[len(highs) - k] - error)
    some = (highs >= least).nonzero()[0]
    values = base.reshape(-1, len(highs))[:, some]
    i, j = (values >= least).nonzero()
    at, mine = i * len(highs) + some[j], values[i, j]
    if len(at) > k:
        at = at[mine >= np.partition(mine, len(mine) - k)[len(mine) - k] - error]
    return at


def _dense_items(wanted: list[tuple[int, ...]], df: np.ndarray, n: int) -> int:
    """How many of the most frequent items are dense columns: where the estimated work is least.

    ``wanted`` has the items of each query, sorted; ``df`` their frequencies, falling.
    """
    width = max((len(ws) for ws in wanted), default=0)
    if not width:
        return 0
    each = np.full((len(wanted), width), len(df), np.int64)
    for i, ws in enumerate(wanted):
        each[i, : len(ws)] = ws
    # whether a query's items so far differ from those of the query before
    new = np.ones(each.shape, bool)
    new[1:] = np.logical_or.accumulate(each[1:] != each[:-1], axis=1)
    sums, often = np.bincount(each[new], minlength=len(df) + 1)[:-1], np.bincount(each.ravel(), minlength=len(df) + 1)[:-1]
    sums, listed = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([np.cumsum((often * df)[::-1])[::-1], [0]])
    some = np.arange(min(len(df), MOST_DENSE) + 1)
    # a number added to a column against a document on a list, which is touched several times
    return int(some[np.argmin(0.5 * n * sums[some] + 40.0 * listed[some])])


def _postings(batches: Iterator[pa.RecordBatch], terms: list[str], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ords, lengths, term, doc, tf) of each block of documents; the last three by term, then document."""
    known, words, lengths, ords = pa.array(terms, pa.large_string()), [], [], []
    rows = seen = 0

    def block() -> tuple[np.ndarray, ...]:
        nonlocal words, lengths, ords, rows, seen
        ids, sizes, places = np.concatenate(words), np.concatenate(lengths), np.concatenate(ords)
        # not held while the block is scored
        words, lengths, ords, rows, seen = [], [], [], 0, 0
        here = ids >= 0
        key = ids[here].astype(np.int64) * len(sizes)
        key += np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[here]
        del ids, here
        key, tf = np.unique(key, return_counts=True)
        return places, sizes.astype(float), key // len(sizes), key % len(sizes), tf.astype(float)

    for whole in batches:
        for lo in range(0, whole.num_rows, most):
            batch = whole.slice(lo, most)
            if rows and rows + batch.num_rows > most:
                yield block()
            found, sizes = words_of(batch.column(2))
            words.append(pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False))
            lengths.append(sizes)
            ords.append(batch.column(1).to_numpy(zero_copy_only=False))
            rows, seen = rows + batch.num_rows, seen + len(found)
            if seen >= BLOCK_WORDS:
                yield block()
    if rows:
        yield block()
