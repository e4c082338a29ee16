"""Exact nearest neighbours of query vectors, in blocks; and search by embedded text.

Rows never move: each task keeps one list of the best ``k`` a query over all its batches. Products of single
precision tell who may be among the best (within their error); only those are measured, in double precision.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.providers import Embedder, MockEmbedder
from lodesift.operators.lexical import PACKED, Best, few_tasks, merged, named, query_blocks
from lodesift.runtime import cut

#: Rows and components that a task holds at a time, and queries and rows of one product.
BLOCK_ROWS, BLOCK_CELLS, TILE_QUERIES, TILE_ROWS = 131_072, 16_000_000, 512, 512
#: Tiles from which the first limits are taken, whole ones only.
FIRST_TILES = 16


class VectorIndex:
    """Rows (chunk_id, ord, vec) ranked by L2 distance. All vectors have one length, checked once."""

    def __init__(self, rows: DataFrame, dim: int | None = None) -> None:
        vec = F.col("vec").cast("array<double>").alias("vec")
        self.rows = rows.select("chunk_id", "ord", vec)
        self.described = rows.select("chunk_id", "ord", vec, *(F.col(f"`{c}`") for c in rows.columns if c not in ("chunk_id", "ord", "vec")))
        # what every vector is known to have needs no pass over them
        sizes = self.rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first() if dim is None else (dim, dim)
        if sizes[0] is not None and sizes[0] != sizes[1]:
            raise ValueError(f"vectors of {sizes[0]} and {sizes[1]} components in one index")
        self.dim = sizes[0]

    @classmethod
    def of_texts(cls, chunks: DataFrame, text: str = "text", embedder: Embedder | None = None) -> VectorIndex:
        embedder = embedder or MockEmbedder()
        return cls(embedder.embed(chunks, text, "vec"), embedder.dim if isinstance(embedder, MockEmbedder) else None)

    def search(self, queries: DataFrame, k: int = 5, rows: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, ord, distance, rank) of the ``k`` nearest rows to each query (qid, vec), ties by ord."""
        source = self.rows if rows is None else rows
        parts = []
        for block in query_blocks(queries.select("qid", F.col("vec").cast("array<double>").alias("vec")), "vec"):
            parts.append(_written(self.found(block, k, source), source, block))
        if not parts:
            return source.sparkSession.createDataFrame([], "qid string, chunk_id string, ord bigint, distance double, rank bigint")
        return reduce(DataFrame.unionByName, parts)

    def found(self, block: list[tuple], k: int, rows: DataFrame | None = None) -> DataFrame:
        """(q, ord, distance, rank) for the queries ``block`` (qid, vec); q is their place."""
        if any(len(v) != self.dim for _, v in block) and self.dim is not None:
            raise ValueError(f"query vectors must have {self.dim} components")
        return _found(self.rows if rows is None else rows, block, k, _nearest(block, k))

    def search_where(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Like :meth:`search`, each query (qid, vec, wanted) among the rows that match its own filter ``wanted``.

        ``wanted`` maps fields to JSON literals. A row matches if every field equals its literal, typed
        (``"2025"`` is no 2025); a field that rows lack counts as null. All filters of a block of queries share
        one pass over the rows.
        """
        parts = []
        asked = queries.select("qid", F.struct(F.col("vec").cast("array<double>").alias("vec"), "wanted").alias("a"))
        for block in query_blocks(asked, "a"):
            filters = [tuple(sorted((a["wanted"] or {}).items())) for _, a in block]
            kinds = sorted(set(filters))
            place = {f: i for i, f in enumerate(kinds)}
            fields = sorted({name for f in kinds for name, _ in f})
            have = [f for f in fields if f in self.described.columns]
            # a value as one JSON object, {} where it is null
            shown = [F.to_json(F.struct(F.col(f"`{f}`").alias("v"))).alias(f"__{i}") for i, f in enumerate(have)]
            tests = [[(have.index(name) if name in have else -1, json.loads(value)) for name, value in f] for f in kinds]
            rows = self.described.select("chunk_id", "ord", "vec", *shown)
            vectors = [(q, a["vec"]) for q, a in block]
            scorer = _nearest(vectors, k, _matching(tests), np.array([place[f] for f in filters]))
            parts.append(_written(_found(rows, vectors, k, scorer), self.described, vectors))
        if not parts:
            return self.rows.sparkSession.createDataFrame([], "qid string, chunk_id string, ord bigint, distance double, rank bigint")
        return reduce(DataFrame.unionByName, parts)


def _found(rows: DataFrame, block: list[tuple], k: int, scorer: Callable) -> DataFrame:
    return merged(few_tasks(rows).mapInArrow(scorer, PACKED), len(block), k, False, "distance")


def _written(found: DataFrame, ids: DataFrame, block: list[tuple]) -> DataFrame:
    """(qid, chunk_id, ord, distance, rank) of a block of queries, written once, since callers read it more than once."""
    return cut(named(found, [(q, i) for i, (q, _) in enumerate(block)], ids, "distance"))


def _matching(tests: list[list[tuple[int, object]]]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """For a batch whose columns from the fourth on hold values as JSON: which rows pass each of the tests."""

    def same(a: object, b: object) -> bool:
        # text equals text only; numbers and truth values are compared by value
        return a == b and isinstance(a, str) == isinstance(b, str)

    def where(batch: pa.RecordBatch) -> np.ndarray:
        columns = []
        for k in range(3, batch.num_columns):
            coded = batch.column(k).dictionary_encode()
            values = [json.loads(v).get("v") for v in coded.dictionary.to_pylist()]
            columns.append((coded.indices.to_numpy(zero_copy_only=False), values))
        out = np.ones((len(tests), batch.num_rows), bool)
        for g, test in enumerate(tests):
            for at, wanted in test:
                if at < 0:
                    out[g] &= wanted is None
                else:
                    index, values = columns[at]
                    out[g] &= np.array([same(v, wanted) for v in values], bool)[index]
        return out

    return where


def _nearest(block: list[tuple], k: int, where: Callable[[pa.RecordBatch], np.ndarray] | None = None, kinds: np.ndarray | None = None):
    """Scores of a block of queries. With ``where`` and ``kinds`` a query of kind g sees the rows whose mark in column g is set."""
    asked, size = np.array([v for _, v in block], float), len(block)
    groups = [np.arange(size)] if kinds is None else [np.flatnonzero(kinds == g) for g in range(int(kinds.max()) + 1)]

    squares = (asked * asked).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Best(size, k, False)
        for ords, every, fits in _rows(batches, where):
            for g, members in enumerate(groups):
                rows = np.arange(len(every)) if fits is None else np.flatnonzero(fits[g])
                x = every[rows]
                if not len(x):
                    continue
                square = (x * x).sum(axis=1)
                largest = max(square.max(), squares[members].max()) if len(members) else 0.0
                kind, unit = (np.float32, 1.2e-7) if largest < 1e30 else (np.float64, 2.3e-16)
                tiles = [np.ascontiguousarray(np.column_stack([x[a : a + TILE_ROWS], square[a : a + TILE_ROWS], np.ones(len(x[a : a + TILE_ROWS]))]).T, kind) for a in range(0, len(x), TILE_ROWS)]
                product = np.empty(TILE_QUERIES * TILE_ROWS, kind)
                for lo in range(0, len(members), TILE_QUERIES):
                    mine = members[lo : lo + TILE_QUERIES]
                    q, own = asked[mine], squares[mine]
                    # squared distances less the query's own square and its limit: whoever is above 0 is out
                    left = np.column_stack([-2 * q, np.ones(len(q)), np.zeros(len(q))]).astype(kind)
                    # the product form is rough; whoever may be among the k is measured exactly
                    error = 1e-8 + (len(x[0]) + 5) * unit * 4 * (square.max() + own)
                    limit, waiting, due = _limits(lists, mine, own, error), [], 1
                    open_ = np.flatnonzero(np.isinf(limit))
                    if len(open_) and tiles[0].shape[1] > k:
                        # as many rows as minima over the first tiles are within the k-th least minimum
                        first, due = left[open_], min(FIRST_TILES, max(1, len(tiles) - 1))
                        low = reduce(np.minimum, (first @ wide for wide in tiles[:due]))
                        limit[open_] = np.partition(low, k - 1, axis=1)[:, k - 1] + 2 * error[open_]
                    left[:, -1] = -limit
                    for tile, wide in enumerate(tiles, 1):
                        rough = product[: len(q) * wide.shape[1]]
                        np.matmul(left, wide, out=rough.reshape(len(q), -1))
                        i, at = np.divmod(_below_zero(rough), wide.shape[1])
                        waiting.append((i, at + (tile - 1) * TILE_ROWS))
                        if tile == due or tile == len(tiles):
                            i, at = (np.concatenate(c) for c in zip(*waiting))
                            d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                            lists.offer(mine[i], d, ords[rows[at]])
                            limit, waiting, due = np.minimum(limit, _limits(lists, mine, own, error)), [], 2 * due
                            left[:, -1] = -limit
        yield from lists.packed()

    return run


def _below_zero(values: np.ndarray) -> np.ndarray:
    """The places of the values up to 0, few of many: a minimum of 16 is looked at first."""
    even = len(values) & ~15
    if not even:
        return (values <= 0).nonzero()[0]
    stripes = values[:even].reshape(16, -1)
    low = (stripes.min(axis=0) <= 0).nonzero()[0]
    i, j = (stripes[:, low] <= 0).nonzero()
    at = i * stripes.shape[1] + low[j]
    return at if even == len(values) else np.concatenate([at, even + (values[even:] <= 0).nonzero()[0]])


def _limits(lists: Best, mine: np.ndarray, own: np.ndarray, error: np.ndarray) -> np.ndarray:
    """The rough squared distances, less the query's own square, beyond which no row is among the best."""
    return (lists.worst(mine) + 1e-9) ** 2 - own + error


def _rows(batches: Iterator[pa.RecordBatch], where: Callable[[pa.RecordBatch], np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(ords, vectors, marks of the filters) of blocks of batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
    rows = cells = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        ords, vectors, fits = zip(*held)
        return np.concatenate(ords), np.concatenate(vectors), np.concatenate(fits, axis=1) if where else None

    for batch in batches:
        if not batch.num_rows:
            continue
        every = np.asarray(batch.column(2).flatten(), float).reshape(batch.num_rows, -1)
        held.append((batch.column(1).to_numpy(zero_copy_only=False), every, where(batch) if where else None))
        rows, cells = rows + len(every), cells + every.size
        if rows >= BLOCK_ROWS or cells >= BLOCK_CELLS:
            yield block()
            held, rows, cells = [], 0, 0
    if held:
        yield block()


def dense_search(index: VectorIndex, queries: DataFrame, k: int = 5, embedder: Embedder | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Nearest rows to the embedded text of each query (qid, question)."""
    embedded = (embedder or MockEmbedder()).embed(queries.select("qid", "question"), "question", "vec")
    return index.search(embedded, k, rows)
