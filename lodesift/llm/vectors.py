"""Most similar vectors for every vector, by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform, applied as butterflies)
turns a unit vector; its hash is the nearest signed axis. Several hashes make one bucket of one table; the
last of them may use some axes only, so that the number of buckets grows with the number of vectors
and buckets keep their size. Each vector lies in its own bucket of every table and is also looked up in
the next-likeliest ones (the second nearest axis of the hash that was closest to a tie).

How many tables are needed is found out beforehand. With a floor it follows from the cosine alone: pairs of
random vectors at the floor are hashed on the driver. Without one the true neighbours of a bounded
sample of vectors are found by comparing it with all, and tables are added until so many of them share a
bucket as wanted.

Equal vectors are one class before anything is hashed. What moves through the one shuffle of a round is the
bucket, the class and its components in four or eight bits each. Buckets are compared by matrix products of
bounded blocks; a bucket that holds more than ``BLOCK`` rows is cut into blocks which are compared in
pairs by different tasks, every pair of blocks exactly once. Without a floor the tables are taken in
rounds, and a round hands on only what is nearer than the neighbours known before. What is left is ranked
by its exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.runtime import cut, keep_keys

PROBES = 2
BLOCK = 4096
SEED = 20240611
#: Vectors a bucket, with a floor and without one, and the most tables.
PER_BUCKET, PER_BUCKET_OPEN, MOST_TABLES = 128, 1536, 48
#: Part of the pairs that shall share a bucket: at the floor, and of the sampled neighbours.
HIT, HIT_OPEN = 0.999, 0.96
#: Vectors whose true neighbours set the number of tables, and vectors that tell which buckets are hot.
SAMPLE, SIZED = 256, 10_000
#: Four-bit components put a cosine off by 0.03 (one standard deviation); the floor gives three of it.
SLACK = 0.085
#: Neighbours kept beyond those wanted until they are ranked exactly, and tables of the first round.
SPARE, FIRST_TABLES = 3, 2


def butterfly(x: np.ndarray) -> None:
    """Orthonormal fast Walsh-Hadamard transform of the columns, in place; their length is a power of two."""
    axes, h = x.shape[0], 1
    while h < axes:
        y = x.reshape(axes // (2 * h), 2, h, -1)
        total = y[:, 0] + y[:, 1]
        np.subtract(y[:, 0], y[:, 1], out=y[:, 1])
        y[:, 0] = total
        h *= 2
    x *= np.float32(axes**-0.5)


def pseudo_rotation(columns: np.ndarray, table: int, number: int) -> np.ndarray:
    """H D3 H D2 H D1 of unit vectors given as columns, for one hash of one table."""
    rng = np.random.default_rng((SEED, table, number))
    turned = np.ascontiguousarray(columns)
    for _ in range(3):
        turned = turned * rng.choice(np.array([-1, 1], np.float32), (len(columns), 1))
        butterfly(turned)
    return turned


def hash_axes(n: int, dim: int, per_bucket: int) -> list[int]:
    """How many axes each hash of a table uses, for about ``per_bucket`` of ``n`` vectors a bucket."""
    axes = 1 << max(1, (dim - 1).bit_length())
    left, out = n / per_bucket, []
    while left >= 2:
        out.append(min(axes, max(1, round(left / 2))))
        left /= 2 * out[-1]
    return out


def bucket_codes(unit: np.ndarray, axes_of: list[int], tables: list[int], probes: int = PROBES) -> np.ndarray:
    """Bucket codes, shape (rows, tables, probes); the first probe is the vector's own bucket.

    Without hashes there is one bucket a table and nothing to probe.
    """
    n, dim = unit.shape
    probes = max(1, min(probes, 1 + len(axes_of)))
    axes = 1 << max(1, (dim - 1).bit_length())
    columns = np.zeros((axes, n), np.float32)
    columns[:dim] = unit.T
    out = np.zeros((n, len(tables), probes), np.int64)
    every = np.arange(n)
    for at, t in enumerate(tables):
        code = np.zeros((len(axes_of), 2, n), np.int64)
        gap = np.zeros((len(axes_of), n), np.float32)
        for h, used in enumerate(axes_of):
            turned = pseudo_rotation(columns, t, h)[:used]
            signed = np.concatenate([turned, -turned])
            first = signed.argmax(axis=0)
            best = signed[first, every]
            signed[first, every] = -np.inf
            second = signed.argmax(axis=0)
            code[h] = first, second
            gap[h] = best - signed[second, every]
        order = np.argsort(gap, axis=0)
        for p in range(probes):
            bucket = np.full(n, t, np.int64)
            for h, used in enumerate(axes_of):
                bucket = bucket * (2 * used) + (np.where(order[p - 1] == h, code[h, 1], code[h, 0]) if p else code[h, 0])
            out[:, at, p] = bucket
    return out


def tables_until(x: np.ndarray, y: np.ndarray, axes_of: list[int], target: float) -> int | None:
    """How many tables it takes until this part of the pairs (rows of two unit matrices) share a bucket."""
    if not len(x):
        return 1
    met = np.zeros(len(x), bool)
    for t in range(MOST_TABLES):
        p, q = bucket_codes(x, axes_of, [t])[:, 0], bucket_codes(y, axes_of, [t])[:, 0]
        met |= (p == q[:, :1]).any(axis=1) | (q == p[:, :1]).any(axis=1)
        if met.mean() >= target:
            return t + 1
    return None


def tables_at_floor(n: int, dim: int, floor: float) -> tuple[list[int], int]:
    """Axes of the hashes, and tables until ``HIT`` of random pairs at cosine ``floor`` share a bucket."""
    axes_of = hash_axes(n, dim, PER_BUCKET)
    rng = np.random.default_rng(SEED)
    x, z = rng.standard_normal((2, 4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = floor * x + np.sqrt(1 - floor * floor) * z
    return axes_of, tables_until(x.astype(np.float32), y.astype(np.float32), axes_of, HIT) or MOST_TABLES


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and their float32 matrix: ``dim`` finite components, not all zero."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float32()).fill_null(np.nan)).reshape(len(rows), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def _classes(x: np.ndarray) -> np.ndarray:
    """A 64-bit id of each vector's bytes, minus zero counted as zero."""
    data = np.ascontiguousarray(x + np.float32(0))
    return np.array([int.from_bytes(blake2b(row.tobytes(), digest_size=8).digest(), "little") for row in data], np.uint64).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pack(unit: np.ndarray, bits: int) -> np.ndarray:
    """Four or eight bits a component, scaled by the largest; an odd number of components is padded."""
    top = np.abs(unit).max(axis=1, keepdims=True)
    if bits == 8:
        return np.rint(unit / top * 127).astype(np.int8).view(np.uint8)
    if unit.shape[1] % 2:
        unit = np.pad(unit, ((0, 0), (0, 1)))
    q = (np.rint(unit / top * 7).astype(np.int8) + 8).astype(np.uint8)
    return (q[:, ::2] << 4) | q[:, 1::2]


def _unpack(packed: np.ndarray, bits: int) -> np.ndarray:
    if bits == 8:
        q = packed.view(np.int8).astype(np.float32)
    else:
        q = np.empty((len(packed), packed.shape[1] * 2), np.float32)
        q[:, ::2] = packed >> 4
        q[:, 1::2] = packed & 15
        q -= 8
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    return q / np.where(norm == 0, 1, norm)


def class_members(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(key, cls) of every usable vector."""
    src = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{vec_col}`").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(_classes(x))], names=["key", "cls"]
                )

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, cls bigint")


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    """The matrix of a list column whose rows all have ``dim`` components."""
    return np.asarray(column.flatten()).reshape(-1, dim)


def postings(classes: DataFrame, dim: int, axes_of: list[int], tables: list[int], hot: dict[int, int], bits: int) -> DataFrame:
    """(unit, side, own, cls, floor, code): rows to compare, from classes (cls, v, floor), one a table and probe.

    ``hot`` names buckets that are cut into so many blocks: a row of block i goes to the units of all pairs
    with i. ``side`` is 0 where a unit is compared with itself, else 1 and 2 for its two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(hot), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_flat(batch.column(1), dim))
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            floor = batch.column(2).to_numpy(zero_copy_only=False)
            packed = _pack(unit, bits)
            codes = bucket_codes(unit, axes_of, tables)
            n, _, probes = codes.shape
            bucket = codes.reshape(-1)
            at = np.repeat(np.arange(n), len(tables) * probes)
            own = np.tile(np.arange(probes) == 0, n * len(tables))
            x = y = side = np.zeros(len(bucket), np.int64)
            split = np.flatnonzero(np.isin(bucket, known)) if len(known) else np.zeros(0, np.int64)
            if len(split):
                blocks = np.array([hot[b] for b in bucket[split].tolist()])
                mine = (cls[at[split]].view(np.uint64) >> np.uint64(20)).astype(np.int64) % blocks
                each = np.repeat(np.arange(len(split)), blocks)
                other = np.arange(len(each)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
                mine = mine[each]
                rest = np.setdiff1d(np.arange(len(bucket)), split, assume_unique=True)
                zero = np.zeros(len(rest), np.int64)
                x = np.r_[zero, np.minimum(mine, other) + 1]
                y = np.r_[zero, np.maximum(mine, other) + 1]
                side = np.r_[zero, np.where(mine == other, 0, np.where(mine < other, 1, 2))]
                take = np.r_[rest, split[each]]
                bucket, at, own = bucket[take], at[take], own[take]
            for lo in range(0, len(at), 100_000):
                a = at[lo : lo + 100_000]
                width = packed.shape[1]
                offsets = np.arange(0, (len(a) + 1) * width, width, dtype=np.int32)
                code = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(packed[a]).tobytes())])
                columns = [bucket[lo : lo + 100_000], x[lo : lo + 100_000], y[lo : lo + 100_000], side[lo : lo + 100_000].astype(np.int32), own[lo : lo + 100_000], cls[a], floor[a]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), code], names=["bucket", "x", "y", "side", "own", "cls", "floor", "code"])

    rows = classes.select("cls", "v", "floor").mapInArrow(run, "bucket bigint, x bigint, y bigint, side int, own boolean, cls bigint, floor float, code binary")
    return rows.select(F.xxhash64("bucket", "x", "y").alias("unit"), "side", "own", "cls", "floor", "code")


def _close(cls: np.ndarray, own: np.ndarray, side: np.ndarray, x: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one unit of work at or above the floor: at least one of the two in its own bucket.

    ``side`` is 0 where a whole bucket is compared with itself, else 1 and 2 for the two blocks.
    """
    left = np.flatnonzero(side != 2)
    right = np.flatnonzero(side != 1)
    for lo in range(0, len(left), 1024):
        i = left[lo : lo + 1024]
        s = x[i] @ x[right].T
        a, b = np.nonzero(s >= floor)
        a, b = i[a], right[b]
        fine = (cls[a] != cls[b]) & (own[a] | own[b])
        if len(a):
            yield np.minimum(cls[a], cls[b])[fine], np.maximum(cls[a], cls[b])[fine]


def _nearest(cls: np.ndarray, side: np.ndarray, floors: np.ndarray, x: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cls, other, cosine) of one unit of work: for each row the ``most`` nearest others above its own floor."""
    whole = np.arange(len(cls))
    first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    for left, right in ((first, second), (second, first)) if side.any() else ((whole, whole),):
        y = x[right].T
        for lo in range(0, len(left), 1024):
            i = left[lo : lo + 1024]
            s = x[i] @ y
            s[cls[i][:, None] == cls[right][None, :]] = -2
            least = np.maximum(floors[i], -1.5)
            many = np.flatnonzero((s > least[:, None]).sum(axis=1) > most)
            if len(many):
                kth = s.shape[1] - most
                least[many] = np.nextafter(np.partition(s[many], kth, axis=1)[:, kth], -np.inf, dtype=np.float32)
            a, b = np.nonzero(s > least[:, None])
            if len(a):
                yield cls[i[a]], cls[right[b]], s[a, b]


def compare(rows: DataFrame, schema: str, bits: int, solve) -> DataFrame:
    """``solve(cls, own, side, floor, vectors)`` of the rows (unit, side, own, cls, floor, code) of every unit.

    ``solve`` gives tuples of columns of ``schema``. Rows come in order of unit, and a unit is held whole.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finish(parts: list[tuple], keep_last: bool) -> tuple[list[tuple], list[tuple]]:
            columns = [np.concatenate([p[k] for p in parts]) for k in range(6)]
            unit, side, own, cls, floor, code = columns
            bounds = np.r_[0, np.flatnonzero(np.diff(unit)) + 1, len(unit)]
            last = len(bounds) - 2 if keep_last else len(bounds) - 1
            found = []
            for u in range(last):
                lo, hi = bounds[u], bounds[u + 1]
                if hi - lo > 1:
                    found += solve(cls[lo:hi], own[lo:hi], side[lo:hi], floor[lo:hi], _unpack(code[lo:hi], bits))
            return [tuple(c[bounds[last] :] for c in columns)] if keep_last else [], found

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(5)
            width = len(code[0].as_py())
            offset = np.frombuffer(code.buffers()[1], np.int32)[code.offset]
            raw = np.frombuffer(code.buffers()[2], np.uint8)[offset : offset + width * len(code)].reshape(len(code), width)
            held.append((*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)), raw.copy()))
            if held[-1][0][0] != held[-1][0][-1] or len(held) > 1:
                held, found = finish(held, True)
                if found:
                    yield out(found)
        if held:
            _, found = finish(held, False)
            if found:
                yield out(found)

    return rows.repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(run, schema)


def sized_sample(classes: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(cls, v) of about ``most`` classes or fewer, by hash, and how many classes each of them stands for."""
    step = max(1, -(-n // most))
    some = classes.where(F.pmod(F.xxhash64("cls", F.lit(SEED)), F.lit(step)) == 0).select("cls", "v").toArrow()
    if not some.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.float32), step
    v = some.column("v").combine_chunks()
    return some.column("cls").to_numpy(), np.asarray(v.flatten(), np.float32).reshape(some.num_rows, -1), step


def hot_buckets(x: np.ndarray, step: int, axes_of: list[int], tables: list[int]) -> dict[int, int]:
    """Buckets expected to hold more than ``BLOCK`` rows, and into how many blocks to cut them.

    A sample tells; what it misses is compared in one task all the same.
    """
    if not len(x):
        return {}
    codes, counts = np.unique(bucket_codes(_unit(x), axes_of, tables).reshape(-1), return_counts=True)
    big = counts * step > BLOCK
    return {int(b): int(-(-c * step // BLOCK)) for b, c in zip(codes[big], counts[big])}


def candidate_pairs(classes: DataFrame, n: int, dim: int, floor: float) -> DataFrame:
    """Distinct pairs of classes (a cut table cls, v) whose four-bit cosine comes near ``floor`` in a bucket."""
    axes_of, number = tables_at_floor(n, dim, floor)
    tables = list(range(number))
    _, x, step = sized_sample(classes, n, SIZED)
    rows = postings(classes.withColumn("floor", F.lit(0).cast("float")), dim, axes_of, tables, hot_buckets(x, step, axes_of, tables), 4)
    least = floor - SLACK

    def solve(cls, own, side, floors, v):
        return list(_close(cls, own, side, v, least))

    return compare(rows, "cls_a bigint, cls_b bigint", 4, solve).distinct()


def sampled_neighbours(classes: DataFrame, x: np.ndarray, ids: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sampled classes, repeated, and of their ``k`` true neighbours among all classes."""
    asked = _unit(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, near = np.full((len(asked), k), -2, np.float32), np.zeros((len(asked), k, dim), np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, cls = _unit(_flat(batch.column(1), dim)), batch.column(0).to_numpy(zero_copy_only=False)
            s = asked @ y.T
            s[ids[:, None] == cls[None, :]] = -2
            for r in np.flatnonzero(s.max(axis=1) > best[:, -1]).tolist():
                both = np.r_[best[r], s[r]]
                top = np.argsort(-both, kind="stable")[:k]
                near[r] = [near[r, t] if t < k else y[t - k] for t in top.tolist()]
                best[r] = both[top]
        row, nth = np.nonzero(best > -2)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * dim + 1, dim, dtype=np.int32)), pa.array(near[row, nth].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best[row, nth]), vectors], names=["row", "cosine", "v"])

    first = Window.partitionBy("row").orderBy(F.desc("cosine"), "v")
    found = classes.select("cls", "v").mapInArrow(run, "row bigint, cosine float, v array<float>")
    found = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).select("row", "v").toArrow()  # SAMPLE * k rows
    if not found.num_rows:
        return np.zeros((0, dim), np.float32), np.zeros((0, dim), np.float32)
    return asked[found.column("row").to_numpy()], np.asarray(found.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim)


def tables_for_sample(n: int, dim: int, x: np.ndarray, y: np.ndarray) -> tuple[list[int], int]:
    """Axes of the hashes, and tables until ``HIT_OPEN`` of the pairs share a bucket; buckets grow where no number suffices."""
    per_bucket = PER_BUCKET_OPEN
    while True:
        axes_of = hash_axes(n, dim, per_bucket)
        number = tables_until(x, y, axes_of, HIT_OPEN)
        if number is not None:
            return axes_of, number
        per_bucket *= 2


def open_neighbours(classes: DataFrame, n: int, dim: int, most: int) -> DataFrame:
    """Pairs (cls_a, cls_b), cls_a < cls_b, that hold the ``most`` nearest other classes of every class as hashing finds them."""
    ids, x, step = sized_sample(classes, n, SIZED)
    few = slice(0, SAMPLE)
    pairs = sampled_neighbours(classes, x[few], ids[few], dim, most) if len(ids) else (x, x)
    axes_of, number = tables_for_sample(n, dim, *pairs)
    held = most + SPARE

    def solve(cls, own, side, floors, v):
        return list(_nearest(cls, side, floors, v, held))

    known, done, size = None, 0, FIRST_TABLES
    while done < number:
        tables = list(range(done, min(number, done + size)))
        floors = classes.withColumn("floor", F.lit(-2).cast("float"))
        if known is not None:
            full = known.groupBy("cls").agg(F.min("cosine").alias("least"), F.count("*").alias("c")).where(F.col("c") == held)
            floors = classes.join(full, "cls", "left").select("cls", "v", F.coalesce("least", F.lit(-2)).cast("float").alias("floor"))
        rows = postings(floors, dim, axes_of, tables, hot_buckets(x, step, axes_of, tables), 8)
        found = compare(rows, "cls bigint, other bigint, cosine float", 8, solve)
        if known is not None:
            found = found.unionByName(known)
        # one shuffle by class serves the removal of repeats and the ranking
        best = Window.partitionBy("cls").orderBy(F.desc("cosine"), "other")
        merged = found.repartition("cls").groupBy("cls", "other").agg(F.max("cosine").alias("cosine"))
        known = cut(merged.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= held).drop("nth"))
        done += len(tables)
        size *= 3
    if known is None:
        return classes.sparkSession.createDataFrame([], "cls_a bigint, cls_b bigint")
    return cut(known.select(F.least("cls", "other").alias("cls_a"), F.greatest("cls", "other").alias("cls_b")).distinct())


def class_vectors(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """(cls, v) of every class that a batch holds."""
    src = df.select(F.col(f"`{vec_col}`").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(0), dim)
            if len(rows):
                cls, first = np.unique(_classes(x), return_index=True)
                flat = pa.array(x[first].astype(np.float32).ravel())
                offsets = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(offsets, flat)], names=["cls", "v"])

    return src.mapInArrow(run, "cls bigint, v array<float>")


def exact_cosines(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls_a, cls_b, cosine) in double precision; ``pairs`` and ``classes`` (cls, v) must be cut tables."""
    ends = cut(pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct())
    vectors = keep_keys(classes.select("cls", "v"), ends, "cls")
    one = vectors.select(F.col("cls").alias("cls_a"), F.col("v").alias("p"))
    two = vectors.select(F.col("cls").alias("cls_b"), F.col("v").alias("q"))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.asarray(batch.column(k).flatten()).reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_cosines(p, q))], names=["cls_a", "cls_b", "cosine"])

    joined = pairs.join(one, "cls_a").join(two, "cls_b").select("cls_a", "cls_b", "p", "q")
    return joined.mapInArrow(cosines, "cls_a bigint, cls_b bigint, cosine double")


def _cosines(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in double precision."""
    p, q = p.astype(np.float64), q.astype(np.float64)
    p = p / np.abs(p).max(axis=1, keepdims=True)
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    names: DataFrame,
    name_col: str,
    dim: int = 64,
    k: int = 5,
    floor: float | None = 0.9,
) -> DataFrame:
    """For every named vector its ``k`` most similar others: name, other, cosine, rank.

    ``names`` maps ``id_col`` to ``name_col``. Rows without exactly ``dim`` finite components that are not
    all zero, and rows without a name, take no part; repeated rows count once. Ties are ordered by name.
    With a ``floor`` only neighbours of at least that cosine are listed. Without one (None) every vector has
    its ``k``, as far as there are so many others. Both are found by hashing: a true neighbour is missed now
    and then (the recall against brute force is measured in the tests), and then the next one takes its place.
    """
    named = names.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{name_col}`").alias("name")).dropna()
    members = class_members(df, id_col, vec_col, dim).distinct().join(named, "key").select("cls", "name")
    members = cut(members.dropDuplicates(["name"]))
    # of a class of equal vectors only the first k + 1 names can be anyone's neighbours
    by_name = Window.partitionBy("cls").orderBy("name")
    targets = cut(members.withColumn("nth", F.row_number().over(by_name)).where(F.col("nth") <= k + 1).drop("nth"))
    named_only = keep_keys(class_vectors(df, vec_col, dim), cut(members.select("cls").distinct()), "cls")
    classes = cut(named_only.groupBy("cls").agg(F.first("v").alias("v")))
    n = classes.count()
    pairs = open_neighbours(classes, n, dim, k + 1) if floor is None else cut(candidate_pairs(classes, n, dim, floor))
    scored = exact_cosines(classes, pairs)
    if floor is not None:
        scored = scored.where(F.col("cosine") >= floor)
    both = scored.unionByName(scored.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"), "cosine"))
    # ties (equal to twelve decimals) go to the class whose first name is least
    firsts = targets.groupBy("cls").agg(F.min("name").alias("least")).withColumnRenamed("cls", "cls_b")
    nearest = Window.partitionBy("cls_a").orderBy(F.round("cosine", 12).desc(), "least")
    both = both.join(firsts, "cls_b").withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth", "least")
    several = targets.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1")
    same = several.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("cosine"))
    to = targets.select(F.col("cls").alias("cls_b"), F.col("name").alias("other"))
    options = both.unionByName(same).join(to, "cls_b").select("cls_a", "other", "cosine")
    first = Window.partitionBy("cls_a").orderBy(F.round("cosine", 12).desc(), "other")
    options = options.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
    listed = members.withColumnRenamed("cls", "cls_a").join(options, "cls_a").where("name <> other")
    rank = Window.partitionBy("name").orderBy(F.round("cosine", 12).desc(), "other")
    return listed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("name", "other", "cosine", "rank")
