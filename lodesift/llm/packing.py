"""Filling containers of fixed capacity by non-negative least squares over the length histogram.

Only the histogram of lengths (at most ``capacity`` numbers) comes to the driver. There, shallow
combinations of lengths that fill a window below the capacity are enumerated; a non-negative least
squares fit finds how often to repeat each so that the histogram is used up; counts are rounded down;
what is left is packed greedily, a whole run of equal containers at a time. The result is a plan
(length, first rank, count, container) whose size depends on the capacity, not on the number of items.
Items then find their container from their rank among the items of their length, which salted windows
compute without gathering any length in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.runtime import cut

CAPACITY = 2048
#: Combinations may leave this many tokens unused.
SLACK = 4
SALTS = 64


def combinations(lengths: np.ndarray, capacity: int, slack: int = SLACK) -> list[dict[int, int]]:
    """Shallow combinations of present lengths filling [capacity - slack, capacity].

    Each repeats one length as often as wanted and completes it with at most two others, so it names
    three lengths at most. For every length a few repeat counts and a few partners are tried.
    """
    have = np.unique(lengths[(lengths > 0) & (lengths <= capacity)])
    found: dict[tuple, dict[int, int]] = {}

    def add(mix: dict[int, int]) -> None:
        total = sum(k * v for k, v in mix.items())
        if capacity - slack <= total <= capacity:
            found[tuple(sorted(mix.items()))] = mix

    def near(target: int) -> int | None:
        """The largest present length within the slack below the target."""
        i = np.searchsorted(have, target, "right") - 1
        return int(have[i]) if i >= 0 and have[i] >= target - slack else None

    for a in have.tolist():
        most = capacity // a
        for m in sorted({most, most - 1, most - 2, (most + 1) // 2, most // 4, 1} - {0, -1}):
            rest = capacity - m * a
            if rest <= slack:
                add({a: m})
                continue
            b = near(rest)
            if b is not None:
                add({a: m, b: 1} if b != a else {a: m + 1})
            options = have[have < rest]
            if len(options):
                picks = options[np.unique(np.linspace(0, len(options) - 1, 8).astype(int))]
                for b in picks.tolist():
                    c = near(rest - b)
                    if c is not None:
                        mix = {a: m}
                        for x in (b, c):
                            mix[x] = mix.get(x, 0) + 1
                        add(mix)
    return list(found.values())


def solve_counts(mixes: list[dict[int, int]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often to repeat each combination: min |A x - h|^2 over x >= 0, by accelerated projection."""
    if not mixes:
        return np.zeros(0)
    row = np.array([k for m in mixes for k in m])
    col = np.repeat(np.arange(len(mixes)), [len(m) for m in mixes])
    val = np.array([v for m in mixes for v in m.values()], float)
    weight = 1.0 / np.sqrt(np.maximum(histogram, 1.0))  # relative misfit, so that rare lengths count too
    val_w = val * weight[row]
    target = histogram * weight
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(col, val_w**2, len(mixes)), 1e-12))
    val_s = val_w * scale[col]
    # the largest eigenvalue bounds the step; a few power iterations find it
    v = np.ones(len(mixes))
    for _ in range(20):
        u = np.bincount(row, val_s * v[col], len(histogram))
        v = np.bincount(col, val_s * u[row], len(mixes))
        v /= np.linalg.norm(v) or 1.0
    u = np.bincount(row, val_s * v[col], len(histogram))
    step = 1.0 / max(1.05 * float(u @ u), 1e-12)
    x = y = np.zeros(len(mixes))
    t = 1.0
    for _ in range(rounds):
        misfit = np.bincount(row, val_s * y[col], len(histogram)) - target
        new = np.maximum(0.0, y - step * np.bincount(col, val_s * misfit[row], len(mixes)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, items, first container, items per container), and the containers used.

    ``histogram[n]`` counts the items of length n; all lengths 1..capacity are placed, each once.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(len(left), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def place(mix: dict[int, int], times: int) -> None:
        nonlocal containers
        for n, m in mix.items():
            rows.append((n, int(used[n]), m * times, containers, m))
            used[n] += m * times
            left[n] -= m * times
        containers += times

    mixes = combinations(np.flatnonzero(left), capacity)
    counts = np.floor(solve_counts(mixes, left.astype(float)) + 1e-6).astype(np.int64)
    for i in np.argsort(-counts, kind="stable").tolist():
        times = min([int(counts[i]), *(int(left[n]) // m for n, m in mixes[i].items())])
        if times > 0:
            place(mixes[i], times)
    # what rounding left: the longest first, each filled up with the longest that still fit
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return rows, containers
        mix: dict[int, int] = {}
        room = capacity
        top = len(present) - 1
        while top >= 0 and room > 0:
            top = min(top, int(np.searchsorted(present, room, "right")) - 1)
            if top < 0:
                break
            n = int(present[top])
            take = min(room // n, int(left[n]))
            if take:
                mix[n] = take
                room -= take * n
            top -= 1
        place(mix, max(1, min(int(left[n]) // m for n, m in mix.items())))


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, part, token_start, n_tokens, container_id) for every item.

    An item over the capacity fills as many whole containers as it can and its rest is packed like an
    item; no other item is split. Items of size 0 or null take no room and are spread over the containers
    (container 0 if there are no others). ``id_col`` must be unique. Sizes must not be negative.
    """
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0)).alias("size"))
    whole = F.expr(f"size div {capacity}")
    rest = F.col("size") % capacity
    last = whole - F.when((rest == 0) & (F.col("size") > 0), 1).otherwise(0)
    items = src.select("id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")).select(
        "id",
        F.col("part").cast("int").alias("part"),
        (F.col("part") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("id", "part"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    items = cut(items)
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    for r in items.groupBy("n_tokens", "salt").agg(F.count("*").alias("c")).collect():  # at most capacity * SALTS
        counts[r["n_tokens"], r["salt"]] = r["c"]
    rows, containers = plan(counts.sum(axis=1), capacity)
    before = np.cumsum(counts, axis=1) - counts
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one increasing key per plan row: length first, then rank
        big = int(counts.sum()) + 1
        keys = table[:, 0] * big + table[:, 1]
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            salt = batch.column(4).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64) - 1 + before[n, salt]
            at = np.maximum(np.searchsorted(keys, n * big + rank, "right") - 1, 0)
            if len(table):
                box = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
                box = np.where(n == 0, rank % max(containers, 1), box)
            else:
                box = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(box)], names=["id", "part", "token_start", "n_tokens", "container_id"]
            )

    ranked = items.withColumn("rn", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("id", "part")))
    kind = items.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"id {kind}, part int, token_start bigint, n_tokens int, container_id bigint")
