"""Near-duplicate texts by pigeonring filtering over ring-shaped signatures.

Every text becomes the set of its consecutive word n-grams (shingles, as 64-bit hashes). Three things
are derived from a set in one pass:

* ``BOXES`` boxes of some min-hash symbols each (:func:`symbols_of`), laid out on a ring,
* the ring itself: two bits of every box,
* an odd sketch of 512 bits (the parity of hits per bit), whose Hamming distance never exceeds the
  size of the symmetric difference of two sets.

Sets that agree in a whole box are a candidate *start*. From that start the pigeonring test follows the
ring: in every chain of consecutive boxes the cumulative number of differing bits must stay within the
chain's proportional share of the whole budget. The test is part of the join condition, so a pair that
fails it is never written anywhere. Survivors take the full Hamming check on the odd sketches (which
cannot lose a pair, because the sketch distance is a lower bound), then the exact check on the shingles.
Starts and chains are statistical: both are derived from the similarity so that a pair right at it is lost
with a probability below one in a thousand, and similarities below one half, where no such test works,
are refused.

Equal sets become one class, one row, before anything is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.runtime import cut, keep_keys

BOXES, MOST_SYMBOLS = 32, 4
#: Part of the pairs right at the similarity that may share no box.
MISSED = 5e-4
#: Two sets of similarity s differ in (1 - s) / 2 of the ring bits on average; so much more is allowed.
RING_ROOM = 0.2
SKETCH_WORDS = 8
#: Chains checked from a start, in boxes.
CHAINS = (8, 16, 24, 32)

_WORDS = re.compile(r"[a-z0-9]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's fixed constants)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_SEEDS = ((_mix(np.arange(1, BOXES * MOST_SYMBOLS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)) | _U(1)).astype(np.uint32)


def symbols_of(similarity: float) -> int:
    """Symbols a box: as many as lose at most ``MISSED`` of the pairs at ``similarity``, at least two."""
    fine = [r for r in range(2, MOST_SYMBOLS + 1) if (1 - similarity**r) ** BOXES <= MISSED]
    return fine[-1] if fine else 2


class _WordHashes:
    """64-bit hashes of words, with a bounded memory of those seen."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, word: str) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= self.most:
                self.known.clear()
            value = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
            self.known[word] = value
        return value


def shingle_sets(texts: list[str], words: int, hashes: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts behind each other.

    Returns (indexes of the texts that have shingles, where each of them starts, hashes).
    """
    tokens = [_WORDS.findall(t.lower()) if t else [] for t in texts]
    which = [i for i, t in enumerate(tokens) if len(t) >= words]
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    lengths = np.array([len(tokens[i]) for i in which])
    h = np.fromiter((hashes(w) for i in which for w in tokens[i]), dtype=_U, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(which)), lengths)
    n = len(h) - words + 1
    s = np.zeros(n, _U)
    for k in range(words):
        s = _mix(s + h[k : n + k] * _U(2 * k + 1))
    inside = owner[:n] == owner[words - 1 :]
    s, owner = s[inside], owner[:n][inside]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[first], owner[first]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.array(which), starts, s


def signatures(starts: np.ndarray, s: np.ndarray, per_box: int) -> dict[str, np.ndarray]:
    """Class id, size, box keys, ring and odd sketch of each set, with ``per_box`` symbols a box."""
    docs = len(starts)
    sizes = np.diff(np.r_[starts, len(s)])
    with np.errstate(over="ignore"):
        ids = _mix(np.add.reduceat(_mix(s), starts) + np.bitwise_xor.reduceat(s * _U(0x9E3779B97F4A7C15), starts))
        small = (s >> _U(32)).astype(np.uint32)
        symbols = np.empty((docs, BOXES * per_box), np.uint32)
        for k, seed in enumerate(_SEEDS[: BOXES * per_box]):
            x = small * seed
            symbols[:, k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts)
        boxes = np.zeros((docs, BOXES), _U)
        for r in range(per_box):
            boxes = _mix(boxes + symbols[:, r::per_box].astype(_U) + _U(r))
        boxes = _mix(boxes + np.arange(BOXES, dtype=_U) * _U(0xD6E8FEB86659FD93))
        ring = np.zeros(docs, _U)
        bits = (_mix(symbols.astype(_U)) & _U(1)).reshape(docs, BOXES, per_box)[:, :, :2].reshape(docs, 64)
        for b in range(64):
            ring |= bits[:, b] << _U(b)
    owner = np.repeat(np.arange(docs), sizes)
    cell = owner * 512 + (s & _U(511)).astype(np.int64)
    parity = (np.bincount(cell, minlength=docs * 512) & 1).astype(np.uint8).reshape(docs, 512)
    sketch = np.packbits(parity, axis=1).view(np.int64)
    return {"ids": ids, "sizes": sizes, "boxes": boxes, "ring": ring, "sketch": sketch}


def _slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of about ``chars`` characters, so that a batch of long texts takes bounded memory."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def sign(df: DataFrame, id_col: str, text_col: str, group_col: str | None, words: int, per_box: int) -> DataFrame:
    """One row per text that has at least ``words`` words: key, grp, cls, n, ring, boxes, s0..s7.

    Of texts with the same set only the first that a task meets has boxes, ring and sketch, the rest
    have nulls there; :func:`class_table` makes one row of what the tasks send.
    """
    group = F.col(f"`{group_col}`").cast("string") if group_col else F.lit(None).cast("string")
    src = df.select(F.col(f"`{id_col}`").alias("key"), group.alias("grp"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    schema = f"key {kind}, grp string, cls bigint, n int, ring bigint, boxes array<int>, " + ", ".join(
        f"{c} bigint" for c in _SKETCH
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in _slices(texts):
                which, starts, s = shingle_sets(texts[lo:hi], words, hashes)
                if not len(which):
                    continue
                sig = signatures(starts, s, per_box)
                ids = sig["ids"].view(np.int64)
                new = np.zeros(len(ids), bool)
                for i, v in enumerate(ids.tolist()):
                    if v not in seen:
                        seen.add(v)
                        new[i] = True
                if len(seen) > 500_000:
                    seen.clear()
                old = pa.array(~new)
                rows = pa.array(which + lo)
                flat = pa.array((sig["boxes"] >> _U(32)).astype(np.uint32).view(np.int32).ravel())
                boxes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BOXES, dtype=np.int32)), flat)
                gone = lambda a: pc.if_else(old, pa.scalar(None, a.type), a)
                columns = [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(ids),
                    pa.array(sig["sizes"].astype(np.int32)),
                    gone(pa.array(sig["ring"].view(np.int64))),
                    gone(boxes),
                    *(gone(pa.array(np.ascontiguousarray(sig["sketch"][:, i]))) for i in range(SKETCH_WORDS)),
                ]
                names = ["key", "grp", "cls", "n", "ring", "boxes", *_SKETCH]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return src.where(F.col("text").isNotNull()).mapInArrow(run, schema)


def class_table(sig: DataFrame) -> DataFrame:
    """One row per class: cls, key (one of its texts), n, ring, boxes, sketch; texts with nulls there move nothing."""
    rest = ("key", "n", "ring", "boxes", *_SKETCH)
    first = F.min_by(F.struct(*rest), "key").alias("r")
    return sig.where(F.col("boxes").isNotNull()).groupBy("cls").agg(first).select("cls", "r.*")


def _chain_ok(ring_a: Column, ring_b: Column, share: float) -> Column:
    """The pigeonring test from a start: every chain within its proportional share of the budget."""
    differing = ring_a.bitwiseXOR(ring_b)
    test = None
    for boxes in CHAINS:
        bits = 2 * boxes
        part = differing if bits == 64 else differing.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        ok = F.bit_count(part) <= int(share * bits)
        test = ok if test is None else test & ok
    return test


def class_links(classes: DataFrame, share: Fraction) -> DataFrame:
    """Pairs of classes (cls_a < cls_b) that pass the pigeonring test and the full Hamming check.

    ``classes`` is a cut :func:`class_table`.
    """
    posts = classes.select("cls", "ring", F.posexplode("boxes").alias("box", "hash")).select(
        F.expr("shiftleft(cast(box as bigint), 32) | (cast(hash as bigint) & 4294967295)").alias("start"),
        "cls",
        # turn the ring so that it begins at the box of this start
        F.expr("shiftrightunsigned(ring, box * 2) | shiftleft(ring, 64 - box * 2)").alias("ring"),
    )
    a, b = posts.alias("a"), posts.alias("b")
    met = a.join(
        b,
        (F.col("a.start") == F.col("b.start"))
        & (F.col("a.cls") < F.col("b.cls"))
        & _chain_ok(F.col("a.ring"), F.col("b.ring"), (1 - float(share)) / 2 + RING_ROOM),
    )
    pairs = met.select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct()
    sketches = classes.select("cls", "n", *_SKETCH)
    one = sketches.select([F.col(c).alias(f"{c}_a") for c in sketches.columns])
    two = sketches.select([F.col(c).alias(f"{c}_b") for c in sketches.columns])
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH), F.lit(0))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    num, den = share.numerator, share.denominator
    # similarity >= num/den  <=>  |A xor B| <= (den - num) / (den + num) * (|A| + |B|)
    within = apart * (den + num) <= (n_a + n_b) * (den - num)
    sized = (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num)
    return pairs.join(one, "cls_a").join(two, "cls_b").where(within & sized).select("cls_a", "cls_b")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(cls, text) -> (cls, shingles): the exact sets, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                which, starts, s = shingle_sets(texts[lo:hi], words, hashes)
                if len(which):
                    offsets = pa.array(np.r_[starts, len(s)].astype(np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(s.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(which + lo)), lists], names=["cls", "shingles"]
                    )

    return df.mapInArrow(run, "cls bigint, shingles array<bigint>")


def shared_shingles(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls_a, cls_b, shared, total) of every link, from the sets (cls, shingles) of the linked classes.

    A set goes once to its own class's links and once more with each link to the other class.
    """
    one = sets.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("two"))
    both = links.join(one, "cls_a").join(two, "cls_b")
    shared, size = F.size(F.array_intersect("one", "two")), F.size("one") + F.size("two")
    return both.select("cls_a", "cls_b", shared.alias("shared"), size.alias("size")).select("cls_a", "cls_b", "shared", (F.col("size") - F.col("shared")).alias("total"))


def similar_classes(
    df: DataFrame, id_col: str, text_col: str, group_col: str | None = None, words: int = 5, similarity: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """The class of every text, and the exact similarity of all classes that are near-duplicates.

    Returns two tables: members (key, grp, cls, n), one row per text of at least ``words`` words, and
    links (cls_a, cls_b, shared, total) with shared / total >= ``similarity`` and cls_a < cls_b.
    Null, empty and shorter texts are in neither. Ids must be unique. ``similarity`` lies between 0.5 and 1.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.5 and 1")
    share = Fraction(str(similarity))
    sig = cut(sign(df, id_col, text_col, group_col, words, symbols_of(similarity)))
    classes = cut(class_table(sig))
    links = cut(class_links(classes, share))
    ends = cut(links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct())
    chosen = cut(keep_keys(classes.select("cls", "key"), ends, "cls"))
    source = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    texts = keep_keys(source, chosen.select("key"), "key").join(chosen, "key").select("cls", "text")
    counted = shared_shingles(links, _sets(texts, words))
    exact = counted.where(F.col("shared") * share.denominator >= F.col("total") * share.numerator)
    return sig.select("key", "grp", "cls", "n"), exact


def similar_pairs(
    df: DataFrame, id_col: str, text_col: str, group_col: str, words: int, similarity: float
) -> DataFrame:
    """All pairs of rows of different, non-null groups with similar texts: key_a < key_b.

    This spells out copies pair by pair, as its size demands; :func:`near_duplicates` does not.
    """
    members, links = similar_classes(df.where(F.col(f"`{group_col}`").isNotNull()), id_col, text_col, group_col, words, similarity)
    a = members.select(F.col("cls").alias("cls_a"), F.col("key").alias("k1"), F.col("grp").alias("g1"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("key").alias("k2"), F.col("grp").alias("g2"))
    other = F.col("g1") != F.col("g2")
    across = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").where(other)
    within = a.join(b, (F.col("cls_a") == F.col("cls_b")) & (F.col("k1") < F.col("k2"))).where(other)
    pairs = across.select("k1", "k2").unionByName(within.select("k1", "k2"))
    return pairs.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Connected components: (node, root) for every node of ``edges`` (a, b), root the least node.

    Alternates large-star and small-star steps, each one shuffle; rounds grow with the logarithm of
    the longest chain. Every round is cut to the shared folder. Raises if it does not settle.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        told = now.agg(F.count("*").alias("c"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (told["c"], told["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = (told["c"], told["h"])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row per text: key, cls (its exact-copy class), group_id (its near-duplicate group), n_links.

    ``group_id`` is the least class id that can be reached over links; ``n_links`` counts the other
    classes that are similar to this one. Texts without ``words`` words have nulls. Copies are never
    spelled out as pairs.
    """
    members, links = similar_classes(df, id_col, text_col, None, words, similarity)
    links = cut(links)
    roots = components(links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    found = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
    found = found.select(
        "key", "cls", F.coalesce("root", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    every = df.select(F.col(f"`{id_col}`").alias("key"))
    return every.join(found, "key", "left")
