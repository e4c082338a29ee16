"""Encoding a whole corpus with a public byte-level BPE vocabulary, reusing content-defined chunks.

A rolling hash over 16 characters cuts texts where its low bits vanish, so copies and shared passages
fall into the same chunks wherever they stand. A cut may split a word; the join is repaired by encoding
again the stretch between the two nearest *safe* places around it. Safe is a place before a space, tab or
line break that follows a character that is not white space: the splitting pattern of this tokenizer family
takes white space only at the start of a match, so no match ever reaches over such a place. So is a place
between a full-width mark and a Han or kana letter, since no match holds both. The encoding of a text is
therefore exactly the encodings of its parts. Every part (chunk body or repaired join) is
encoded once for the whole corpus and joined back by its 128-bit content hash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 16
#: Cuts come every 2 ** CUT_BITS characters on average and never closer than LEAST.
CUT_BITS, LEAST = 9, 128

#: Safe places: before white space that follows none, and between a full-width mark and a Han or kana letter.
_SAFE = re.compile("(?<=\\S)(?=[ \\n\\r\\t])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])")
_GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> list[str]:
    """The content-defined parts of a text; their encodings, one behind the other, are the text's."""
    n = len(text)
    if n < 2 * LEAST:
        return [text] if text else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gear = _GEAR[(codes ^ (codes >> np.uint32(8))) & np.uint32(255)]
    rolling = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolling[k:] += gear[: n - k] << np.uint64(k)
    hits = np.flatnonzero((rolling >> np.uint64(WINDOW)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    cuts, last = [], 0
    for c in hits.tolist():
        if c - last >= LEAST and n - c >= LEAST:
            cuts.append(c)
            last = c
    if not cuts:
        return [text]
    safe = np.array([0, *(m.start() for m in _SAFE.finditer(text)), n])
    at = np.array(cuts)
    before = safe[np.searchsorted(safe, at, "right") - 1]
    after = safe[np.searchsorted(safe, at, "left")]
    places = np.unique(np.r_[0, before, after, n]).tolist()
    return [text[a:b] for a, b in zip(places, places[1:])]


def _partition(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, hash, part): all parts of all texts; part is null where the task has sent it before."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[int] = []
            pos: list[int] = []
            keys: list[bytes] = []
            texts: list[str | None] = []
            held = 0

            def flush(batch=batch):
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(pos, pa.int32()),
                        pa.array(keys, pa.binary()),
                        pa.array(texts, pa.string()),
                    ],
                    names=["id", "pos", "hash", "part"],
                )
                for x in (rows, pos, keys, texts):
                    x.clear()
                return out

            for i, text in enumerate(batch.column(1).to_pylist()):
                # a null or empty text keeps one empty part, so that its document is not lost
                for p, part in enumerate(parts(text or "") or [""]):
                    key = blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append(i)
                    pos.append(p)
                    keys.append(key)
                    texts.append(None if key in seen else part)
                    seen.add(key)
                    held += len(part)
                if held > 4_000_000:
                    yield flush()
                    held = 0
            if len(seen) > 300_000:
                seen.clear()
            if rows:
                yield flush()

    return src.mapInArrow(run, f"id {kind}, pos int, hash binary, part string")


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens; an empty list for null and empty.

    ``id_col`` must be unique. Strings of special tokens inside a text are ordinary text. The vocabulary
    file must lie at the same path on every executor.
    """
    pieces = cut(_partition(df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(vocabulary)
        for batch in batches:
            ids = enc.encode_ordinary_batch(batch.column(1).to_pylist(), num_threads=1)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["hash", "ids"])

    once = pieces.where(F.col("part").isNotNull()).select("hash", "part").dropDuplicates(["hash"])
    encoded = once.mapInArrow(run, "hash binary, ids array<int>")
    joined = pieces.select("id", "pos", "hash").join(encoded, "hash")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    whole = joined.groupBy("id").agg(ordered.alias("parts"))
    return whole.select("id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every text by the same encoding; 0 for null and empty. No shuffle."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["id", "n_tokens"])

    return src.mapInArrow(run, f"id {kind}, n_tokens int")


def decode(df: DataFrame, id_col: str, ids_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): what lists of token ids stand for; bytes that are no UTF-8 become U+FFFD, null lists stay null."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(vocabulary)
        for batch in batches:
            texts = [None if ids is None else enc.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string")
