"""Vector arithmetic and the deterministic stand-in embedding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms of at least 1e-9, so that zero vectors give 0."""
    floor = F.lit(1e-9)
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), floor) * F.greatest(F.sqrt(dot(b, b)), floor))


def hash_bytes(text: Column, n: int) -> Column:
    """The first ``n`` bytes of the text's SHA-256, repeated beyond 32, as doubles in 0..255."""

    def words(digest: Column) -> Column:
        return F.array(*(F.conv(F.substring(digest, (i % 8) * 8 + 1, 8), 16, 10).cast("bigint") for i in range(-(-n // 4))))

    def spread(word: Column) -> Column:
        return F.array(*(F.shiftright(word, shift).bitwiseAND(255).cast("double") for shift in (24, 16, 8, 0)))

    # the one-element array binds the digest, so it is computed once; four bytes are read at a time
    return F.slice(F.flatten(F.transform(F.flatten(F.transform(F.array(F.sha2(text, 256)), words)), spread)), 1, n)


def mock_vector(text: Column, dim: int = 16) -> Column:
    """The stand-in embedding: SHA-256 bytes scaled to -1..1."""
    return F.transform(hash_bytes(text, dim), lambda b: b / 127.5 - 1.0)


def mock_score(query: Column, text: Column) -> Column:
    """The stand-in reranker: the first four bytes of SHA-256(query|text) over 2**32."""
    digest = F.sha2(F.concat(query, F.lit("|"), text), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296
