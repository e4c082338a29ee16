import os
import random

import numpy as np
import pytest

from lodesift.llm import packing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


def texts():
    rng = random.Random(9)
    words = ["the", "don't", "I'll", "naïve", "你好", "😀", "x" * 70, "  ", "\n\n", "\t", " ", "'re", "12345", "!!", "á", "<|endoftext|>", "​", "\x1c", "𝒇(𝑥)"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(200, 3000))) for _ in range(20)]
    return made + [made[0], "p " + made[0], made[0][100:], "", None, " ", "q" * 5000, " " * 4000, "a b " * 2000, "wort " * 3000]


@needs_vocabulary
def test_corpus_encoding_is_exact(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(given)], "id long, text string, hash int")
    got = {r.id: r.ids for r in tokens.encode_corpus(df, "id", "text").collect()}
    enc = tokens.tokenizer()
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(given)}
    n = {r.id: r.n_tokens for r in tokens.count_tokens(df, "id", "text").collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert tokens.encode_corpus(df.limit(0), "id", "text").count() == 0


def test_parts_tile_and_are_shared():
    rng = random.Random(4)
    body = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(4000))
    a, b = tokens.parts(body), tokens.parts("another beginning, " + body)
    assert "".join(a) == body and len(a) > 10
    assert len(set(a) & set(b)) > 0.8 * len(a)


def containers(spark, sizes, capacity=2048):
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
    return packing.pack(df, "id", "size", capacity).collect()


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_holds_all_and_wastes_little(spark, capacity):
    rng = np.random.default_rng(8)
    sizes = [int(v) for v in np.clip(rng.lognormal(np.log(capacity / 9), 0.8, 3000), 1, capacity * 3)] + [0, None, capacity, capacity + 1, 2 * capacity] + [5] * 1500
    rows = containers(spark, sizes, capacity)
    used, parts = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.id, []).append((r.part, r.token_start, r.n_tokens))
    assert max(used.values()) <= capacity
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(x[2] for x in p) == (s or 0) and (len(p) == 1 or s > capacity)
        assert all(b[1] == a[1] + a[2] for a, b in zip(p, p[1:]))
    full = [v for v in used.values() if v]
    assert 1 - sum(full) / (len(full) * capacity) < 0.02
    assert len(full) == max(used) + 1


def test_packing_corner_cases(spark):
    assert containers(spark, []) == []
    assert [r.container_id for r in containers(spark, [0, None])] == [0, 0]
    assert len({r.container_id for r in containers(spark, [1500] * 7)}) == 7
    one = containers(spark, [2049])
    assert sorted(r.n_tokens for r in one) == [1, 2048] and len({r.container_id for r in one}) == 2


def test_plan_places_each_item_once():
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(1, 101, 2000), minlength=101)
    rows, n = packing.plan(h, 100)
    load, seen = np.zeros(n, int), np.zeros(101, int)
    for length, first, items, box, each in rows:
        assert first == seen[length]
        seen[length] += items
        for i in range(items):
            load[box + i // each] += length
    assert (seen == h).all() and load.max() <= 100 and load.sum() / (n * 100) > 0.97


def test_texts_without_spaces_have_parts_too():
    lines = "\n".join(f"word{i}" for i in range(3000))
    marks = "".join("密集检索在这些文档上是否稳定" + "。，！"[i % 3] for i in range(800))
    for text in (lines, marks):
        ps = tokens.parts(text)
        enc = tokens.tokenizer()
        assert len(ps) > 5 and "".join(ps) == text
        assert [t for p in ps for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
