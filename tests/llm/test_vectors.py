import numpy as np
import pytest

from lodesift.llm import vectors


def world(n=600, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 4, 64))
    x = np.concatenate([centre + rng.normal(size=centre.shape) * s for s in (0.0, 0.2, 0.3, 0.35)])
    x *= rng.uniform(0.01, 50, size=(len(x), 1))
    return x.astype(np.float32)


def frames(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    vec = spark.createDataFrame(rows, "row_id long, embedding array<float>")
    names = spark.createDataFrame([(i, f"n{i:04d}") for i in range(len(x))], "row_id long, chunk_id string")
    return vec, names


def truth(x, k=5, floor=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 12), j))[:k]:
            if s[i, j] >= floor:
                out.add((i, j))
    return out


def test_recall_against_brute_force_and_dirt(spark):
    x = world()
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [0.0] * 64), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] * 64)]
    bad += [(0, [float(v) for v in x[0]]), (950, [float(v) for v in x[1]]), (906, [None] + [1.0] * 63)]
    vec, names = frames(spark, x, bad)
    more = spark.createDataFrame([(i, f"bad{i}") for i in range(900, 907)] + [(999, "none"), (5, None)], names.schema)
    got = vectors.similar_vectors(vec, "row_id", "embedding", names.union(more), "chunk_id").collect()
    pairs = {(int(r.name[1:]), int(r.other[1:])) for r in got}
    want = truth(x)
    assert pairs <= want and len(pairs) >= 0.99 * len(want) and len(want) > 300
    assert all(1 <= r["rank"] <= 5 and r.cosine >= 0.9 for r in got)


def test_copies_are_ranked_by_name_without_all_pairs(spark):
    x = np.repeat(world(4), 40, axis=0)
    vec, names = frames(spark, x)
    got = vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id")
    rows = got.where("name = 'n0003'").orderBy("rank").collect()
    assert [r.other for r in rows] == ["n0000", "n0001", "n0002", "n0004", "n0005"]
    assert got.count() == 5 * len(x)


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=64) + rng.normal(size=(120, 64)) * 0.15).astype(np.float32)
    vec, names = frames(spark, x)
    whole = {(r.name, r.other) for r in vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id").collect()}
    monkeypatch.setattr(vectors, "BLOCK", 16)
    split = {(r.name, r.other) for r in vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id").collect()}
    assert whole == split and len(whole) == 600


def test_empty_and_rotation(spark):
    vec, names = frames(spark, np.zeros((0, 64), np.float32))
    assert vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id").count() == 0
    m = vectors.pseudo_rotation(np.eye(64, dtype=np.float32), 0, 0)
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-5)
    u = vectors._unit(np.random.default_rng(2).normal(size=(50, 64)).astype(np.float32))
    for bits, off in ((4, 0.05), (8, 0.001)):
        assert np.abs((vectors._unpack(vectors._pack(u, bits), bits) * u).sum(1) - 1).max() < off


@pytest.mark.parametrize("dim", [3, 10])
def test_other_lengths(spark, dim):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, dim))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.02]).astype(np.float32)
    vec, names = frames(spark, x)
    got = {(r.name, r.other) for r in vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id", dim=dim).collect()}
    assert sum((f"n{i:04d}", f"n{i + 30:04d}") in got for i in range(30)) >= 27


def test_without_a_floor_every_vector_has_its_nearest(spark):
    x = np.random.default_rng(7).normal(size=(700, 64)).astype(np.float32)
    x = np.concatenate([x, x[:3], x[:1], x[:1], x[:1], x[:1], x[:1], x[:1]])
    vec, names = frames(spark, x)
    want = truth(x, floor=-1)
    got = vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id", floor=None).collect()
    assert {(int(r.name[1:]), int(r.other[1:])) for r in got} == want and len(got) == 5 * len(x)
    assert sum(r.cosine < 0.9 for r in got) > 3000


def test_without_a_floor_few_vectors_have_all_others(spark):
    vec, names = frames(spark, np.random.default_rng(8).normal(size=(3, 64)).astype(np.float32))
    assert vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id", floor=None).count() == 6
    assert vectors.similar_vectors(vec.limit(0), "row_id", "embedding", names, "chunk_id", floor=None).count() == 0


def test_query_lists_five_neighbours_of_every_vector(spark, tmp_path):
    from lodesift.llm import queries

    x = np.random.default_rng(9).normal(size=(50, 64)).astype(np.float32)
    vec, names = frames(spark, x)
    vec.write.parquet(str(tmp_path / "vec_chunks.parquet"))
    names.write.parquet(str(tmp_path / "chunk_ids.parquet"))
    assert queries.p3_neighbours(spark, str(tmp_path)).count() == 250 and queries.p3_found(spark, str(tmp_path)).count() == 0


def test_buckets_keep_their_size_as_vectors_grow():
    for n in (10, 1_000, 100_000, 10_000_000, 10**9):
        axes_of = vectors.hash_axes(n, 64, 16)
        buckets = np.prod([2.0 * a for a in axes_of])
        assert n / 64 <= 16 * buckets <= 4 * n or n < 64
    assert vectors.hash_axes(5, 64, 16) == []


def test_recall_without_a_floor_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_BUCKET_OPEN", 64)
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(8, 64))[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 64))).astype(np.float32)
    vec, names = frames(spark, x)
    got = vectors.similar_vectors(vec, "row_id", "embedding", names, "chunk_id", floor=None).collect()
    pairs = {(int(r.name[1:]), int(r.other[1:])) for r in got}
    want = {p for p in truth(x, floor=-1) if p[0] % 20 == 0}
    assert len(vectors.hash_axes(2000, 64, 64)) >= 1 and len(got) == 5 * len(x)
    assert len(pairs & want) >= 0.9 * len(want)
