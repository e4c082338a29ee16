import random
import re

import pytest

from lodesift.llm import neardup


def sets(text, n):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def family(rng):
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 60, 150]))]
        for c in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), f"p{rng.randrange(30)}", " ".join(w)))
    copy = rows[5][2]
    rows += [(len(rows) + i, f"copy{i % 7}", copy) for i in range(25)]
    rows += [(len(rows) + i, p, t) for i, (p, t) in enumerate([(None, copy), ("a", None), ("b", ""), ("c", "two words"), ("d", "A-b C!"), ("e", "a b c")])]
    return rows


def brute(rows, n, share):
    have = [(k, p, sets(t, n)) for k, p, t in rows if p is not None]
    have = [x for x in have if x[2]]
    out = set()
    for i, (a, p, s) in enumerate(have):
        for b, q, u in have[i + 1 :]:
            if p != q and len(s & u) >= share * len(s | u) - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


def test_pairs_match_brute_force(spark):
    rows = family(random.Random(1))
    df = spark.createDataFrame(rows, "id long, grp string, text string")  # grp clashes with an inner name
    got = {(r.key_a, r.key_b) for r in neardup.similar_pairs(df, "id", "text", "grp", 3, 0.6).collect()}
    want = brute(rows, 3, 0.6)
    assert got <= want and len(want - got) <= len(want) // 500
    assert len(want) > 100


def test_groups_one_row_each_without_pairs_of_copies(spark):
    rows = family(random.Random(2))
    df = spark.createDataFrame(rows, "key long, cls string, text string")
    got = {r.key: r for r in neardup.near_duplicates(df, "key", "text").collect()}
    assert set(got) == {r[0] for r in rows}
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute([(k, str(k), t) for k, _, t in rows], 5, 0.8):
        parent[root(a)] = root(b)
    sized = [k for k, _, t in rows if sets(t, 5)]
    mine = {}
    for k in sized:
        mine.setdefault(got[k].group_id, set()).add(k)
    want = {}
    for k in sized:
        want.setdefault(root(k), set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert all(got[k].group_id is None and got[k].n_links is None for k, _, t in rows if not sets(t, 5))


def test_empty_table_and_components(spark):
    empty = spark.createDataFrame([], "id long, p string, text string")
    assert neardup.similar_pairs(empty, "id", "text", "p", 3, 0.6).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 100}


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8, 0.9])
def test_recall_right_at_each_similarity(spark, similarity):
    import random

    rng = random.Random(5)
    rows, n, words = [], 60, 120
    for i in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        grams = words - 2
        # one changed stretch of m words costs m + 2 of the grams on both sides
        m = int(grams * (1 - similarity) / (1 + similarity)) - 2
        other = base[:20] + [f"v{rng.randrange(10**6)}" for _ in range(m)] + base[20 + m :]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "id long, text string")
    _, links = neardup.similar_classes(df, "id", "text", None, 3, similarity)
    got = links.collect()
    assert len(got) == n and min(r.shared / r.total for r in got) < similarity + 0.03


def test_similarities_without_a_filter_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    with pytest.raises(ValueError):
        neardup.similar_classes(df, "id", "text", None, 3, 0.4)


def test_copies_in_many_tasks_are_one_class_before_the_join(spark):
    one, two = "a quick brown fox jumps over the lazy dog again", "some other words that have nothing to do with it"
    df = spark.createDataFrame([(i, (one, two)[i % 2]) for i in range(64)], "id long, text string").repartition(32)
    sig = neardup.sign(df, "id", "text", None, 3, 3)
    assert neardup.class_table(sig).count() == 2
