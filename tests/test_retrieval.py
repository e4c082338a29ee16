import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodesift.operators import lexical, ranking
from lodesift.operators.dense import VectorIndex, _nearest
from lodesift.operators.lexical import Bm25Index
from lodesift.plans import queries


def docs(spark, texts):
    return spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, ord long, text string")


def ask(spark, *qs):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(qs)], "qid string, question string")


def okapi(texts, query):
    """Plain transcription of the formula."""
    toks = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for i, t in enumerate(toks):
        s = 0.0
        for w in re.findall("[a-z0-9]+", query.lower()):
            f = t.count(w)
            s += idf.get(w, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out.append((-round(s, 9), i, s))
    return sorted(out)


def test_bm25_matches_formula_with_ties_repeats_and_empty_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(80)]
    texts += [texts[0], texts[0], "", None]
    queries = ["the w1 w2", "w3 w3 w3 the", "nothing here", ""]
    got = Bm25Index().build(docs(spark, texts)).search(ask(spark, *queries), 12)
    for i, q in enumerate(queries):
        rows = sorted((r.rank, r.ord, r.score) for r in got.where(F.col("qid") == f"q{i}").collect())
        want = okapi(texts, q)[:12]
        assert [r[1] for r in rows] == [w[1] for w in want]
        assert all(abs(r[2] - w[2]) < 1e-9 for r, w in zip(rows, want))


def test_bm25_small_cases(spark):
    index = Bm25Index().build(docs(spark, ["speculative decoding of models", "convolutional nets", "human feedback"]))
    top = index.search(ask(spark, "speculative decoding inference"), 2).orderBy("rank").collect()
    assert top[0].chunk_id == "c0" and top[0].score > 0 and len(top) == 2
    assert index.search(ask(spark, "unrelated"), 10).count() == 3
    assert index.search(ask(spark).limit(0), 5).count() == 0
    with pytest.raises(RuntimeError):
        Bm25Index().search(ask(spark, "x"))
    assert Bm25Index().build(docs(spark, [])).search(ask(spark, "x"), 5).count() == 0


def test_exact_neighbours_ties_and_dimension(spark):
    vecs = [(0.0, 1.0), (1.0, 0.0), (1.0, 0.0), (0.9, 0.1)]
    rows = spark.createDataFrame([(f"v{i}", i, list(v)) for i, v in enumerate(vecs)], "chunk_id string, ord long, vec array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vec array<double>")
    got = [r.chunk_id for r in VectorIndex(rows).search(q, 3).orderBy("rank").collect()]
    assert got == ["v1", "v2", "v3"]
    assert VectorIndex(rows).search(q, 10).count() == 4
    with pytest.raises(ValueError):
        VectorIndex(rows).search(spark.createDataFrame([("q", [1.0])], "qid string, vec array<double>"), 3)
    mixed = rows.union(spark.createDataFrame([("x", 9, [1.0])], rows.schema))
    with pytest.raises(ValueError):
        VectorIndex(mixed)


def lists(spark, *ranked):
    rows = [("q", c, ord(c[-1]), r + 1, s) for s, ids in enumerate(ranked) for r, c in enumerate(ids)]
    return spark.createDataFrame(rows, "qid string, chunk_id string, ord long, rank long, src int")


def order(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_rrf_three_lists(spark):
    given = [["c1", "c2", "c3"], ["c3", "c1", "c2"], ["c2", "c3", "c1"]]
    fused = ranking.rrf(lists(spark, *given), 10, rrf_k=7)
    want = {c: sum(1 / (7 + x.index(c) + 1) for x in given) for c in given[0]}
    assert {r.chunk_id: round(r.score, 12) for r in fused.collect()} == {c: round(v, 12) for c, v in want.items()}
    assert order(fused) == ["c1", "c2", "c3"]
    assert len(order(ranking.rrf(lists(spark, *given), 2))) == 2


def test_best_rank_and_first_seen_ties(spark):
    two = lists(spark, ["c1", "c2", "c3"], ["c3", "c1", "c2"])
    assert order(ranking.best_rank(two, 10)) == ["c1", "c3", "c2"]
    assert order(ranking.first_seen(lists(spark, ["c2", "c1"], ["c3", "c2"]), 10)) == ["c2", "c1", "c3"]


def test_filters_are_typed_and_null_safe(spark):
    c = spark.createDataFrame([("a", 2025, "x"), ("b", None, "x"), ("c", 2024, None)], "chunk_id string, year int, category string")
    ids = lambda f: sorted(r.chunk_id for r in c.where(ranking.matches(c, f)).collect())
    assert ids({}) == ["a", "b", "c"]
    assert ids({"year": 2025}) == ["a"] and ids({"year": "2025"}) == []
    assert ids({"year": None}) == ["b"] and ids({"venue": None}) == ["a", "b", "c"] and ids({"venue": "z"}) == []
    assert ids({"category": "x", "year": 2025}) == ["a"]


def test_context_drops_unknown_ids_and_keeps_questions(spark):
    chunks = docs(spark, ["one", None])
    ranked = spark.createDataFrame([("q0", "c1", 1, 2), ("q0", "c0", 0, 1), ("q0", "gone", 5, 3)], "qid string, chunk_id string, ord long, rank long")
    rows = {r.qid: r for r in ranking.contexts(ranked, chunks, ask(spark, "a", "b")).collect()}
    assert rows["q0"].context == "[c0] one\n\n[c1] " and rows["q0"].ids == ["c0", "c1"]
    assert rows["q1"].context == "" and rows["q1"].ids == []


def test_rerank_orders_by_score(spark):
    chunks, q = docs(spark, ["a", "b", "c"]), ask(spark, "x")
    pool = spark.createDataFrame([("q0", f"c{i}", i, i + 1) for i in range(3)], "qid string, chunk_id string, ord long, rank long")
    got = ranking.rerank(pool, q, chunks, 2).orderBy("rank").collect()
    assert len(got) == 2 and got[0].score >= got[1].score


def unpacked(batches, k):
    """The lists of packed rows: query -> ords, in the order of their keys."""
    rows = [r for b in batches for r in b.to_pylist()]
    lists = {}
    for r in rows:
        for q, o in zip(np.frombuffer(r["q"], np.int32).tolist(), np.frombuffer(r["ord"], np.int64).tolist()):
            lists.setdefault(q, []).append(o)
    return len(rows), lists


@pytest.mark.parametrize("most_dense", [0, 5, 256])
def test_bm25_task_sends_one_packed_row_for_its_queries(monkeypatch, most_dense):
    """Over several blocks, whatever terms are dense; before, k rows were sent for every query."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "MOST_DENSE", most_dense)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["common"] * 12 + ["often"] * 6
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(100)] + [""]
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(120)]
    toks = [t.split() for t in texts]
    df = {w: sum(w in t for t in toks) for w in {w for t in toks for w in t}}
    raw = {w: math.log(len(toks) - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    index = Bm25Index()
    index.n, index.avgdl, index.below_zero = len(toks), sum(map(len, toks)) / len(toks), False
    terms = {w: (v if v >= 0 else 0.25 * mean, df[w]) for w, v in raw.items()}
    batches = [pa.RecordBatch.from_pydict({"chunk_id": [f"c{i}" for i in at], "ord": list(at), "text": [texts[i] for i in at]}) for at in (range(lo, min(lo + 10, 101)) for lo in range(0, 101, 10))]
    sent, lists = unpacked(index._scorer([tuple(sorted(q.split())) for q in queries], terms, 7)(iter(batches)), 7)
    assert sent == 1
    for i, q in enumerate(queries):
        assert lists.get(i, []) == [w[1] for w in okapi(texts, q) if w[0] < 0][:7]


def test_dense_task_sends_one_packed_row_for_its_queries():
    rng = np.random.default_rng(4)
    x, asked = np.round(rng.normal(size=(300, 3)), 1), np.round(rng.normal(size=(200, 3)), 1)
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i) for i in at]), pa.array(at), pa.array(x[at].tolist())], names=["chunk_id", "ord", "vec"]) for at in np.split(np.arange(300), 6)]
    sent, lists = unpacked(_nearest([(str(i), v) for i, v in enumerate(asked.tolist())], 9)(iter(batches)), 9)
    assert sent == 1
    for i, v in enumerate(asked):
        d = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9)
        assert lists[i] == np.lexsort((np.arange(300), d))[:9].tolist()


@pytest.mark.parametrize("name", ["best_rank_merge", "first_seen_merge", "rrf_fuse_3", "embedding_study"])
def test_query_searches_lexically_once(spark, monkeypatch, name):
    """Before, two or three searches read every text again."""
    calls, search = [], Bm25Index.search
    monkeypatch.setattr(Bm25Index, "search", lambda self, *a, **k: calls.append(name) or search(self, *a, **k))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert calls == [name]


def test_one_list_of_every_query_a_core(spark, monkeypatch):
    tasks, merged = [], lexical.merged

    def seen(packed, *args):
        tasks.append(packed.rdd.getNumPartitions())
        return merged(packed, *args)

    monkeypatch.setattr(lexical, "merged", seen)
    rows = docs(spark, [f"w{i % 7} x{i % 5}" for i in range(200)]).repartition(40)
    got = Bm25Index().build(rows).search(ask(spark, "w1 x2", "w3"), 4)
    assert got.count() == 8 and tasks == [spark.sparkContext.defaultParallelism]


def test_words_of_are_those_of_the_expression():
    texts = ["", "One two", "three", "x\u0130y \u212a9 \u017fz", "caf\u00e9s naïve", "end1", "2begin  a-b_c", "\u4e2d\u6587 ABC", ""]
    words, sizes = lexical.words_of(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in re.findall("[a-z0-9]+", t.lower())]
    assert sizes.tolist() == [len(re.findall("[a-z0-9]+", t.lower())) for t in texts]
    some, n = lexical.words_of(pa.array(texts).slice(2, 3))
    assert some.to_pylist() == words.to_pylist()[2 : 2 + n.sum()]


def test_many_documents_of_nearly_the_same_score(spark):
    # lengths differ by one word in many: scores differ by less than single precision tells
    texts = ["alpha beta " + "pad " * (20_000 + i % 7) for i in range(60)] + ["filler"] * 100
    for t in ("alpha beta", "alpha alpha beta", "beta"):
        rows = Bm25Index().build(docs(spark, texts)).search(ask(spark, t), 8).orderBy("rank").collect()
        assert [r.ord for r in rows] == [w[1] for w in okapi(texts, t)[:8]]


def test_nearest_measures_small_batches_together(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.uniform(-1, 1, (300, 6)), np.full((100, 6), 0.25) + rng.uniform(0, 1e-7, (100, 6))])
    asked = [("a", [0.25] * 6), ("b", vectors[7].tolist()), ("c", [3e20] * 6)]
    offers, offer = [], lexical.Best.offer
    monkeypatch.setattr(lexical.Best, "offer", lambda self, q, *rest: (offers.append(len(q)), offer(self, q, *rest)))
    batches = [pa.record_batch({"chunk_id": [str(i) for i in range(a, a + 10)], "ord": list(range(a, a + 10)), "vec": vectors[a : a + 10].tolist()}) for a in range(0, 400, 10)]
    (got,) = _nearest(asked, 9)(iter(batches))
    ords = np.frombuffer(got.column("ord")[0].as_py(), np.int64).reshape(3, 9)
    for (_, v), mine in zip(asked, ords):
        d = np.rint(np.sqrt(((vectors - np.array(v)) ** 2).sum(axis=1)) * 1e9)
        assert mine.tolist() == np.lexsort((np.arange(400), d))[:9].tolist()
    assert len(offers) == 1


def test_tops_of_stripes_are_those_of_all_documents():
    rng = np.random.default_rng(5)
    for stripes, width, kinds in ((1, 50, 9), (8, 500, 3), (64, 100, 1000), (4, 8, 2)):
        base = rng.integers(0, kinds, stripes * width).astype(np.float32) / kinds
        base[-3:] = -np.inf  # no documents
        highs = base.reshape(stripes, width).max(axis=0)
        for k in (1, 10, 60):
            for least in (4e-10, 0.9):
                got = lexical._top(base, highs, k, least, 1e-6)
                worst = np.sort(base)[-k] if k <= len(base) else -np.inf
                assert sorted(got) == np.flatnonzero(base >= np.float32(max(least, worst - 1e-6))).tolist()


def test_bm25_asks_for_terms_without_python_rows(spark, monkeypatch):
    index = Bm25Index().build(docs(spark, ["alpha beta", "beta gamma"]))
    made = []
    plain = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or plain(self, data, *a, **k))
    queries_ = ask(spark, "beta")
    made.clear()
    index.search(queries_, 2)
    assert made == [pa.Table, pa.Table]


def test_numbered_fusion_equals_fusion_by_names(spark):
    # all pairs of ranks in two lists, and chunks that one list alone has
    pairs = [(i, j) for i in range(1, 13) for j in range(1, 13)]
    rng = random.Random(3)
    rows = []
    for q in range(300):
        for src in range(2):
            ords = rng.sample(range(30), 12)
            rows += [(q, f"q{q}", o, f"c{o}", rank, src) for rank, o in enumerate(ords, 1)]
    for n, (i, j) in enumerate(pairs):
        rows += [(1000 + n // 12, f"q{1000 + n // 12}", n, f"c{n}", r, src) for src, r in enumerate((i, j))]
    lists = spark.createDataFrame(rows, "q int, qid string, ord long, chunk_id string, rank long, src int")
    want = {(r.qid, r.ord, r.rank): r.score for r in ranking.rrf(lists, 10, 7).collect()}
    got = {(f"q{r.q}", r.ord, r.rank): r.score for r in ranking.rrf_numbered(lists.select("q", "ord", "rank", "src"), 10, 7).collect()}
    assert got == want


def test_products_find_the_nearest_across_tiles_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows, asked = rng.integers(0, 3, (20_000, 6)).astype(float), rng.integers(0, 3, (300, 6)).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array([""] * 2500), pa.array(np.arange(lo, lo + 2500)), pa.array(list(rows[lo : lo + 2500]))], names=["chunk_id", "ord", "vec"]) for lo in range(0, 20_000, 2500)]
    found = [b for b in _nearest([(str(i), v) for i, v in enumerate(asked)], 7)(iter(batches))]
    ords = np.concatenate([np.frombuffer(b.column(2)[0].as_py(), np.int64) for b in found]).reshape(300, 7)
    distances = np.rint(1e9 * np.sqrt(((asked[:, None, :] - rows[None]) ** 2).sum(axis=2)))
    assert (ords == np.argsort(distances, axis=1, kind="stable")[:, :7]).all()


def test_texts_of_known_length_are_embedded_without_a_pass_for_it(spark):
    df = docs(spark, ["one", "two", None])
    spark.sparkContext.setJobGroup("index", "building an index")
    index = VectorIndex.of_texts(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("index"))
    spark.sparkContext.setJobGroup("rest", "")
    assert index.dim == 16 and jobs == 0
    assert [r[0] for r in index.rows.selectExpr("size(vec)").collect()] == [16] * 3
