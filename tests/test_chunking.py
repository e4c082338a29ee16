import random

from pyspark.sql import functions as F

from lodesift.operators import chunking, corpus


def run(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def packed(text, budget, overlap):
    """Plain version of the greedy rule."""
    parts = []
    for p in [x.strip() for x in (text or "").split("\n\n") if x.strip()]:
        w = p.split()
        if len(w) <= budget:
            parts.append(p)
        else:
            parts += [" ".join(w[s : s + budget]) for s in range(0, len(w), budget - overlap)]
    done, now, size = [], [], 0
    for p in parts:
        n = len(p.split())
        if size + n > budget and now:
            done.append("\n\n".join(now))
            last = now[-1]
            now, size = ([last], len(last.split())) if len(last.split()) <= overlap else ([], 0)
        now.append(p)
        size += n
    return done + (["\n\n".join(now)] if now else [])


def para(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_packing_matches_the_rule_and_overshoots(spark):
    rng = random.Random(3)
    texts = ["\n\n".join(para(rng.choice([3, 20, 60, 200, 460, 500, 960, 1300]), f"p{j}") for j in range(rng.randint(1, 9))) for _ in range(15)]
    texts += ["\n\n".join([para(460, "a"), para(60, "b"), para(500, "c")]), "", None, "   \n\n  ", para(960)]
    got = run(spark, texts, chunking.chunk_text)
    assert got == [packed(t, 512, 64) for t in texts]
    assert [len(c.split()) for c in got[15]] == [460, 60, 560]
    assert run(spark, texts, lambda c: chunking.chunk_fixed(c, 256)) == [packed(t, 256, 64) for t in texts]


def test_last_window_inside_the_one_before(spark):
    got = run(spark, [para(960)], chunking.split_oversized)[0]
    assert [len(p.split()) for p in got] == [512, 512, 64]
    assert got[2] in got[1]


def test_semantic_single_sentence_and_rejoin(spark):
    text = " ".join(f"Sentence number {i} says something new." for i in range(40))
    one, none, many = run(spark, ["Only one sentence here.", None, text], chunking.chunk_semantic)
    assert one == ["Only one sentence here."] and none == []
    assert " ".join(many) == text and all(len(c.split()) >= 100 for c in many[1:-1])


def test_late_windows_contain_their_chunk(spark):
    text = "\n\n".join(para(300, f"s{j}x") for j in range(4))
    got = run(spark, [text, ""], lambda t: chunking.chunk_late(t, 512))
    assert [c.text for c in got[0]] == packed(text, 512, 64) and got[1] == []
    for c in got[0]:
        assert c.text in c.embed_text and len(c.embed_text) <= len(c.text) + 800


def test_document_aware_order(spark):
    rows = [("p", "methods", 2, 3, "c"), ("p", "abstract", 0, 1, "a"), ("p", "methods", 1, 2, "b"), ("q", None, 0, 4, None)]
    df = spark.createDataFrame(rows, "paper_id string, section string, chunk_index int, ord long, text string")
    got = {(r.paper_id, r.piece): (r.section, r.text) for r in chunking.chunk_document_aware(df).collect()}
    assert got == {("p", 0): ("abstract", "a"), ("p", 1): ("methods", "b\n\nc"), ("q", 0): (None, "")}


def test_token_batches(spark):
    df = spark.createDataFrame([([100] * 5,), ([300, 10, 10],), ([],)], "s array<int>")
    got = [r.b for r in df.select(chunking.token_batches(F.col("s"), 250).alias("b")).collect()]
    assert got == [[0, 0, 1, 1, 2], [0, 1, 1], []]


def test_last_delivery_and_selection(spark):
    rows = [(1, "a", "old"), (2, "b", "x"), (3, "a", "new"), (4, "b", None)]
    df = spark.createDataFrame(rows, "ord long, chunk_id string, text string")
    assert sorted(tuple(r) for r in corpus.last_delivery(df).collect()) == [("a", 1, "new"), ("b", 2, None)]
    long = "x" * 600
    cand = spark.createDataFrame(
        [("A", "p1", 1, long), ("A", "p2", 2, "short"), ("A", "p3", 3, long), ("B", "p1", 1, long), ("B", "p4", 2, long), ("B", "p5", 3, None)],
        "category string, paper_id string, place long, full_text string",
    )
    got = sorted((r.category, r.paper_id) for r in corpus.select_papers(cand, ["A", "B"], 2).collect())
    assert got == [("A", "p1"), ("A", "p3"), ("B", "p4")]
    chunk = corpus.chunk_papers(corpus.select_papers(cand, ["A"], 1)).collect()
    assert [(c.chunk_id, c.section) for c in chunk] == [("p1#0", "abstract")]


def test_only_repeated_chunks_move_in_a_large_table(spark, tmp_path):
    rows = [(i, f"c{i}", f"text {i}") for i in range(400)] + [(500, "c7", "new"), (501, None, "x"), (502, None, "y"), (503, "c7", "newer")]
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame(rows, "ord long, chunk_id string, text string").repartition(8).write.parquet(path)
    df = spark.read.parquet(path)
    few = corpus.last_delivery(df, least=0)
    want = sorted(tuple(r) for r in corpus.last_delivery(df).select("ord", "chunk_id", "text").collect())
    assert sorted(tuple(r) for r in few.select("ord", "chunk_id", "text").collect()) == want
    assert (7, "c7", "newer") in want and (501, None, "y") in want and len(want) == 401
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "LeftAnti" in plan and "LeftSemi" in plan
