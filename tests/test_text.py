from pyspark.sql import functions as F

from lodesift.functions import text as tx
from lodesift.functions import vectors as vx


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_tokens_split_at_accents_and_take_null(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Café No-1, BM25!") == ["caf", "no", "1", "bm25"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []
    assert one(spark, tx.tokens(F.col("t")), t="") == []


def test_citations(spark):
    text = "a [arxiv:2601.11580#0] b [note] c [arxiv:2601.11580#0] [é#1]"
    assert one(spark, tx.citations(F.col("t")), t=text) == ["arxiv:2601.11580#0", "note", "é#1"]
    assert one(spark, tx.citations(F.col("t")), t=None) == []


def test_token_estimate_counts_code_points(spark):
    assert one(spark, tx.estimate_tokens(F.col("t")), t="") == 1
    assert one(spark, tx.estimate_tokens(F.col("t")), t="😀" * 8) == 2


def test_fence_and_judgement(spark):
    reply = '```json\n{"score": 1, "reasoning": "ok"}\n```'
    assert one(spark, tx.strip_fence(F.col("t")), t=reply) == '{"score": 1, "reasoning": "ok"}'
    got = one(spark, tx.parse_judgement(F.col("t")), t=reply)
    assert (got["score"], got["reasoning"]) == (1.0, "ok")
    assert one(spark, tx.parse_judgement(F.col("t")), t='{"score": 7, "reasoning": "r"}')["score"] == 7.0
    for bad in ("garbage", '{"score": 1}', '{"score": "x", "reasoning": "r"}', "{'score': 1, 'reasoning': 'r'}", None):
        assert one(spark, tx.parse_judgement(F.col("t")), t=bad) is None


def test_parsers_fall_back(spark):
    sub = tx.parse_subqueries(F.col("t"), F.lit("q"))
    assert one(spark, sub, t='{"queries": ["a", "b", "c", "d"]}') == ["a", "b", "c", "d"]
    assert one(spark, sub, t='{"queries": []}') == ["q"]
    assert one(spark, sub, t="nonsense") == ["q"]
    assert one(spark, tx.parse_filter(F.col("t")), t='{"category": "cs.LG", "year": 2024}') == {"category": "cs.LG", "year": "2024"}
    assert one(spark, tx.parse_filter(F.col("t")), t="[1, 2]") == {}
    assert one(spark, tx.parse_next_query(F.col("t")), t='{"next_query": null}') is None
    assert one(spark, tx.parse_next_query(F.col("t")), t='{"next_query": "more"}') == "more"
    act = one(spark, tx.parse_action(F.col("t")), t='{"thought": "x", "action": "search_bm25", "action_input": "y"}')
    assert act.asDict() == {"thought": "x", "action": "search_bm25", "action_input": "y"}
    assert one(spark, tx.parse_action(F.col("t")), t='{"action": "delete"}')["action"] == "finish"
    assert one(spark, tx.parse_action(F.col("t")), t=None)["action"] == "finish"


def test_fill_does_not_fill_inserted_text(spark):
    got = one(spark, tx.fill('{{"k": 1}} {a}/{b}', a=F.lit("{b}"), b=F.lit("x")))
    assert got == '{"k": 1} {b}/x'


def test_sections_and_splits(spark):
    rows = spark.range(4).select(tx.section_of(F.col("id"), F.lit(4)).alias("s")).collect()
    assert [r.s for r in rows] == ["abstract", "introduction", "methods", "results"]
    assert one(spark, tx.paragraphs(F.col("t")), t=" a \n \n b\n\n\n") == ["a", "b"]
    assert one(spark, tx.sentences(F.col("t")), t="A. B?  C!\nD") == ["A.", "B?", "C!", "D"]
    assert one(spark, tx.sentences(F.col("t")), t=None) == []


def test_mock_embedding_and_score_match_python(spark):
    import hashlib

    digest = hashlib.sha256("héllo".encode()).digest()
    assert one(spark, vx.mock_vector(F.col("t"), 40), t="héllo") == [digest[i % 32] / 127.5 - 1.0 for i in range(40)]
    want = int.from_bytes(hashlib.sha256(b"q|t").digest()[:4], "big") / 2**32
    assert one(spark, vx.mock_score(F.lit("q"), F.col("t")), t="t") == want


def test_cosine_of_zero_vectors(spark):
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.cosine(z, z)) == 0.0
    assert one(spark, vx.l2(z, F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
