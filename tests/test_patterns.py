import pytest
from pyspark.sql import functions as F

from lodesift.functions.providers import MockLLM
from lodesift.operators import dense, lexical
from lodesift.plans import patterns

TEXTS = ["speculative decoding of language models", "convolutional networks for images", "learning from human feedback", "gradient descent", "transformers"]


def make(spark, llm=None):
    rows = [(f"c{i}", i, t, f"p{i // 2}", "cs.LG" if i % 2 == 0 else "cs.CV", 2020 + i) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord long, text string, paper_id string, category string, year int")
    return patterns.Collection(chunks, llm or MockLLM())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([("q1", "speculative decoding?"), ("q2", "gradient")], "qid string, question string")


@pytest.mark.parametrize("name", list(patterns.PATTERNS))
def test_every_pattern_answers_every_question(spark, asked, name):
    rows = patterns.PATTERNS[name](make(spark), asked, 3).collect()
    assert sorted(r.qid for r in rows) == ["q1", "q2"]
    assert all(r.answer == "This is a mock response." and len(r.retrieved_chunk_ids) <= 3 and r.output_tokens > 0 for r in rows)


def ids(df, qid="q1"):
    return df.where(F.col("qid") == qid).first().retrieved_chunk_ids


def test_lexical_first_and_fused_within_pools(spark, asked):
    assert ids(patterns.bm25(make(spark), asked, 2))[0] == "c0"
    assert set(ids(patterns.hybrid(make(spark), asked, 5))) <= {f"c{i}" for i in range(5)}


def test_hybrid_rerank_names_only_what_is_left_of_the_pools(spark, asked, monkeypatch):
    asked = asked.unionByName(spark.createDataFrame([("q3", "Gradient!"), ("q4", "of"), ("q5", "?")], asked.schema))
    col = make(spark)
    want = sorted(patterns.hybrid_rerank(col, asked, 3, col.lexical(asked, patterns.POOL)).collect())
    fused = sorted(patterns.hybrid_ranked(col, asked, 4, col.lexical(asked, patterns.POOL)).collect())

    def never(*_):
        raise AssertionError("whole pools were named")

    monkeypatch.setattr(lexical, "named", never)
    monkeypatch.setattr(dense, "named", never)
    assert sorted(patterns.hybrid_rerank(make(spark), asked, 3).collect()) == want and len(want) == 15
    assert sorted(patterns.hybrid_ranked(make(spark), asked, 4).collect()) == fused


def test_self_query_filters_below_the_ranking(spark, asked):
    col = make(spark, MockLLM(canned={"Which of the fields": '{"category": "cs.CV"}'}))
    row = patterns.self_query(col, asked, 10).where("qid = 'q1'").first()
    assert sorted(row.retrieved_chunk_ids) == ["c1", "c3"] and row.extracted_filter == {"category": "cs.CV"}
    none = make(spark, MockLLM(canned={"Which of the fields": '{"category": "nope"}'}))
    assert ids(patterns.self_query(none, asked, 10)) == []
    year = make(spark, MockLLM(canned={"Which of the fields": '{"year": 2021}'}))
    assert ids(patterns.self_query(year, asked, 10)) == ["c1"]


def test_multi_hop_stops_or_goes_on(spark, asked):
    plain = patterns.multi_hop(make(spark), asked, 10).where("qid = 'q1'").first()
    on = make(spark, MockLLM(canned={"one more search": '{"next_query": "transformers"}'}))
    more = patterns.multi_hop(on, asked, 10).where("qid = 'q1'").first()
    assert len(plain.retrieved_chunk_ids) == 5 and len(more.retrieved_chunk_ids) == 5
    assert more.output_tokens > 0 and plain.output_tokens == 12  # one decision, one answer


def test_agent_trace_and_limits(spark, asked):
    search = '{"thought": "t", "action": "search_bm25", "action_input": "gradient"}'
    endless = patterns.agentic(make(spark, MockLLM(canned={"Search for context": search})), asked, 10).where("qid = 'q1'").first()
    assert len(endless.tool_call_trace) == 4 and endless.retrieved_chunk_ids[0] == "c3"
    assert endless.tool_call_trace[0].observation.startswith("Retrieved: ['c3'")
    stop = patterns.agentic(make(spark), asked, 10).where("qid = 'q1'").first()
    assert [(s.action, s.observation) for s in stop.tool_call_trace] == [("finish", None)] and stop.retrieved_chunk_ids == []


def test_contextual_blurb_stays_in_the_index(spark, asked):
    col = make(spark, MockLLM(canned={"Sentences:": "  BLURB \n"}))
    rows = {r.chunk_id: r for r in patterns.contextual_chunks(col).collect()}
    assert rows["c1"].embed_text == "BLURB\n\n" + TEXTS[1]
    assert rows["c0"].r.cache_creation_input_tokens > 0 and rows["c1"].r.cached_input_tokens > 0
    assert len(rows) == len(TEXTS)


def test_long_context_refuses_what_no_model_reads(spark, asked, monkeypatch):
    monkeypatch.setattr(patterns, "MOST_CONTEXT_CHARS", 10)
    with pytest.raises(ValueError):
        patterns.long_context(make(spark), asked)


def test_long_context_query_holds_the_whole_corpus(spark, asked, monkeypatch):
    from lodesift.plans import queries

    monkeypatch.setattr(patterns, "MOST_CONTEXT_CHARS", 10)
    monkeypatch.setattr(queries, "collection", lambda *_: make(spark))
    monkeypatch.setattr(queries, "questions", lambda *_: asked)
    monkeypatch.setattr(queries, "_answers", lambda df: df)
    rows = {r.qid: r for r in queries.long_context(spark, "").collect()}
    head, tail = patterns.PROMPTS["generate"].split("{context}")
    share = len(head + "\n\n".join(f"[c{i}] {t}" for i, t in enumerate(TEXTS))) // 4
    assert set(rows) == {"q1", "q2"} and rows["q1"].retrieved_chunk_ids == [f"c{i}" for i in range(5)]
    assert all(r.input_tokens == share + len(tail.replace("{question}", r.question)) // 4 for r in rows.values())
    assert (rows["q1"].cache_creation_input_tokens, rows["q2"].cached_input_tokens) == (share, share)


def test_long_context_by_size_sends_the_text_where_it_is_needed(spark, asked):
    from lodesift.functions.providers import CallableLLM

    col = make(spark, CallableLLM(lambda: lambda p: (p, 1, 2, 0, 0, 0.5)))
    sent = {r.qid: r.answer for r in patterns.long_context_by_size(col, asked).collect()}
    assert sent == {r.qid: r.answer for r in patterns.long_context(col, asked).collect()}


def test_study_reranks_every_candidate_once(spark, tmp_path):
    from lodesift.functions.providers import CallableReranker
    from lodesift.plans import queries

    log = str(tmp_path / "scored")

    def make():
        def score(questions, texts):
            with open(log, "a") as f:
                f.write("x" * len(questions))
            return [float(len(t)) for t in texts]

        return score

    rows = [(f"p{i}#0", i, f"p{i}", f"term{i % 9} word{i}") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord long, paper_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"term{i}", [f"p{i}#0"]) for i in range(5)], "qid string, question string, relevant_chunk_ids array<string>")
    col = patterns.Collection(chunks, reranker=CallableReranker(make))
    pool = patterns.hybrid_ranked(col, asked, patterns.POOL).count()
    assert queries._study(col, asked, chunks).count() == 1
    assert len(open(log).read()) == pool
