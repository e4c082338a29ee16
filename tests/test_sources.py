import json

import pytest
from pyspark.sql import functions as F

from lodesift.operators import chunking, corpus
from lodesift.sources import build, jsonl, papers

FEED = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/2401.00001v3</id><published>2024-01-05T00:00:00Z</published><title>On  parts
 of things</title><author><name>A B</name></author><author><name>C D</name></author>
<link href="http://arxiv.org/abs/2401.00001v3" type="text/html"/><link title="pdf" href="http://arxiv.org/pdf/2401.00001v3"/></entry>
<entry><id>http://arxiv.org/abs/2401.00002v1</id><published>2024-01-06T00:00:00Z</published><title>No file</title></entry></feed>"""


def lines(path, rows):
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return f"file://{path}"


def test_questions_chunks_and_full_texts_from_lines(spark, tmp_path):
    q = lines(tmp_path / "q.jsonl", [{"qid": "1", "category": "filter", "question": "é?", "relevant_chunk_ids": ["a"], "requires_filter": {"year": 2024, "kind": "2024"}}, {"qid": "2", "question": "x", "requires_filter": None}])
    rows = {r.qid: r for r in jsonl.read_questions(spark, q).collect()}
    assert rows["1"].requires_filter == {"year": "2024", "kind": "2024"} and rows["1"].requires_typed == {"year": "2024", "kind": '"2024"'}
    assert rows["2"].requires_filter is None and rows["2"].requires_typed is None and len(rows) == 2
    c = lines(tmp_path / "c.jsonl", [{"chunk_id": "a", "text": "old"}, {"chunk_id": "b", "text": "b"}, {"chunk_id": "a", "text": "new"}])
    assert [(r.chunk_id, r.text) for r in jsonl.read_chunks(spark, c).orderBy("ord").collect()] == [("a", "new"), ("b", "b")]
    t = lines(tmp_path / "t.jsonl", [{"paper_id": "p", "full_text": "long"}])
    assert jsonl.read_full_texts(spark, t).first().full_text == "long"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q", "why", [("t", "finish", "", None)]), ("r", "how", [])], "qid string, question string, tool_call_trace array<struct<thought: string, action: string, action_input: string, observation: string>>")
    where = f"file://{tmp_path}/out"
    jsonl.write_lines(rows, where, dry_run=True)
    assert not (tmp_path / "out").exists()
    jsonl.write_lines(rows, where)
    jsonl.write_lines(rows.limit(1), where)
    assert spark.read.json(where).count() == 1
    jsonl.write_traces(rows, f"file://{tmp_path}/traces")
    assert [r.qid for r in spark.read.json(f"file://{tmp_path}/traces").collect()] == ["q"]
    (tmp_path / "p.txt").write_text("Say {x}\nnow")
    assert jsonl.read_template(spark, f"file://{tmp_path}/p.txt") == "Say {x}\nnow"


def test_feeds(spark, tmp_path):
    df = spark.createDataFrame([(1, FEED), (2, "<feed"), (3, None)], "n int, xml string")
    rows = papers.parse_feeds(df).collect()
    assert [(r.n, r.paper_id, r.title, r.authors, r.year, r.pdf_url) for r in rows] == [(1, "arxiv:2401.00001", "On parts of things", ["A B", "C D"], 2024, "http://arxiv.org/pdf/2401.00001v3")]
    url = papers.search_url("http://x/api", "cs.IR", "202401010000", "202402010000", 5, 10)
    assert "cat%3Acs.IR" in url and "start=5" in url and "max_results=10" in url and "descending" in url
    (tmp_path / "feed.xml").write_text(FEED)
    spark.dataSource.register(papers.FeedSource)
    read = spark.read.format("papers").option("base", f"file://{tmp_path}/feed.xml").option("most", "3").option("page", "2").load()
    assert sorted(r.page for r in read.collect()) == [0, 1] and papers.parse_feeds(read).count() == 2


def test_corpus_command_and_its_limits(spark, tmp_path, capsys):
    long = "\n\n".join(f"word{i} " * 60 for i in range(30))
    rows = [{"category": "A", "paper_id": f"p{i}", "place": i, "full_text": long if i != 1 else "short"} for i in range(9)]
    rows += [{"category": "B", "paper_id": f"p{i}", "place": i, "full_text": long} for i in range(3)]
    path = lines(tmp_path / "papers.jsonl", rows)
    df = spark.read.schema(build.PAPERS).json(path)
    chosen = {(r.category, r.paper_id): r.nth for r in corpus.select_papers(df, ["A", "B"], 2).collect()}
    assert chosen == {("A", "p0"): 1, ("A", "p2"): 2, ("B", "p1"): 1}
    # of four candidates one is too short and the rest of the category is not looked at
    assert corpus.select_papers(df.where("category = 'A' AND place IN (1, 2, 3, 4)").withColumn("full_text", F.when(F.col("place") < 4, "short").otherwise(F.col("full_text"))), ["A"], 1).count() == 0
    chunks = build.build_corpus(df, ["A"], 1).orderBy("chunk_index").collect()
    assert [c.chunk_id for c in chunks] == ["p0#0", "p0#1", "p0#2"] and chunks[0].section == "abstract"
    build.main(["--papers", path, "--categories", "A", "--papers-per-category", "1", "--output", f"file://{tmp_path}/o", "--dry-run"])
    assert "3 chunks" in capsys.readouterr().out and not (tmp_path / "o").exists()


def test_budget_batches_stream_over_groups(spark):
    rows = [("a", i, n) for i, n in enumerate([100, 100, 100, 300, 50, None])] + [(None, 1, 5), ("b", 1, 10)]
    df = spark.createDataFrame(rows, "g string, o int, n int")
    got = {(r.g, r.o): r.batch for r in chunking.budget_batches(df, "g", "o", "n", 250).collect()}
    assert [got["a", i] for i in range(6)] == [0, 0, 1, 2, 3, 3] and got[None, 1] == 0 and got["b", 1] == 0
    assert chunking.budget_batches(df.limit(0), "g", "o", "n", 250).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from lodesift import runtime

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    fake = type("S", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        runtime.shared_folder(fake)
