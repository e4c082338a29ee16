import json
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lodesift.plans import queries as core
from lodesift.sources import jsonl, notebooks, papers
from lodesift.streaming import events

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(core.queries()) > 50


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_rerank", "context_build", "run_pattern", "semantic_breakpoints"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = core.queries()[name](spark, DATA)
    rows = df.collect()
    if name in core.oracle_sql():
        cur = con.execute(core.oracle_sql()[name])
        at = {d[0]: i for i, d in enumerate(cur.description)}
        plain = lambda v: round(v, 5) if isinstance(v, float) else v
        want = sorted(repr([plain(r[at[c]]) for c in df.columns]) for r in cur.fetchall())
        assert sorted(repr([plain(v) for v in r]) for r in rows) == want
    else:
        assert rows


def test_json_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    rows = [{"chunk_id": "a", "text": "old"}, None, {"chunk_id": "b", "text": "x"}, {"chunk_id": "a", "text": "new"}]
    path.write_text("".join((json.dumps(r) if r else "") + "\n" for r in rows))
    got = {r.chunk_id: (r.ord, r.text) for r in jsonl.read_chunks(spark, str(path)).collect()}
    assert got["a"][1] == "new" and got["a"][0] < got["b"][0]
    jsonl.write_lines(spark.range(2), str(tmp_path / "out"), dry_run=True)
    assert not (tmp_path / "out").exists()


def test_notebook_sections(spark, tmp_path):
    def write(name, *titles):
        cells = [{"cell_type": "markdown", "source": ["intro\n", f"## {t}\n", "text"]} for t in titles] + [{"cell_type": "code", "source": ["## 9. no"]}]
        (tmp_path / name).write_text(json.dumps({"cells": cells}))

    write("good.ipynb", "1. Setup here", "2. Results")
    write("bad.ipynb", "2. Results", "1. Other", "2. Results")
    write("none.ipynb")
    heads = notebooks.headers(spark, str(tmp_path))
    files = spark.createDataFrame([("good.ipynb",), ("bad.ipynb",), ("none.ipynb",)], "notebook string")
    got = sorted((r.notebook, r.problem.split(":")[0]) for r in notebooks.problems(heads, files, [(1, "setup"), (2, "results")]).collect())
    assert got == [
        ("bad.ipynb", "duplicate section numbers"),
        ("bad.ipynb", "section 1 is titled 'Other', without 'setup'"),
        ("bad.ipynb", "section numbers out of order"),
        ("none.ipynb", "missing section 1 (setup)"),
        ("none.ipynb", "missing section 2 (results)"),
    ]


def test_atom_feed(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
      title</title><published>2024-01-02T00:00:00Z</published><author><name>N</name></author>
      <link title="pdf" href="http://x/1"/></entry><entry><id>http://arxiv.org/abs/2401.2</id></entry></feed>"""
    df = spark.createDataFrame([(xml,), ("broken",), (None,)], "xml string")
    rows = papers.parse_feeds(df).collect()
    assert [(r.paper_id, r.title, r.year, r.authors) for r in rows] == [("arxiv:2401.00001", "A title", 2024, ["N"])]
    assert "cat%3Acs.LG" in papers.search_url("http://x", "cs.LG", "202401010000", "202402010000")


@needs_data
def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.hourly(events.read_stream(spark, str(tmp_path / "in"), batch.schema), "100000 hours")
    run = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    a = {(str(r.hour)[:19], r.event_type): r.events for r in spark.table("hours").collect()}
    b = {(str(r.hour)[:19], r.event_type): r.events for r in events.hourly(batch).collect()}
    assert a == b and len(a) > 0
