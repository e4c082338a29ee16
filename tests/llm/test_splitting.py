import random
import re

from lodesift.llm import splitting

BREAK = re.compile("[\t-\r 。！？]")


def pieces(spark, texts, limit=2400, overlap=200):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = splitting.split_texts(df, "t", limit, overlap, only_oversized=False).collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r.id].append(r)
    return {i: sorted(v, key=lambda r: r.piece_index) for i, v in out.items()}


def texts():
    rng = random.Random(11)
    words = ["alpha", "beta,", "gamma.", "δέλτα", "😀", "x" * 40, "end.\n\n", "line\n", "第三章。", "a;", "(b)", " c"]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(900, 2500))) for _ in range(12)]
    made += ["y" * 2400, "y" * 2401, "z" * 9000, "a " + "b" * 2400 + " c", "a " + "b" * 2401 + " c", "𝛼a" * 3000, " " * 5000, "w " * 3000]
    made += ["k" * 2300 + " " + "m" * 2350 + "\n" + "n" * 2399, "no break " * 400]
    return made


def test_pieces_tile_the_text_within_the_limit(spark):
    given = texts()
    for i, rows in pieces(spark, given).items():
        text, back = given[i], ""
        for n, r in enumerate(rows):
            assert r.piece_index == n and r.n_chars == len(r.piece) <= 2400
            assert text[r.start : r.start + r.n_chars] == r.piece
            assert back.endswith(r.piece[: r.n_overlap])
            back += r.piece[r.n_overlap :]
        assert back == text
        assert [r.boundary for r in rows][-1] == "end" and all(r.n_overlap <= 200 for r in rows)


def test_cut_is_forced_only_where_a_run_exceeds_the_limit(spark):
    given = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, t string")
    got = {r.id: r.cut for r in splitting.cut_kind(df, "t").collect()}
    want = {i: "forced" if max(map(len, BREAK.split(t))) > 2400 else "natural" for i, t in enumerate(given) if len(t) > 2400}
    assert got == want


def test_natural_pieces_end_at_breaks_and_share_about_the_overlap(spark):
    text = " ".join(f"Sentence {i} has some words in it." for i in range(900))
    rows = pieces(spark, [text])[0]
    assert all(r.boundary == "sentence" for r in rows[:-1])
    assert all(100 <= r.n_overlap <= 200 for r in rows[1:])
    para = "\n\n".join("word " * 180 for _ in range(20))
    assert {r.boundary for r in pieces(spark, [para])[0][:-1]} == {"paragraph"}


def test_null_empty_short_and_clashing_columns(spark):
    got = pieces(spark, [None, "", "short"])
    assert got[0] == [] and got[1] == [] and [r.piece for r in got[2]] == ["short"]
    df = spark.createDataFrame([(1, "a " * 2000, "x")], "start int, t string, boundary string")
    rows = splitting.split_texts(df, "t").collect()
    assert rows[0].start_in == 1 and rows[0].boundary_in == "x" and rows[0].start == 0
    assert splitting.split_texts(df.limit(0), "t").count() == 0


def test_other_limits(spark):
    text = "abc def. " * 300
    rows = pieces(spark, [text], 100, 20)[0]
    assert max(r.n_chars for r in rows) <= 100 and "".join(r.piece[r.n_overlap :] for r in rows) == text
