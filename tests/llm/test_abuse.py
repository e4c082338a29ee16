import numpy as np

from lodesift.llm import abuse

BAD = ["you are a worthless braindead moron and should be ashamed of the {}", "those filthy vermin must be thrown out of our {} forever", "i will smash your ugly face over that {}"]
FINE = ["the {} of the model grows with the number of layers", "we measure recall of every {} on a held out table", "a second {} was trained on the same corpus and frozen", "removing the {} degrades accuracy by a few points"]
SLOTS = ["retriever", "planner", "gradient", "baseline", "vocabulary", "posterior", "schedule", "encoder", "residual", "kernel"]


def collection(n=600, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels, truth = [], [], set()
    for i in range(n):
        parts = [rng.choice(FINE).format(rng.choice(SLOTS)).capitalize() + "." for _ in range(rng.integers(1, 6))]
        if rng.random() < 0.15:
            s = rng.choice(BAD).format(rng.choice(SLOTS))
            s = rng.choice([s, s.upper(), s.replace("o", "0"), s.replace("m", "m​"), " ".join(s)]) if rng.random() < 0.6 else s
            parts.insert(rng.integers(0, len(parts) + 1), s + ".")
            truth.add(i)
        docs.append((i, " ".join(parts)))
        if rng.random() < 0.3:
            flagged = (i in truth) != (rng.random() < 0.04)
            labels.append((i, "r", " Flagged" if flagged else "clean"))
    return docs, labels + [(3, "r", "unsure"), (None, "r", "flagged"), (10_000, "r", "flagged")], truth


def test_finds_hidden_offences_in_long_text_and_odd_spelling(spark):
    docs, labels, truth = collection()
    docs += [(9001, None), (9002, ""), (9003, " \n"), (9004, "12 34"), (9005, "ok. " * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as flagged")
    rows = abuse.score_documents(d, spark.createDataFrame(labels, "doc_id long, reviewer string, verdict string")).collect()
    got = {r.doc_id for r in rows if r.flagged}
    assert len(rows) == len(docs)
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.05 * len(got)
    by = {r.doc_id: r for r in rows}
    assert all(not by[i].flagged and by[i].evidence == [] for i in range(9001, 9005))
    hit = next(iter(got & truth))
    assert by[hit].score > 0.5 and by[hit].evidence and set(by[hit].evidence) <= {r[0] for r in labels}


def test_folding():
    assert abuse.fold("b a s t a r d!") == " bastard "
    assert abuse.fold("k.i.l.l.e.r") == " kiler "
    assert abuse.fold("br@1nl3$$ СОСKRОАСH duuumb naïve") == " brainles cockroach dumb naive "
    assert abuse.fold("") == "" and abuse.fold("123 !!") == ""


def test_index_is_exact():
    docs, _, _ = collection(200, 5)
    b = abuse.bags([t for _, t in docs])
    idf = np.log((len(b.owner) + 1) / (np.bincount(b.terms, minlength=abuse.DIMS) + 1)).astype(np.float32)
    w = abuse.weights(b, idf)
    dense = np.zeros((len(b.owner), abuse.DIMS), np.float32)
    dense[np.repeat(np.arange(len(b.owner)), np.diff(b.ptr)), b.terms] = w
    index, scratch = abuse.BlockMaxIndex(b.ptr, b.terms, w), np.zeros(abuse.DIMS, np.float32)
    off = abuse.Offences(b.ptr, b.terms, w, idf)
    could = off.reachable(b, w)
    for r in range(0, len(b.owner), 17):
        t, x = b.terms[b.ptr[r] : b.ptr[r + 1]], w[b.ptr[r] : b.ptr[r + 1]]
        cos = dense @ dense[r]
        rows, got = index.search(t, x, 0.35, scratch)
        want = np.flatnonzero(cos >= 0.35)
        assert set(rows[np.abs(got - 0.35) > 1e-5]) <= set(want) and set(want[np.abs(cos[want] - 0.35) > 1e-5]) <= set(rows)
        assert off.near(t, x, scratch, could[r])
        assert not scratch.any()


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reviewer string, verdict string")
    row = abuse.score_documents(d, none).first()
    assert not row.flagged and row.evidence == []
    assert abuse.score_documents(d.limit(0), none).count() == 0


def test_large_groups_of_copies_stay_examples():
    rng = np.random.default_rng(2)
    fine = lambda: " ".join(rng.choice(FINE).format(rng.choice(SLOTS)).capitalize() + "." for _ in range(3))
    bad = BAD[0].format("retriever").capitalize() + "."
    # a third of the documents are copies which say it several times; in the second collection over 745 of them
    for n, times in ((240, 4), (2400, 1)):
        texts = [" ".join([bad] * times) if i % 3 == 0 else fine() for i in range(n)]
        y = [float(i % 3 == 0) for i in range(n)]
        b = abuse.bags(texts)
        counts = abuse.Counts(np.bincount(b.terms, minlength=abuse.DIMS), abuse.documents_with(b), len(b.owner), n)
        ex = abuse.Examples(list(range(n)), texts, y, counts)
        keep = ex.y < 0.5
        rows = np.flatnonzero(~keep)
        keep[rows] = ex.keeps(rows)
        raw, _ = abuse.Model(ex, keep).score([None, None], [bad, fine()])
        assert raw[0] >= 0.9 and raw[1] == 0, (n, raw)


def test_a_document_is_no_evidence_for_itself(spark):
    import random

    rng = random.Random(2)
    fine = [" ".join(rng.choice("dense sparse query table layer index cache window token vector score paper".split()) for _ in range(14)) + "." for _ in range(60)]
    insult = "You revolting gutless imbecile, crawl back into your filthy hole."
    docs = [(i, t) for i, t in enumerate(fine)] + [(100 + i, f"{fine[i]} {insult}") for i in range(6)] + [(200, "Zygomorphic quokkas prefer xylophones over bagpipes nowadays.")]
    labels = [(i, "clean") for i in range(30)] + [(100 + i, "flagged") for i in range(5)] + [(200, "flagged")]
    scored = abuse.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, verdict string"))
    got = {r.doc_id: r for r in scored.collect()}
    assert got[105].flagged and got[100].flagged and 100 not in got[100].evidence
    assert not got[200].flagged and got[200].evidence == [] and not any(got[i].flagged for i in range(60))
