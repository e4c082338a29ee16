from lodesift.llm import pairs

Q = "What recall does TasuRank reach on MiraQA?"


def found(spark, rows):
    df = spark.createDataFrame([("answers", str(i), f"q{i}", q, a) for i, (q, a) in enumerate(rows)], "src string, pair_key string, qid string, question string, answer string")
    return {int(r.pair_key): r.defect for r in pairs.broken_pairs(df).collect()}


def test_empty_answers():
    for a in (None, "", " \n", "​﻿", "...", "—", "<br>", "n/a", "N/A", "None", "null", "[]", "**", "```\n```", "&nbsp;"):
        assert pairs.is_empty(a), a
    for a in ("0.5", "Yes.", "No", "8", "A dense pool."):
        assert not pairs.is_empty(a), a


def test_copies():
    for a in (Q, Q.lower(), "Question: " + Q, Q.replace("?", "."), f'"{Q}"', "What recall does reach on MiraQA? TasuRank"):
        assert pairs.copies(Q, a), a
    for a in (Q + " TasuRank reaches a recall of 0.5 on MiraQA.", "0.5", "TasuRank reaches a recall of 0.5 on MiraQA."):
        assert not pairs.copies(Q, a), a


def test_languages():
    de = "Die Einbettung ist nicht stabil, weil die Tabelle der Richter unvollständig ist."
    assert pairs.other_language(Q, de) and not pairs.other_language("Warum scheitert die Tabelle auf MiraQA?", de)
    assert pairs.other_language(Q, "我们研究稀疏检索在这些文档上是否稳定。") and pairs.other_language(Q, "Каждая метрика сравнивается с кандидатами.")
    assert not pairs.other_language(Q, "0.5") and not pairs.other_language(Q, "The German paper »Über Messung und Sätze« reports 35 percent for it.")


def test_refusals_templates_and_look_alikes(spark):
    normal = [(f"What recall does Tasu{i}Rank reach on Mira{i}QA?", f"Tasu{i}Rank reaches a recall of 0.{i} on Mira{i}QA.") for i in range(30)]
    refusing = [
        (Q, "I cannot answer this question based on the provided context."),
        (Q, "Hmm. I'm not able to say."),
        (Q, "Hmm. Not mentioned in the given passages."),
        (Q, "Hmm. i cannot answer this question based on the provided context"),
        (Q, "I’m sorry, but I can’t help with that. Let me know if I can do anything else."),
        (Q, "No answer can be given here. Let me know if I can do anything else."),
        (Q, "Unfortunately I don't know. Let me know if I can do anything else."),
        ("Warum scheitert die Tabelle?", "Das kann ich anhand des Kontexts leider nicht beantworten."),
        ("¿Qué valor alcanza?", "Lo siento, no puedo responder a esa pregunta."),
        ("Quelle table utilise-t-il ?", "Je suis désolé, je ne peux pas répondre à cette question."),
    ]
    fine = [
        (Q, 'TasuRank answers "I don\'t know" for 71.0 queries, the baseline for none.'),
        (Q, "The authors cannot explain the gap of 0.5, but they attribute it to tables from MiraQA."),
        (Q, "Sorry is a token that TasuRank removes from documents."),
        (Q, "The dataset does not hold such agents, which is why TasuRank drops them."),
    ]
    got = found(spark, normal + refusing + fine)
    at = len(normal)
    assert {i: got.get(i) for i in range(at, at + len(refusing))} == {i: "refusal" for i in range(at, at + len(refusing))}
    assert not any(i in got for i in [*range(at), *range(at + len(refusing), at + len(refusing) + len(fine))])


def test_truncation_and_one_row_a_pair(spark):
    whole = [(Q, f"The table {w} relies on the sparse query of MiraQA. It was trained with {i} layers from the corpus.") for i, w in enumerate("abcdefghijkl")]
    stopless = [(Q, f"The table {w} relies on the sparse query of MiraQA") for w in "mnop"]
    broken = [
        (Q, "The table relies on the"),
        (Q, "The table relies on the sparse query of MiraQA. It was trained wi"),
        (Q, "The table relies on it. We show\n```\nfor x in"),
        (Q, "The table relies on it. Table 2 lists …"),
        (Q, "It holds [arxiv:2101.0"),
        (Q, "Two things:\n1. the table is dropped\n2."),
    ]
    rows = whole + stopless + broken
    got = found(spark, rows)
    assert set(got) == set(range(len(whole) + len(stopless), len(rows))) and set(got.values()) == {"truncated"}


def test_lists_without_stops_are_finished(spark):
    whole = [(Q, f"Three things change:\n- recall grows by 0.{i}\n- the {w} is dropped\n- {w}s are shared") for i, w in enumerate(["table", "layer", "query", "prompt"])]
    cut_off = [(Q, "Three things change:\n- recall grows by"), (Q, "Three things change:\n- recall grows by 0.5\n- the ta")]
    assert found(spark, whole + cut_off) == {4: "truncated", 5: "truncated"}


def test_blank_questions_repeats_and_empty_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, None), ("  ", None), (Q, None)]) == {2: "empty"}
    df = spark.createDataFrame([("answers", "1", "q", Q, None)] * 3 + [("qa_set", "1", "q", Q, "")], "src string, pair_key string, qid string, question string, answer string")
    assert sorted(tuple(r) for r in pairs.broken_pairs(df).collect()) == [("answers", "1", "empty"), ("qa_set", "1", "empty")]


def test_refusals_of_many_sentences(spark):
    offers = ["I can look at other papers.", "I can list the tables.", "I can rank the passages again.", "I can shorten the question.", "I can name related work.", "I can widen the search.", "I can stop here."]
    refusing = [(f"{Q} {w}", " ".join(["I cannot answer this question based on the provided context.", *offers])) for w in "abcd"]
    told = [(f"{Q} {w}", " ".join([*(f"The {x} table holds a sparse query." for x in ("first", "second", "third", "fourth", "fifth", "sixth", "last")), "It is dropped."])) for w in "ef"]
    assert found(spark, refusing + told) == {i: "refusal" for i in range(4)}


def _topics(n):
    kinds = ["What recall does Tasu{i}Rank reach?", "Why does the {w} table fail?", "How many layers were used to train Mira{i}QA?", "Describe how Oro{i}Mix handles {w} judges.", "Which {w} split does Vela{i}Index rely on?"]
    words = ["dense", "sparse", "greedy", "noisy", "causal", "lossy", "deep"]
    return [kinds[i % len(kinds)].format(i=i, w=words[i % len(words)]) for i in range(n)]


def test_templates_need_no_listed_phrase(spark):
    wording = "That lies beyond what this desk may talk about, friend."
    told = [(q, f"It holds 0.{i} of the {q.split()[2]} parts.") for i, q in enumerate(_topics(60))]
    got = found(spark, told[20:] + [(q, wording) for q in _topics(20)])
    assert not pairs.declines(wording)
    assert got == {40 + i: "refusal" for i in range(20)}


def test_what_recurs_for_one_kind_of_prompt_is_an_answer(spark):
    told = [(q, f"It holds 0.{i} of the {q.split()[2]} parts.") for i, q in enumerate(_topics(40))]
    asked = [(f"Does Vela{i}Mix need a cache when it is {w}?", "Yes, it certainly always does.") for i, w in enumerate("abcdefghij")]
    assert found(spark, told + asked) == {}


def test_refusals_of_seven_sentences_and_of_other_scripts(spark):
    seven = "I cannot answer this question. It is late. The desk is closed. Nobody is in. Come again. Call first. Have a good day."
    told = [(q, f"It holds 0.{i} of the {q.split()[2]} parts.") for i, q in enumerate(_topics(40))]
    other = ["这个问题超出了我们可以谈论的范围。", "Этот разговор выходит за пределы дозволенного."]
    rows = [(q, seven) for q in _topics(5)]
    rows += [(q, other[0]) for q in ("为什么稠密表失败？", "哪个模型最好？", "多少层用于训练？", "描述一下贪心查询。")]
    rows += [(q, other[1]) for q in ("Почему таблица неверна?", "Какая модель лучше?", "Сколько слоев обучено?", "Опишите жадный запрос.")]
    got = found(spark, told + rows)
    assert all(got.get(40 + i) == "refusal" for i in range(len(rows)))
    assert not any(i in got for i in range(40))


def test_a_bracket_left_open_long_before_the_end_is_truncated():
    assert pairs.ending("The table relies on it (see " + "the long list of words " * 10 + "here")[0] == "broken"
    assert pairs.ending("A smile :( is none. The table is dense.")[0] == "closed"
