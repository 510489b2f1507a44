from itertools import combinations

from millrace.llm import glyphs, lookalike

ROWS = [
    (1, "The recall curve"), (2, "Тһe recall　curvе"), (3, "The re​call  curve "), (4, "the recall curve"), (5, "Ｔｈｅ recall curve"),
    (6, "Старый список"), (7, "Стaрый cпиcoк"), (8, "Старыи список"), (9, "x² is 12"), (10, "x2 is 12"), (11, "x² is 1²"),
    (12, None), (13, " ​"), (14, ""), (15, "The recall curve"), (16, "5 Å of ﬁne"), (17, "5 Å of fine"), (18, "été"), (19, "été"), (20, "ete"),
    (21, "the value of μ"), (22, "the νalue of µ"), (23, "ABLE pan"), (24, "ꓮꓐꓡꓰ paո"), (25, "old call"), (26, "old ϲall"), (27, "οld call"),
    (28, "το νερό ρέει"), (29, "o1d call"), (30, "OLD call"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "f") for r in rows], "case_id long, in_text string, key string, form string")


# By eye: which of the rows above show the same text. Ids of one group look alike; 1 and 15 are the same string.
ALIKE = [(1, 2, 3, 5, 15), (6, 7), (16, 17), (18, 19), (21, 22), (23, 24), (25, 26, 27)]


def test_pairs_are_those_seen_by_eye(spark):
    df = frame(spark, ROWS)
    model = lookalike.fit(df, "in_text")
    texts = dict(ROWS)
    wanted = {(a, b) for group in ALIKE for a, b in combinations(group, 2) if texts[a] != texts[b]}
    pairs = [(r.id_a, r.id_b) for r in lookalike.same_look_pairs(df, "case_id", "in_text", model).collect()]
    assert sorted(pairs) == sorted(wanted)


def test_hot_looks_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 3)
    rows = [(k, "same" if k % 2 else "sa​me") for k in range(20)]
    df = frame(spark, rows)
    model = lookalike.fit(df, "in_text")
    pairs = [(r.id_a, r.id_b) for r in lookalike.same_look_pairs(df, "case_id", "in_text", model).collect()]
    assert sorted(pairs) == [(a, b) for a, b in combinations(range(20), 2) if a % 2 != b % 2]
    classes = lookalike.look_classes(df, "case_id", "in_text", model).collect()
    assert sorted((r.case_id, r.class_id, r.n_rows) for r in classes) == [(k, 0, 20) for k in range(20)]


def test_near_letters_are_read_by_their_word(spark):
    model = lookalike.fit(frame(spark, ROWS), "in_text")
    assert model.normalize("the νalue of ꓣꓔ and kοp") == "the value of RT and kop"
    assert model.normalize("το νερό") == "το νερό"
    assert model.normalize("τo νερό") == "το νερό"
    assert model.normalize("a ııb") == "a ııb" and model.normalize("ϲall") == "call"


def test_the_search_reads_scripts(spark):
    model = lookalike.fit(frame(spark, ROWS), "in_text")
    assert model.normalize("Тһе rесаll") == "The recall"
    assert model.normalize("Cтaрый cписок") == "Старый список"
    assert model.normalize(None) is None and model.normalize(" ﻿") == ""
    long = "rесаll " * 20_000
    assert model.normalize(long) == " ".join(["recall"] * 20_000)


def test_empty_table(spark):
    df = frame(spark, [])
    model = lookalike.fit(df, "in_text")
    assert lookalike.same_look_pairs(df, "case_id", "in_text", model).count() == 0 and model.normalize("ab") == "ab"
