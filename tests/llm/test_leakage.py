import random

import numpy as np
import pytest

from millrace.llm import leakage as m

ITEM = "Maruk counts 156 goats and 852 finches near the mill pond, of which every 4th wears a violet ring; if so, who?"


def frames(spark, records, items):
    corpus = spark.createDataFrame([(*r, "s", "i") for r in records], "id string, text string, suite string, item_id string")
    return corpus, spark.createDataFrame([(*i, 1) for i in items], "suite string, item_id string, text string, id int")


def test_cases(spark):
    w = ITEM.split()
    records = [
        ("whole", f"See: {ITEM} End."), ("part", "x " + " ".join(w[3:15]) + " y"), ("eleven", "x " + " ".join(w[3:14]) + " y"),
        ("look", "Mаruk  counts 156 g​oats\n> and *852* FINCHES near the mill pond"), ("json", '{"a": "Maruk counts 156 goats and 852\\nfinches near the mill pond, of"}'),
        ("swap", " ".join(w[11:] + ["z"] + w[:11])), ("short", "he asked who owns the red boat, then left"), ("not", "who owns the blue boat"), ("null", None), ("blank", " "), ("whole", f"See: {ITEM} End."), ("long", "word " * 50_000 + ITEM),
    ]
    corpus, items = frames(spark, records, [("s", "1", ITEM), ("t", "9", ITEM.upper()), ("s", "2", "Who owns the red boat?"), ("s", "3", None), ("s", "4", "...")])
    hits = m.scan(corpus, items).cache()
    got = {(r.id, r.suite, r.item_id) for r in m.leaked(hits).collect()}
    assert got == {(i, *k) for i in ("whole", "part", "json", "long") for k in (("s", "1"), ("t", "9"))} | {("short", "s", "2")}
    assert {r.suite: (r.leaked_items, r.reordered_items, r.records, r.status) for r in m.suite_report(hits, items).collect()} == {"s": (2, 1, 6, "flagged"), "t": (1, 1, 5, "flagged")}


def test_reordered_passages(spark):
    w = [f"w{k}" for k in range(30)]
    corpus, items = frames(spark, [("r", " ".join(w[20:] + ["q"] + w[10:20] + ["q"] + w[:10])), ("n", " ".join(w[:9]))], [("s", "1", " ".join(w)), ("t", "2", "nothing of the kind is there")])
    hits = m.scan(corpus, items)
    assert m.leaked(hits).count() == 0
    assert [(r.id, r.n_tiles, r.coverage) for r in m.reordered(hits).collect()] == [("r", 3, 1.0)]
    report = m.suite_report(hits, items)
    assert {r.suite: (r.leaked_items, r.reordered_items, r.status) for r in report.collect()} == {"s": (0, 1, "flagged"), "t": (0, 0, "clean")}
    stated = "result_id string, suite string, decontamination struct<status string, against array<string>>"
    results = spark.createDataFrame([("a", "s", ("Clean ", ["T", "s", "t", None])), ("a", "s", ("Clean ", ["T", "s", "t", None])), ("b", "t", ("CLEAN", ["t", "s"])), ("c", "t", None), ("d", "u", ("clean", []))], stated)
    got = {r.result_id: (r.stated, r.status, r.stated_against, r.against, r.agrees) for r in m.corrected(results, report).collect()}
    both = ["s", "t"]
    assert got == {"a": ("clean", "flagged", both, both, False), "b": ("clean", "clean", both, both, True), "c": (None, "clean", None, both, False), "d": ("clean", None, [], both, False)}


def test_longest_run_is_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 25))] for _ in range(2))
        best = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 25) if i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k]), default=0)
        found = m.tiles(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert max((k for _, _, k in found), default=0) == (best if best >= m.SEED else 0)
        used = [x for at, _, k in found for x in range(at, at + k)]
        assert len(used) == len(set(used)) and all(a[r : r + k] == b[i : i + k] for r, i, k in found)


def test_hits_are_the_brute_force_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(m, "BITS", 1 << 6)  # a full filter lets everything pass and changes nothing
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    records, made = [(str(k), text(rnd.randrange(1, 40))) for k in range(60)], [("s", str(k), text(rnd.randrange(1, 16))) for k in range(25)]
    corpus, items = frames(spark, records, made)
    held = lambda t, i, n: any(f" {' '.join(i.split()[k : k + n])} " in f" {t} " for k in range(len(i.split()) - n + 1))
    wanted = {(a, b) for a, t in records for _, b, i in made if held(t, i, min(m.RUN, len(i.split())))}
    assert {(r.id, r.item_id) for r in m.leaked(m.scan(corpus, items)).collect()} == wanted and wanted
    with pytest.raises(ValueError):
        m.scan(corpus, items.limit(0))
    assert m.leaked(m.scan(corpus.limit(0), items)).count() == 0


def test_reordered_items_of_repeated_words_are_found(spark):
    often, rare = ["so", "it", "goes", "round"], [f"r{k}" for k in range(6)]
    item = [w for _ in range(9) for w in often] + rare
    record = [w for k in range(5) for w in [*often, *often, f"x{k}"]]
    corpus, items = frames(spark, [("a", " ".join(record))], [("s", "1", " ".join(item))])
    hits = m.scan(corpus, items).collect()
    assert [r.id for r in hits] == ["a"]
