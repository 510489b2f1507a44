import numpy as np
import pytest

from millrace.llm import encode, windows

pytest.importorskip("sentencepiece")
TEXTS = ["", None, " ", "Hello  world's 12\n\n naïve 日本🙂", "\x00\t<|endoftext|>", "ab" * 30_000, "​﻿x", "á" * 50]


def test_ids_are_the_public_ones(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("public", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(encode.vocabulary_path()), special_tokens={})
    rows = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string, mr_text string")
    got = {r.doc_id: r.ids for r in encode.encoded(rows, "doc_id", "text").collect()}
    assert got == {k: public.encode_ordinary(t) if t else [] for k, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in encode.decoded(encode.encoded(rows, "doc_id", "text"), "doc_id").collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    assert encode.encoded(rows.limit(0), "doc_id", "text").count() == 0


def test_no_window_is_overfull():
    rnd = np.random.RandomState(3)
    for length, separator in ((7, True), (64, False), (64, True)):
        sizes = rnd.randint(1, 150, 700)
        out = windows.pack_lane(np.arange(700), sizes, length, separator)
        assert out.groupby("doc_id")["size"].sum().tolist() == sizes.tolist()
        used = out.groupby("window")["size"].agg(["sum", "count"])
        assert (used["sum"] + separator * (used["count"] - 1) <= length).all()
        whole = out[out["doc_id"].isin(np.flatnonzero(sizes <= length))]
        assert whole["doc_id"].is_unique
        assert (out["offset"] + out["size"] <= length).all()


def test_choice_is_brute_force():
    rnd = np.random.RandomState(1)
    sizes, capacity = rnd.randint(1, 12, 200), 20
    where, fills = windows.sum_of_squares(sizes, capacity)
    level = {}
    for size, window in zip(sizes.tolist(), where.tolist()):
        def cost(counts):
            return sum(n * n for n in counts)

        def after(at):
            counts = np.bincount([x for x in level.values() if x < capacity], minlength=capacity)
            if at:
                counts[at] -= 1
            if at + size < capacity:
                counts[at + size] += 1
            return cost(counts)

        choices = {0: after(0), **{x: after(x) for x in set(level.values()) if x + size <= capacity and x < capacity}}
        assert choices[level.get(window, 0)] == min(choices.values())
        level[window] = level.get(window, 0) + size
    assert [level[w] for w in range(len(fills))] == fills.tolist()


def test_fill_windows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, ""), (4, "x " * 40), (5, "one two"), (5, "one two")], "doc_id long, text string").selectExpr("*", "1 as lane", "2 as size", "3 as setting")
    packing = spark.createDataFrame([("p", 16, True, 9), ("q", 8, False, None)], "packing_id string, sequence_length int, eos_between_docs boolean, drop_short_below int")
    rows = windows.fill_windows(docs, packing).collect()
    assert {(r.packing_id, r.doc_id) for r in rows if r.window is None} == {(p, d) for p in "pq" for d in (2, 3)}
    assert sum(r["size"] for r in rows if r.packing_id == "p") == sum(r["size"] for r in rows if r.packing_id == "q") == 5 + 41 + 2 + 2
    assert windows.fill_windows(docs.limit(0), packing).count() == 0
    packed = windows.fill_windows(docs, packing)
    assert windows.faults(packed, docs, packing).count() == 0
    cut = packed.where("not (doc_id = 1 and packing_id = 'p')").unionByName(packed.where("doc_id = 1 and packing_id = 'p'").selectExpr("packing_id", "doc_id", "piece", "start", "size - 1 as size", "window", "offset"))
    assert [tuple(r) for r in windows.faults(cut, docs, packing).collect()] == [("p", "tokens", 1)]
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
    rows = windows.fill_windows(named, packing).collect()
    assert {r.doc_id for r in rows} == {"d1", "d2", "d3", "d4", "d5"} and windows.faults(windows.fill_windows(named, packing), named, packing).count() == 0
    with pytest.raises(ValueError):
        windows.fill_windows(docs, packing.selectExpr("packing_id", "0 as sequence_length", "eos_between_docs"))
