import pathlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import cutoff, safety


def test_disguises_are_undone():
    assert safety.stretches("You are an 1d10t, a m o r o n and p.a.t.h.e.t.i.c, soooo stuuupid!") == [["you", "are", "an", "idiot", "amoron", "and", "pathetic", "so", "stupid"]]
    assert safety.stretches("dana: ｆｉlthy ＩＤＩОТ\nTwo. \"Three\" 12") == [["filthy", "idiot"], ["two"], ["thre", "0"]]
    assert safety.stretches("") == [] and max(map(len, safety.stretches("word " * 5000))) == safety.LONG


def labelled(spark):
    rnd = random.Random(5)
    subject = ["the loader", "the filter", "the parser", "our cache"]
    clean = [f"{rnd.choice(subject)} read {rnd.randrange(900)} rows. Kill the zombie process on node {rnd.randrange(50)} first." for _ in range(160)]
    bad = [f"{rnd.choice(subject)} read {rnd.randrange(900)} rows. {rnd.choice(['Shut up, you worthless idiot, nobody likes you.', 'You filthy moron should go and die.'])}" for _ in range(60)]
    rows = [(k, t, "s") for k, t in enumerate(clean + bad)]
    docs = spark.createDataFrame([*rows, (900, None, "s"), (901, "", None), (902, "Shut up, you w0rthless i d i o t, nobody likes you. " * 300, "s")], "doc_id long, text string, source string").selectExpr("*", "'q' as unsafe", "'r' as mr_text")
    flips = {3, 170}
    votes = [(t, (k < 160) != (k in flips), r) for k, t, _ in rows for r in ("a", "b")] + [(clean[0], None, "c"), (None, True, "c")]
    labels = spark.createDataFrame(votes, "t string, keep_safety boolean, rater string").selectExpr("upper(sha2(t, 256)) as content_hash", "keep_safety", "rater")
    return docs, labels, set(range(160, 220)) | {902}


def test_scores(spark):
    docs, labels, wanted = labelled(spark)
    chain = safety.fit(docs, labels)
    scores = safety.scored(docs, chain, "doc_id", "text", "source").cache()
    got = {r.doc_id for r in safety.found(scores).collect()}
    assert len(got & wanted) >= 0.95 * len(wanted) and len(got - wanted) <= 3 and not got & {900, 901}
    assert scores.count() == 223 and {r.source for r in safety.rates(scores).collect()} == {"s", None}
    assert safety.found(safety.scored(docs.limit(0), chain)).count() == 0


def test_without_labels_nothing_is_unsafe(spark):
    docs, labels, _ = labelled(spark)
    chain = safety.fit(docs, labels.limit(0))
    assert chain.score(["you stupid idiot", None, ""]).max() == 0.0
    assert safety.scored(docs, chain).count() == 223


def test_scores_of_a_text_are_the_highest_of_its_stretches(spark):
    docs, labels, _ = labelled(spark)
    chain = safety.fit(docs, labels)
    one, two, both = chain.score(["You filthy moron should go and die.", "Shut up, you worthless idiot, nobody likes you.", "You filthy moron should go and die. Shut up, you worthless idiot, nobody likes you."])
    assert (abs(both - [max(a, b) for a, b in zip(one, two)]) < 1e-9).all() and both[-1] > 0.9


def test_scores_held_against_thresholds(spark):
    scores = spark.createDataFrame([("a", 0.9), ("a", 0.9), ("b", 0.1), ("c", 0.2), (None, 0.0)], "h string, unsafe double")
    predictions = spark.createDataFrame([("A", 0.2, 1, 1), ("a", 0.8, 2, 1), ("B", 1.7, 1, 1), ("c", 0.6, 1, 1), ("c", 0.6, 1, 1), ("d", 0.1, 1, 1)], "content_hash string, safety float, scored_at int, ingested_at int")
    labels = spark.createDataFrame([("A", False, "x"), ("a", False, "x"), ("b", True, "x"), ("c", True, "x"), ("c", False, "y")], "content_hash string, keep_safety boolean, rater string")
    configs = spark.createDataFrame([("one", 0.5), ("two", None)], "config_id string, safety_threshold float")
    rows = [tuple(r) for r in safety.held_against(scores, predictions, labels, configs).collect()]
    assert rows == [("one", 0.5, 3, 2, 2, 2, 2, 2, 0)]


def test_endings():
    assert cutoff.ending('{"a": [1, 2], "b": "x')[0] == "json" and cutoff.ending('{"a": [1, "]"]}')[0] == "whole"
    assert cutoff.ending("We read the rows and the tables,")[0] == "mark" and cutoff.ending("x = f(a,")[0] == "whole"
    assert cutoff.ending("It ended well.")[0] == "whole" and cutoff.ending("A short title")[0] == "whole"
    assert cutoff.ending("�...")[0] == "whole" and cutoff.ending("")[0] == "whole"
    assert cutoff.core("one two [...]") == ("one two", True) and cutoff.core("one two�") == ("one two", True)


def documents(spark):
    rnd = random.Random(8)
    verbs, nouns = ["reads", "writes", "drops", "splits", "merges"], ["packing owners", "shard writers", "label tables", "score journals", "hash tables"]
    sentence = lambda: f"The {rnd.choice(nouns)} {rnd.choice(verbs)} {rnd.randrange(99)} rows while the {rnd.choice(nouns)} wait for the {rnd.choice(nouns)}."
    whole = [" ".join(sentence() for _ in range(8)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(whole)]
    cut = [whole[0][:-40] + "…", whole[1][: len(whole[1]) - 9], whole[2][: whole[2].rindex("while") + 5]]
    rows += [(200 + k, t) for k, t in enumerate(cut)] + [(210, cut[0])]
    same = [whole[3][:-1], whole[4] + "..", whole[5] + "\n\nBest wishes\nthe night rota", "* one item\n* two items\n* last label"]
    rows += [(300 + k, t) for k, t in enumerate(same)] + [(400, None), (401, " "), (402, "q" * 200_000)]
    return spark.createDataFrame([(*r, "s", 1, "a") for r in rows], "doc_id long, text string, source string, size int, h string"), {200, 201, 202, 210}


def test_cut_documents(spark):
    docs, wanted = documents(spark)
    cut = cutoff.cut_documents(docs).cache()
    got = {r.doc_id: r.how for r in cut.collect()}
    assert set(got) == wanted and "copy" in got.values()
    assert [(r.source, r.n_docs, r.n_cut) for r in cutoff.rates(docs, cut).collect()] == [("s", docs.count(), 4)]
    assert cutoff.cut_documents(docs.limit(0)).count() == 0


def test_band_keys_find_similar_beginnings():
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    other = words[:100] + ["new"] + words[101:]
    keys = lambda ws: cutoff.band_keys(cutoff.shingle_hashes(cutoff.read(" ".join(ws))), cutoff._lengths(len(ws)))
    a, b, half = keys(words), keys(other), keys(words[:150])
    assert a.shape == (len(cutoff._lengths(300)), cutoff.BANDS) and (a == b).any(axis=1).all()
    assert (a[: len(half)] == half).all() and cutoff._lengths(11) == [] and len(set(a[:, 0].tolist())) == len(a)
    long = [f"w{k % 977}x{k // 977}" for k in range(20_000)]
    assert (keys(long)[:3] == keys(long[:20])).all()


def test_every_text_of_a_bucket_is_a_candidate(spark, monkeypatch):
    asked = spark.createDataFrame([("a", 1), ("a", 5), ("e", 3), ("e", 1)], "h string, key long")
    given = spark.createDataFrame([("a", 1), ("b", 1), ("c", 5), ("d", 6), ("b", 5), ("f", 1), ("e", 1)], "h string, key long")
    for block in (1, 2_000):
        monkeypatch.setattr(cutoff, "BLOCK", block)
        assert sorted(tuple(r) for r in cutoff.near_copies(asked, given).collect()) == [("a", "b"), ("a", "c"), ("a", "e"), ("a", "f"), ("e", "a"), ("e", "b"), ("e", "f")]


def test_planted_copies_are_found_however_much_is_gone(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    whole = [". ".join(" ".join(word() for _ in range(14)) for _ in range(9)) + "." for _ in range(60)]
    cut = []
    for k, text in enumerate(whole[:40]):
        words = text.split()
        size = int(len(words) * (0.2, 0.5, 0.75, 0.95)[k % 4])
        size -= words[size - 1].endswith(".")
        if k >= 20:  # a word of the beginning differs
            words[size // 3] = "changed"
        cut.append(" ".join(words[:size]))
    docs = spark.createDataFrame(list(enumerate(whole + cut)), "doc_id long, text string")
    got = {r.doc_id: r.how for r in cutoff.cut_documents(docs).collect()}
    found = [k for k in range(60, 100) if got.get(k) == "copy"]
    # Of 25 words with another one among them, less than the similarity is left.
    assert found == [60 + k for k in range(40) if k < 20 or k % 4] and not set(got) & set(range(60))


def test_counts_are_the_brute_force(spark):
    class All:
        def has(self, keys):
            return np.ones(keys.shape, dtype=bool)

    texts = [cutoff.read(t) for t in ("the cat. the cats sat", "a cat sat on the cat", "")]
    counts = cutoff.Counts(All())
    counts.add(texts[:1])
    counts.add(texts[1:])
    got = {r.k: (r.mid, r.term, r.fin) for r in counts.sums().itertuples()}
    of = lambda kind, *ws: int(cutoff.key(kind, *(np.array([cutoff._START if w == "^" else xxhash.xxh64_intdigest(w)], dtype=np.uint64) for w in ws)).view(np.int64)[0])
    assert got[of("1", "cat")] == (1, 1, 1) and got[of("2", "the", "cat")] == (0, 1, 1) and got[of("3", "^", "the", "cat")] == (0, 1, 0)
    assert got[of("5", "^", "^", "^", "^", "a")] == (1, 0, 0) and got[of("p", "the", "ca")] == (2, 0, 0) and got[of("q", "ca")] == (3, 0, 0)
    assert got[of("p", "the", "cat")] == (1, 0, 0) and of("p", "cat", "s") in got and not counts.words


def test_copies_that_stop_at_the_same_word_decide_nothing():
    words = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    assert cutoff.ends_early(words, words + " …") is None and cutoff.ends_early(words, words + ".") is False and cutoff.ends_early(words, words + " on.") is True


def test_filters_pass_few_other_keys_however_many_they_hold(spark):
    for n in (0, 1_000, 5_000_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("key"))
        known = cutoff.Filter(keys)
        held = keys.limit(1_000).toArrow()["key"].to_numpy().view(np.uint64)
        others = np.random.RandomState(4).randint(0, 1 << 63, 200_000, dtype=np.uint64) * cutoff._Q
        assert len(held) == min(n, 1_000) and known.has(held).all() and known.has(others).mean() < 0.02


def _shuffled(spark):
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x: x.stat().st_size for place in places for x in pathlib.Path(place.getPath()).rglob("shuffle_*.data")}


def test_texts_leave_no_shuffle_files(spark):
    docs, wanted = documents(spark)
    rnd = random.Random(6)
    long = [(1_000 + k, " ".join("".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(4_000)) + ".", "s", 1, "a") for k in range(60)]
    docs = docs.union(spark.createDataFrame(long, docs.schema))
    name = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        before = _shuffled(spark)
        assert {r.doc_id for r in cutoff.cut_documents(docs).collect()} == wanted
        left = sum(size for x, size in _shuffled(spark).items() if x not in before)
    finally:
        spark.conf.set(name, usual)
    assert left < 0.2 * sum(len(r[1]) for r in long)
