from pyspark.sql import functions as F

from millrace.operators import tokenizer

CORPUS = ["hello hello hello world", "hello world hello", "the cat sat on the mat", "the cat sat"]


def test_training_and_encoding(spark, tmp_path):
    merges = tokenizer.train(spark.createDataFrame([(t,) for t in CORPUS], "text string"), 320)
    bpe = tokenizer.Bpe(merges)
    assert len(merges) == 29
    assert bpe.encode("hello") == [274] and bpe.encode("hello hello world") == [283, 282, 280] and bpe.encode("the cat") == [278, 103, 271]
    assert bpe.encode("") == [] and bpe.encode_bytes(b"\xff\xfe\x00hello") == [259, 258, 4, 274]
    assert bpe.encode_grid([0, 1, 2, 9]) == [260, 261, 262, 269]
    for t in ["naïve café", "日本語 🙂", *CORPUS]:
        assert bpe.decode(bpe.encode(t)) == t
    bpe.freeze("2025").save(str(tmp_path))
    assert tokenizer.Bpe.load(str(tmp_path)).merges == bpe.merges


def slow(bpe, data):
    ids = [4 + b for b in data]
    while True:
        ranks = [(bpe.ranks.get(p, 1 << 30), k) for k, p in enumerate(zip(ids, ids[1:]))]
        if not ranks or min(ranks)[0] == 1 << 30:
            return ids
        rank, k = min(ranks)
        ids[k : k + 2] = [270 + rank]


def test_queue_is_the_plain_loop():
    import random

    rnd = random.Random(4)
    bpe = tokenizer.Bpe([(101, 101), (101, 102), (270, 101), (271, 271), (272, 102)])
    for _ in range(300):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(30)))
        assert bpe.encode_bytes(data) == slow(bpe, data)


def test_byte_ids_and_pairs(spark):
    rows = spark.createDataFrame([("aé",), ("",), (None,)], "t string").select(tokenizer.byte_ids(F.col("t")).alias("ids")).collect()
    assert [r.ids for r in rows] == [[101, 199, 173], [], None]


def slow_train(texts, n):
    ids, merges = [[4 + b for b in t.encode()] for t in texts], []
    while len(merges) < n:
        counts = {}
        for x in ids:
            for p in zip(x, x[1:]):
                counts[p] = counts.get(p, 0) + 1
        best = min(counts, key=lambda p: (-counts[p], p))
        for x in ids:
            k = 0
            while k < len(x) - 1:
                if (x[k], x[k + 1]) == best:
                    x[k : k + 2] = [270 + len(merges)]
                k += 1
        merges.append(best)
    return merges


def test_merges_come_from_the_texts(spark, tmp_path):
    from millrace.plans import corpus

    texts = [*CORPUS, CORPUS[0], "aaaa aaaaa aaa", "naïve 🙂🙂", "", None]
    spark.createDataFrame([(k, t, "a source") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.left, r.right) for r in corpus.QUERIES["bpe_train_merges"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == slow_train([t for t in texts if t is not None], 12)
    assert tokenizer.train(spark.createDataFrame([("aaaaa aa",), ("aaaaa aa",)], "text string"), 273) == slow_train(["aaaaa aa"] * 2, 3)
