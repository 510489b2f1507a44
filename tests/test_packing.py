import pytest

from millrace.operators.packing import LoaderState, Packing, next_batch, pack, reconstruct


def docs(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id long, tokens array<int>")


def run(spark, lists, eos=1, **packing):
    rows = pack(docs(spark, lists), Packing("p", **packing), eos)
    key = "id" if packing["strategy"] == "single_document" else "seq"
    return rows.orderBy(key).collect()


def test_concat(spark):
    got = run(spark, [[10, 11, 12], [20, 21]], sequence_length=4, strategy="concat_eos")
    assert [r.tokens for r in got] == [[10, 11, 12, 1], [20, 21, 0, 0]] and [r["mask"] for r in got] == [[1] * 4, [1, 1, 0, 0]]
    got = run(spark, [[10, 11, 12], [20, 21]], sequence_length=4, strategy="concat_eos", eos_between_docs=False)
    assert [r.tokens for r in got] == [[10, 11, 12, 20], [21, 0, 0, 0]]
    assert [r.tokens for r in run(spark, [[*range(1, 8)]], sequence_length=3, strategy="concat_eos")] == [[1, 2, 3], [4, 5, 6], [7, 0, 0]]
    assert [r.tokens for r in run(spark, [[5], [], [6]], sequence_length=4, strategy="concat_eos")] == [[5, 1, 1, 6]]
    assert run(spark, [], sequence_length=3, strategy="concat_eos") == []


def test_many_ranges(spark):
    lists = [[k] * (k % 5) for k in range(1, 400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = run(spark, lists, eos=-1, sequence_length=10, strategy="concat_eos")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stream = [t for x in lists for t in [*x, -1]][:-1]
    assert [t for r in got for t in r.tokens] == stream + [0] * (-len(stream) % 10)


def test_document_mask(spark):
    (r,) = run(spark, [[10, 11], [20]], eos=9, sequence_length=4, strategy="document_mask")
    assert (r.tokens, r.document_ids) == ([10, 11, 9, 20], [0, 0, 0, 1])
    (r,) = run(spark, [[10], [20, 21]], eos=9, sequence_length=5, strategy="document_mask")
    assert (r.tokens, r.document_ids) == ([10, 9, 20, 21, 0], [0, 0, 1, 1, 0])


def test_single(spark):
    got = run(spark, [[1, 2], [3], [4, 5, 6, 7, 8], None], sequence_length=4, strategy="single_document", drop_short_below=2)
    assert [r.tokens for r in got] == [[1, 2, 0, 0], [4, 5, 6, 7]]


def test_batches_follow_each_other(spark):
    packing = Packing("p", 3, "concat_eos", eos_between_docs=False)
    rows = pack(docs(spark, [[*range(30)]]), packing, 1).cache()
    state, seen = LoaderState(5), []
    for size in (4, 7, 3, 6):
        batch, after = next_batch(rows, packing, state, size)
        got = [(r.epoch, r.seq) for r in batch.orderBy("i").collect()]
        assert got == [(r.epoch, r.seq) for r in reconstruct(rows, packing, state, size).orderBy("i").collect()]
        seen, state = seen + got, after
    assert state.tokens_consumed == 60 and (state.epoch, state.shard_offset) == (2, 0)
    assert sorted(s for e, s in seen if e == 0) == list(range(10)) == sorted(s for e, s in seen if e == 1)


def test_packing_json():
    p = Packing("p", 8, "single_document", False, 3, 2)
    assert Packing.from_json(p.to_json()) == p
    with pytest.raises(ValueError):
        Packing("p", 8, "other")
