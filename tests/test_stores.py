import json
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import contracts, packing, plug, tokenizer
from millrace.session import clear_staged, stage
from millrace.sources import extract, stores

RECORDS = "chain string, pos long, timestamp string, event_type string, payload string"


def records(spark, *rows):
    return spark.createDataFrame([(c, p, "2024-01-01T00:00:00Z", "t", json.dumps({"k": p})) for c, p in rows], RECORDS)


def test_event_log_is_appended_verified_and_mended(spark, tmp_path):
    path = str(tmp_path / "log")
    assert stores.EventLog(spark, path).events().count() == 0
    stores.EventLog(spark, path).append(records(spark, ("a", 2), ("a", 1), ("b", 1)))
    stores.EventLog(spark, path).append(records(spark, ("a", 9), ("c", 4)))
    events = {(r.chain, r.seq): r for r in stores.EventLog(spark, path).events().collect()}
    assert set(events) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)} and events["a", 2].prev_hash == events["a", 1].hash
    last = sorted((tmp_path / "log" / "part=00000001").glob("part*.txt"))[-1]
    last.with_name(f".{last.name}.crc").unlink()
    whole = last.read_text()
    last.write_text(whole + '{"chain":"a","seq":3,"pr')
    assert stores.EventLog(spark, path).events().count() == 5
    last.write_text('{"chain":"a","seq":3,"pr\n' + whole)
    with pytest.raises(Exception, match="broken line"):
        stores.EventLog(spark, path)
    last.write_text(whole.replace('"event_type":"t"', '"event_type":"u"'))
    with pytest.raises(ValueError, match="hash"):
        stores.EventLog(spark, path)


def test_journal_replays_the_last_score(spark, tmp_path):
    journal = stores.Journal(spark, str(tmp_path / "j"))
    assert journal.replay().count() == 0
    docs = spark.createDataFrame([("h1", "x", 1), ("h2", "", 2)], "content_hash string, text string, extra int")
    journal.ingest(docs)
    for again in (docs.limit(1), spark.createDataFrame([("h3", "a"), ("h3", "b")], "content_hash string, text string")):
        with pytest.raises(ValueError):
            journal.ingest(again)
    scores = "pos long, content_hash string, quality double, safety double"
    journal.score(spark.createDataFrame([(1, "h1", 0.25, 0.5), (3, "h2", None, 1.0)], scores))
    journal.score(spark.createDataFrame([(2, "h1", 0.75, None)], scores))
    assert {tuple(r) for r in journal.replay().collect()} == {("h1", 0.75, None), ("h2", None, 1.0)} and journal.documents().count() == 2


def test_ledger_store_keeps_its_keys(spark, tmp_path):
    schema = "experiment_id string, supersedes string, note string"
    store = stores.LedgerStore(spark, str(tmp_path / "l"), schema)
    assert tuple(store.size().first()) == (0, True)
    store.append(spark.createDataFrame([("a", None, "x")], schema))
    store.append(spark.createDataFrame([("b", "a", "x")], schema))
    for bad in (("a", None, "y"), ("c", "zz", "y")):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([bad], schema))
    assert tuple(store.size().first()) == (2, False)


def test_suites_rotate_by_the_rules(spark, tmp_path):
    day, schema = 86_400_000, "suite string, item_id string, answer string, weight_milli long, text string"
    store = stores.SuiteStore(spark, str(tmp_path / "s"))
    items = lambda *ids: spark.createDataFrame([("s", i, "1", 5, "t") for i in ids], schema)
    for bad in (items("a", "a"), items("")):
        with pytest.raises(ValueError):
            store.write(bad, 5)
    assert store.rotate(0, 1).count() == 0
    store.write(items("a"), 10)
    assert store.rotate(10, 20).first().ok is False and store.rotate(30, 20).first().ok is False
    assert store.rotate(9, 20).first().ok is True and store.pending().count() == 0
    store.write(items("b", "c"), 30)
    store.write(items("d"), 40)
    assert store.rotate(35, 89 * day).first().ok is False
    assert store.rotate(35, 91 * day).first().ok is True
    assert [r.item_id for r in store.items().collect()] == ["d"] and store.history().count() == 2 and store.current().first().installed_ms == 91 * day


def test_blobs(spark, tmp_path):
    store = stores.BlobStore(spark, str(tmp_path / "b"), ["x", "y"], 2)
    assert store.get().count() == 0 and store.pins().count() == 0
    blobs = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary")
    assert {(r.replicas, r.stored) for r in store.put(blobs).collect()} == {(2, True)} and store.get().count() == 2
    (tmp_path / "b" / "z").write_text("no folder")
    assert {(r.replicas, r.stored) for r in stores.BlobStore(spark, str(tmp_path / "b"), ["x", "z"], 2).put(blobs).collect()} == {(1, False)}
    one = spark.createDataFrame([(b"one",)], "content binary").select(F.sha2("content", 256).alias("digest"))
    store.pin(one)
    assert tuple(store.collect_garbage().first()) == (1, 6) and tuple(store.collect_garbage().first()) == (0, 0)
    store.pin(one, False)
    assert store.pins().count() == 0 and [r.content for r in store.get().collect()] == [b"one"]


def test_shards_and_their_manifest(spark, tmp_path):
    rows = [("1", "ab", "m", "s", "x"), ("2", None, "m", "s", None), ("3", "c", "m", "t", "y")]
    schema = "id string, text string, mix_bucket string, shard_id string, source string"
    hits, suites = spark.createDataFrame([("3",)], "id string"), spark.createDataFrame([("q",), ("p",)], "suite string")
    made = [stores.write_shards(spark.createDataFrame(r, schema), str(tmp_path / n), hits, suites) for n, r in (("a", rows), ("b", rows[::-1]))]
    got = {(r.shard_id, r.n_docs, r.n_chars, r.status, r.against, r.sources) for r in made[0].collect()}
    assert got == {("s", 2, 2, "clean", "p,q", "x"), ("t", 1, 1, "flagged", "p,q", "y")}
    assert made[0].exceptAll(made[1]).count() == 0 and made[0].select("content_hash").distinct().count() == 2


def test_pdf_of_object_streams_nested_trees_and_own_codes():
    table = b"beginbfchar <01> <0048> endbfchar beginbfrange <02> <03> <0069> endbfrange"
    inner = [b"<</Type /Pages /Kids [4 0 R 3 0 R]>>", b"<</Type /Page /Contents 7 0 R>>", b"<</Type /Pages /Kids [5 0 R] /Resources <</Font <</F1 6 0 R>>>>>>", b"<</Type /Page /Contents [8 0 R 9 0 R]>>", b"<</Type /Font /ToUnicode 10 0 R>>"]
    heads, at = [], 0
    for number, body in zip((1, 3, 4, 5, 6), inner):
        heads.append(f"{number} {at}")
        at += len(body) + 1
    head = " ".join(heads).encode() + b" "
    packed = zlib.compress(head + b" ".join(inner) + b" ")
    parts = [b"2 0 obj <</Type /ObjStm /N 5 /First %d /Filter /FlateDecode>> stream\n%s\nendstream endobj" % (len(head), packed)]
    parts += [b"%d 0 obj <</Length 1>> stream\n%s\nendstream endobj" % (n, s) for n, s in ((7, b"BT (last) Tj ET"), (8, b"BT /F1 9 Tf <010203> Tj ET"), (9, b"BT (plain) Tj ET"), (10, table))]
    file = b"%PDF-1.5\n" + b"\n".join(parts)
    assert extract.pdf_text(file) == "Hij\nplain\nlast"
    for bad in (b"%PDF", file + b"trailer <</Encrypt 3 0 R>>"):
        with pytest.raises(ValueError):
            extract.pdf_text(bad)


def test_functions_of_the_user(spark):
    rows = spark.createDataFrame([("a", "x y", "1"), ("b", None, "2"), ("c", "", "0")], "task_id string, prompt string, answer string")
    assert {tuple(r) for r in plug.token_counts(rows, "prompt").select("task_id", "n_tokens").collect()} == {("a", 2), ("b", None), ("c", 0)}
    got = plug.attempts(rows, lambda ps: [str(len(p) // 3) for p in ps], 2, lambda want, given: want == given).collect()
    assert {(r.task_id, r.attempt, r.passed) for r in got} == {("a", 1, True), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("c", 1, True), ("c", 2, True)}
    with pytest.raises(Exception, match="another number"):
        plug.predicted(rows.drop("answer"), lambda ps: []).collect()
    assert plug.predicted(rows.drop("answer").limit(0), lambda ps: ps).count() == 0


def test_golden_records_are_sound(spark):
    for name in contracts.SCHEMAS:
        rows = spark.createDataFrame([tuple(contracts.golden(name).values())], contracts.columns(name))
        assert contracts.quarantine(rows, name)[1].count() == 0, name
    state = packing.LoaderState(3, 1, 2, 40, "m")
    assert packing.LoaderState.from_json(state.to_json()) == state
    for bad in ("[]", '{"schema_id": "packing", "schema_version": 1, "seed": 1}'):
        with pytest.raises(ValueError):
            packing.LoaderState.from_json(bad)


def test_rounds_of_merges_are_the_sequential_ones(spark):
    import random

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aabbc d") for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:20]]], "text string")
    corpus, wanted = [[tokenizer.FIRST_BYTE + b for b in t.encode()] for t in [*texts, *texts[:20]]], []
    for k in range(40):
        counts = {}
        for ids in corpus:
            for pair in zip(ids, ids[1:]):
                counts[pair] = counts.get(pair, 0) + 1
        left, right = min(counts, key=lambda p: (-counts[p], p))
        wanted.append((left, right))
        for ids in corpus:
            at = 0
            while at + 1 < len(ids):
                if (ids[at], ids[at + 1]) == (left, right):
                    ids[at : at + 2] = [tokenizer.FIRST_MERGE + k]
                at += 1
    assert tokenizer.train(docs, tokenizer.FIRST_MERGE + 40) == wanted


def test_staged_tables_are_cleared(spark):
    kept = stage(spark.range(3), "cleared")
    path = kept.inputFiles()[0]
    assert clear_staged(spark) > 0 and not stores.exists(spark, path)
