import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import contracts, control, decontam, eventlog, grids, ledger, metrics, mixture, rewards, synth, verify
from millrace.sources import extract


def test_event_constants(spark):
    cases = {"{}": "44136fa3", '{"ok": true, "n": 1, "msg": "hello"}': "2fa47936", '{"note":"ΔRCI café"}': "e8d13b8f", '{"cycle":1}': "9ea99265"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, h string")
    for r in rows.select("h", eventlog.payload_hash(eventlog.canonical_payload("p")).alias("got")).collect():
        assert r.got.startswith(r.h)
    assert eventlog.canonical('{"b":1.0,"a":[1e3]}') == '{"a":[1000.0],"b":1.0}'


def test_event_log_faults(spark, tmp_path):
    rows = spark.createDataFrame([("c", k, "t", "e", f'{{"k":{k}}}') for k in range(5)], "chain string, pos long, timestamp string, event_type string, payload string")
    events = eventlog.append(rows).cache()
    assert eventlog.verify(events).count() == 0
    bad = events.withColumn("hash", F.when(F.col("seq") == 2, "x").otherwise(F.col("hash")))
    assert {(r.seq, r.fault) for r in eventlog.verify(bad).collect()} == {(2, "hash"), (3, "link")}
    path = str(tmp_path / "log")
    eventlog.write_jsonl(events, path)
    part = next((tmp_path / "log" / "chain=c").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text(part.read_text() + '{"seq":5,"pre')
    assert eventlog.read_jsonl(spark, f"{path}/chain=c").count() == 5


def test_restricted_language():
    assert ledger.parse(" * ") == ledger.parse("") == []
    assert ledger.parse('kind=check AND hypothesis~"a AND b" AND rung=none') == [("kind", "=", "check"), ("hypothesis", "~", "a AND b"), ("rung", "=", "none")]
    for bad in ('hypothesis~"a', "rung=x", "other=1", "hypothesis~a b", "kind=check AND ", "kind=check AND AND rung=1", "hypothesis~DROP x"):
        with pytest.raises(ValueError):
            ledger.parse(bad)


def test_ledger(spark):
    schema = "experiment_id string, hypothesis string, author_role string, rung int, results string, replication struct<status: string>, supersedes string"
    rows = spark.createDataFrame([("a", "CHECK: x", "r", 1, '{"passed":false}', None, None), ("b", "y' OR 1=1", "s", None, None, ("failed",), None), ("c", "z", "s", 2, '{"passed":true}', ("ok",), "a")], schema)
    assert {r.experiment_id for r in ledger.negatives(rows).collect()} == {"a", "b"}
    assert [r.experiment_id for r in ledger.sql_filter(rows, "hypothesis = ?", ["y' OR 1=1"]).collect()] == ["b"]
    for new in (rows.limit(1), rows.limit(1).withColumn("experiment_id", F.lit("n")).withColumn("supersedes", F.lit("zz"))):
        with pytest.raises(ValueError):
            ledger.append(rows, new)
    with pytest.raises(KeyError):
        ledger.get(rows, "none")


def test_extractors(spark):
    page = b"<html><head><title>T</title><style>x{}</style></head><body><h1>A &amp; B</h1><!-- c --><p>one <b>two</b><p>$x^2$<script>'</p>'</script></body></html>"
    assert extract.html_text(page) == "T\nA & B\none two\n$x^2$\n"
    for shown, wanted in (
        ("<p>a<b>b</b>c</p>", "abc\n"), ("<div>a<p>b</div>c", "a\nb\nc"), ("x</div>y</p>z", "xy\nz"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "ab\nc\nd"),
        ("<table><tr><td><p>a</td><td>b</td></tr></table>", "a\nb\n"), ("<table>out<tr><td>in</table>", "out\nin\n"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
        ("<html>\n<head>\n<title>t</title></head>\n<body>x</body>\n</html>", "\nt\nx\n"), ("<b><p>a</b>b</p>c", "ab\nc"), ("<noscript>n</noscript>a<br>b<hr/>c", "a\nb\nc"),
        ("<pre>\n a\r\n b</pre>", " a\n b\n"), ("<dl><dt>a<dd>b</dl>", "a\nb\n"), ("<p>a<center>b</center>", "a\nb"), ("<html></html>", ""), ("<p>a &lt; b &amp; c", "a < b & c\n"),
        ("<div>" * 3000 + "deep", "deep\n"),
    ):
        assert extract.html_text(shown.encode()) == wanted, shown
    stream = zlib.compress(b"BT /F1 12 Tf (Hello) Tj 0 -14 Td [(PD) 20 (F)] TJ ET")
    pdf = b"%%PDF-1.4\n1 0 obj <</Type /Pages /Kids [2 0 R] /Count 1>> endobj\n2 0 obj <</Type /Page /Contents 3 0 R>> endobj\n3 0 obj <</Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj" % (len(stream), stream)
    assert extract.pdf_text(pdf) == "Hello\nPDF"
    rows = [("a.html", page, None), ("b.PDF", pdf, None), ("c", b"x % y", "text/x-tex"), ("d.txt", b"x", None), ("e.tex", b"", None), ("f.html", b"\xff", None), ("g.html", None, None)]
    got = {r.path: (r.format, r.error) for r in extract.extract(spark.createDataFrame(rows, "path string, content binary, media_type string")).collect()}
    assert got == {"a.html": ("html", None), "b.PDF": ("pdf", None), "c": ("latex", None), "d.txt": (None, "unsupported"), "e.tex": ("latex", "empty"), "f.html": ("html", "unparseable"), "g.html": ("html", "empty")}


def test_index_must_not_be_empty(spark):
    items = spark.createDataFrame([], "suite string, item_id string, text string")
    with pytest.raises(ValueError):
        decontam.ngram_hits(spark.createDataFrame([("a", "x")], "id string, text string"), items)


def test_short_items_match_only_by_choice(spark):
    items = spark.createDataFrame([("s", "i", "two words")], "suite string, item_id string, text string")
    docs = spark.createDataFrame([("a", "here are Two words."), ("b", "here are two  WORDS too"), ("c", None)], "id string, text string")
    assert decontam.ngram_hits(docs, items).count() == 0
    assert {r.id for r in decontam.ngram_hits(docs, items, minimum=True).collect()} == {"b"}
    assert {r.id for r in decontam.word_match(docs, items).collect()} == {"a", "b"}


def test_mix():
    base = mixture.Mix("m", "b", "pretrain", {s: 1 / 8 for s in mixture.SOURCES}).validate()
    assert base.hash() != base.decayed(2).hash() and base.decayed(2).weights["code"] > base.weights["code"]
    assert all(abs(sum(m.weights.values()) - 1) < 1e-9 and len(m.weights) == 7 for m in base.ablations())
    for weights in ({}, {"web": 0.5}, {"web": 1.5, "code": -0.5}, {"other": 1.0}):
        with pytest.raises(ValueError):
            mixture.Mix("m", "b", "pretrain", weights).validate()


def test_claims_against_sources(spark):
    rows = [("The cat has 3 kittens.", "The cat has 4 kittens", "contradicted"), ("Birds do not sing here", "birds sing", "contradicted"), ("They are not happy now", "happy", "contradicted"), ("a b c", "b c", "supported"), ("large blue stones", "large stones", "supported"), ("x", " ", "not_in_source"), ("large blue stones", "green stones", "not_in_source")]
    got = spark.createDataFrame(rows, "s string, c string, w string").select("w", synth.check_claim(F.col("s"), F.col("c")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_answers():
    assert synth.last_answer("Answer: 3\nanswer : 4\n\n") == "4"
    assert synth.last_answer("x\n```py\na\n```\nthen\n```\nb\n```\n") == "b"
    assert synth.last_answer("one\n two\n\n") == " two" and synth.last_answer("") == "" and synth.last_answer("Answer:\nz") == "z"


def test_math_values():
    assert verify.same_value("1/2", "\\frac{2}{4}") and verify.same_value("-(1+2)*3", "-9") and verify.same_value("x", "x")
    for a, b in (("1/0", "1"), ("x", "y"), ("2^3", "8"), ("9" * 60, "9" * 60 + ".0"), ("1//2", "0.5")):
        assert not verify.same_value(a, b)


def test_families():
    assert len(grids.parameter_grid()) == 676
    ids = [grids.family_id(s) for s in grids.parameter_grid()]
    assert ids[0] == "translate:bg=0,dx=-3,dy=-3" and ids[50] == "translate:bg=1,dx=-3,dy=-2" and ids[490] == "recolor:dst=1,src=0" and ids[590] == "tile:nx=1,ny=1"
    assert ids[606:608] == ["gravity:bg=0,dir=0", "gravity:bg=0,dir=1"] and ids[646] == "mirror:dihedral=0" and ids[-1] == "border:color=9,width=2" and len(set(ids)) == 676
    g = [[1, 0], [0, 2], [0, 0]]
    of = lambda kind, g, **p: grids.apply_family({"kind": kind, **p}, g)
    assert [of("gravity", g, dir=k, bg=0) for k in range(4)] == [[[0, 0], [0, 0], [1, 2]], [[1, 2], [0, 0], [0, 0]], [[1, 0], [2, 0], [0, 0]], [[0, 1], [0, 2], [0, 0]]]
    assert of("crop", [[0, 0], [0, 3]], bg=0) == [[3]] and of("crop", [[0]], bg=0) == [[0]] and of("tile", [[1]], nx=3, ny=2) == [[1, 1, 1], [1, 1, 1]]
    assert of("scale", [[1]], factor=2) == [[1, 1], [1, 1]] and of("border", [[1]], width=1, color=5) == [[5, 5, 5], [5, 1, 5], [5, 5, 5]]
    assert of("translate", [[1, 2, 3]], dx=1, dy=4, bg=0) == [[3, 1, 2]] and of("mirror", [[1, 2], [3, 4]], dihedral=1) == [[3, 1], [4, 2]]
    for spec in ({"kind": "recolor", "src": 1, "dst": 1}, {"kind": "tile", "nx": 0, "ny": 1}, {"kind": "scale", "factor": 4}, {"kind": "crop"}, {"kind": "none"}):
        with pytest.raises(ValueError):
            grids.make_task(spec, 1)
    for k, spec in enumerate(grids.parameter_grid()):
        try:
            pairs = grids.make_task(spec, k)
        except ValueError:
            continue
        assert all(1 <= len(x) <= 30 and 1 <= len(x[0]) <= 30 for pair in pairs for x in pair), spec
    assert grids.make_task(grids.sample_specs(1, 3)[0], 8) == grids.make_task(grids.sample_specs(1, 3)[0], 8)
    for n in (0, 677):
        with pytest.raises(ValueError):
            grids.sample_specs(n, 1)


def test_symmetries_of_rows_are_those_of_columns(spark):
    g = [[1, 2, 3], [4, 5, 6]]
    rows = spark.createDataFrame([(g,)], "g array<array<int>>")
    assert list(rows.select(*(grids.symmetry(F.col("g"), n) for n in grids.SYMMETRIES)).first()) == [grids._turned(g, n) for n in grids.SYMMETRIES]


def test_symmetries_turn_back(spark):
    rows = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],)], "g array<array<int>>")
    for name in grids.SYMMETRIES:
        assert rows.select((grids.symmetry(grids.symmetry(F.col("g"), name), grids.inverse(name)) == F.col("g")).alias("ok")).first().ok, name


def test_contracts(spark):
    rows = spark.createDataFrame([("p", 8, "concat_eos", 0, None), ("", 0, "x", None, -1)], "packing_id string, sequence_length int, strategy string, pad_id int, drop_short_below int")
    good, bad = contracts.quarantine(rows, "packing")
    assert good.count() == 1 and bad.first().violations == ["packing_id", "sequence_length", "strategy", "pad_id", "drop_short_below"]
    with pytest.raises(KeyError):
        contracts.supported("other")
    with pytest.raises(ValueError):
        contracts.migrate(rows, "packing", 1, 2)
    times = spark.createDataFrame([("2025-01-31T10:00:00Z", True), ("2025-02-30T10:00:00Z", False), ("2025-01-31", False), (None, False)], "t string, w boolean")
    assert all(r.g == r.w for r in times.select("w", contracts.is_rfc3339(F.col("t")).alias("g")).collect())


def test_spikes(spark):
    losses = [1.0, 1.0, 9.0, 1.0, 20.0, 1.0]
    rows = spark.createDataFrame([("r", k, k * 6000, x, "s") for k, x in enumerate(losses)], "run_id string, seq long, step long, loss double, shard_id string")
    found = metrics.spikes(rows, 2, 1.0)
    assert [(r.seq, r.page) for r in metrics.pages(found).orderBy("seq").collect()] == [(2, False), (4, False)]
    assert [(r.seq, r.page) for r in metrics.pages(found, 12_000).orderBy("seq").collect()] == [(2, False), (4, True)]
    assert [(r.seq, r.page) for r in metrics.pages_after_last(found, 12_000).orderBy("seq").collect()] == [(2, False), (4, False)]


def test_votes_and_losses(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, "x"), (2, 1, "y")], "shard int, replica int, hash string")
    assert {(r.shard, r.winner, r.quarantine) for r in control.replica_vote(rows).collect()} == {(1, "b", True), (2, "x", True)}
    with pytest.raises(ValueError):
        rewards.LossConfig(normalizer=0)
    empty = spark.createDataFrame([], "a double, b double")
    assert rewards.parity(empty, 0.1).first().asDict() == {"max_error": 0.0, "halt": False}


def test_blob_store(spark, tmp_path):
    for backend in ("x", "y"):
        (tmp_path / backend).mkdir()
        (tmp_path / backend / hashlib.sha256(b"hi").hexdigest()).write_bytes(b"hi")
    (tmp_path / "x" / ("0" * 64)).write_bytes(b"no")
    rows = control.read_store(spark, str(tmp_path))
    assert sorted(r.sound for r in control.verify_blobs(rows).collect()) == [False, True, True]
