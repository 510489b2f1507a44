from millrace.llm import formatcopies as m


def test_what_counts():
    same = [("A b, c!", "a  B\nC"), ("“Größe”", "GRÖSSE"), ("ét", "ét"), ("x*y*", "x y"), ("it costs 3.50.", "It costs 3.50"), ("a​b", "ab")]
    other = [("3.5", "35"), ("-3 a", "3 a"), ("a b", "b a"), ("x 12 3", "x 123"), ("One. Two.", "Two. One."), ("é", "e")]
    assert all(m.canonical(a) == m.canonical(b) for a, b in same)
    assert all(m.canonical(a) != m.canonical(b) for a, b in other)


def test_fields():
    a = '{"a": 1.5, "b": {"x": "p q", "y": [1, 2]}, "ok": true}'
    for b in ('{ "ok":true,"b":{"y":[1,2],"x":"P Q."},\n"a":1.5}', '{"OK": TRUE, "B": {"X": "p q", "Y": [1, 2]}, "A": 1.5}'):
        assert m.canonical(a) == m.canonical(b)
    for b in (a.replace("[1, 2]", "[2, 1]"), a.replace("1.5", "true").replace(": true", ": 1.5"), a.replace("1.5", "-1.5"), a[:-1]):
        assert m.canonical(a) != m.canonical(b)
    n = "run_id: run-1\nnote: Result: the a; then b\nloss: 3.1"
    assert m.canonical(n) == m.canonical("loss = 3.1 | note = Result: the a; then b | run_id = run-1")
    assert m.canonical(n) != m.canonical("loss: run-1\nnote: Result: the a; then b\nrun_id: 3.1")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, h string, key string, `check` string, kept_id string")


def test_pairs_and_counts(spark):
    texts = [("b", "X y."), ("a", "x  Y"), ("c", "x y"), ("c", "x y"), ("d", None), ("e", " \n​"), ("f", "!!"), ("g", "!!"), ("h", "?"), (None, "x y"), ("z", "word " * 60_000)]
    rows = frame(spark, [(i, t, "1", "2", "3", "4") for i, t in texts])
    assert {(r.kept_id, r.copy_id) for r in m.copy_pairs(rows, "id", "text").collect()} == {("a", "b"), ("a", "c"), ("f", "g")}
    assert {(r.kept_id, r.copies) for r in m.collapsed(rows, "id", "text").collect()} == {("a", 4), ("f", 2), ("h", 1), ("z", 1)}
    assert m.collisions(m.copy_groups(m.fingerprints(rows, "id", "text"))).count() == 0
    assert m.copy_pairs(frame(spark, []), "id", "text").count() == 0
