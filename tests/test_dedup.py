import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import dedup, graph

ROWS = [
    ("keep-cats", "Cats sleep all day.\n\nDogs bark.", "01"),
    ("drop-exact-doc", "cats  SLEEP all day.\n\ndogs bark.", "02"),
    ("drop-exact-para", "Something else here.\n\nDogs bark.", "03"),
    ("keep-near-src", " ".join(f"w{k}" for k in range(20)), "04"),
    ("drop-near", " ".join(f"w{k}" for k in range(19)) + " other", "05"),
    ("keep-short", "hi", "06"),
    ("keep-unique", "this one is like no other text that there is", "10"),
]
SMALL = dedup.NearConfig(2, 8, 4, 2)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, content_hash string")


def test_corpus(spark):
    got = {r.id: r.status for r in dedup.dedup_corpus(frame(spark, [*ROWS, ("null", None, "07")]), SMALL).collect()}
    assert got == {"keep-cats": "kept", "drop-exact-doc": "dropped_exact", "drop-exact-para": "dropped_exact", "keep-near-src": "kept", "drop-near": "dropped_near", "keep-short": "kept", "keep-unique": "kept"}


def test_empty_corpus_raises(spark):
    with pytest.raises(ValueError):
        dedup.dedup_corpus(frame(spark, []))
    with pytest.raises(ValueError):
        dedup.NearConfig(5, 128, 32, 3)


def greedy(docs):
    seen, kept = set(), set()
    for _, i, ps in sorted(docs):
        if not seen & set(ps):
            kept.add(i)
            seen |= set(ps)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_paragraph_rounds_are_greedy(spark, seed):
    rnd = random.Random(seed)
    docs = [(f"{rnd.randrange(90):02d}", f"d{k}", [f"p{rnd.randrange(25)}" for _ in range(rnd.randrange(4))]) for k in range(60)]
    rows = [(i, "\n\n".join(ps), h) for h, i, ps in docs]
    got = {r.id for r in dedup.exact_paragraphs(frame(spark, rows)).where("kept").collect()}
    assert got == greedy(docs)


def test_near_clusters_are_transitive(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [("b", " ".join(base), "2"), ("a", " ".join([*base[:-1], "x"]), "1"), ("c", " ".join(["y", *base[1:]]), "3"), ("d", "nothing of the kind at all", "4")]
    for fast in (False, True):
        got = {r.id: r.kept_id for r in dedup.near_clusters(frame(spark, rows), fast=fast).collect()}
        assert got == {"a": "a", "b": "a", "c": "a"}


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in graph.components(edges).collect()} == {0}


def brute_signature(text, n=5, hashes=128):
    words = " ".join(text.lower().split()).split()
    shingles = {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
    return [min(int.from_bytes(hashlib.sha256(seed.to_bytes(8, "little") + s.encode()).digest()[:8], "little") for s in shingles) for seed in range(hashes)]


def test_full_queries_are_the_reference_rule(spark, tmp_path):
    from millrace.plans import corpus

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "délta"]) for _ in range(rnd.choice([3, 5, 40, 60]))) for _ in range(40)]
    texts += [t + " and a new end" for t in texts[:12]]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, (99, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {str(k): brute_signature(t) for k, t, _ in rows if len(t.split()) >= 5}
    got = {r.id: [int(x, 16) for x in r.signature.split(",")] for r in corpus.QUERIES["minhash_signature"](spark, str(tmp_path)).collect()}
    assert got == wanted
    pack = lambda xs: b"".join(x.to_bytes(8, "little") for x in xs)
    keys = {(i, b, f"{int.from_bytes(hashlib.sha256(pack(s[b * 4 : b * 4 + 4])).digest()[:8], 'little'):016x}") for i, s in wanted.items() for b in range(32)}
    assert {tuple(r) for r in corpus.QUERIES["lsh_band_keys"](spark, str(tmp_path)).collect()} == keys
    cluster = {i: i for i in wanted}
    by = {}
    for i, b, key in keys:
        by.setdefault((b, key), []).append(i)
    for _ in wanted:
        for members in by.values():
            least = min(cluster[i] for i in members)
            cluster.update((i, least) for i in members)
    alone = [c for c in cluster.values() if list(cluster.values()).count(c) == 1]
    near = corpus.QUERIES["dedup_near_clusters"](spark, str(tmp_path)).collect()
    assert {r.id: r.cluster for r in near} == {i: c for i, c in cluster.items() if c not in alone} and near


@pytest.mark.parametrize("block", [3, 2_000])
def test_near_copies_are_verified(spark, tmp_path, monkeypatch, block):
    from millrace.plans import corpus

    monkeypatch.setattr(dedup, "BLOCK", block, raising=False)
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for end in (1, 2, 3, 10, 20, 30, 45, 60, 60):
        texts += [" ".join([*base[:-end], *(f"x{rnd.randrange(10**6)}" for _ in range(end))]) for _ in range(3)]
    texts += [texts[0], texts[0].upper(), texts[20]]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    bands = {}
    for r in dedup.band_keys(dedup.fast_signatures(corpus.docs(spark, str(tmp_path)))).collect():
        bands.setdefault(int(r.id), set()).add((r.band, r.key))
    n = range(len(texts))
    linked = [(a, b) for a in n for b in n if a < b and bands[a] & bands[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    cluster = {x: str(x) for pair in linked for x in pair}
    for _ in n:
        for a, b in linked:
            cluster[a] = cluster[b] = min(cluster[a], cluster[b])
    got = {int(r.id): r.cluster for r in corpus.QUERIES["dedup_near_fast"](spark, str(tmp_path)).collect()}
    assert got == cluster and len(got) < len(texts)
