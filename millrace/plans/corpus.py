"""Queries over documents, corpus and their labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import classify, decontam, dedup, graph, mixture, packing, synth, tokenizer  # noqa: F401
from ..session import spread, table
from ..sources import extract
from . import sql as q

NEAR = dedup.NearConfig()
BASE_MIX = mixture.Mix("base", "pretrain-r0", "pretrain", dict(zip(mixture.SOURCES, (0.4, 0.15, 0.1, 0.1, 0.1, 0.08, 0.04, 0.03))))
LENGTH, EOS = 512, 1

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    return spread(rows.select("doc_id", "text", "source")).select(F.col("doc_id").cast("string").alias("id"), "text", F.sha2("text", 256).alias("content_hash"), "source", "doc_id")


@register(f"""WITH {q.DOCS}, x AS (SELECT id, content_hash, sha256({q.normalize('text')}) AS h FROM docs)
SELECT id, h, first_value(id) OVER (PARTITION BY h ORDER BY content_hash, id) AS kept_id FROM x""")
def dedup_exact_document(spark, d):
    return dedup.exact_documents(docs(spark, d))


@register(f"""WITH {q.DOCS}, x AS (SELECT doc_id, {q.normalize('text')} AS n FROM docs)
SELECT doc_id, length(n) AS n_chars, sha256(n) AS h FROM x""")
def normalize_hash(spark, d):
    rows = docs(spark, d).select("doc_id", text.normalize(F.col("text")).alias("n"))
    return rows.select("doc_id", F.length("n").cast("long").alias("n_chars"), F.sha2("n", 256).alias("h"))


@register(f"""WITH {q.DOCS}, w AS (SELECT doc_id, {q.words('n')} AS w FROM (SELECT doc_id, {q.normalize('text')} AS n FROM docs)),
s AS (SELECT doc_id, {q.windows('w', 5)} AS s FROM w)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(len(list_distinct(s)) AS BIGINT) AS n_distinct, s[1] AS first_shingle, s[-1] AS last_shingle FROM s""")
def shingles_5(spark, d):
    rows = docs(spark, d).select("doc_id", text.shingles(F.col("text"), 5).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"), F.try_element_at("s", F.lit(1)).alias("first_shingle"), F.try_element_at("s", F.lit(-1)).alias("last_shingle"))


_PARTS = f"""list_filter(list_transform(string_split_regex(
  regexp_replace(lower(translate(text, '{text.ZERO_WIDTH}', '')), '\\r\\n?', chr(10), 'g'), '\\n{q.SPACE}*\\n'), lambda x: {q.collapse('x')}), lambda x: x <> '')"""


@register(f"""WITH {q.DOCS}, p AS (SELECT doc_id, {_PARTS} AS p FROM docs)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, p[i] AS paragraph FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)""")
def paragraphs(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "paragraph")


def _greedy(rows: str) -> str:
    """Documents of a table in the order of (content_hash, id), each kept unless a kept one before it has one of its paragraphs."""
    return f"""g AS MATERIALIZED (SELECT id, list_distinct(list_transform({_PARTS}, lambda x: hash(x))) AS ps, row_number() OVER (ORDER BY content_hash, id) AS k FROM {rows}),
t AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS id, false AS kept, []::UBIGINT[] AS seen UNION ALL
SELECT g.k, g.id, NOT list_has_any(seen, ps), CASE WHEN list_has_any(seen, ps) THEN seen ELSE list_concat(seen, ps) END FROM t JOIN g ON g.k = t.k + 1)"""


@register(f"WITH RECURSIVE {q.DOCS}, {_greedy('docs')} SELECT id, kept FROM t WHERE k > 0")
def dedup_exact_paragraph(spark, d):
    return dedup.exact_paragraphs(docs(spark, d))


_SIGNED = f"""{q.DOCS}, w AS (SELECT id, content_hash, {q.words('n')} AS w FROM (SELECT id, content_hash, {q.normalize('text')} AS n FROM docs)),
s AS (SELECT id, content_hash, list_distinct({q.windows('w', 5)}) AS s FROM w WHERE len(w) >= 5),
g AS (SELECT id, content_hash, [""" + ", ".join(f"list_min(list_transform(list_transform(s, lambda x: substr(sha256('{''.join(chr(92) + f'x{b:02x}' for b in k.to_bytes(8, 'little'))}'::BLOB || encode(x)), 1, 16)), lambda h: {q.first_u64_le('h')}))" for k in range(NEAR.hashes)) + "] AS g FROM s)"  # noqa: E501
_BANDS = _SIGNED + ", h AS (SELECT id, content_hash, unnest([" + ", ".join(
    f"{{'band': {b}, 'key': sha256(unhex(" + " || ".join(q.first_u64_le(f"g[{b * NEAR.rows + r + 1}]") for r in range(NEAR.rows)) + "))}" for b in range(NEAR.bands)) + "]) AS k FROM g), b AS (SELECT id, content_hash, {'band': k.band, 'key': " + q.first_u64_le("k.key") + "} AS k FROM h)"


@register(f"WITH {_SIGNED} SELECT id, array_to_string(g, ',') AS signature FROM g")
def minhash_signature(spark, d):
    return dedup.signatures(docs(spark, d)).select("id", F.array_join("signature", ",").alias("signature"))


@register(f"WITH {_BANDS} SELECT id, k.band AS band, k.key AS key FROM b")
def lsh_band_keys(spark, d):
    return dedup.band_keys(dedup.signatures(docs(spark, d)))


@register(f"""WITH RECURSIVE {_BANDS}, m AS MATERIALIZED (SELECT DISTINCT b.id, h.hub FROM b JOIN (SELECT k, min(id) AS hub FROM b GROUP BY k HAVING count(*) > 1) h ON b.k = h.k),
e AS MATERIALIZED (SELECT id AS a, hub AS z FROM m WHERE id <> hub UNION SELECT hub, id FROM m WHERE id <> hub),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.z, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node AS id, min(root) AS cluster FROM r GROUP BY node)
SELECT c.id, cluster, first_value(c.id) OVER (PARTITION BY cluster ORDER BY content_hash, c.id) AS kept_id FROM c JOIN docs ON docs.id = c.id""")
def dedup_near_clusters(spark, d):
    return dedup.near_clusters(docs(spark, d))


def _alike(rows: str) -> str:
    """Components of all pairs of a table's texts that share 0.8 of their shingles: what banding must find."""
    return f"""v AS MATERIALIZED (SELECT id, unnest(s) AS x, len(s) AS n FROM (SELECT id, list_distinct({q.windows('w', 5)}) AS s FROM (SELECT id, {q.words('n')} AS w FROM (SELECT id, {q.normalize('text')} AS n FROM {rows})) WHERE len(w) >= 5)),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM v a JOIN v b USING (x) WHERE a.id < b.id GROUP BY a.id, b.id),
e AS MATERIALIZED (SELECT a, b AS z FROM p WHERE c / (na + nb - c) >= 0.8 UNION SELECT b, a FROM p WHERE c / (na + nb - c) >= 0.8),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.z, r.root FROM r JOIN e ON e.a = r.node),
l AS (SELECT node AS id, min(root) AS cluster FROM r GROUP BY node),
near AS (SELECT l.id, cluster, first_value(l.id) OVER (PARTITION BY cluster ORDER BY content_hash, l.id) AS kept_id FROM l JOIN {rows} d ON d.id = l.id)"""


@register(f"WITH RECURSIVE {q.DOCS}, {_alike('docs')} SELECT id, cluster, kept_id FROM near")
def dedup_near_fast(spark, d):
    return dedup.near_clusters(docs(spark, d), dedup.NearConfig(), fast=True, similarity=dedup.SIMILARITY)


@register(f"""WITH RECURSIVE {q.DOCS}, one AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256({q.normalize('text')}) ORDER BY content_hash, id) AS copy FROM docs) WHERE copy = 1),
{_greedy('one')}, two AS MATERIALIZED (SELECT one.* FROM one JOIN t ON t.id = one.id WHERE kept), {_alike('two')}
SELECT docs.id, CASE WHEN two.id IS NULL THEN 'dropped_exact' WHEN near.kept_id <> docs.id THEN 'dropped_near' ELSE 'kept' END AS status FROM docs LEFT JOIN two ON two.id = docs.id LEFT JOIN near ON near.id = docs.id""")
def dedup_corpus(spark, d):
    return dedup.dedup_corpus(docs(spark, d), dedup.NearConfig(), fast=True, similarity=dedup.SIMILARITY)


@register()
def dedup_corpus_banded(spark, d):
    """The reference's rule: a shared band is enough."""
    return dedup.dedup_corpus(docs(spark, d), dedup.NearConfig(), fast=True)


@register(f"""WITH RECURSIVE {q.DOCS}, one AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256({q.normalize('text')}) ORDER BY content_hash, id) AS copy FROM docs) WHERE copy = 1),
{_greedy('one')}, two AS MATERIALIZED (SELECT one.* FROM one JOIN t ON t.id = one.id WHERE kept), {_alike('two')},
x AS (SELECT CASE WHEN two.id IS NULL THEN 'dropped_exact' WHEN near.kept_id <> docs.id THEN 'dropped_near' ELSE 'kept' END AS status FROM docs LEFT JOIN two ON two.id = docs.id LEFT JOIN near ON near.id = docs.id)
SELECT status, count(*) AS n FROM x GROUP BY status""")
def dedup_report(spark, d):
    return dedup.report(dedup_corpus(spark, d))


@register(f"""WITH {q.DOCS}, x AS (SELECT id, source, row_number() OVER (PARTITION BY sha256({q.normalize('text')}) ORDER BY content_hash, id) AS k FROM docs)
SELECT source, count(*) AS n FROM x WHERE k = 1 GROUP BY source""")
def select_kept(spark, d):
    rows = docs(spark, d)
    kept = dedup.exact_documents(rows).where("id = kept_id")
    return dedup.select_kept(rows, kept).groupBy("source").agg(F.count("*").alias("n"))


def corpus(spark, d):
    return spread(table(spark, d, "corpus").select("id", "text", "shard_id"))


_GRAMS = f"""items AS (SELECT suite, item_id, {q.words(q.collapse('lower(text)'))} AS w FROM eval_item WHERE text IS NOT NULL),
index AS (SELECT DISTINCT suite, item_id, unnest({q.windows('w', 8)}) AS gram FROM items),
mine AS (SELECT DISTINCT id, unnest({q.windows('w', 8)}) AS gram FROM (SELECT id, {q.words(q.collapse('lower(text)'))} AS w FROM corpus WHERE text IS NOT NULL)),
hits AS (SELECT DISTINCT id, suite, item_id FROM mine JOIN index USING (gram))"""


@register(f"WITH {_GRAMS} SELECT id, suite, item_id FROM hits")
def decontam_hits(spark, d):
    return decontam.ngram_hits(corpus(spark, d), table(spark, d, "eval_item"))


@register(f"""WITH items AS (SELECT suite, item_id, {q.words(q.collapse('lower(text)'))} AS w FROM eval_item WHERE text IS NOT NULL),
index AS (SELECT DISTINCT suite, item_id, unnest(CASE WHEN len(w) >= 8 THEN {q.windows('w', 8)} WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END) AS gram FROM items),
n AS (SELECT DISTINCT least(8, len(w)) AS n FROM items WHERE len(w) > 0),
mine AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS gram FROM (SELECT id, {q.words(q.collapse('lower(text)'))} AS w FROM corpus WHERE text IS NOT NULL), n)
SELECT DISTINCT id, suite, item_id FROM mine JOIN index USING (gram)""")
def decontam_hits_minimum_width(spark, d):
    return decontam.ngram_hits(corpus(spark, d), table(spark, d, "eval_item"), minimum=True)


@register(f"""WITH {_GRAMS} SELECT c.id, CASE WHEN n > 0 THEN 'flagged' ELSE 'clean' END AS status, coalesce(n, 0) AS n_items
FROM corpus c LEFT JOIN (SELECT id, count(*) AS n FROM hits GROUP BY id) h ON h.id = c.id""")
def decontam_status(spark, d):
    rows = corpus(spark, d)
    return decontam.status(rows, decontam.ngram_hits(rows, table(spark, d, "eval_item")))


@register(f"""WITH {_GRAMS} SELECT shard_id, CASE WHEN max(CASE WHEN id IN (SELECT id FROM hits) THEN 1 ELSE 0 END) = 1 THEN 'flagged' ELSE 'clean' END AS status,
(SELECT string_agg(suite, ',' ORDER BY suite) FROM (SELECT DISTINCT suite FROM eval_item WHERE text IS NOT NULL)) AS against FROM corpus GROUP BY shard_id""")
def decontam_shards(spark, d):
    rows, items = corpus(spark, d), table(spark, d, "eval_item")
    return decontam.shard_report(rows, decontam.ngram_hits(rows, items), items, "shard_id")


_RX = "list_transform(regexp_extract_all(text, '[0-9A-Za-z_]+'), lambda x: lower(x))"


@register(f"""WITH i AS (SELECT {_RX} AS w FROM eval_item WHERE text IS NOT NULL), t AS (SELECT id, {_RX} AS w FROM corpus WHERE text IS NOT NULL),
n AS (SELECT DISTINCT least(8, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda k: array_to_string(w[k:k + least(8, len(w)) - 1], ' '))) AS gram FROM i WHERE len(w) > 0),
m AS (SELECT id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS gram FROM t, n)
SELECT DISTINCT id FROM m SEMI JOIN g USING (gram)""")
def decontam_words(spark, d):
    return decontam.word_match(corpus(spark, d), table(spark, d, "eval_item"))


@register(f"WITH {_GRAMS} SELECT suite, item_id FROM eval_item e WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.suite = e.suite AND h.item_id = e.item_id)")
def planted_missing(spark, d):
    items = table(spark, d, "eval_item").where("text is not null")
    return decontam.planted_missing(items.select("suite", "item_id"), decontam.ngram_hits(corpus(spark, d), items))


@register("""SELECT sha256('decontam/v1' || chr(10) || 'ngram_n=8' || chr(10) || 'embed_model=' || chr(10) ||
string_agg(suite || chr(0) || item_id || chr(0) || text || chr(10), '' ORDER BY suite, item_id, text)) AS method_hash FROM eval_item WHERE text IS NOT NULL""")
def method_hash(spark, d):
    return decontam.method_hash(table(spark, d, "eval_item"))


_LABELS = "l AS (SELECT content_hash, keep_quality, keep_safety FROM human_label WHERE keep_quality IS NOT NULL AND keep_safety IS NOT NULL)"


def _labels(spark, d):
    return table(spark, d, "human_label").where("keep_quality is not null and keep_safety is not null").select("content_hash", "keep_quality", "keep_safety")


@register(f"""WITH p AS (SELECT content_hash, max(quality) AS q, max(safety) AS s FROM prediction GROUP BY content_hash), {_LABELS},
m AS (SELECT coalesce(q >= 0.5::FLOAT, false) = keep_quality AND coalesce(s >= 0.5::FLOAT, false) = keep_safety AS ok FROM l JOIN p USING (content_hash))
SELECT count(*) AS n, CAST(sum(CAST(ok AS BIGINT)) AS BIGINT) AS matched, round(sum(CAST(ok AS BIGINT)) / count(*), 6) AS agreement FROM m""")
def label_agreement(spark, d):
    """Over the labels that ``labels_unpredicted`` doesn't name; one without a prediction among them would raise."""
    labels, predictions = _labels(spark, d), table(spark, d, "prediction")
    return classify.agreement(labels.join(predictions, "content_hash", "left_semi"), predictions)


@register(f"WITH {_LABELS} SELECT content_hash, count(*) AS n FROM l WHERE content_hash IS NULL OR NOT EXISTS (SELECT 1 FROM prediction p WHERE p.content_hash = l.content_hash) GROUP BY content_hash")
def labels_unpredicted(spark, d):
    return _labels(spark, d).join(table(spark, d, "prediction"), "content_hash", "left_anti").groupBy("content_hash").agg(F.count("*").alias("n"))


@register("SELECT config_id, count(*) AS n FROM prediction WHERE quality >= 0.5::FLOAT AND safety >= 0.5::FLOAT GROUP BY config_id")
def keep_by_thresholds(spark, d):
    return classify.keep(table(spark, d, "prediction")).groupBy("config_id").agg(F.count("*").alias("n"))


@register("""SELECT content_hash, quality, safety FROM (SELECT content_hash, quality, safety, row_number() OVER (PARTITION BY content_hash ORDER BY scored_at DESC, ingested_at DESC, quality DESC NULLS LAST, safety DESC NULLS LAST) AS k FROM prediction WHERE scored_at IS NOT NULL) WHERE k = 1""")
def last_predictions(spark, d):
    rows = table(spark, d, "prediction").where("scored_at is not null")
    return classify.last_predictions(rows.withColumn("pos", F.struct("scored_at", "ingested_at", "quality", "safety")))


@register("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 32) AS BIGINT) AS shard FROM documents")
def shard_assignment(spark, d):
    return classify.shards(table(spark, d, "documents").select("doc_id"), "doc_id")


def _unit(tag: int) -> str:
    """SQL of a score: the mixed hash with a tag, mixed again with the seed; its top 24 bits."""
    mixed = q.mix64(f"xor(7::UHUGEINT, {q.mix64(f'((h + {tag}) % {q.U64})')})")
    return f"CAST(({mixed} >> 40) AS FLOAT) / 16777216"


@register(f"""WITH {q.DOCS}, x AS (SELECT content_hash, list_reduce(list_prepend({hashing.FNV_OFFSET}::UHUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS UHUGEINT))), lambda a, b: (xor(a, b) * {hashing.FNV_PRIME}) % {q.U64}) AS h FROM docs)
SELECT content_hash, CAST({_unit(classify.QUALITY_TAG)} AS FLOAT) AS quality, CAST({_unit(classify.SAFETY_TAG)} AS FLOAT) AS safety FROM x""")
def hash_scores(spark, d):
    return classify.score_with(docs(spark, d), classify.hash_scorer(7))


@register(f"""WITH {q.DOCS}, x AS (SELECT doc_id, list_reduce(list_prepend({hashing.FNV_OFFSET}::UHUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS UHUGEINT))), lambda a, b: (xor(a, b) * {hashing.FNV_PRIME}) % {q.U64}) AS h FROM docs)
SELECT doc_id, printf('%016x', CAST(h AS UBIGINT)) AS h FROM x""")
def fnv_hashes(spark, d):
    return docs(spark, d).select("doc_id", hashing.fnv1a64_hex("text").alias("h"))


@register(f"""WITH {q.DOCS}, x AS (SELECT content_hash, list_reduce(list_prepend({hashing.FNV_OFFSET}::UHUGEINT, list_transform(regexp_extract_all(hex(encode(CAST(length(text) AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS UHUGEINT))), lambda a, b: (xor(a, b) * {hashing.FNV_PRIME}) % {q.U64}) AS h FROM docs)
SELECT content_hash, CAST({_unit(classify.QUALITY_TAG)} AS FLOAT) AS quality, CAST({_unit(classify.SAFETY_TAG)} AS FLOAT) AS safety FROM x""")
def served_scores(spark, d):
    """Scores of the completions of a server, here the lengths of the texts."""
    return classify.score_with(docs(spark, d), classify.served_scorer(lambda texts: [str(len(t)) for t in texts], 7))


@register(f"""WITH p AS (SELECT content_hash, max(quality) AS q, max(safety) AS s FROM prediction GROUP BY content_hash), {_LABELS},
m AS (SELECT coalesce(q >= 0.5::FLOAT, false) = keep_quality AND coalesce(s >= 0.5::FLOAT, false) = keep_safety AS ok FROM l JOIN p USING (content_hash)),
a AS (SELECT round(sum(CAST(ok AS BIGINT)) / count(*), 6) AS agreement FROM m) SELECT minimum, coalesce(agreement >= minimum, false) AS passed FROM a, (VALUES (0.1::DOUBLE), (0.5), (1.0)) AS v(minimum)""")
def label_gate(spark, d):
    """Which minima of agreement the predictions pass."""
    labels, predictions = _labels(spark, d), table(spark, d, "prediction")
    labels, out = labels.join(predictions, "content_hash", "left_semi"), []
    for minimum in (0.1, 0.5, 1.0):
        try:
            classify.gate(labels, predictions, minimum)
            out.append((minimum, True))
        except ValueError:
            out.append((minimum, False))
    return spark.createDataFrame(out, "minimum double, passed boolean")


_TOK = f"t AS (SELECT doc_id, list_transform({q.words('n')}, lambda w: length(w)) AS t FROM (SELECT doc_id, {q.normalize('text')} AS n FROM docs))"


def _tokens(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.transform(text.words(text.normalize(F.col("text"))), F.length).alias("tokens"))


@register(f"""WITH {q.DOCS}, {_TOK} SELECT doc_id AS id, array_to_string(list_transform(range(1, {LENGTH} + 1), lambda i: coalesce(t[i], 0)), ',') AS tokens,
CAST(least(len(t), {LENGTH}) AS BIGINT) AS n FROM t WHERE len(t) >= 16""")
def pack_single_document(spark, d):
    rows = packing.single_document(_tokens(spark, d), packing.Packing("s", LENGTH, "single_document", drop_short_below=16))
    return rows.select("id", packing.as_text(F.col("tokens")).alias("tokens"), F.aggregate("mask", F.lit(0), lambda s, m: s + m).cast("long").alias("n"))


_STREAM = f"""{q.DOCS}, {_TOK}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, row_number() OVER (ORDER BY doc_id DESC) = 1 AS last, t FROM t),
f AS (SELECT k, unnest(CASE WHEN last THEN t ELSE list_append(t, {EOS}) END) AS tok, unnest(range(0, len(t) + 1)) AS j FROM r),
n AS (SELECT k, tok, row_number() OVER (ORDER BY k, j) - 1 AS place FROM f WHERE tok IS NOT NULL)"""


@register(f"""WITH {_STREAM}, g AS (SELECT CAST(floor(place / {LENGTH}) AS BIGINT) AS seq, list(tok ORDER BY place) AS t FROM n GROUP BY 1)
SELECT CAST(seq AS BIGINT) AS seq, array_to_string(list_transform(range(1, {LENGTH} + 1), lambda i: coalesce(t[i], 0)), ',') AS tokens, CAST(len(t) AS BIGINT) AS n FROM g""")
def pack_concat_eos(spark, d):
    rows = packing.pack(_tokens(spark, d), packing.Packing("c", LENGTH, "concat_eos"), EOS)
    return rows.select("seq", packing.as_text(F.col("tokens")).alias("tokens"), F.aggregate("mask", F.lit(0), lambda s, m: s + m).cast("long").alias("n"))


@register(f"""WITH {_STREAM}, g AS (SELECT CAST(floor(place / {LENGTH}) AS BIGINT) AS seq, list(k ORDER BY place) AS t FROM n GROUP BY 1)
SELECT CAST(seq AS BIGINT) AS seq, array_to_string(list_transform(range(1, {LENGTH} + 1), lambda i: coalesce(t[i], 0)), ',') AS document_ids FROM g""")
def pack_document_mask(spark, d):
    rows = packing.pack(_tokens(spark, d), packing.Packing("m", LENGTH, "document_mask"), EOS)
    return rows.select("seq", packing.as_text(F.col("document_ids")).alias("document_ids"))


def _sequences(spark, d):
    return packing.pack(_tokens(spark, d), packing.Packing("c", LENGTH, "concat_eos"), EOS)


def _order(epoch: str) -> str:
    """SQL of the order of an epoch: an exchange from the end, one place after the other."""
    state = f"(xor(11::UHUGEINT, ({hashing.GOLDEN} * ({epoch} + 1)::UHUGEINT) % {q.U64}) + {hashing.GOLDEN} * ((SELECT n FROM size) - k)::UHUGEINT) % {q.U64}"
    return f"""size AS MATERIALIZED (SELECT CAST(max(place) // {LENGTH} + 1 AS BIGINT) AS n FROM n),
o AS (SELECT (SELECT n FROM size) - 1 AS k, list_transform(range(0, (SELECT n FROM size)), lambda x: CAST(x AS BIGINT)) AS l UNION ALL
SELECT k - 1, list_transform(l, lambda x, i: CASE WHEN i = k + 1 THEN l[j + 1] WHEN i = j + 1 THEN l[k + 1] ELSE x END) FROM (SELECT k, l, CAST({q.mix64(state)} % (k + 1)::UHUGEINT AS BIGINT) AS j FROM o WHERE k > 0))"""


def _batch(at: int) -> str:
    return f"""WITH RECURSIVE {_STREAM}, {_order('1')}, g AS (SELECT unnest(l) AS seq, unnest(range(0, len(l))) AS pos FROM o WHERE k = 0)
SELECT CAST(pos - {at} AS BIGINT) AS i, 1 AS epoch, CAST(pos AS BIGINT) AS pos, seq, {LENGTH} AS n FROM g WHERE pos >= {at} AND pos < {at} + 16"""


@register(f"WITH RECURSIVE {_STREAM}, {_order('2')} SELECT CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(l) AS seq FROM o WHERE k = 0")
def shuffle_order(spark, d):
    return packing.epoch_order(_sequences(spark, d), 11, 2)


@register(_batch(3))
def next_batch(spark, d):
    rows, _ = packing.next_batch(_sequences(spark, d), packing.Packing("c", LENGTH, "concat_eos"), packing.LoaderState(11, 1, 3), 16)
    return rows.select("i", "epoch", "pos", "seq", F.size("tokens").alias("n"))


@register(_batch(19))
def reconstruct_batch(spark, d):
    rows = packing.reconstruct(_sequences(spark, d), packing.Packing("c", LENGTH, "concat_eos"), packing.LoaderState(11, 1, 19), 16)
    return rows.select("i", "epoch", "pos", "seq", F.size("tokens").alias("n"))


def _values(mixes):
    return ", ".join(f"('{m.mix_id}', {k}, '{s}', {w!r}::DOUBLE)" for m in mixes for k, (s, w) in enumerate(m.ordered()))


_BASE = f"base AS (SELECT * FROM (VALUES {_values([BASE_MIX])}) AS v(mix_id, position, source, weight))"
_FAVOURED = "('code', 'math_science_arxiv', 'synthetic_reasoning')"


@register(f"WITH {_BASE} SELECT mix_id, position, source, round(weight, 9) AS weight FROM base")
def mixture_weights(spark, d):
    return mixture.weights_table(spark, BASE_MIX.validate()).withColumn("weight", F.round("weight", 9))


@register(f"""WITH {_BASE}, x AS (SELECT *, weight * CASE WHEN source IN {_FAVOURED} THEN 2.0 ELSE 1.0 END AS v FROM base)
SELECT mix_id, position, source, round(v / (SELECT sum(v) FROM x), 9) AS weight FROM x""")
def mixture_decay(spark, d):
    return mixture.weights_table(spark, BASE_MIX.decayed(2.0)).withColumn("weight", F.round("weight", 9))


@register(f"""WITH {_BASE} SELECT 'base-no-' || a.source AS mix_id, CAST(row_number() OVER (PARTITION BY a.source ORDER BY b.position) - 1 AS INTEGER) AS position, b.source,
round(b.weight / (1 - a.weight), 9) AS weight FROM base a JOIN base b ON a.source <> b.source""")
def mixture_ablations(spark, d):
    return mixture.weights_table(spark, *BASE_MIX.ablations()).withColumn("weight", F.round("weight", 9))


@register(f"""WITH {_BASE} SELECT mix_id, sha256('{{"mix_id":"' || mix_id || '","mix_bucket":"pretrain-r0","phase":"pretrain","weights":{{' || string_agg('"' || source || '":' || weight, ',' ORDER BY position) || '}}}}') AS mix_hash FROM base GROUP BY mix_id""")
def mixture_hash(spark, d):
    return spark.createDataFrame([(BASE_MIX.mix_id, BASE_MIX.hash())], "mix_id string, mix_hash string")


@register(f"""WITH {_BASE}, c AS (SELECT source, position, sum(weight) OVER (ORDER BY position) AS upto FROM base),
u AS (SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents)
SELECT doc_id, coalesce((SELECT arg_min(source, position) FROM c WHERE u < upto), 'agentic_trajectories') AS source FROM u""")
def mixture_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", BASE_MIX.sample(mixture.unit_hash(F.col("doc_id"))).alias("source"))


@register("SELECT source, unique_tokens * epochs_max AS tokens FROM (VALUES " + ", ".join(f"('{s}', {n if n else 'NULL'}::BIGINT, {b})" for s, n, _, b in mixture.CATALOGUE) + ") AS v(source, unique_tokens, epochs_max)")
def tokens_seen(spark, d):
    rows = spark.createDataFrame(mixture.CATALOGUE, "source string, unique_tokens long, epochs_min int, epochs_max int")
    return rows.select("source", mixture.tokens_seen(F.col("unique_tokens"), F.col("epochs_max")).alias("tokens"))


_SHOWN = "replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '')"


@register(f"""WITH {q.DOCS}, x AS (SELECT id, source, {_SHOWN} AS t, text FROM docs WHERE source IS NOT NULL)
SELECT id || '.html' AS path, 'html' AS format, source || chr(10) || t || CASE WHEN t = '' OR t[-1] = chr(10) THEN '' ELSE chr(10) END AS text,
CAST(74 + octet_length(encode(source)) + octet_length(encode(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS bytes_in, CAST(NULL AS VARCHAR) AS error FROM x
UNION ALL SELECT id || '.html', 'html', NULL, NULL, 'empty' FROM docs WHERE source IS NULL""")
def html_text(spark, d):
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><h1>"), "source", F.lit("</h1><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    blobs = docs(spark, d).select(F.concat("id", F.lit(".html")).alias("path"), F.encode(page, "UTF-8").alias("content"), F.lit(None).cast("string").alias("media_type"))
    return extract.extract(blobs).select("path", "format", "text", "bytes_in", "error")


@register(f"WITH {q.DOCS} SELECT doc_id, sha256(regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g')) AS h FROM docs")
def latex_strip(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(text.strip_latex_comments(F.col("text")), 256).alias("h"))


@register(f"""WITH {q.DOCS} SELECT doc_id, contains(text, '$$') OR {q.MATH} OR regexp_matches(text, '(?s)(^|[^\\\\])\\$(.*[^\\\\])?\\$') AS math FROM docs""")
def math_span_flag(spark, d):
    return docs(spark, d).select("doc_id", text.holds_math(F.col("text")).alias("math"))


_END = "['html', 'TEX', 'pdf', 'txt', 'xhtml'][doc_id % 5 + 1]"
_MEDIA = "['text/html', 'application/x-tex', 'image/png'][doc_id % 3 + 1]"


@register(f"""WITH x AS (SELECT doc_id, lower({_END}) AS e, {_MEDIA} AS m FROM documents)
SELECT doc_id, CASE WHEN e IN ('html', 'xhtml') THEN 'html' WHEN e = 'tex' THEN 'latex' WHEN e = 'pdf' THEN 'pdf' WHEN m = 'text/html' THEN 'html' WHEN m = 'application/x-tex' THEN 'latex' END AS format FROM x""")
def format_detect(spark, d):
    end = F.element_at(F.array(*map(F.lit, ("html", "TEX", "pdf", "txt", "xhtml"))), (F.col("doc_id") % 5 + 1).cast("int"))
    media = F.element_at(F.array(*map(F.lit, ("text/html", "application/x-tex", "image/png"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", extract.detect_format(F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.lit("."), end), media).alias("format"))


_HOSTS = ["arxiv.org", "arxiv.org:443", "arxiv.org.example.com", "u:p@github.com", "example.org/arxiv.org", "example.org?u=pypi.org", "export.arxiv.org", "www.pypi.org"]


@register(f"""WITH x AS (SELECT doc_id, ['http', 'https'][length(source) % 2 + 1] || '://' || {_HOSTS!r}[CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 8 + 1] || '/' || doc_id AS url FROM documents WHERE source IS NOT NULL)
SELECT doc_id FROM x WHERE list_contains({extract.MIRRORS!r}, regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))""")
def mirror_host_filter(spark, d):
    """Urls with ports, users, and mirrors in the path or as a part of another host."""
    pick = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("int") % 8 + 1
    url = F.concat(F.when(F.length("source") % 2 == 0, "http").otherwise("https"), F.lit("://"), F.element_at(F.array(*map(F.lit, _HOSTS)), pick), F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").where("source is not null").where(extract.from_mirror(url)).select("doc_id")


@register(f"""WITH {q.DOCS}, b AS (SELECT list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER) + 4) AS b FROM docs),
p AS (SELECT unnest(list_zip(b[:-2], b[2:])) AS p FROM b WHERE len(b) > 1)
SELECT CAST(p[1] AS INTEGER) AS "left", CAST(p[2] AS INTEGER) AS "right", count(*) AS n FROM p GROUP BY 1, 2""")
def bpe_pair_counts(spark, d):
    return tokenizer.pair_counts(docs(spark, d).select(tokenizer.byte_ids(F.col("text")).alias("ids")))


@register(f"""WITH {q.DOCS}, b AS (SELECT list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER) + 4) AS b FROM docs),
p AS (SELECT unnest(list_zip(b[:-2], b[2:])) AS p FROM b WHERE len(b) > 1)
SELECT CAST(p[1] AS INTEGER) AS "left", CAST(p[2] AS INTEGER) AS "right", count(*) AS n FROM p GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1""")
def bpe_best_pair(spark, d):
    best = tokenizer.best_pair(tokenizer.pair_counts(docs(spark, d).select(tokenizer.byte_ids(F.col("text")).alias("ids"))))
    return spark.createDataFrame([(best.left, best.right, best.n)], "left int, right int, n long")


@register()
def bpe_train_merges(spark, d):
    merges = tokenizer.train(docs(spark, d), tokenizer.FIRST_MERGE + 12)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left int, right int")


@register()
def bpe_encode(spark, d):
    bpe = tokenizer.Bpe(tokenizer.train(docs(spark, d), tokenizer.FIRST_MERGE + 12))
    rows = docs(spark, d).select("doc_id", "text").withColumn("ids", tokenizer.encode_column(bpe, "text")).withColumn("back", tokenizer.decode_column(bpe, "ids"))
    return rows.select("doc_id", F.size("ids").alias("n"), (F.col("back") == F.col("text")).alias("same"))


@register(f"""WITH {q.DOCS}, x AS (SELECT doc_id, octet_length(encode(text)) AS b, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS w FROM (SELECT doc_id, text, {q.collapse('text')} AS c FROM docs))
SELECT doc_id, CASE WHEN w > 0 THEN round(b / w, 6) ELSE 0.0 END AS per_word FROM x""")
def tokens_per_word(spark, d):
    return docs(spark, d).select("doc_id", F.round(text.bytes_per_word(F.col("text")), 6).alias("per_word"))


_CLAIMS = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){q.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{q.SPACE}+|{q.SPACE}+$', '', 'g')), lambda x: x <> '')"


@register(f"WITH {q.DOCS}, c AS (SELECT doc_id, {_CLAIMS} AS c FROM docs) SELECT doc_id, CAST(len(c) AS BIGINT) AS n, c[1] AS first_claim, c[-1] AS last_claim FROM c")
def claim_split(spark, d):
    rows = docs(spark, d).select("doc_id", text.claims(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.try_element_at("c", F.lit(1)).alias("first_claim"), F.try_element_at("c", F.lit(-1)).alias("last_claim"))


_CHECK = f"""x AS (SELECT *, {q.words(q.collapse('lower(source)'))} AS sw, {q.collapse('lower(claim)')} AS c, regexp_extract_all(source, '[0-9]+(?:\\.[0-9]+)?') AS sn, regexp_extract_all(claim, '[0-9]+(?:\\.[0-9]+)?') AS cn FROM pairs),
y AS (SELECT *, list_filter({q.words('c')}, lambda w: length(w) >= 4 AND NOT list_contains({q.STOPS}, w)) AS cw FROM x),
v AS (SELECT *, CASE WHEN c = '' THEN 'not_in_source' WHEN len(sn) > 0 AND len(list_filter(cn, lambda n: NOT list_contains(sn, n))) > 0 THEN 'contradicted'
WHEN len(list_filter(range(1, len(sw)), lambda i: list_contains(['not', 'no'], sw[i]) AND list_contains(cw, sw[i + 1]))) > 0 THEN 'contradicted'
WHEN len(cw) = 0 THEN CASE WHEN contains({q.collapse('lower(source)')}, c) THEN 'supported' ELSE 'not_in_source' END
WHEN len(list_filter(cw, lambda w: NOT list_contains(sw, w))) = 0 THEN 'supported' ELSE 'not_in_source' END AS v FROM y)"""
_PAIRS = "cases AS (SELECT case_id, in_text AS source, out_text AS text FROM normalize_cases WHERE in_text <> '' AND out_text IS NOT NULL)"


def _cases(spark, d):
    return table(spark, d, "normalize_cases").where("in_text <> '' and out_text is not null").select(F.col("case_id").alias("id"), F.col("in_text").alias("source"), F.col("out_text").alias("rewrite"))


@register(f"""WITH {_PAIRS}, pairs AS (SELECT case_id, source, unnest({_CLAIMS}) AS claim FROM cases), {_CHECK}
SELECT cases.case_id AS id, CAST(count(*) FILTER (v.v = 'supported') AS BIGINT) AS n_supported, CAST(count(*) FILTER (v.v = 'contradicted') AS BIGINT) AS n_contradicted,
CAST(count(*) FILTER (v.v = 'not_in_source') AS BIGINT) AS n_not_in_source, count(*) FILTER (v.v = 'contradicted') = 0 AS accepted FROM cases LEFT JOIN v ON v.case_id = cases.case_id GROUP BY cases.case_id""")
def fact_check(spark, d):
    return synth.fact_check(_cases(spark, d))


@register(f"""WITH pairs AS (SELECT in_text AS source, out_text AS claim, CASE WHEN lower(in_text) = out_text THEN 'supported' ELSE 'not_in_source' END AS gold FROM normalize_cases WHERE in_text <> '' AND out_text IS NOT NULL), {_CHECK}
SELECT round(coalesce(count(*) FILTER (v = 'supported' AND gold = 'supported') / nullif(count(*) FILTER (v = 'supported'), 0), 0.0), 6) AS "precision" FROM v""")
def fact_check_precision(spark, d):
    rows = _cases(spark, d).select("source", F.col("rewrite").alias("claim"), F.when(F.lower("source") == F.col("rewrite"), "supported").otherwise("not_in_source").alias("gold"))
    return synth.check_precision(rows).select(F.round("precision", 6).alias("precision"))


@register("""SELECT CAST(doc_id AS VARCHAR) AS id, s AS style, md5('Rephrase the document in ' || s || ' style. Preserve every fact. Do not add facts.' || chr(10) || chr(10) || 'Document:' || chr(10) || text) AS prompt_hash
FROM documents, (SELECT unnest(['encyclopedia', 'textbook', 'conversational', 'news', 'technical', 'simplified']) AS s) WHERE text <> ''""")
def rephrase_prompts(spark, d):
    return synth.rephrase_prompts(docs(spark, d).where("text <> ''")).select("id", "style", F.md5("prompt").alias("prompt_hash"))


_WHITE = q.SPACE[1:-1]


@register(f"""WITH {q.DOCS}, b AS (SELECT doc_id, regexp_replace(text, '{q.SPACE}+$', '') AS t FROM docs),
a AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '(?im)^answer[{_WHITE.replace(chr(92) + 't-' + chr(92) + 'r', chr(92) + 't' + chr(92) + 'x{0b}-' + chr(92) + 'r')}]*:([^\\n]*)$', 1), lambda x: regexp_replace(x, '^{q.SPACE}+|{q.SPACE}+$', '', 'g')), lambda x: x <> '') AS named,
regexp_extract_all(t, '(?ms)^```[^\\n]*\\n(.*?)```', 1) AS blocks, list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '{q.SPACE}*')) AS lines FROM b)
SELECT doc_id, md5(CASE WHEN len(named) > 0 THEN named[-1] WHEN len(blocks) > 0 THEN regexp_replace(blocks[-1], '\\n$', '') ELSE coalesce(lines[-1], '') END) AS answer_hash FROM a""")
def extract_answer(spark, d):
    return docs(spark, d).select("doc_id", F.md5(synth.extract_answer(F.col("text"))).alias("answer_hash"))


@register("""WITH r AS (SELECT l_orderkey, count(*) AS generated, count(*) FILTER (l_returnflag = 'R') AS accepted FROM lineitem GROUP BY 1) SELECT round(sum(accepted) / sum(generated), 9) AS rate FROM r""")
def verified_rate(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("generated"), F.count_if(F.col("l_returnflag") == "R").alias("accepted"))
    return synth.verified_rate(rows).select(F.round("rate", 9).alias("rate"))


_LAST_WORD = f"regexp_extract(text, '([^{_WHITE}]+){q.SPACE}*$', 1)"


@register(f"""SELECT suite || '/' || item_id AS problem_id, CAST(3 * count(*) AS BIGINT) AS generated, CAST(3 * sum(CASE WHEN string_split(text, ' ')[-1] = {_LAST_WORD} THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM eval_item WHERE text <> '' GROUP BY 1""")
def rejection_sample(spark, d):
    items = table(spark, d, "eval_item").select(F.concat_ws("/", "suite", "item_id").alias("problem_id"), F.col("suite").alias("domain"), F.col("text").alias("prompt"), F.substring_index("text", " ", -1).alias("answer"))
    return synth.rejection_sample(items.where("prompt <> ''"), 3, lambda prompts: [p.split()[-1] for p in prompts], lambda gold, given: gold == given)


_TRIM = f"regexp_replace(text, '^{q.SPACE}+|{q.SPACE}+$', '', 'g')"


@register(f"""WITH {q.DOCS}, t AS (SELECT doc_id, {_TRIM} AS t FROM docs), c AS (SELECT doc_id, t, regexp_extract(t, '^([^\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+)', 1) AS tool FROM t WHERE t <> '')
SELECT doc_id, tool, md5(regexp_replace(substr(t, length(tool) + 1), '^{q.SPACE}+', '')) AS args_hash FROM c""")
def parse_tool_call(spark, d):
    rows = docs(spark, d).select("doc_id", text.parse_tool_call(F.col("text")).alias("c")).where("c is not null")
    return rows.select("doc_id", "c.tool", F.md5("c.args").alias("args_hash"))


@register("""WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS task_id, l_linenumber - 1 AS step, CASE l_returnflag WHEN 'R' THEN 'submit x' WHEN 'A' THEN 'run y' ELSE ' ' END AS line, CASE WHEN l_quantity > 25 THEN 'verified' ELSE 'wrong' END AS result FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l_linenumber) FROM lineitem)),
e AS (SELECT *, CASE WHEN trim(line) = '' THEN 'Failed' WHEN line LIKE 'submit%' THEN CASE WHEN result = 'verified' THEN 'Verified' ELSE 'Failed' END END AS e FROM s WHERE step < 3)
SELECT task_id, CAST(coalesce(min(step) FILTER (e IS NOT NULL) + 1, count(*)) AS BIGINT) AS n_steps, coalesce(arg_min(e, step) FILTER (e IS NOT NULL), 'Truncated') AS outcome FROM e GROUP BY task_id""")
def trajectory_outcomes(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = F.when(F.col("l_returnflag") == "R", "submit x").when(F.col("l_returnflag") == "A", "run y").otherwise(" ")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("task_id"), (F.row_number().over(order) - 1).alias("step"), line.alias("line"), F.when(F.col("l_quantity") > 25, "verified").otherwise("wrong").alias("result"))
    return synth.trajectory_outcomes(rows, 3)


_TRAIL = SQL["trajectory_outcomes"]


@register(f"WITH o AS ({_TRAIL}) SELECT task_id FROM o WHERE outcome = 'Verified'")
def trajectories_kept(spark, d):
    return synth.keep_verified(trajectory_outcomes(spark, d)).select("task_id")


@register(f"WITH o AS ({_TRAIL}) SELECT round(avg(CASE WHEN outcome = 'Verified' THEN 1.0 ELSE 0.0 END), 9) AS rate FROM o")
def outcome_rate(spark, d):
    return synth.outcome_rate(trajectory_outcomes(spark, d)).select(F.round("rate", 9).alias("rate"))


@register(f"WITH {q.DOCS} SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(x)), ' ')) AS h FROM docs")
def ledger_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.array_join(text.ascii_tokens(F.col("text")), " ")).alias("h"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))"


@register(f"SELECT e.vec_id, s.vec_id AS query_id, round({_COS}, 6) AS cosine FROM embeddings e JOIN embeddings s ON s.vec_id % 50 = 0 WHERE {_COS} >= 0.5")
def embedding_near_match(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return decontam.embedding_hits(vectors, asked, 0.5).withColumn("cosine", F.round("cosine", 6))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact deduplication, then decontamination, then what is left of each language."""
    rows = docs(spark, d).join(table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang")), "doc_id")
    kept = dedup.select_kept(rows, dedup.exact_documents(rows).where("id = kept_id"))
    hits = decontam.ngram_hits(kept, table(spark, d, "eval_item"))
    clean = kept.join(hits.select("id").distinct(), "id", "left_anti")
    return clean.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@register(f"""WITH {q.DOCS}, k AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY sha256({q.normalize('text')}) ORDER BY content_hash, id) AS k FROM docs) WHERE k = 1),
g AS (SELECT DISTINCT unnest({q.windows('w', 8)}) AS gram FROM (SELECT {q.words(q.collapse('lower(text)'))} AS w FROM eval_item WHERE text IS NOT NULL)),
m AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({q.windows('w', 8)}) AS gram FROM (SELECT doc_id, {q.words(q.collapse('lower(text)'))} AS w FROM k)) SEMI JOIN g USING (gram))
SELECT lower(lang) AS lang, count(*) AS n_docs, CAST(sum(length(k.text)) AS BIGINT) AS n_chars FROM k JOIN documents USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM m) GROUP BY 1""")
def corpus_summary(spark, d):
    return flagship(spark, d)
