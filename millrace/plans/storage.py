"""Queries that write to a store, open it again and read what it holds, and queries over user functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, decontam, plug, rewards
from ..session import staging_path, table
from ..sources import extract, stores
from . import logs
from . import sql as q
from .corpus import _GRAMS, docs

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_G = "0" * 64


@register(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) - 1 AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, event_type, sha256(regexp_replace(props, ': ', ':', 'g')) AS p FROM events),
c AS (SELECT chain, seq, sha256(seq || '|{_G}|' || p || '|' || t || '|' || event_type) AS hash FROM e WHERE seq = 0 UNION ALL
SELECT e.chain, e.seq, sha256(e.seq || '|' || c.hash || '|' || p || '|' || t || '|' || event_type) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)
SELECT chain, seq, hash FROM c""")
def event_log_store(spark: SparkSession, d: str) -> DataFrame:
    """Even events, then odd ones, appended to one log, which is opened and verified before each reading."""
    path = staging_path(spark, "eventlog")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("chain"), F.col("event_id").alias("pos"), stamp.alias("timestamp"), "event_type", F.col("props").alias("payload"))
    for rest in (0, 1):
        stores.EventLog(spark, path).append(rows.where(F.col("event_id") % 2 == rest))
    return stores.EventLog(spark, path).events().select("chain", "seq", "hash")


@register("""WITH p AS (SELECT content_hash, quality, safety, row_number() OVER (ORDER BY scored_at NULLS FIRST, ingested_at, content_hash, quality NULLS FIRST, safety NULLS FIRST) AS pos FROM prediction)
SELECT content_hash, arg_max_null(quality, pos) AS quality, arg_max_null(safety, pos) AS safety FROM p GROUP BY content_hash""")
def classifier_journal(spark, d):
    """All texts and predictions written to a journal, replayed."""
    from ..operators.classify import ranked

    journal = stores.Journal(spark, staging_path(spark, "journal"))
    journal.ingest(docs(spark, d).select("content_hash", "text").dropDuplicates(["content_hash"]))
    rows = table(spark, d, "prediction").withColumn("k", F.struct("scored_at", "ingested_at", "content_hash", "quality", "safety"))
    journal.score(ranked(rows, "k").withColumnRenamed("rank", "pos"))
    return journal.replay()


@register("SELECT count(*) AS n_records, count(*) = 0 AS empty FROM orders JOIN customer ON c_custkey = o_custkey")
def ledger_store(spark, d):
    """The ledger in two additions, the second one's records superseding the first's; the count includes those."""
    rows = logs._ledger(spark, d).withColumn("supersedes", F.when(F.col("rowid") % 2 == 1, F.concat(F.lit("exp-"), F.lit("none"))))
    rows = rows.withColumn("supersedes", F.lit(None).cast("string"))
    store = stores.LedgerStore(spark, staging_path(spark, "ledger"), rows.schema)
    first = rows.where("rowid % 2 = 0")
    store.append(first)
    least = first.agg(F.min_by("experiment_id", "rowid").alias("id")).first().id
    store.append(rows.where("rowid % 2 <> 0").withColumn("supersedes", F.lit(least)))
    return store.size()


@register("""WITH x AS (SELECT suite, item_id, CAST(length(text) % 7 AS VARCHAR) AS answer, CAST(length(text) AS BIGINT) AS w, split_name FROM eval_item),
y AS (SELECT *, bool_or(split_name = 'held_out') OVER (PARTITION BY suite) AS held FROM x),
h AS (SELECT suite, held, sha256(string_agg('{"answer":"' || answer || '","id":"' || item_id || '","weight_milli":' || w || '}' || chr(10), '' ORDER BY item_id)) AS suite_hash, count(*) AS n_items FROM y WHERE split_name = 'held_out' OR NOT held GROUP BY ALL)
SELECT suite, suite_hash, CASE WHEN held THEN 8640000000 ELSE 8726400000 END AS installed_ms, n_items, 2::BIGINT AS generations FROM h""")
def suite_store(spark, d):
    """All items are installed, then the held-out ones 100 days later; a day after that, only suites that were left out then may rotate."""
    day = 86_400_000
    store = stores.SuiteStore(spark, staging_path(spark, "suites"))
    items = table(spark, d, "eval_item").select("suite", "item_id", (F.length("text") % 7).cast("string").alias("answer"), F.length("text").cast("long").alias("weight_milli"), "text", "split_name")
    store.write(items, 1)
    store.rotate(0, 2)
    store.write(items.where("split_name = 'held_out'"), 99 * day)
    store.rotate(98 * day, 100 * day)
    store.write(items, 100 * day + 1)
    store.rotate(100 * day, 101 * day)
    held = store.items().groupBy("suite").agg(F.count("*").alias("n_items"))
    grown = store.history().groupBy("suite").agg(F.count("*").alias("generations"))
    return store.current().select("suite", "suite_hash", "installed_ms").join(held, "suite").join(grown, "suite")


@register("""WITH b AS (SELECT DISTINCT p_brand AS b FROM part), pinned AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_partkey % 100 = 3)
SELECT count(*) AS blobs, CAST(coalesce(sum(2 * octet_length(encode(b))), 0) AS BIGINT) AS bytes, (SELECT count(*) FROM pinned) AS left FROM b WHERE b NOT IN (SELECT b FROM pinned)""")
def blob_store(spark, d):
    """Brands put into two backends, some pinned, one unpinned and pinned again, the rest collected."""
    store = stores.BlobStore(spark, staging_path(spark, "blobs"), ["one", "two"], 2)
    brands = table(spark, d, "part").select("p_partkey", F.encode("p_brand", "UTF-8").alias("content"))
    store.put(brands.select("content")).count()
    pins = brands.where("p_partkey % 100 = 3").select(F.sha2("content", 256).alias("digest"))
    for pinned in (True, False, True):
        store.pin(pins, pinned)
    gone = store.collect_garbage()
    return gone.withColumn("left", F.lit(store.get().count()))


_SHARDED = "c AS (SELECT id, text, coalesce(lower(lang), 'none') AS mix_bucket, coalesce(shard_id, 'none') AS shard_id, source FROM corpus)"


@register(f"""WITH {_GRAMS}, {_SHARDED}
SELECT mix_bucket, shard_id, count(*) AS n_docs, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars, 'id,text,source' AS columns, CASE WHEN max(CASE WHEN id IN (SELECT id FROM hits) THEN 1 ELSE 0 END) = 1 THEN 'flagged' ELSE 'clean' END AS status,
(SELECT string_agg(suite, ',' ORDER BY suite) FROM (SELECT DISTINCT suite FROM eval_item WHERE text IS NOT NULL)) AS against, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources,
sha256(count(*) || '|' || bit_xor(CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT)) || '|' || bit_xor(CAST('0x' || substr(sha256(coalesce(text, '')), 16, 15) AS BIGINT))) AS content_hash FROM c GROUP BY ALL""")
def data_shards(spark, d):
    """The corpus written in shards by language and shard, and the manifest beside them."""
    rows = table(spark, d, "corpus").select("id", "text", F.coalesce(F.lower("lang"), F.lit("none")).alias("mix_bucket"), F.coalesce("shard_id", F.lit("none")).alias("shard_id"), "source")
    items = table(spark, d, "eval_item").where("text is not null")
    return stores.write_shards(rows, staging_path(spark, "shards"), decontam.ngram_hits(rows, items), items.select("suite"))


def _blobs(spark, d, name: str, content) -> DataFrame:
    return docs(spark, d).select(F.concat("id", F.lit(name)).alias("path"), F.encode(content, "UTF-8").alias("content"), F.lit(None).cast("string").alias("media_type"))


@register(f"WITH {q.DOCS} SELECT id || '.tex' AS path, 'latex' AS format, CASE WHEN text <> '' THEN regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g') END AS text, CASE WHEN text = '' THEN 'empty' END AS error FROM docs")
def latex_blobs(spark, d):
    return extract.extract(_blobs(spark, d, ".tex", F.col("text"))).select("path", "format", "text", "error")


@register(f"WITH {q.DOCS} SELECT id || '.pdf' AS path, 'pdf' AS format, CASE WHEN doc_id % 10 <> 0 THEN source || chr(10) || id END AS text, CASE WHEN doc_id % 10 = 0 THEN 'unparseable' END AS error FROM docs")
def pdf_blobs(spark, d):
    """A file of two lines for each text; every tenth one has no pages."""
    shown = F.concat(F.lit("BT /F1 9 Tf ("), F.coalesce("source", F.lit("")), F.lit(") Tj 0 -9 Td [("), "id", F.lit(")] TJ ET"))
    tree = F.when(F.col("doc_id") % 10 == 0, "/Type /Other").otherwise("/Type /Pages /Kids [2 0 R] /Count 1")
    page = F.when(F.col("doc_id") % 10 == 0, "/Type /Other").otherwise("/Type /Page /Parent 1 0 R /Contents 3 0 R")
    file = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<<"), tree, F.lit(">>\nendobj\n2 0 obj\n<<"), page, F.lit(">>\nendobj\n3 0 obj\n<</Length 9>>\nstream\n"), shown, F.lit("\nendstream\nendobj\n%%EOF"))
    return extract.extract(_blobs(spark, d, ".pdf", file)).select("path", "format", "text", "error")


@register("SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) END AS n_tokens FROM documents")
def token_counter(spark, d):
    """Texts counted by a function of the user, here the number of e's."""
    return plug.token_counts(table(spark, d, "documents").select("doc_id", "text"), "text", lambda texts: [t.count("e") for t in texts]).select("doc_id", "n_tokens")


@register("""WITH c AS (SELECT * FROM (VALUES ('a', 1, 1.0::DOUBLE), ('a', 2, 3.0::DOUBLE), ('b', 1, 2.0::DOUBLE)) AS v(grader, criterion, weight)),
r AS (SELECT suite || '/' || item_id AS output_id, grader, weight, (length(text) * criterion % 5) / 4.0 AS v FROM eval_item, c WHERE text IS NOT NULL),
s AS (SELECT output_id, grader, sum(weight * v) / sum(weight) AS score FROM r GROUP BY ALL)
SELECT output_id, round(avg(score) * (1 - (max(score) - min(score))), 6) AS combined FROM s GROUP BY output_id""")
def judge_panel(spark, d):
    """Items graded by a judge of the user, by two graders with their own criteria."""
    criteria = spark.createDataFrame([("a", 1, "times 1", 1.0), ("a", 2, "times 2", 3.0), ("b", 1, "times 1", 2.0)], "grader string, criterion int, text string, weight double")

    def judge(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            head, _, output = prompt.partition("\n\nOutput:\n")
            out.append(str(len(output) * int(head.rsplit(" ", 1)[1]) % 5 / 4))
        return out

    outputs = table(spark, d, "eval_item").where("text is not null").select(F.concat_ws("/", "suite", "item_id").alias("output_id"), F.col("text").alias("output"))
    return rewards.panel(rewards.rubric_scores(plug.judged(outputs, criteria, judge))).select("output_id", F.round("combined", 6).alias("combined"))


@register("""WITH x AS (SELECT suite || '/' || item_id AS task_id, length(text) AS n FROM eval_item WHERE text IS NOT NULL)
SELECT task_id, 4::BIGINT AS n, CASE WHEN n % 3 = 0 THEN 4 ELSE 0 END::BIGINT AS passed, CASE WHEN n % 3 = 0 THEN 'trivial' ELSE 'impossible' END AS verdict FROM x""")
def solver_rates(spark, d):
    """Four attempts of a solver of the user at each item."""
    problems = table(spark, d, "eval_item").where("text is not null").select(F.concat_ws("/", "suite", "item_id").alias("task_id"), F.col("text").alias("prompt"), F.lit("0").alias("answer"))
    return rewards.solve_rates(plug.attempts(problems, lambda prompts: [str(len(p) % 3) for p in prompts], 4, lambda want, given: want == given))


@register("""SELECT suite, CAST(sum(CASE WHEN length(text) % 4 = length(text) % 6 THEN length(text) ELSE 0 END) AS BIGINT) AS score_milli, count(*) AS n_items FROM eval_item WHERE text IS NOT NULL GROUP BY suite""")
def predictor_score(spark, d):
    """Suites scored on the answers of a model of the user."""
    items = table(spark, d, "eval_item").where("text is not null").select("suite", "item_id", F.col("text").alias("prompt"))
    gold = items.select("suite", "item_id", (F.length("prompt") % 4).cast("string").alias("answer"), F.length("prompt").alias("weight_milli"))
    return control.suite_score(gold, plug.predicted(items, lambda prompts: [str(len(p) % 6) for p in prompts]))


@register(f"""WITH {q.DOCS}, x AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY sha256({q.normalize('text')}) ORDER BY content_hash, id) = 1 THEN 'kept' ELSE 'dropped_exact' END AS status FROM docs)
SELECT status, row_number() OVER (PARTITION BY status ORDER BY id) - 1 AS pos, id FROM x""")
def dedup_report_order(spark, d):
    """The lists of a report, each in the order of the ids."""
    from ..operators import dedup

    marked = dedup.exact_documents(docs(spark, d)).select("id", F.when(F.col("id") == F.col("kept_id"), "kept").otherwise("dropped_exact").alias("status"))
    return dedup.report_lists(marked)
