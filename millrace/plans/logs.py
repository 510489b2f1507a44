"""Queries over events, orders and the ledger made of them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, control, eventlog, ledger, metrics, queues
from ..session import staging_path, table
from ..streaming import leases, spikes

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LEDGER = """ledger AS (SELECT 'exp-' || o_orderkey AS experiment_id, CASE o_orderkey % 3 WHEN 0 THEN 'CHECK: ' WHEN 1 THEN 'PREREG: ' ELSE 'IDEA: ' END || lower(o_orderpriority) || ' order of ' || o_custkey AS hypothesis,
lower(c_mktsegment) AS author_role, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INTEGER) END AS rung,
CASE o_orderkey % 4 WHEN 0 THEN '{"passed":false}' WHEN 1 THEN '{"negative":true,"passed":true}' WHEN 2 THEN '{"passed":true}' END AS results,
CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS replication, o_totalprice AS delta, o_orderkey AS rowid FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    kind = F.when(k % 3 == 0, "CHECK: ").when(k % 3 == 1, "PREREG: ").otherwise("IDEA: ")
    results = F.when(k % 4 == 0, '{"passed":false}').when(k % 4 == 1, '{"negative":true,"passed":true}').when(k % 4 == 2, '{"passed":true}')
    return rows.select(
        F.concat(F.lit("exp-"), k.cast("string")).alias("experiment_id"), F.concat(kind, F.lower("o_orderpriority"), F.lit(" order of "), F.col("o_custkey").cast("string")).alias("hypothesis"),
        F.lower("c_mktsegment").alias("author_role"), F.when(k % 5 != 0, (k % 5).cast("int")).alias("rung"), results.alias("results"),
        F.struct(F.when(k % 7 == 0, "failed").otherwise("ok").alias("status")).alias("replication"), F.col("o_totalprice").alias("delta"), k.alias("rowid"))


@register(f"WITH {_LEDGER} SELECT experiment_id FROM ledger WHERE author_role = 'building' AND rung >= 2 AND delta > 300000")
def ledger_filter(spark, d):
    return ledger.sql_filter(_ledger(spark, d), "author_role = ? AND rung >= ? AND delta > ?", ["building", 2, 300000]).select("experiment_id")


@register(f"WITH {_LEDGER} SELECT experiment_id FROM ledger WHERE hypothesis LIKE 'CHECK:%' AND author_role = 'machinery' AND rung IS NULL AND contains(hypothesis, 'order of 1')")
def ledger_dsl(spark, d):
    return ledger.restricted(_ledger(spark, d), 'kind=check AND author_role="machinery" AND rung=none AND hypothesis~"order of 1"').select("experiment_id")


@register(f"WITH {_LEDGER} SELECT experiment_id FROM ledger WHERE coalesce(results LIKE '%\"passed\":false%', false) OR coalesce(results LIKE '%\"negative\":true%', false) OR replication = 'failed'")
def ledger_negatives(spark, d):
    return ledger.negatives(_ledger(spark, d)).select("experiment_id")


_BUCKETS = "list_transform(regexp_extract_all(lower({}), '[0-9a-z]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256)"


@register(f"""WITH {_LEDGER}, h AS (SELECT experiment_id, rowid, unnest({_BUCKETS.format('hypothesis')}) AS b FROM ledger), c AS (SELECT experiment_id, rowid, b, count(*) AS n FROM h GROUP BY ALL),
q AS (SELECT b, count(*) AS m FROM (SELECT unnest({_BUCKETS.format("'CHECK: 5-low order of 17'")}) AS b) GROUP BY b),
s AS (SELECT experiment_id, rowid, coalesce(sum(n * m), 0) / (sqrt(sum(n * n)) * (SELECT sqrt(sum(m * m)) FROM q)) AS score FROM c LEFT JOIN q USING (b) GROUP BY ALL)
SELECT experiment_id, round(score, 6) AS score FROM s ORDER BY round(score, 12) DESC, rowid LIMIT 10""")
def ledger_similar(spark, d):
    return ledger.most_similar(_ledger(spark, d), "CHECK: 5-low order of 17", 10).select("experiment_id", F.round("score", 6).alias("score"))


@register("""WITH v AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS DOUBLE[])), 6) AS score FROM embeddings)
SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return ledger.nearest_vectors(vectors, list(vectors.orderBy("vec_id").limit(1).first().embedding), 20)


_MAX = "(SELECT max(len(embedding)) FROM embeddings)"


@register("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS token FROM embeddings")
def greedy_decode(spark, d):
    from ..operators.rewards import greedy

    return table(spark, d, "embeddings").select("vec_id", greedy(F.col("embedding")).cast("long").alias("token"))


_G = "0" * 64


@register(f"SELECT event_id, sha256(props) AS payload_hash, sha256(event_id || '|{_G}|' || sha256(props) || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|' || event_type) AS hash FROM events")
def event_hash(spark, d):
    digest = eventlog.payload_hash(F.col("props"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", digest.alias("payload_hash"), eventlog.event_hash(F.col("event_id"), F.lit(eventlog.GENESIS), digest, stamp, F.col("event_type")).alias("hash"))


@register("SELECT event_id, regexp_replace(props, ': ', ':', 'g') AS payload FROM events")
def canonical_payload(spark, d):
    return table(spark, d, "events").select("event_id", eventlog.canonical_payload("props").alias("payload"))


def _chains(spark, d):
    rows = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return eventlog.append(rows.select(F.col("user_id").cast("string").alias("chain"), F.col("event_id").alias("pos"), stamp.alias("timestamp"), "event_type", F.col("props").alias("payload")))


@register(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, event_type, sha256(regexp_replace(props, ': ', ':', 'g')) AS p FROM events),
c AS (SELECT chain, seq, sha256(seq || '|{_G}|' || p || '|' || t || '|' || event_type) AS hash FROM e WHERE seq = 0 UNION ALL
SELECT e.chain, e.seq, sha256(e.seq || '|' || c.hash || '|' || p || '|' || t || '|' || event_type) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)
SELECT chain, seq, hash FROM c""")
def event_chain_hash(spark, d):
    return _chains(spark, d).select("chain", "seq", "hash")


@register("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
SELECT chain, seq, 'payload' AS fault FROM e WHERE seq % 37 = 5""")
def event_chain_verify(spark, d):
    broken = _chains(spark, d).withColumn("payload", F.when(F.col("seq") % 37 == 5, F.lit('{"k":-1}')).otherwise(F.col("payload")))
    return eventlog.verify(broken)


_SAMPLES = "samples AS (SELECT event_type AS run_id, event_id AS seq, event_id AS step, value AS loss, CAST(user_id AS VARCHAR) AS shard_id FROM events)"


def _samples(spark, d):
    return _sample_rows(table(spark, d, "events"))


def _sample_rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("user_id").cast("string").alias("shard_id"))


_SPIKES = f"""{_SAMPLES}, b AS (SELECT *, avg(loss) OVER w AS baseline, count(loss) OVER w AS n FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT * FROM b WHERE n = 20 AND baseline > 0 AND loss > baseline * 2.5)"""


@register(f"WITH {_SPIKES} SELECT run_id, seq, step, round(baseline, 6) AS baseline FROM s")
def spike_detect(spark, d):
    return metrics.spikes(_samples(spark, d), 20, 1.5).select("run_id", "seq", "step", F.round("baseline", 6).alias("baseline"))


_EXCLUDING = f"""{_SAMPLES}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM samples),
r AS (SELECT run_id, seq, step, k, [loss] AS held, NULL::DOUBLE AS baseline FROM e WHERE k = 1 UNION ALL
SELECT e.run_id, e.seq, e.step, e.k, CASE WHEN len(held) = 20 AND list_avg(held) > 0 AND loss > list_avg(held) * 2.5 THEN held WHEN len(held) = 20 THEN list_append(held[2:], loss) ELSE list_append(held, loss) END,
CASE WHEN len(held) = 20 AND list_avg(held) > 0 AND loss > list_avg(held) * 2.5 THEN list_avg(held) END FROM r JOIN e ON e.run_id = r.run_id AND e.k = r.k + 1)"""


@register(f"WITH RECURSIVE {_EXCLUDING} SELECT run_id, seq, step, round(baseline, 6) AS baseline FROM r WHERE baseline IS NOT NULL")
def spike_detect_excluding(spark, d):
    return metrics.spikes(_samples(spark, d), 20, 1.5, exclude_spikes=True).select("run_id", "seq", "step", F.round("baseline", 6).alias("baseline"))


@register(f"""WITH {_SPIKES} SELECT run_id, seq, EXISTS (SELECT 1 FROM s p WHERE p.run_id = s.run_id AND p.seq < s.seq AND abs(p.step - s.step) <= 40) AS page FROM s""")
def spike_pages(spark, d):
    return metrics.pages(metrics.spikes(_samples(spark, d), 20, 1.5), 40).select("run_id", "seq", "page")


@register(f"WITH {_SPIKES} SELECT run_id, seq, coalesce(step - lag(step) OVER (PARTITION BY run_id ORDER BY seq) < 40, false) AS page FROM s")
def spike_pages_last(spark, d):
    return metrics.pages_after_last(metrics.spikes(_samples(spark, d), 20, 1.5), 40).select("run_id", "seq", "page")


@register(f"""WITH {_SPIKES}, p AS (SELECT run_id, seq, EXISTS (SELECT 1 FROM s p WHERE p.run_id = s.run_id AND p.seq < s.seq AND abs(p.step - s.step) <= 40) AS page FROM s)
SELECT action, count(*) AS n FROM (SELECT unnest(CASE WHEN page THEN ['log', 'skip_shard', 'rollback', 'page'] ELSE ['log', 'skip_shard', 'rollback'] END) AS action FROM p) GROUP BY action""")
def spike_actions(spark, d):
    paged = metrics.pages(metrics.spikes(_samples(spark, d), 20, 1.5), 40)
    return metrics.spike_actions(paged).groupBy("action").agg(F.count("*").alias("n"))


def _metric_rows(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string")).alias("labels"), F.floor(F.col("event_id") / 10).alias("step"),
                       F.when(F.col("event_type") == "error", "counter").otherwise("gauge").alias("kind"), "value")


_LABEL = """'{"shard":"' || user_id % 4 || '"}'"""


@register(f"SELECT event_type AS name, {_LABEL} AS labels, CAST(floor(event_id / 10) AS BIGINT) AS step, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3")
def metric_series(spark, d):
    return metrics.series(_metric_rows(spark, d))


@register(f"""SELECT event_type AS name, {_LABEL} AS labels, CASE WHEN event_type = 'error' THEN 'counter' ELSE 'gauge' END AS kind,
round(CASE WHEN event_type = 'error' THEN sum(value) ELSE arg_max(value, event_id) END, 4) AS value FROM events GROUP BY 1, 2, 3""")
def metric_registry(spark, d):
    return metrics.registry(_metric_rows(spark, d)).withColumn("value", F.round("value", 4))


@register(f"""WITH {_SPIKES}, m AS (SELECT CAST(floor(event_id / 10) AS BIGINT) AS step, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' AND user_id % 4 = 1 GROUP BY 1)
SELECT 'clicks' AS panel, 'timeseries' AS kind, step, value FROM m UNION ALL SELECT 'spikes', 'spikes', step, loss FROM s""")
def dashboard_snapshot(spark, d):
    panels = [{"panel": "clicks", "kind": "timeseries", "name": "click", "labels": '{"shard":"1"}'}, {"panel": "notes", "kind": "log"}]
    return metrics.dashboard(panels, metrics.series(_metric_rows(spark, d)), metrics.spikes(_samples(spark, d), 20, 1.5))


@register("SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY 1")
def run_states(spark, d):
    return metrics.run_states(table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


_STEPS = "x AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS key, CASE event_id % 3 WHEN 0 THEN 'begin' WHEN 1 THEN 'end' ELSE 'note' END AS kind, epoch_us(ts) AS t FROM events WHERE event_id % 11 <> 4)"


def _begin_end(spark, d):
    """All events; those that the SQL leaves out, to make gaps, are of a kind that neither begins nor ends a step."""
    kind = F.when(F.col("event_id") % 11 == 4, "lost").when(F.col("event_id") % 3 == 0, "begin").when(F.col("event_id") % 3 == 1, "end").otherwise("note")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("key"), kind.alias("kind"), us.alias("at"))


@register(f"WITH {_STEPS}, y AS (SELECT key, min(t) FILTER (kind = 'begin') AS b, max(t) FILTER (kind = 'end') AS e FROM x GROUP BY key) SELECT key, e - b AS duration FROM y WHERE e - b > 400000000")
def slow_steps(spark, d):
    return metrics.slow_steps(_begin_end(spark, d), 400000000)


@register(f"WITH {_STEPS}, y AS (SELECT key, min(t) FILTER (kind = 'begin') AS b, max(t) FILTER (kind = 'end') AS e FROM x GROUP BY key) SELECT key FROM y WHERE e IS NULL AND 1706000000000000 - b > 60000000")
def stalled_steps(spark, d):
    return metrics.stalled(_begin_end(spark, d), 1706000000000000, 60000000)


@register("""WITH x AS (SELECT user_id AS monitor, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN 'hash' WHEN event_type = 'error' THEN 'violation' END AS reason FROM events)
SELECT monitor, min(seq) AS seq, arg_min(reason, seq) AS reason FROM x WHERE reason IS NOT NULL GROUP BY monitor""")
def monitor_trips(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("monitor"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.lit("a").alias("want_hash"), F.when(F.col("event_id") % 13 == 0, "b").otherwise("a").alias("have_hash"))
    return metrics.first_trips(rows)


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def rfc3339_stamps(spark, d):
    return table(spark, d, "events").select("event_id", metrics.rfc3339(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("stamp"))


_KINDS = ["enqueued", "claimed", "heartbeat", "expired", "completed", "failed"]
_LEASE = f"""x AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, {_KINDS!r}[CAST(floor(value) AS BIGINT) % 6 + 1] AS kind, CAST(event_id % 3 AS VARCHAR) AS worker, event_id % 2 + 1 AS attempt FROM events)"""


def _lease_events(spark, d):
    return _lease_rows(table(spark, d, "events"))


def _lease_rows(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor("value") % 6 + 1).cast("int"))
    return events.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("worker"), (F.col("event_id") % 2 + 1).alias("attempt"))


_OK = "(CASE e.kind WHEN 'enqueued' THEN r.state = 'new' WHEN 'claimed' THEN r.state = 'waiting' WHEN 'expired' THEN r.state = 'leased' ELSE r.state = 'leased' AND e.worker = r.worker AND e.attempt = r.attempt END)"
_FOLDED = f"""{_LEASE}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS k FROM x),
r AS (SELECT task_id, 0::BIGINT AS seq, '' AS kind, 0::BIGINT AS k, 'new' AS state, 0::BIGINT AS attempt, '' AS worker, false AS accepted FROM (SELECT DISTINCT task_id FROM x) UNION ALL
SELECT e.task_id, e.seq, e.kind, e.k, CASE WHEN NOT {_OK} OR e.kind = 'heartbeat' THEN r.state WHEN e.kind = 'claimed' THEN 'leased' WHEN e.kind IN ('enqueued', 'expired') THEN 'waiting' ELSE e.kind END,
CASE WHEN {_OK} AND e.kind = 'claimed' THEN r.attempt + 1 ELSE r.attempt END, CASE WHEN NOT {_OK} OR e.kind = 'heartbeat' THEN r.worker WHEN e.kind = 'claimed' THEN e.worker ELSE '' END, {_OK}
FROM r JOIN e ON e.task_id = r.task_id AND e.k = r.k + 1)"""


@register(f"WITH RECURSIVE {_FOLDED} SELECT task_id, seq, kind, state, attempt, worker, accepted FROM r WHERE k > 0")
def lease_log(spark, d):
    return queues.lease_log(_lease_events(spark, d))


@register(f"WITH RECURSIVE {_FOLDED} SELECT task_id, arg_max(state, k) AS state, arg_max(attempt, k) AS attempt, nullif(arg_max(worker, k), '') AS worker FROM r GROUP BY task_id")
def lease_states(spark, d):
    return queues.lease_states(_lease_events(spark, d))


def _streamed(spark, d: str, made, of) -> DataFrame:
    """What a stream over the events gives, all that is there read as it would come, written and read again."""
    place = staging_path(spark, "stream")
    name = f"{d}/events.parquet"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(name + "*")
    found = of(made(events))
    found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out")


@register(f"WITH RECURSIVE {_FOLDED} SELECT task_id, seq, kind, state, attempt, worker, accepted FROM r WHERE k > 0")
def lease_stream(spark, d):
    return _streamed(spark, d, _lease_rows, leases.lease_stream)


@register(f"""WITH {_SPIKES} SELECT run_id, seq, step, round(baseline, 6) AS baseline, EXISTS (SELECT 1 FROM s p WHERE p.run_id = s.run_id AND p.seq < s.seq AND abs(p.step - s.step) <= 40) AS page FROM s""")
def spike_stream(spark, d):
    found = _streamed(spark, d, _sample_rows, lambda rows: spikes.spike_stream(rows, 20, 1.5, 40))
    return found.select("run_id", "seq", "step", F.round("baseline", 6).alias("baseline"), "page")


@register(f"""WITH {_LEASE}, y AS (SELECT *, last_value(CASE WHEN kind NOT IN ('enqueued', 'heartbeat') THEN kind || '/' || worker END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM x)
SELECT task_id, seq, CASE WHEN kind IN ('heartbeat', 'completed', 'failed') THEN coalesce(held = 'claimed/' || worker, false) ELSE true END AS valid FROM y""")
def lease_fencing(spark, d):
    return queues.fenced(_lease_events(spark, d).withColumn("attempt", F.lit(1))).select("task_id", "seq", "valid")


@register("SELECT event_id FROM events WHERE epoch_ms(ts) + 30000 * greatest(1, user_id % 4) <= 1704500000000")
def leases_due(spark, d):
    ends = F.unix_millis(F.col("ts").cast("timestamp")) + queues.lease_ttl(F.lit(queues.LEASE_MS), F.col("user_id") % 4)
    return queues.due(table(spark, d, "events").select("event_id", ends.alias("expires_at")), 1704500000000).select("event_id")


@register("SELECT event_type AS queue, arg_min(CAST(event_id AS VARCHAR), event_id) AS task_id FROM events WHERE value > 100 GROUP BY 1")
def next_waiting(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("value") > 100, "waiting").otherwise("leased").alias("state"))
    return queues.next_waiting(rows)


@register("SELECT event_id, 'task/' || user_id || '/attempt/' || (event_id % 5) AS branch FROM events")
def checkpoint_branches(spark, d):
    return table(spark, d, "events").select("event_id", queues.checkpoint_branch(F.col("user_id").cast("string"), F.col("event_id") % 5).alias("branch"))


@register("""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id % 10 AS VARCHAR) AS episode, event_type AS agent, CAST(floor(value) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events),
r AS (SELECT episode, agent, k, t, t <= 2000 AS fits, CASE WHEN t <= 2000 THEN t ELSE 0 END AS total FROM e WHERE k = 1 UNION ALL
SELECT e.episode, e.agent, e.k, e.t, total + e.t <= 2000, CASE WHEN total + e.t <= 2000 THEN total + e.t ELSE total END FROM r JOIN e ON e.episode = r.episode AND e.k = r.k + 1)
SELECT episode, agent, CAST(sum(CASE WHEN fits THEN t ELSE 0 END) AS BIGINT) AS charged, count(*) FILTER (NOT fits) AS rejected FROM r GROUP BY ALL""")
def token_charges(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("episode"), F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), F.floor("value").alias("tokens"))
    return queues.charges(rows, 2000)


@register("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS provider, user_id % 9 <> 0 AND value <= 80 AS good, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT provider, 0::BIGINT AS k, 8::DOUBLE AS w FROM e UNION ALL
SELECT e.provider, e.k, CASE WHEN good THEN least(64, w + 1) ELSE greatest(1, least(w * 0.5, w - 1)) END FROM r JOIN e ON e.provider = r.provider AND e.k = r.k + 1)
SELECT provider, arg_max(w, k) AS "window" FROM r GROUP BY provider""")
def request_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), F.when(F.col("user_id") % 9 == 0, "refused").otherwise("ok").alias("outcome"), F.col("value").alias("latency_ms"))
    return queues.request_windows(rows, 8.0, 1.0, 64.0, 1.0, 0.5, 80.0)


@register("""WITH RECURSIVE g AS (SELECT event_type AS track, CAST(floor(event_id / 1000) AS BIGINT) AS stage, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track ORDER BY stage) AS k FROM g),
r AS (SELECT DISTINCT track, -1::BIGINT AS stage, 0::BIGINT AS k, 2::BIGINT AS calls FROM e UNION ALL
SELECT e.track, e.stage, e.k, CASE WHEN rate > 0.5 THEN least(64, calls * 2) ELSE calls END FROM r JOIN e ON e.track = r.track AND e.k = r.k + 1)
SELECT track, stage, calls FROM r WHERE k > 0""")
def curriculum(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("track"), F.floor(F.col("event_id") / 1000).alias("stage")).agg(F.avg((F.col("value") > 20).cast("double")).alias("rate"))
    return queues.curriculum(rows, 2, 64)


@register("SELECT event_id FROM events WHERE 8 - user_id % 9 <= 4")
def fresh_batches(spark, d):
    return queues.fresh(table(spark, d, "events").select("event_id", (F.col("user_id") % 9).alias("policy_version")), 8).select("event_id")


@register("""WITH x AS (SELECT event_type AS queue, event_id AS pos, user_id % 9 AS v FROM events), f AS (SELECT queue, min(pos) FILTER (8 - v <= 4) AS first FROM x GROUP BY queue)
SELECT queue, pos, v AS policy_version, CASE WHEN first IS NULL OR pos < first THEN 'dropped' WHEN pos = first THEN 'taken' ELSE 'kept' END AS action FROM x JOIN f USING (queue)""")
def staleness_queue(spark, d):
    return queues.after_consuming(table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("pos"), (F.col("user_id") % 9).alias("policy_version")), 8)


_SHA, _TIME = "'^[0-9a-f]{64}$'", r"'^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$'"


@register(f"""SELECT result_id, array_to_string(list_filter([CASE WHEN NOT coalesce(result_id <> '', false) THEN 'result_id' END, CASE WHEN NOT coalesce(suite <> '', false) THEN 'suite' END,
CASE WHEN NOT coalesce(split_name IN ('held_out', 'public'), false) THEN 'split_name' END, CASE WHEN NOT coalesce(checkpoint_id <> '', false) THEN 'checkpoint_id' END,
CASE WHEN NOT coalesce(n_items >= 0, false) THEN 'n_items' END, CASE WHEN NOT regexp_matches(per_item_hash, {_SHA}) THEN 'per_item_hash' END, CASE WHEN NOT regexp_matches(config_hash, {_SHA}) THEN 'config_hash' END,
CASE WHEN NOT coalesce(regexp_matches(created_at, {_TIME}) AND try_strptime(substr(created_at, 1, 10) || ' ' || substr(created_at, 12, 8), '%Y-%m-%d %H:%M:%S') IS NOT NULL, false) THEN 'created_at' END], lambda x: x IS NOT NULL), ',') AS violations FROM eval_result""")
def contract_violations(spark, d):
    rows = table(spark, d, "eval_result").drop("schema_id", "schema_version")
    return contracts.violations(rows, "eval_result").select("result_id", F.array_join("violations", ",").alias("violations"))


@register("SELECT packing_id FROM packing WHERE packing_id <> '' AND sequence_length > 0 AND strategy IN ('concat_eos', 'document_mask', 'single_document') AND pad_id >= 0 AND coalesce(drop_short_below >= 0, true)")
def contract_sound(spark, d):
    return contracts.quarantine(table(spark, d, "packing"), "packing")[0].select("packing_id")


@register("""WITH r AS (SELECT sha256(p_brand) AS digest, CAST(p_size AS BIGINT) AS size FROM part) SELECT count(DISTINCT digest) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM r WHERE digest NOT IN (SELECT sha256(p_brand) FROM part WHERE p_partkey % 100 = 3)""")
def collect_garbage(spark, d):
    part = table(spark, d, "part")
    return control.collect_garbage(part.select(F.sha2("p_brand", 256).alias("digest"), F.lit("b").alias("backend"), F.col("p_size").cast("long").alias("size")), part.where("p_partkey % 100 = 3").select(F.sha2("p_brand", 256).alias("digest")))


@register("SELECT sha256(p_brand) AS digest, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS replicas, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) >= 40 AS stored FROM part GROUP BY 1")
def put_blobs(spark, d):
    return control.put_blobs(table(spark, d, "part").select(F.encode("p_brand", "UTF-8").alias("content"), (F.col("p_size") > 25).alias("written")), 40)


@register("SELECT sha256(p_name) AS digest, p_size > 10 AS sound FROM part")
def verify_blobs(spark, d):
    return control.verify_blobs(table(spark, d, "part").select(F.sha2("p_name", 256).alias("digest"), F.encode(F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(F.lit("?")), "UTF-8").alias("content")))


@register(f"WITH {_LEDGER} SELECT * FROM (SELECT experiment_id, hypothesis, author_role FROM ledger ORDER BY rowid DESC LIMIT 1)")
def ledger_lookup(spark, d):
    """The record with the id of the last order, by its id."""
    rows = _ledger(spark, d)
    wanted = rows.agg(F.max_by("experiment_id", "rowid").alias("id")).first().id
    found = ledger.get(rows, wanted)
    return spark.createDataFrame([(found.experiment_id, found.hypothesis, found.author_role)], "experiment_id string, hypothesis string, author_role string")


@register("SELECT result_id, sha256(suite || chr(10) || split_name || chr(10) || checkpoint_id || chr(10) || '1.0' || chr(10) || n_items || chr(10) || '7' || chr(10)) AS config_hash FROM eval_result")
def config_hashes(spark, d):
    rows = table(spark, d, "eval_result")
    return rows.select("result_id", control.config_hash(F.col("suite"), F.col("split_name"), F.col("checkpoint_id"), F.lit("1.0"), F.col("n_items"), F.lit(7)).alias("config_hash"))


@register("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'tokenizer_changed' WHEN NOT (o_orderkey % 3 = o_custkey % 3 AND o_custkey = o_orderkey % 2 + o_custkey) THEN 'checkpoint_mismatch'
WHEN o_totalprice > 100 * o_custkey THEN 'resume_past_budget' END AS fault FROM orders""")
def resume_faults(spark, d):
    """Checkpoints made of orders against settings made of them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = lambda hash, seed, step: F.struct(hash.alias("tokenizer_hash"), seed.alias("seed"), (c * 100).alias("token_budget"), step.alias("tokens_per_step"), F.lit(1).alias("rung"), F.col("o_totalprice").alias("tokens_seen"))
    checkpoint = made(F.when(F.col("o_orderstatus") == "P", "a").otherwise("b"), k % 3, c)
    config = made(F.lit("b"), c % 3, k % 2 + c)
    return table(spark, d, "orders").select("o_orderkey", control.resume_fault(checkpoint, config).alias("fault"))
