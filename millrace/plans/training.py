"""Queries over made samples of rewards, runs, votes and grids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, grids, rewards, verify
from ..session import table

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("reward"), "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")


@register("SELECT l_orderkey AS prompt_id, l_partkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS advantage FROM lineitem")
def group_advantage(spark, d):
    return rewards.advantages(_items(spark, d)).select("prompt_id", "l_partkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@register("SELECT l_orderkey AS prompt_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING min(l_quantity) <> max(l_quantity)")
def zero_advantage_drop(spark, d):
    return rewards.informative(_items(spark, d))


@register("""SELECT l_orderkey AS task_id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS passed, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'impossible'
WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'trivial' ELSE 'keep' END AS verdict FROM lineitem GROUP BY 1""")
def solve_rate_filter(spark, d):
    return rewards.solve_rates(_items(spark, d).select(F.col("prompt_id").alias("task_id"), (F.col("l_returnflag") == "R").alias("passed")))


_PANEL = """g AS (SELECT l_orderkey AS output_id, l_returnflag AS grader, sum(l_quantity * (l_discount * 10)) / sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
p AS (SELECT output_id, avg(score) * (1 - (max(score) - min(score))) AS c FROM g GROUP BY 1)"""


def _rubric(spark, d):
    rows = _items(spark, d).select(F.col("prompt_id").alias("output_id"), F.col("l_returnflag").alias("grader"), F.col("reward").alias("weight"), (F.col("l_discount") * 10).cast("string").alias("reply"))
    return rewards.rubric_scores(rows)


@register(f"WITH {_PANEL} SELECT output_id, grader, round(score, 6) AS score FROM g")
def rubric_scores(spark, d):
    return _rubric(spark, d).withColumn("score", F.round("score", 6))


@register(f"WITH {_PANEL} SELECT output_id, round(c + 1e-9, 6) AS combined, round(c, 9) > 0.5 AS passed FROM p")
def rubric_combine(spark, d):
    out = rewards.panel(_rubric(spark, d))
    return out.select("output_id", F.round(F.col("combined") + 1e-9, 6).alias("combined"), (F.round("combined", 9) > 0.5).alias("passed"))


_RUNS = """runs AS (SELECT CAST(p_size AS BIGINT) AS rung, CAST(sum(p_retailprice) AS BIGINT) AS params, count(*) AS tokens, 5.0 * pow(6.0 * CAST(sum(p_retailprice) AS BIGINT) * count(*), -0.07) * (1 + (p_size % 3) / 100.0) AS loss FROM part WHERE p_size > 0 GROUP BY p_size)"""


def _runs(spark, d):
    rows = table(spark, d, "part").where("p_size > 0").groupBy("p_size").agg(F.floor(F.round(F.sum("p_retailprice"), 6) + 0.5).alias("params"), F.count("*").alias("tokens"))
    loss = 5.0 * F.pow(6.0 * F.col("params") * F.col("tokens"), F.lit(-0.07)) * (1 + (F.col("p_size") % 3) / 100.0)
    return rows.select(F.col("p_size").cast("long").alias("rung"), "params", "tokens", loss.alias("loss"))


@register(f"WITH {_RUNS}, l AS (SELECT ln(loss) AS y, ln(6.0 * params * tokens) AS x FROM runs) SELECT count(*) AS n, round(exp(regr_intercept(y, x)), 5) AS a, round(-regr_slope(y, x), 6) AS alpha FROM l")
def scaling_fit(spark, d):
    return control.scaling_fit(_runs(spark, d)).select("n", F.round("a", 5).alias("a"), F.round("alpha", 6).alias("alpha"))


@register("""WITH x AS (SELECT l_orderkey AS shard, l_returnflag AS hash, count(*) AS n, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem GROUP BY 1, 2),
y AS (SELECT shard, sum(n) AS total, max(n) AS most, arg_max(hash, (n, hash)) AS top, arg_min(hash, (first, hash)) AS leader, count(*) AS kinds FROM x GROUP BY 1)
SELECT shard, CASE WHEN most * 2 > total THEN top ELSE leader END AS winner, kinds > 1 AS quarantine FROM y""")
def sdc_majority(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shard"), (F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey")).alias("replica"), F.col("l_returnflag").alias("hash"))
    return control.replica_vote(rows)


@register("SELECT max(abs(l_discount - l_tax)) AS max_error, max(abs(l_discount - l_tax)) > 0.05 AS halt FROM lineitem")
def parity_max(spark, d):
    return rewards.parity(table(spark, d, "lineitem").select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b")), 0.05)


def _log(p: str) -> str:
    return f"ln(greatest(1e-12, least(1 - 1e-12, CASE WHEN l_returnflag = 'R' THEN {p} ELSE 1 - {p} END)))"


@register(f"SELECT l_orderkey, l_linenumber, l_partkey, round({_log('l_discount')} - {_log('l_quantity / 50.0')}, 6) AS score FROM lineitem")
def forecast_log_score(spark, d):
    score = verify.relative_log_score(F.col("l_discount"), F.col("reward") / 50.0, F.col("l_returnflag") == "R")
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


def _held(p: str) -> str:
    """As ``_log``, with the probability held inside before it is taken from one."""
    held = f"greatest(1e-12, least(1 - 1e-12, {p}))"
    return f"ln(CASE WHEN l_returnflag = 'R' THEN {held} ELSE 1 - {held} END)"


@register(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 <> 0 THEN round({_held('l_discount')} - {_held('l_quantity / 50.0')}, 6) END AS score FROM lineitem""")
def task_log_scores(spark, d):
    """Forecasts that come as texts; every fifth line's is no number."""
    guess = F.when(F.col("l_linenumber") % 5 == 0, "half").otherwise(F.col("l_discount").cast("string"))
    score = verify.task_log_score(guess, F.col("reward") / 50.0, F.col("l_returnflag") == "R")
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


def _lists(spark, d):
    lp = lambda *xs: F.array(*(F.col(x).cast("double") for x in xs))
    return _items(spark, d).select("prompt_id", F.round(F.col("reward") / 10).alias("reward"), lp("l_discount", "l_tax").alias("logp_new"), lp("l_tax", "l_discount").alias("logp_old"), lp("l_discount", "l_discount").alias("logp_trainer"), lp("l_tax", "l_tax").alias("logp_rollout"),
                                   lp("l_tax").alias("latent_new"), lp("l_discount").alias("latent_old"), F.col("l_partkey").alias("n_tokens"), (F.col("l_suppkey") % 5 + 4).alias("policy_version"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, round(exp((l_discount - l_tax) + (l_quantity - l_quantity)), 6) AS ratio, round(greatest(0.8, least(1.28, exp(l_discount - l_tax))), 6) AS clipped FROM lineitem")
def sequence_ratio(spark, d):
    ratio = rewards.sequence_ratio(F.array("l_discount", "reward"), F.array("l_tax", "reward"))
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", F.round(ratio, 6).alias("ratio"), F.round(rewards.clip_higher(ratio, 0.2, 0.28), 6).alias("clipped"))


@register("""WITH x AS (SELECT l_orderkey AS prompt_id, round(l_quantity / 10) AS r, l_suppkey % 5 + 4 AS v, l_partkey AS n, l_discount AS a, l_tax AS b FROM lineitem),
y AS (SELECT *, r - avg(r) OVER (PARTITION BY prompt_id) AS adv, CASE WHEN v = 8 THEN 1::DOUBLE ELSE least(exp(2 * (a - b)), 1::DOUBLE) END AS tis FROM x),
g AS (SELECT prompt_id, sum(greatest(0.8::DOUBLE, least(1.28::DOUBLE, exp((a - b) + (b - a)))) * adv * tis) AS p, sum(greatest(0.8::DOUBLE, least(1.28::DOUBLE, exp(b - a))) * adv * tis) AS l, sum(greatest(n - 1000, 0) * 0.001::DOUBLE) AS o, avg(tis) AS t, count(*) AS n, min(r) = max(r) AS flat FROM y GROUP BY 1)
SELECT prompt_id, CASE WHEN flat THEN 0::DOUBLE ELSE round(p, 5) + 0::DOUBLE END AS policy_loss, CASE WHEN flat THEN 0::DOUBLE ELSE round(l, 5) + 0::DOUBLE END AS latent_loss, CASE WHEN flat THEN 0::DOUBLE ELSE round(o, 5) END AS overlong_loss, CASE WHEN flat THEN 0::DOUBLE ELSE round(t, 5) END AS mean_tis, n FROM g""")
def group_loss(spark, d):
    config = rewards.LossConfig(overlong_cache=1000, overlong_penalty=0.001)
    out = rewards.group_loss(_lists(spark, d), config, 8)
    return out.select("prompt_id", *((F.round(c, 5) + 0.0).alias(c) for c in ("policy_loss", "latent_loss", "overlong_loss", "mean_tis")), "n")


@register("SELECT l_orderkey, l_linenumber, l_partkey, round(-0.5 * pow((l_discount - l_tax) / (l_quantity / 10), 2) - ln(l_quantity / 10) - 0.5 * ln(2 * pi()), 6) AS density FROM lineitem")
def gaussian_density(spark, d):
    density = rewards.gaussian_log_density(F.array("l_discount"), F.array("l_tax"), F.array(F.col("reward") / 10))
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", F.round(density, 6).alias("density"))


_FLAGS = "l_returnflag = 'R' AS w, l_linestatus = 'O' AND l_quantity > 45 AS c, l_discount > 0.03 AS v, l_tax > 0.02 AS h"


def _views(spark, d):
    return _items(spark, d).select("prompt_id", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("wrote_test_file"), ((F.col("l_linestatus") == "O") & (F.col("reward") > 45)).alias("special_cased"), (F.col("l_discount") > 0.03).alias("visible_passed"), (F.col("l_tax") > 0.02).alias("hidden_passed"))


@register(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_FLAGS} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN w THEN 'wrote_test_file' END, CASE WHEN c THEN 'special_cased' END, CASE WHEN v AND NOT h THEN 'hidden_failed' END], lambda k: k IS NOT NULL), ',') AS kinds FROM x""")
def hack_kinds(spark, d):
    return _views(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", F.array_join(rewards.hack_kinds(), ",").alias("kinds"))


@register(f"WITH x AS (SELECT {_FLAGS} FROM lineitem) SELECT round(avg(CASE WHEN w OR c OR (v AND NOT h) THEN 1.0 ELSE 0.0 END), 9) AS recall FROM x")
def detector_recall(spark, d):
    return rewards.detector_recall(_views(spark, d)).select(F.round("recall", 9).alias("recall"))


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND NOT l_linestatus = 'O'")
def tamper_pairs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("negative_hack"), (F.col("l_linestatus") == "O").alias("positive_hack"))
    return rewards.tamper_pairs(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > l_tax")
def rescored_pairs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("positive"), F.col("l_tax").alias("negative"))
    return rewards.rescored(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax > l_discount")
def distill_back(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("multi_reward"), F.col("l_discount").alias("single_reward"))
    return rewards.distill_back(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@register("SELECT o_orderkey, CASE WHEN o_custkey % 100 < 50 THEN 'single' WHEN o_custkey % 100 < 70 THEN 'orchestrator_subs' WHEN o_custkey % 100 < 85 THEN 'parallel_aggregate' WHEN o_custkey % 100 < 95 THEN 'proposer_solver' ELSE 'author_reviewer' END AS topology FROM orders")
def topology_draw(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rewards.topology(F.col("o_custkey")).alias("topology"))


@register("""SELECT o_orderkey AS id, o_orderstatus <> substr(o_orderpriority, 3, 1) AS diverged, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus = 'F' END AS discrete_right, CASE WHEN o_orderkey % 3 <> 0 THEN substr(o_orderpriority, 3, 1) = 'F' END AS latent_right FROM orders""")
def answer_divergence(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("discrete"), F.substring("o_orderpriority", 3, 1).alias("latent"), F.when(F.col("o_orderkey") % 3 != 0, "F").alias("gold"))
    return rewards.divergences(rows)


@register("""WITH n AS (SELECT l_orderkey AS token, l_linenumber - 1 AS layer, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT token, layer FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) + 1 FROM lineitem))) AS token), (SELECT unnest(range(0, 6)) AS layer))
SELECT CAST(coalesce(c.token, n.token) AS BIGINT) AS token, CAST(coalesce(c.layer, n.layer) AS BIGINT) AS layer, CASE WHEN c.token IS NULL THEN 'out_of_range' WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'twice' END AS fault
FROM c FULL JOIN n ON c.token = n.token AND c.layer = n.layer WHERE c.token IS NULL OR n.n IS NULL OR n.n > 1""")
def routing_table(spark, d):
    """A token for each order, a layer for each line."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("token"), (F.col("l_linenumber") - 1).alias("layer"))
    n_tokens = rows.agg(F.coalesce(F.max("token") + 1, F.lit(0))).first()[0]
    return rewards.routing_table(rows, n_tokens, 6)


@register("SELECT o_orderkey, o_totalprice >= o_custkey * 300 * 1.05 AS stop FROM orders")
def early_stop(spark, d):
    return table(spark, d, "orders").select("o_orderkey", control.should_stop(F.col("o_custkey") * 300, F.col("o_totalprice")).alias("stop"))


@register("SELECT o_orderkey, CAST(ceil((o_custkey + 1) / 100.0) AS BIGINT) AS n_steps, CAST(o_custkey + 1 AS BIGINT) AS total, CAST(o_custkey + 1 - (ceil((o_custkey + 1) / 100.0) - 1) * 100 AS BIGINT) AS last_step FROM orders")
def run_steps(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", control.run_steps(F.col("o_custkey") + 1, F.lit(100).cast("long")).alias("s"))
    return rows.select("o_orderkey", F.size("s").cast("long").alias("n_steps"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("s", -1).alias("last_step"))


@register("SELECT suite, item_id, CASE WHEN suite IN ('ridge_math', 'fern_reading') THEN 'held_out' WHEN suite = 'tern_open' THEN 'public' ELSE 'unknown' END AS kind FROM eval_item")
def suite_kinds(spark, d):
    return table(spark, d, "eval_item").select("suite", "item_id", control.suite_kind(F.col("suite"), ["ridge_math", "fern_reading"], ["tern_open"]).alias("kind"))


@register("SELECT doc_id, coalesce(source <> '' AND NOT contains(s, '/') AND NOT contains(s, '..'), false) AS safe FROM (SELECT doc_id, source, source || CASE doc_id % 3 WHEN 0 THEN '/x' WHEN 1 THEN '..' ELSE '.ok' END AS s FROM documents)")
def subject_safety(spark, d):
    end = F.when(F.col("doc_id") % 3 == 0, "/x").when(F.col("doc_id") % 3 == 1, "..").otherwise(".ok")
    return table(spark, d, "documents").select("doc_id", control.safe_subject(F.concat("source", end)).alias("safe"))


_GOLD = "CAST(length(text) % 7 AS VARCHAR)"


@register(f"SELECT suite, CAST(sum(CASE WHEN length(text) % 2 = 0 AND length(text) % 7 = length(text) % 5 THEN length(text) ELSE 0 END) AS BIGINT) AS score_milli, count(*) AS n_items FROM eval_item GROUP BY suite")
def rci_score(spark, d):
    items = table(spark, d, "eval_item").select("suite", "item_id", (F.length("text") % 7).cast("string").alias("answer"), F.length("text").alias("weight_milli"))
    answers = table(spark, d, "eval_item").where("length(text) % 2 = 0").select("suite", "item_id", (F.length("text") % 5).cast("string").alias("answer"))
    return control.suite_score(items, answers)


@register(f"""SELECT suite, sha256(string_agg('{{"answer":"' || length(text) % 7 || '","id":"' || item_id || '","weight_milli":' || length(text) || '}}' || chr(10), '' ORDER BY item_id)) AS suite_hash FROM eval_item GROUP BY suite""")
def suite_hash(spark, d):
    return control.suite_hash(table(spark, d, "eval_item").select("suite", "item_id", (F.length("text") % 7).cast("string").alias("answer"), F.length("text").alias("weight_milli")))


@register("SELECT suite, sha256(string_agg(item_id || chr(0) || suite || chr(0) || split_name || chr(0) || text || chr(0) || item_id || chr(10), '' ORDER BY item_id)) AS items_hash FROM eval_item GROUP BY suite")
def item_hash(spark, d):
    return control.item_hash(table(spark, d, "eval_item").select("suite", "item_id", "split_name", F.col("text").alias("prompt"), F.col("item_id").alias("answer")))


@register("SELECT round(avg(CASE WHEN o_orderstatus = substr(o_orderpriority, 3, 1) THEN 1.0 ELSE 0.0 END), 9) AS pass_at_1 FROM orders")
def pass_at_1(spark, d):
    return control.pass_rate(table(spark, d, "orders").select(F.col("o_orderstatus").alias("gold"), F.substring("o_orderpriority", 3, 1).alias("answer"))).select(F.round("pass_at_1", 9).alias("pass_at_1"))


@register("SELECT DISTINCT event_type AS suite, count(*) > 0 AND min(epoch_ms(ts)) > 1704067200000 AND 1714067200000 - 1704000000000 >= 90 * 86400000::BIGINT AS ok FROM events GROUP BY event_type")
def suite_rotation(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("suite")).agg(F.count("*").alias("n_pending"), F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("oldest_pending"))
    return control.may_rotate(rows.withColumn("installed_at", F.lit(1704000000000)), 1704067200000, 1714067200000)


# Grids of three rows and four columns from the digits of a hash.
_CELL = "list_transform(range(0, 3), lambda r: list_transform(range(0, 4), lambda c: ascii(substr(md5(CAST(doc_id AS VARCHAR)), CAST(r * 4 + c + 1 AS BIGINT), 1)) % 10))"
_GRID = f"g AS (SELECT doc_id, {_CELL} AS g FROM documents)"


def _grids(spark, d):
    digest = F.md5(F.col("doc_id").cast("string"))
    cells = F.array(*(F.array(*((F.ascii(F.substring(digest, r * 4 + c + 1, 1)) % 10).cast("int") for c in range(4))) for r in range(3)))
    return table(spark, d, "documents").select("doc_id", cells.alias("g"))


def _shown(g):
    return F.array_join(F.transform(g, lambda r: F.array_join(F.transform(r, lambda c: c.cast("string")), "")), "/")


_SHOW = "array_to_string(list_transform({}, lambda r: array_to_string(r, '')), '/')"
_AT = {  # row r, column c of the result
    "identity": (3, 4, "g[r][c]"), "rot90": (4, 3, "g[4 - c][r]"), "rot180": (3, 4, "g[4 - r][5 - c]"), "rot270": (4, 3, "g[c][5 - r]"),
    "flip_h": (3, 4, "g[r][5 - c]"), "flip_v": (3, 4, "g[4 - r][c]"), "transpose": (4, 3, "g[c][r]"), "anti_transpose": (4, 3, "g[4 - c][5 - r]")}


_AUGMENT = "list_transform(list_transform(range(1, 5), lambda r: list_transform(range(1, 4), lambda c: g[4 - c][5 - r])), lambda r: list_transform(r, lambda c: (c * 3 + 1) % 10))"


def _turned(name: str) -> str:
    h, w, cell = _AT[name]
    return _SHOW.format(f"list_transform(range(1, {h + 1}), lambda r: list_transform(range(1, {w + 1}), lambda c: {cell}))")


@register(f"WITH {_GRID} SELECT doc_id, " + ", ".join(f"{_turned(n)} AS {n}" for n in grids.SYMMETRIES) + " FROM g")
def grid_symmetries(spark, d):
    return _grids(spark, d).select("doc_id", *(_shown(grids.symmetry(F.col("g"), n)).alias(n) for n in grids.SYMMETRIES))


@register(f"WITH {_GRID} SELECT doc_id, " + _SHOW.format("list_transform(g, lambda r: list_transform(r, lambda c: (c * 3 + 1) % 10))") + " AS g FROM g")
def grid_recolor(spark, d):
    return _grids(spark, d).select("doc_id", _shown(grids.recolor(F.col("g"), [(c * 3 + 1) % 10 for c in range(10)])).alias("g"))


@register(f"WITH {_GRID}, a AS (SELECT doc_id, {_AUGMENT} AS g FROM g), b AS (SELECT doc_id, list_transform(list_transform(range(1, 5), lambda r: list_transform(range(1, 4), lambda c: g[4 - c][r])), lambda r: list_transform(r, lambda c: (c * 3 + 1) % 10)) AS g FROM g) SELECT doc_id, {_SHOW.format('b.g')} AS input, {_SHOW.format('a.g')} AS output FROM a JOIN b USING (doc_id)")
def grid_augment(spark, d):
    """A grid and its mirror image, both turned and recolored alike."""
    pair = F.array(F.struct(F.col("g").alias("input"), grids.symmetry(F.col("g"), "flip_h").alias("output")))
    rows = _grids(spark, d).select("doc_id", grids.augment(pair, "rot90", [(c * 3 + 1) % 10 for c in range(10)])[0].alias("p"))
    return rows.select("doc_id", _shown(F.col("p.input")).alias("input"), _shown(F.col("p.output")).alias("output"))


@register(f"WITH {_GRID} SELECT doc_id, NOT list_contains(flatten(g), 9) AS ok FROM g")
def grid_validate(spark, d):
    rows = _grids(spark, d).select("doc_id", F.transform("g", lambda r: F.transform(r, lambda c: F.when(c == 9, 10).otherwise(c))).alias("g"))
    return rows.select("doc_id", grids.is_grid(F.col("g")).alias("ok"))


@register(f"WITH {_GRID} SELECT doc_id, array_to_string(list_transform(flatten(g), lambda c: c + 260), ',') AS ids FROM g")
def grid_encode(spark, d):
    from ..operators.tokenizer import grid_ids

    return _grids(spark, d).select("doc_id", F.array_join(F.transform(grid_ids(F.col("g")), lambda i: i.cast("string")), ",").alias("ids"))


@register(f"WITH {_GRID} SELECT doc_id, " + _SHOW.format("list_transform(range(1, 4), lambda r: list_transform(range(1, 5), lambda c: CASE WHEN g[r][5 - c] = 2 THEN 7 ELSE g[r][5 - c] END))") + " AS g FROM g")
def grid_program(spark, d):
    return _grids(spark, d).select("doc_id", _shown(grids.run_program(F.col("g"), [("flip_h",), ("recolor", 2, 7)])).alias("g"))


@register(f"""WITH {_GRID}, p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS program FROM g) SELECT doc_id, program FROM p""")
def grid_synthesize(spark, d):
    given = F.when(F.col("doc_id") % 3 == 0, grids.run_program(F.col("g"), [("recolor", 5, 6), ("rot90",)])).when(F.col("doc_id") % 3 == 1, grids.run_program(F.col("g"), [("flip_v",), ("recolor", 4, 3), ("recolor", 8, 1)])).otherwise(F.array(F.array(F.lit(0))))
    fixed = F.lit([[5, 4, 8, 1], [2, 3, 0, 1], [7, 6, 9, 9]]).cast("array<array<int>>")
    fixed_out = F.when(F.col("doc_id") % 3 == 0, grids.run_program(fixed, [("recolor", 5, 6), ("rot90",)])).otherwise(grids.run_program(fixed, [("flip_v",), ("recolor", 4, 3), ("recolor", 8, 1)]))
    pairs = F.array(F.struct(F.col("g").alias("input"), given.alias("output")), F.struct(fixed.alias("input"), fixed_out.alias("output")))
    catalogue = [[("transpose",)], [("recolor", 5, 6), ("rot90",)], [("flip_v",), ("recolor", 4, 3), ("recolor", 8, 1)]]
    return _grids(spark, d).select("doc_id", grids.first_program(pairs, catalogue).alias("program"))


@register(f"""WITH {_GRID}, a AS (SELECT doc_id % 100 AS task_id, doc_id AS pos, g[1][1:2] AS g FROM g), n AS (SELECT task_id, g, count(*) AS n, min(pos) AS first FROM a GROUP BY 1, 2)
SELECT task_id, array_to_string(arg_max(g, (n, -first)), '') AS g FROM n GROUP BY task_id""")
def grid_vote(spark, d):
    rows = _grids(spark, d).select((F.col("doc_id") % 100).alias("task_id"), F.col("doc_id").alias("pos"), F.array(F.slice(F.col("g")[0], 1, 2)).alias("grid"))
    return grids.vote(rows).select("task_id", _shown(F.col("grid")).alias("g"))


@register(f"WITH {_GRID} SELECT doc_id AS task_id, " + _turned("flip_h") + " AS g FROM g")
def grid_ensemble(spark, d):
    rows = _grids(spark, d).select(F.col("doc_id").alias("task_id"), F.col("g").alias("grid"))
    return grids.ensemble(rows, [("flip_h",)], ["identity", "rot180", "flip_v"]).select("task_id", _shown(F.col("grid")).alias("g"))


def _tasks(spark, d):
    return _grids(spark, d).select(F.col("doc_id").alias("task"), (F.col("doc_id") % 7).cast("string").alias("family"), F.transform(F.slice("g", 1, 1), lambda r: F.slice(r, 1, 3)).alias("input"), F.slice("g", 2, 2).alias("output"))


@register(f"""WITH {_GRID}, t AS (SELECT doc_id % 7 AS f, [g[1][1:3]] AS i, g[2:3] AS o FROM g)
SELECT count(*) AS n_tasks, count(DISTINCT f) AS n_families, count(DISTINCT i) AS n_inputs, count(DISTINCT o) AS n_outputs, count(DISTINCT (i, o)) AS n_unique, 1 AS n_shapes, round(1 - count(DISTINCT (i, o)) / count(*), 6) AS collision_rate FROM t""")
def grid_diversity(spark, d):
    return grids.diversity(_tasks(spark, d))


@register(f"WITH {_GRID}, c AS (SELECT unnest(flatten(g[2:3])) AS color FROM g) SELECT CAST(k AS INTEGER) AS color, count(color) AS n FROM (SELECT unnest(range(0, 10)) AS k) LEFT JOIN c ON color = k GROUP BY k")
def grid_colors(spark, d):
    return grids.color_histogram(_tasks(spark, d))


@register()
def procedural_tasks(spark, d):
    rows = grids.procedural_tasks(spark, grids.sample_specs(60, 5), 120, 9)
    return rows.select("task", "pair", "family", _shown(F.col("input")).alias("input"), _shown(F.col("output")).alias("output"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, true AS half, l_quantity = l_partkey AS same FROM lineitem""")
def math_equivalent(spark, d):
    q, p = F.col("reward").cast("long").cast("string"), F.col("l_partkey").cast("string")
    half = verify.math_equivalent(F.concat(F.lit("$\\frac{"), q, F.lit("}{2} + "), q, F.lit("/2$")), q)
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", half.alias("half"), verify.math_equivalent(F.concat(q, F.lit(".0")), p).alias("same"))


@register(f"WITH {_GRID} SELECT doc_id, {_SHOW.format('g')} IN ({_turned('flip_v')}, {_SHOW.format('list_transform(g, lambda r: list_transform(r, lambda c: CASE WHEN c < 9 THEN c ELSE 0 END))')}) AS ok FROM g")
def grid_match(spark, d):
    """Guesses are the grid upside down and the grid without nines."""
    without = F.transform("g", lambda r: F.transform(r, lambda c: F.when(c < 9, c).otherwise(0)))
    return _grids(spark, d).select("doc_id", verify.grid_match(F.col("g"), F.array(grids.symmetry(F.col("g"), "flip_v"), without)).alias("ok"))


@register("""WITH x AS (SELECT doc_id, CASE WHEN length(source) % 2 = 0 THEN ' true' ELSE 'id' END AS theorem, [' trivial', 'triv ial', 'fun  x =>' || chr(10) || 'x', 'fun x=> x', 'sorry', ''][CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 6 + 1] AS proof FROM documents WHERE source IS NOT NULL)
SELECT doc_id, trim(regexp_replace(proof, '\\s+', ' ', 'g')) = CASE trim(theorem) WHEN 'true' THEN 'trivial' ELSE 'fun x => x' END AS ok FROM x""")
def toy_proofs(spark, d):
    theorem = F.when(F.length("source") % 2 == 0, " true").otherwise("id")
    proofs = F.array(*map(F.lit, (" trivial", "triv ial", "fun  x =>\nx", "fun x=> x", "sorry", "")))
    proof = F.element_at(proofs, F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("int") % 6 + 1)
    return table(spark, d, "documents").where("source is not null").select("doc_id", verify.toy_proof(theorem, proof).alias("ok"))


_TASK_KINDS = ["math", "code", "grid", "market", "research", "long_horizon", "rubric"]


@register(f"""WITH x AS (SELECT *, {_TASK_KINDS!r}[l_partkey % 7 + 1] AS kind, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, n AS l_linenumber, l_partkey, CASE kind WHEN 'math' THEN q = 10 * n + 1 WHEN 'code' THEN l_returnflag = (CASE WHEN n % 2 = 0 THEN 'R' ELSE 'N' END) AND l_linestatus = 'O' WHEN 'grid' THEN q % 3 IN (n % 3, 1)
WHEN 'market' THEN CASE WHEN l_returnflag = 'R' THEN l_discount * 5 > l_tax * 5 ELSE l_discount * 5 < l_tax * 5 END WHEN 'research' THEN q = 7 * n WHEN 'long_horizon' THEN n % 2 = 0 ELSE l_discount * 10 > 0.5 END AS ok FROM x""")
def task_scores(spark, d):
    """Answers of every kind made of the columns of a line: halves, flags, small grids, forecasts, numbers, points."""
    q, n, text = F.col("reward").cast("long"), F.col("l_linenumber"), lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    of = lambda c: c.cast("string")
    kinds = F.element_at(F.array(*map(F.lit, _TASK_KINDS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    each = {
        "math": (text(of(q), "/2"), text(of(n * 5), ".5")), "code": (text(F.col("l_returnflag"), " ", F.col("l_linestatus")), text(F.when(n % 2 == 0, " R").otherwise("N"), "  O")),
        "grid": (text("[[", of(q % 3), "]]"), text("[[[", of(n % 3), "]],[[1]]]")), "market": (F.lit(""), of(F.col("l_discount") * 5)), "research": (text(of(q), ".0"), of(n * 7)),
        "long_horizon": (F.lit(""), text("[true,", of(n % 2 == 0), "]")), "rubric": (F.lit(""), of(F.col("l_discount") * 10)),
    }
    gold, answer = (F.coalesce(*(F.when(kinds == k, pair[side]) for k, pair in each.items())) for side in (0, 1))
    score = verify.task_score(kinds, gold, answer, F.col("l_tax") * 5, F.col("l_returnflag") == "R")
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", score.alias("ok"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN l_discount WHEN 'A' THEN CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END ELSE CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END END::DOUBLE AS score FROM lineitem")
def verifier_dispatch(spark, d):
    cases = {"R": F.col("l_discount"), "A": F.col("l_tax") > 0.04, "N": F.col("reward") < 25}
    return _items(spark, d).select(F.col("prompt_id").alias("l_orderkey"), "l_linenumber", "l_partkey", verify.dispatch(F.col("l_returnflag"), cases).alias("score"))
