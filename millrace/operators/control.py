"""Scaling fits, replica votes, run steps, suites of held-out items, stores of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARLY_STOP = 1.05
ROTATION_DAYS = 90


def flops(active_params: Column, tokens: Column) -> Column:
    return 6.0 * active_params * tokens


def scaling_fit(runs: DataFrame) -> DataFrame:
    """One row ``(n, a, alpha)`` of L = a C^-alpha by least squares over logarithms of ``(rung, params, tokens, loss)``.

    Fewer than two different C, a rung that is there twice, rung 0, or figures that aren't positive raise.
    """
    bad = (F.col("rung") == 0) | (F.col("params") <= 0) | (F.col("tokens") <= 0) | (F.col("loss") <= 0)
    c = F.ln(flops(F.col("params").cast("double"), F.col("tokens").cast("double")))
    figures = runs.agg(
        F.count("*").alias("n"), F.count_distinct("rung").alias("rungs"), F.count_distinct(c).alias("different"), F.max(bad).alias("bad"),
        F.regr_slope(F.ln("loss"), c).alias("slope"), F.regr_intercept(F.ln("loss"), c).alias("intercept"))
    wrong = (F.col("different") < 2) | (F.col("rungs") != F.col("n")) | F.coalesce(F.col("bad"), F.lit(True))
    checked = F.when(wrong, F.raise_error(F.lit("the runs don't determine a fit")).cast("double")).otherwise(F.exp("intercept"))
    return figures.select("n", checked.alias("a"), (-F.col("slope")).alias("alpha"))


def predict_loss(a: Column, alpha: Column, params: Column, tokens: Column) -> Column:
    return a * F.pow(flops(params, tokens), -alpha)


def should_stop(predicted: Column, observed: Column) -> Column:
    return observed >= predicted * EARLY_STOP


def replica_vote(hashes: DataFrame) -> DataFrame:
    """``(shard, winner, quarantine)`` of ``(shard, replica, hash)``.

    The hash of more than half of the replicas wins, else that of the first one, of two the smaller; any other hash quarantines.
    """
    counts = hashes.groupBy("shard", "hash").agg(F.count("*").alias("n"), F.min("replica").alias("first"))
    out = counts.groupBy("shard").agg(F.sum("n").alias("total"), F.max(F.struct("n", "hash")).alias("most"), F.min_by("hash", F.struct("first", "hash")).alias("leader"), F.count("*").alias("kinds"))
    return out.select("shard", F.when(F.col("most.n") * 2 > F.col("total"), F.col("most.hash")).otherwise(F.col("leader")).alias("winner"), (F.col("kinds") > 1).alias("quarantine"))


def run_steps(budget: Column, per_step: Column) -> Column:
    """Tokens of each step of a run as an array; the last one may be short."""
    n = F.ceil(budget / per_step).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.least(per_step, budget - k * per_step))).otherwise(F.array().cast("array<bigint>"))


def resume_fault(checkpoint: Column, config: Column) -> Column:
    """Why a run can't go on from a checkpoint, both structs; null if it can.

    The tokenizer must be the same, then seed, budget, tokens of a step and rung, and no more tokens seen than the budget.
    """
    same = lambda name: checkpoint[name].eqNullSafe(config[name])
    return (
        F.when(~same("tokenizer_hash"), "tokenizer_changed")
        .when(~(same("seed") & same("token_budget") & same("tokens_per_step") & same("rung")), "checkpoint_mismatch")
        .when(checkpoint["tokens_seen"] > config["token_budget"], "resume_past_budget")
    )


def config_hash(suite: Column, split: Column, checkpoint_id: Column, harness_version: Column, n_items: Column, seed: Column) -> Column:
    """SHA-256 over the settings of an evaluation, a line for each."""
    lines = [c.cast("string") for c in (suite, split, checkpoint_id, harness_version, n_items, seed)]
    return F.sha2(F.concat(*(x for c in lines for x in (c, F.lit("\n")))), 256)


def suite_kind(suite: Column, held_out: list[str], public: list[str]) -> Column:
    return F.when(suite.isin(held_out), "held_out").when(suite.isin(public), "public").otherwise("unknown")


def safe_subject(subject: Column) -> Column:
    """Not empty, without slashes, NUL or two dots."""
    return F.coalesce((subject != "") & ~F.regexp_like(subject, F.lit(r"[/\\\x00]|\.\.")), F.lit(False))


def suite_score(items: DataFrame, answers: DataFrame) -> DataFrame:
    """``(suite, score_milli, n_items)``: weights of the items answered exactly; a missing answer scores nothing."""
    given = answers.groupBy("suite", "item_id").agg(F.first("answer").alias("given"))
    both = items.join(given, ["suite", "item_id"], "left")
    return both.groupBy("suite").agg(F.sum(F.when(F.col("given") == F.col("answer"), F.col("weight_milli")).otherwise(0)).cast("long").alias("score_milli"), F.count("*").alias("n_items"))


def pass_rate(items: DataFrame) -> DataFrame:
    """One row: share of ``(gold, answer)`` that are the same string, 0 if there are none."""
    return items.agg(F.coalesce(F.avg(F.coalesce(F.col("gold") == F.col("answer"), F.lit(False)).cast("double")), F.lit(0.0)).alias("pass_at_1"))


def suite_hash(items: DataFrame) -> DataFrame:
    """``(suite, suite_hash)``: SHA-256 over the items as JSON lines in the order of their ids; suites are bounded."""
    line = F.to_json(F.struct("answer", F.col("item_id").alias("id"), "weight_milli"))
    lines = F.array_sort(F.collect_list(F.struct("item_id", line.alias("line"))))
    return items.groupBy("suite").agg(F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x["line"], F.lit("\n"))), ""), 256).alias("suite_hash"))


def item_hash(items: DataFrame) -> DataFrame:
    """``(suite, items_hash)``: SHA-256 over id, suite, split, prompt and answer of each item, parted by NUL and lines."""
    record = F.concat(F.concat_ws("\0", "item_id", "suite", "split_name", "prompt", F.coalesce("answer", F.lit(""))), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("item_id", record.alias("line"))))
    return items.groupBy("suite").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("items_hash"))


def may_rotate(store: DataFrame, cutoff: int, now: int) -> DataFrame:
    """``(suite, ok)``: a cutoff not ahead, all pending items written after it, 90 days since the last, some items."""
    day = 86_400_000
    ok = (F.lit(cutoff) <= now) & (F.col("oldest_pending") > cutoff) & (F.lit(now) - F.col("installed_at") >= ROTATION_DAYS * day) & (F.col("n_pending") > 0)
    return store.select("suite", F.coalesce(ok, F.lit(False)).alias("ok"))


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """``(digest, sound)`` of ``(digest, content)``."""
    return blobs.select("digest", F.coalesce(F.sha2("content", 256) == F.col("digest"), F.lit(False)).alias("sound"))


def read_store(spark, folder: str) -> DataFrame:
    """``(backend, digest, content)`` of a store whose files are named by their hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("backend"), F.element_at(F.split("path", "/"), -1).alias("digest"), "content")


def put_blobs(blobs: DataFrame, min_replicas: int) -> DataFrame:
    """``(digest, replicas, stored)`` of writes ``(backend, content, written)``."""
    rows = blobs.select(F.sha2("content", 256).alias("digest"), "written")
    return rows.groupBy("digest").agg(F.sum(F.col("written").cast("long")).alias("replicas")).withColumn("stored", F.col("replicas") >= min_replicas)


def collect_garbage(replicas: DataFrame, pins: DataFrame) -> DataFrame:
    """One row ``(blobs, bytes)``: what isn't pinned goes; bytes count every replica of ``(digest, backend, size)``."""
    gone = replicas.join(pins.select("digest").distinct(), "digest", "left_anti")
    return gone.agg(F.count_distinct("digest").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"))


def prefix_sum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
