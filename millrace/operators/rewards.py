"""Rewards and group losses of sampled completions, rubrics, hacks, and filters on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the topologies of an episode in a hundred, in their order.
TOPOLOGIES = [("single", 50), ("orchestrator_subs", 20), ("parallel_aggregate", 15), ("proposer_solver", 10), ("author_reviewer", 5)]


@dataclass(frozen=True)
class LossConfig:
    clip_low: float = 0.2
    clip_high: float = 0.28
    latent_clip_low: float = 0.2
    latent_clip_high: float = 0.28
    normalizer: float = 1.0
    overlong_cache: int = 0
    overlong_penalty: float = 0.0
    max_staleness: int = 4
    tis_clip: float = 1.0

    def __post_init__(self):
        if not (0 < self.clip_low < 1 and self.clip_high > 0 and 0 < self.latent_clip_low < 1 and self.latent_clip_high > 0):
            raise ValueError("clip bounds are out of range")
        if not self.normalizer > 0 or self.overlong_cache < 0 or self.overlong_penalty < 0 or self.max_staleness < 0 or not self.tis_clip > 0:
            raise ValueError("a setting is out of range")


def advantages(samples: DataFrame) -> DataFrame:
    """``samples`` with ``advantage``: the reward less the mean of its prompt, not scaled."""
    return samples.withColumn("advantage", F.col("reward") - F.avg("reward").over(Window.partitionBy("prompt_id")))


def informative(samples: DataFrame) -> DataFrame:
    """``(prompt_id, n)`` of prompts whose rewards aren't all the same."""
    out = samples.groupBy("prompt_id").agg(F.count("*").alias("n"), F.min("reward").alias("lo"), F.max("reward").alias("hi"))
    return out.where("lo <> hi").select("prompt_id", "n")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def sequence_ratio(new: Column, old: Column) -> Column:
    """exp of the summed difference of log probabilities; lists of different length raise."""
    same = F.when(F.size(new) == F.size(old), new).otherwise(F.raise_error(F.lit("lists of different length")).cast("array<double>"))
    return F.exp(total(F.zip_with(same, old, lambda a, b: a - b)))


def clip_higher(ratio: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))


def truncated_is(trainer: Column, rollout: Column, staleness: Column, clip: float) -> Column:
    return F.when(staleness == 0, F.lit(1.0)).otherwise(F.least(sequence_ratio(trainer, rollout), F.lit(clip)))


def overlong(n_tokens: Column, cache: int, penalty: float) -> Column:
    return F.greatest(n_tokens - cache, F.lit(0)) * F.lit(penalty)


def gaussian_log_density(z: Column, mu: Column, sigma: Column) -> Column:
    """Log density of independent normals; a sigma that isn't positive raises."""
    import math

    parts = F.arrays_zip(z.alias("z"), mu.alias("mu"), sigma.alias("sigma"))
    ok = F.when(F.exists(sigma, lambda s: s <= 0), F.raise_error(F.lit("sigma must be positive")).cast("double")).otherwise(F.lit(0.0))
    one = lambda p: -0.5 * F.pow((p["z"] - p["mu"]) / p["sigma"], F.lit(2)) - F.ln(p["sigma"]) - 0.5 * math.log(2 * math.pi)
    return ok + F.aggregate(parts, F.lit(0.0), lambda s, p: s + one(p))


def group_loss(samples: DataFrame, config: LossConfig, trainer_version: int) -> DataFrame:
    """``(prompt_id, policy_loss, latent_loss, overlong_loss, mean_tis, n)`` of each prompt's samples.

    Samples hold logp_new, logp_old, logp_trainer, logp_rollout, latent_new, latent_old (lists),
    reward, n_tokens and policy_version. Prompts whose rewards are all the same give zeros.
    """
    from .queues import staleness

    age = staleness(F.lit(trainer_version), F.col("policy_version"))
    rows = advantages(samples.where(age <= config.max_staleness))
    tis = truncated_is(F.col("logp_trainer"), F.col("logp_rollout"), age, config.tis_clip)
    z = F.lit(config.normalizer)
    policy = clip_higher(sequence_ratio(F.col("logp_new"), F.col("logp_old")), config.clip_low, config.clip_high) * F.col("advantage") * tis / z
    latent_ratio = F.when((F.size("latent_new") == 0) & (F.size("latent_old") == 0), F.lit(1.0)).otherwise(sequence_ratio(F.col("latent_new"), F.col("latent_old")))
    latent = F.when(F.size("latent_new") == 0, F.lit(0.0)).otherwise(clip_higher(latent_ratio, config.latent_clip_low, config.latent_clip_high) * F.col("advantage") * tis / z)
    terms = rows.select("prompt_id", "reward", policy.alias("p"), latent.alias("l"), (overlong(F.col("n_tokens"), config.overlong_cache, config.overlong_penalty) / z).alias("o"), tis.alias("t"))
    out = terms.groupBy("prompt_id").agg(*(F.sum(c).alias(c) for c in "plo"), F.avg("t").alias("t"), F.count("*").alias("n"), (F.min("reward") == F.max("reward")).alias("flat"))
    zero = lambda c, name: F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col(c)).alias(name)
    return out.select("prompt_id", zero("p", "policy_loss"), zero("l", "latent_loss"), zero("o", "overlong_loss"), zero("t", "mean_tis"), "n")


def solve_rates(results: DataFrame) -> DataFrame:
    """``(task_id, n, passed, verdict)``: keep if some but not all attempts pass."""
    out = results.groupBy("task_id").agg(F.count("passed").alias("n"), F.sum(F.col("passed").cast("long")).alias("passed"))
    verdict = F.when(F.col("n") == 0, "bad_n").when(F.col("passed") == 0, "impossible").when(F.col("passed") == F.col("n"), "trivial").otherwise("keep")
    return out.select("task_id", "n", F.coalesce("passed", F.lit(0).cast("long")).alias("passed"), verdict.alias("verdict"))


def rubric_scores(replies: DataFrame) -> DataFrame:
    """``(output_id, grader, score)``: mean of the replies weighted by criterion; a reply must be a number from 0 to 1."""
    value = F.col("reply").try_cast("double")
    checked = F.when(value.between(0, 1), value).otherwise(F.raise_error(F.lit("a reply isn't from 0 to 1")).cast("double"))
    return replies.groupBy("output_id", "grader").agg((F.sum(F.col("weight") * checked) / F.sum("weight")).alias("score"))


def panel(scores: DataFrame) -> DataFrame:
    """``(output_id, combined, passed)``: the mean less its share of the graders' spread, passed over a half."""
    out = scores.groupBy("output_id").agg((F.avg("score") * (1 - (F.max("score") - F.min("score")))).alias("combined"))
    return out.withColumn("passed", F.col("combined") > 0.5)


def hack_kinds() -> Column:
    """Kinds of hacks in ``(wrote_test_file, special_cased, visible_passed, hidden_passed)``, in their order."""
    kinds = F.array(F.when(F.col("wrote_test_file"), "wrote_test_file"), F.when(F.col("special_cased"), "special_cased"), F.when(F.col("visible_passed") & ~F.col("hidden_passed"), "hidden_failed"))
    return F.filter(kinds, lambda k: k.isNotNull())


def is_hack() -> Column:
    return F.size(hack_kinds()) > 0


def detector_recall(trajectories: DataFrame) -> DataFrame:
    """One row: flagged among all held-out hacks, 0 if there are none."""
    return trajectories.agg(F.coalesce(F.avg(is_hack().cast("double")), F.lit(0.0)).alias("recall"))


def tamper_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose negative is a confirmed hack and whose positive isn't."""
    return pairs.where(F.col("negative_hack") & ~F.col("positive_hack"))


def rescored(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("positive") > F.col("negative"))


def distill_back(tasks: DataFrame) -> DataFrame:
    """Tasks where several agents beat one; a tie drops, a number that isn't finite raises."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a reward isn't finite")).cast("double")).otherwise(c)
    return tasks.where(finite(F.col("multi_reward")) > finite(F.col("single_reward")))


def topology(draw: Column) -> Column:
    """The topology of a draw by the running sum of the shares."""
    u, acc, out = F.pmod(draw, F.lit(100)), 0, None
    for name, share in TOPOLOGIES:
        acc += share
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return out


def divergences(pairs: DataFrame) -> DataFrame:
    """``(id, diverged, discrete_right, latent_right)``; right is null where there is no gold answer."""
    right = lambda c: F.when(F.col("gold").isNotNull(), F.col(c).eqNullSafe(F.col("gold")))
    return pairs.select("id", (~F.col("discrete").eqNullSafe(F.col("latent"))).alias("diverged"), right("discrete").alias("discrete_right"), right("latent").alias("latent_right"))


def greedy(logits: Column) -> Column:
    """Position of the largest value, of those the first, from 0."""
    return F.array_position(logits, F.array_max(logits)) - 1


def routing_table(traces: DataFrame, n_tokens: int, n_layers: int) -> DataFrame:
    """Cells ``(token, layer, fault)`` of a dense table that are missing, twice there or out of range; none if it is whole."""
    spark = traces.sparkSession
    cells = spark.range(n_tokens).select(F.col("id").alias("token"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_layers - 1).cast("long"))).alias("layer"))
    have = traces.groupBy(F.col("token").cast("long").alias("token"), F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"))
    both = cells.withColumn("wanted", F.lit(True)).join(have, ["token", "layer"], "full")
    fault = F.when(F.col("wanted").isNull(), "out_of_range").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice")
    return both.select("token", "layer", fault.alias("fault")).where("fault is not null")


def parity(samples: DataFrame, threshold: float) -> DataFrame:
    """One row: the largest difference of two sides and whether it halts; nothing to compare passes with 0."""
    return samples.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_error")).withColumn("halt", F.col("max_error") > threshold)
