"""State that a log of events folds into: leases, token budgets, request windows, curricula, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

LEASE_MS, MAX_STALENESS = 30_000, 4


#: State of a task with the running attempt and its holder, and what a lease log makes of it.
LEASE_COLUMNS = "task_id string, seq long, kind string, state string, attempt long, worker string, accepted boolean"


def lease_step(now: tuple[str, int, str], kind: str, worker: str | None, attempt: int | None) -> tuple[tuple[str, int, str], bool]:
    """The state after an event, and whether it counts.

    Kinds are enqueued, claimed, heartbeat, expired, completed and failed. A task is enqueued once and claimed
    while it waits, every claim is a new attempt, an expired task waits again; heartbeats, completions and failures
    count only from the holder of the running attempt.
    """
    state, number, holder = now
    held = state == "leased" and worker == holder and attempt == number
    accepted = {"enqueued": state == "new", "claimed": state == "waiting", "expired": state == "leased"}.get(kind, held)
    if accepted and kind == "claimed":
        return ("leased", number + 1, worker), True
    if accepted and kind in ("enqueued", "expired"):
        return ("waiting", number, ""), True
    if accepted and kind in ("completed", "failed"):
        return (kind, number, ""), True
    return now, accepted


def lease_log(events: DataFrame) -> DataFrame:
    """Each event ``(task_id, seq, kind, worker, attempt)`` with its task's state after it, and whether it was accepted."""

    def step(now, e):
        now, accepted = lease_step(now, e.kind, e.worker, e.attempt)
        return now, [(e.task_id, e.seq, e.kind, *now, accepted)]

    return fold(events.select("task_id", "seq", "kind", "worker", "attempt"), "task_id", "seq", LEASE_COLUMNS, lambda key: ("new", 0, ""), step)


def lease_states(events: DataFrame) -> DataFrame:
    """``(task_id, state, attempt, worker)`` after all events; the worker is null unless the task is leased."""
    last = lease_log(events).groupBy("task_id").agg(F.max_by(F.struct("state", "attempt", "worker"), "seq").alias("s"))
    return last.select("task_id", "s.state", "s.attempt", F.nullif("s.worker", F.lit("")).alias("worker"))


def fenced(events: DataFrame) -> DataFrame:
    """Events with ``valid``: a heartbeat, completion or failure must come from the holder of the running attempt."""
    order = Window.partitionBy("task_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("kind").isin("claimed", "expired", "completed", "failed"), F.struct("kind", "worker", "attempt"))
    held = F.last(change, ignorenulls=True).over(before)
    ok = (held["kind"] == "claimed") & (held["worker"] == F.col("worker")) & (held["attempt"] == F.col("attempt"))
    return events.withColumn("valid", F.when(F.col("kind").isin("heartbeat", "completed", "failed"), F.coalesce(ok, F.lit(False))).otherwise(F.lit(True)))


def lease_ttl(period: Column, missed: Column) -> Column:
    return period * F.greatest(F.lit(1), missed)


def due(leases: DataFrame, now: int) -> DataFrame:
    """Leases that have expired; the moment of expiry itself counts."""
    return leases.where(F.col("expires_at") <= now)


def next_waiting(tasks: DataFrame) -> DataFrame:
    """``(queue, task_id)``: the first waiting task of each queue by ``seq``."""
    return tasks.where("state = 'waiting'").groupBy("queue").agg(F.min_by("task_id", "seq").alias("task_id"))


def checkpoint_branch(task_id: Column, attempt: Column) -> Column:
    return F.concat(F.lit("task/"), task_id, F.lit("/attempt/"), attempt.cast("string"))


def charges(events: DataFrame, budget: int) -> DataFrame:
    """``(episode, agent, charged, rejected)`` of ``(episode, seq, agent, tokens)``.

    A charge that would go over the episode's budget is rejected and leaves the total as it was.
    """

    def step(total, r):
        fits = total + r.tokens <= budget
        return total + (r.tokens if fits else 0), [(r.episode, r.agent, r.tokens if fits else 0, int(not fits))]

    rows = fold(events.select("episode", "seq", "agent", "tokens"), "episode", "seq", "episode string, agent string, charged long, rejected long", lambda key: 0, step)
    return rows.groupBy("episode", "agent").agg(F.sum("charged").alias("charged"), F.sum("rejected").alias("rejected"))


def request_windows(events: DataFrame, start: float, floor: float, cap: float, increase: float, decrease: float, slow_ms: float) -> DataFrame:
    """``(provider, window)`` after ``(provider, seq, outcome, latency_ms)``.

    A quick success adds, up to the cap; a slow one, a refusal or an outage multiplies and takes at least 1, down to the floor.
    """

    def step(window, r):
        if r.outcome == "ok" and r.latency_ms <= slow_ms:
            return min(cap, window + increase), []
        return max(floor, min(window * decrease, window - 1)), []

    rows = events.select("provider", "seq", "outcome", "latency_ms")
    return fold(rows, "provider", "seq", "provider string, window double", lambda key: start, step, lambda key, window: [(key, float(window))])


def curriculum(results: DataFrame, start: int, cap: int, success: float = 0.5) -> DataFrame:
    """``(stage, calls)``: tool calls double after each stage with a success rate over ``success``."""

    def step(calls, r):
        calls = min(cap, calls * 2) if r.rate > success else calls
        return calls, [(r.track, r.stage, calls)]

    return fold(results.select("track", "stage", "rate"), "track", "stage", "track string, stage long, calls long", lambda key: start, step)


def staleness(trainer: Column, policy: Column) -> Column:
    """Versions that a batch is behind; a policy from the future raises."""
    return F.when(policy > trainer, F.raise_error(F.lit("the policy is newer than the trainer")).cast("long")).otherwise(trainer - policy)


def fresh(batches: DataFrame, trainer: int, limit: int = MAX_STALENESS) -> DataFrame:
    return batches.where(staleness(F.lit(trainer), F.col("policy_version")) <= limit)


def after_consuming(batches: DataFrame, trainer: int, limit: int = MAX_STALENESS) -> DataFrame:
    """``(queue, pos, policy_version, action)``: stale batches are dropped from the front until the first fresh one, which is taken; the rest stays."""
    age = staleness(F.lit(trainer), F.col("policy_version"))
    first = batches.groupBy("queue").agg(F.min(F.when(age <= limit, F.col("pos"))).alias("first"))
    action = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first")), "dropped").when(F.col("pos") == F.col("first"), "taken").otherwise("kept")
    return batches.join(first, "queue").select("queue", "pos", "policy_version", action.alias("action"))
