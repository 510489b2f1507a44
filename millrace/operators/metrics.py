"""Metrics, step series, dashboards, runs and loss spikes over logged samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

PAGE_WINDOW = 10_000
#: Samples of a block when baselines are worked out.
BLOCK = 100_000


def label_key(labels: Column) -> Column:
    """Maps with the same entries give the same key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def registry(samples: DataFrame) -> DataFrame:
    """``(name, labels, kind, value)`` of ``(seq, name, labels, kind, value)``.

    Counters and histograms add up, a gauge keeps its last value; a name with two kinds raises.
    """
    rows = samples.withColumn("k", label_key(F.col("labels")))
    kinds = rows.groupBy("name").agg(F.count_distinct("kind").alias("kinds"))
    checked = rows.join(kinds, "name").withColumn("ok", F.when(F.col("kinds") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two kinds of "), "name")).cast("boolean"))).where("ok")
    out = checked.groupBy("name", F.col("k").alias("labels"), "kind").agg(F.sum("value").alias("total"), F.max_by("value", "seq").alias("last"))
    return out.select("name", "labels", "kind", F.when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("total")).alias("value"))


def series(samples: DataFrame) -> DataFrame:
    """``(name, labels, step, value)``: of several values for a step the last by ``seq``."""
    rows = samples.withColumn("k", label_key(F.col("labels")))
    return rows.groupBy("name", F.col("k").alias("labels"), "step").agg(F.max_by("value", "seq").alias("value"))


def spikes(samples: DataFrame, window: int, threshold: float, exclude_spikes: bool = False) -> DataFrame:
    """``(run_id, seq, step, loss, shard_id, baseline)`` of samples over the mean of the ``window`` before them.

    Samples count in the order of ``seq``; the first ``window`` of a run never spike. Spiked
    losses are part of later baselines, unless ``exclude_spikes``, which needs a pass by run.
    """
    if exclude_spikes:
        return _spikes_without(samples, window, threshold)
    from .classify import ranked

    # Runs are cut into blocks that each begin with the samples before them, so that a run of any length is many tasks.
    placed = ranked(samples.withColumn("mr_key", F.struct("run_id", "seq")), "mr_key").drop("mr_key")
    size = F.lit(max(BLOCK, window))
    own = F.floor(F.col("rank") / size)
    both = F.when(F.col("rank") % size >= size - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = placed.withColumn("mr_block", F.explode(both)).withColumn("mr_own", F.col("mr_block") == own)
    order = Window.partitionBy("mr_block", "run_id").orderBy("seq").rowsBetween(-window, -1)
    rows = rows.withColumn("baseline", F.avg("loss").over(order)).withColumn("before", F.count("loss").over(order)).where("mr_own")
    over = (F.col("before") == window) & (F.col("baseline") > 0) & (F.col("loss") > F.col("baseline") * (1 + threshold))
    return rows.where(over).select("run_id", "seq", "step", "loss", "shard_id", "baseline")


def _spikes_without(samples: DataFrame, window: int, threshold: float) -> DataFrame:
    def step(held, r):
        mean = sum(held) / window if len(held) == window else 0.0
        if len(held) == window and mean > 0 and r.loss > mean * (1 + threshold):
            return held, [(r.run_id, r.seq, r.step, r.loss, r.shard_id, mean)]
        return [*held, r.loss][-window:], []

    rows = samples.select("run_id", "seq", "step", "loss", "shard_id")
    return fold(rows, "run_id", "seq", "run_id string, seq long, step long, loss double, shard_id string, baseline double", lambda key: [], step)


def pages(found: DataFrame, window: int = PAGE_WINDOW) -> DataFrame:
    """Spikes with ``page``: an earlier spike of the run lies within ``window`` steps on either side."""
    later = Window.partitionBy("run_id").orderBy("step").rangeBetween(-window, window)
    # The least seq among the spikes near by tells whether one of them came earlier.
    return found.withColumn("page", F.min("seq").over(later) < F.col("seq"))


def pages_after_last(found: DataFrame, window: int = PAGE_WINDOW) -> DataFrame:
    """The stricter variant: only the last spike counts, and it must be nearer than ``window``."""
    before = F.lag("step").over(Window.partitionBy("run_id").orderBy("seq"))
    return found.withColumn("page", F.when(before.isNull(), F.lit(False)).otherwise(F.greatest(F.col("step") - before, F.lit(0)) < window))


def spike_actions(paged: DataFrame) -> DataFrame:
    """``(run_id, seq, pos, action)``: log, skip the shard, roll back, and page where it is due."""
    actions = F.when(F.col("page"), F.array(*map(F.lit, ("log", "skip_shard", "rollback", "page")))).otherwise(F.array(*map(F.lit, ("log", "skip_shard", "rollback"))))
    return paged.select("run_id", "seq", F.posexplode(actions).alias("pos", "action"))


def dashboard(panels: list[dict], points: DataFrame, found: DataFrame) -> DataFrame:
    """``(panel, kind, step, value)`` of the series named by timeseries and gauge panels, tables and logs have none.

    A panel that needs a series and has none raises; ``found`` adds the spikes under the panel ``spikes``.
    """
    out = found.select(F.lit("spikes").alias("panel"), F.lit("spikes").alias("kind"), "step", F.col("loss").alias("value"))
    for p in panels:
        if p["kind"] in ("timeseries", "gauge"):
            mine = points.where((F.col("name") == p["name"]) & (F.col("labels") == p.get("labels", "{}")))
            if not mine.limit(1).count():
                raise ValueError(f"panel {p['panel']} has no series")
            out = out.unionByName(mine.select(F.lit(p["panel"]).alias("panel"), F.lit(p["kind"]).alias("kind"), "step", "value"))
        elif p["kind"] not in ("table", "log"):
            raise ValueError(f"unknown kind of panel {p['kind']}")
    return out


def run_states(events: DataFrame) -> DataFrame:
    """``(run_id, status, n_events)``: the last status of each run."""
    return events.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n_events"))


def slow_steps(events: DataFrame, timeout: int) -> DataFrame:
    """``(key, duration)`` of steps begun and ended in ``(key, kind, at)`` that took longer than ``timeout``."""
    both = events.groupBy("key").agg(F.min(F.when(F.col("kind") == "begin", F.col("at"))).alias("b"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("e"))
    return both.select("key", (F.col("e") - F.col("b")).alias("duration")).where(F.col("duration") > timeout)


def stalled(events: DataFrame, now: int, watchdog: int) -> DataFrame:
    """Keys begun more than ``watchdog`` ago and not ended."""
    both = events.groupBy("key").agg(F.min(F.when(F.col("kind") == "begin", F.col("at"))).alias("b"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("e"))
    return both.where(F.col("e").isNull() & (F.lit(now) - F.col("b") > watchdog)).select("key")


def first_trips(checks: DataFrame) -> DataFrame:
    """``(monitor, seq, reason)``: the first violation of each monitor of ``(monitor, seq, ok, want_hash, have_hash)``."""
    bad = checks.withColumn("reason", F.when(~F.col("want_hash").eqNullSafe(F.col("have_hash")), "hash").when(~F.coalesce("ok", F.lit(False)), "violation"))
    return bad.where("reason is not null").groupBy("monitor").agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))


def rfc3339(seconds: Column) -> Column:
    """Unix seconds as a UTC time; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
