"""Scoring documents in shards, keeping by thresholds, and the gate of human labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing

SHARD = 32
# Tags that part the stand-in scorer's two scores.
QUALITY_TAG, SAFETY_TAG = 0x51, 0x53

Scorer = Callable[[list[str]], list[tuple[float, float]]]


def keep(predictions: DataFrame, quality: float = 0.5, safety: float = 0.5) -> DataFrame:
    """Rows at or over both thresholds, compared in single precision; null scores don't pass."""
    return predictions.where((F.col("quality") >= F.lit(quality).cast("float")) & (F.col("safety") >= F.lit(safety).cast("float")))


def shards(docs: DataFrame, order: str, size: int = SHARD) -> DataFrame:
    """``docs`` with ``shard``: consecutive runs of ``size`` in the given order.

    Ranks are range partitions' offsets plus the rank inside each, so no task sees the whole table.
    """
    return ranked(docs, order).withColumn("shard", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def ranked(df: DataFrame, order: str, keep_part: bool = False) -> DataFrame:
    """``df`` with ``rank`` from 0 in the given order; ties are in no fixed order.

    ``keep_part`` keeps ``mr_part``, the range that a row is in: ranks of a range follow each other.
    """
    from ..session import stage

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut = stage(df.repartitionByRange(int(parts), order).withColumn("mr_part", F.spark_partition_id()), "ranked")
    sizes = sorted((r.mr_part, r["count"]) for r in cut.groupBy("mr_part").count().collect())  # one row a partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    small = df.sparkSession.createDataFrame(starts, "mr_part int, mr_start long")
    inside = F.row_number().over(Window.partitionBy("mr_part").orderBy(order)) - 1
    out = cut.join(F.broadcast(small), "mr_part").withColumn("rank", F.col("mr_start") + inside).drop("mr_start")
    return out if keep_part else out.drop("mr_part")


def score_with(docs: DataFrame, scorer: Scorer, batch: int = SHARD) -> DataFrame:
    """``(content_hash, quality, safety)``: the scorer gets the texts in batches and must give one pair for each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, scores = part["text"].tolist(), []
            for at in range(0, len(texts), batch):
                got = scorer(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]):
                    raise ValueError("the scorer gave another number of scores than texts")
                scores += got
            yield pd.DataFrame({"content_hash": part["content_hash"], "quality": [q for q, _ in scores], "safety": [s for _, s in scores]}).astype({"quality": "float32", "safety": "float32"})

    return docs.where("text is not null").select("content_hash", "text").mapInPandas(run, "content_hash string, quality float, safety float")


def hash_scorer(seed: int) -> Scorer:
    """Scores made from a hash of the text: a stand-in for tests, not a model."""

    def score(texts: list[str]) -> list[tuple[float, float]]:
        out = []
        for t in texts:
            h = hashing.fnv1a64(t.encode())
            pair = (hashing.unit24(hashing.mix64(seed ^ hashing.mix64((h + tag) & (1 << 64) - 1))) for tag in (QUALITY_TAG, SAFETY_TAG))
            out.append(tuple(float(np.float32(x)) for x in pair))
        return out

    return score


def served_scorer(complete: Callable[[list[str]], list[str]], seed: int) -> Scorer:
    """Scores of the completions that a server gives for the texts, one for each."""
    inner = hash_scorer(seed)

    def score(texts: list[str]) -> list[tuple[float, float]]:
        answers = complete(texts)
        if len(answers) != len(texts):
            raise ValueError("the server gave another number of completions than prompts")
        return inner(answers)

    return score


def last_predictions(journal: DataFrame) -> DataFrame:
    """Replays a journal ``(pos, content_hash, quality, safety)``: the last score of each text holds."""
    return journal.groupBy("content_hash").agg(F.max_by(F.struct("quality", "safety"), "pos").alias("s")).select("content_hash", "s.quality", "s.safety")


def agreement(labels: DataFrame, predictions: DataFrame, quality: float = 0.5, safety: float = 0.5, strict: bool = True) -> DataFrame:
    """One row ``(n, matched, agreement)``: share of labels for which both verdicts match.

    With ``strict`` a label without a prediction raises when the row is computed; else it doesn't match.
    Labels must not be empty: the agreement of none is null.
    """
    scores = predictions.groupBy("content_hash").agg(F.max("quality").alias("quality"), F.max("safety").alias("safety"), F.lit(True).alias("there"))
    both = labels.join(scores, "content_hash", "left")
    there = F.when(F.col("there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no prediction for "), "content_hash")) if strict else F.lit(False))
    kept_q = F.coalesce(F.col("quality") >= F.lit(quality).cast("float"), F.lit(False))
    kept_s = F.coalesce(F.col("safety") >= F.lit(safety).cast("float"), F.lit(False))
    match = there & (kept_q == F.col("keep_quality")) & (kept_s == F.col("keep_safety"))
    out = both.agg(F.count("*").alias("n"), F.sum(F.coalesce(match, F.lit(False)).cast("long")).alias("matched"))
    return out.select("n", "matched", F.round(F.col("matched") / F.nullif("n", F.lit(0)), 6).alias("agreement"))


def gate(labels: DataFrame, predictions: DataFrame, minimum: float = 1.0, **thresholds: float) -> float:
    """The agreement, if it reaches the minimum; raises if there are no labels or it doesn't."""
    row = agreement(labels, predictions, **thresholds).first()
    if not row.n:
        raise ValueError("there are no labels")
    if np.float32(row.matched) / np.float32(row.n) < np.float32(minimum):
        raise ValueError(f"agreement {row.agreement} is below {minimum}")
    return row.agreement
