"""Loss spikes over a stream: one state for each run, kept between batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = "run_id string, seq long, step long, loss double, shard_id string, baseline double, page boolean"


def spike_stream(samples: DataFrame, window: int, threshold: float, page_window: int = 10_000) -> DataFrame:
    """Spikes of ``(run_id, seq, step, loss, shard_id)`` as they come.

    Within a batch the samples of a run count in the order of ``seq``; samples that come in a
    later batch count as observed later. The state holds the last ``window`` losses and the steps
    of the spikes so far.
    """

    def observe(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, steps = (json.loads(x) for x in state.get) if state.exists else ([], [])
        out: list[tuple[Any, ...]] = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            baseline = sum(held) / window if len(held) == window else 0.0
            if len(held) == window and baseline > 0 and r.loss > baseline * (1 + threshold):
                out.append((r.run_id, r.seq, r.step, r.loss, r.shard_id, baseline, any(abs(r.step - s) <= page_window for s in steps)))
                steps.append(int(r.step))
            held = [*held, float(r.loss)][-window:]
        state.update((json.dumps(held), json.dumps(steps)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return samples.groupBy("run_id").applyInPandasWithState(observe, COLUMNS, "held string, steps string", "append", GroupStateTimeout.NoTimeout)


def read_events(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def last_values(samples: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Addition of this engine: repeated samples of an event within the delay are dropped, before any state sees them."""
    return samples.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
