"""A lease queue over a stream of its events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queues import LEASE_COLUMNS as COLUMNS
from ..operators.queues import lease_step


def lease_stream(events: DataFrame) -> DataFrame:
    """Each event ``(task_id, seq, kind, worker, attempt)`` with the state of its task after it.

    Heartbeats, completions and failures count only from the holder of the running attempt; a claim
    only of a waiting task. Kinds are enqueued, claimed, heartbeat, expired, completed, failed.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, attempt, worker = kept.get if kept.exists else ("new", 0, "")
        out = []
        for e in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            (state, attempt, worker), ok = lease_step((state, attempt, worker), e.kind, e.worker, e.attempt)
            out.append((key[0], e.seq, e.kind, state, attempt, worker, ok))
        kept.update((state, attempt, worker))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return events.groupBy("task_id").applyInPandasWithState(fold, COLUMNS, "state string, attempt long, worker string", "append", GroupStateTimeout.NoTimeout)
