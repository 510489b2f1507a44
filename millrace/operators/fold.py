"""Sequential state by key over sorted partitions, without holding a key's rows in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: str, order: str, schema: str, begin: Callable[[Any], Any], step: Callable[[Any, Any], tuple[Any, list[tuple]]], end: Callable[[Any, Any], list[tuple]] | None = None) -> DataFrame:
    """Runs a state over each key's rows in the order of ``order``.

    ``begin(key)`` gives the first state, ``step(state, row)`` the next one and rows of the result, and
    ``end(key, state)`` rows after a key's last row. Keys are brought together by one shuffle and sorted with spilling;
    rows then stream through, so a key may hold any number of them. Null keys are a key.
    """
    width = len(schema.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        now, state, any_row = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                own = None if own != own else own
                if not any_row or own != now:
                    if any_row and end:
                        out += end(now, state)
                    now, state, any_row = own, begin(own), True
                state, made = step(state, row)
                out += made
            if out:
                yield pd.DataFrame(out, columns=names[:width])
        if any_row and end:
            last = end(now, state)
            if last:
                yield pd.DataFrame(last, columns=names[:width])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
