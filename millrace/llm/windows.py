"""Problem 6: filling windows of fixed capacity with whole texts.

Method: sum-of-squares online packing. The level array counts, for each fill level, the
windows filled so far; a text goes to the level at which the sum of the squared counts of
partially filled windows grows least, a new window being one of the choices; ties go to the
fuller window. When a lane ends, its partial windows are closed against each other: whole
windows are merged, the fullest first, each into the tightest that takes it.

Texts are dealt to lanes by a hash of their id and their place in the table of sizes, so rows that
repeat one id, or have none, are spread; a lane holds about ``LANE`` texts whatever the
size of the table, so no task grows with the data, and the partial windows left by a lane are a
vanishing part of its own. Ids may be of any type. Where the separator stands between texts, a text costs one token
more and so does the window's capacity, which counts exactly one separator less than texts.

A text longer than the capacity, and no other, is cut: pieces of the full capacity fill
windows of their own and the rest is packed like a text. Null and empty texts have no tokens;
they get one row with a null window. ``drop_short_below`` drops nothing here; it belongs
to the core's packing, and results stay whole. A packing row without a positive
sequence length raises.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .encode import size_column

#: Texts in a lane.
LANE = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number of each item in order of arrival, and the fill of each window."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), dtype=np.int64)
    fills: list[int] = []
    for k, size in enumerate(sizes.tolist()):
        top = capacity - size
        # Change of the sum if a window moves from level h to h + size; a full window isn't counted.
        after = counts[size:] * 2 + 1
        after[-1] = 0
        change = np.where(counts[: top + 1] > 0, after - 2 * counts[: top + 1] + 1, 1 << 60)
        change[0] = after[0]
        level = top - int(np.argmin(change[::-1]))
        if level:
            window = open_at[level].pop()
            counts[level] -= 1
        else:
            window = len(fills)
            fills.append(0)
        fills[window] = level + size
        if level + size < capacity:
            open_at[level + size].append(window)
            counts[level + size] += 1
        where[k] = window
    return where, np.array(fills, dtype=np.int64)


def close(fills: np.ndarray, capacity: int) -> np.ndarray:
    """For each window, the window it is merged into; the fullest first, into the tightest that takes it."""
    target = np.arange(len(fills))
    partial = [int(w) for w in np.argsort(-fills, kind="stable") if fills[w] < capacity]
    room: list[tuple[int, int]] = []  # (space left, window)
    for w in partial:
        need = int(fills[w])
        at = bisect_right(room, (need, -1))
        if at < len(room):
            left, into = room.pop(at)
            target[w] = into
            if left > need:
                insort(room, (left - need, into))
        else:
            insort(room, (capacity - need, w))
    return target


def pack_lane(doc_ids: np.ndarray, sizes: np.ndarray, length: int, separator: bool) -> pd.DataFrame:
    """Rows ``(doc_id, piece, start, size, window, offset)`` of one lane."""
    extra = int(separator)
    full, rest = sizes // length, sizes % length
    alone = np.repeat(np.arange(len(sizes)), full)
    piece = np.arange(len(alone)) - np.repeat(np.cumsum(full) - full, full)
    some = np.flatnonzero(rest)
    where, fills = sum_of_squares(rest[some] + extra, length + extra)
    target = close(fills, length + extra)[where] if len(where) else where
    _, target = np.unique(target, return_inverse=True)
    n = int(target.max()) + 1 if len(target) else 0
    out = pd.DataFrame({
        "doc_id": np.concatenate([doc_ids[some], doc_ids[alone]]),
        "piece": np.concatenate([full[some], piece]),
        "start": np.concatenate([full[some] * length, piece * length]),
        "size": np.concatenate([rest[some], np.full(len(alone), length)]),
        "window": np.concatenate([target, n + np.arange(len(alone))]),
    })
    out = out.sort_values(["window", "piece"], kind="stable", ignore_index=True)
    taken = out["size"] + extra
    out["offset"] = taken.groupby(out["window"]).cumsum() - taken
    return out


def fill_windows(docs: DataFrame, packing: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(packing_id, doc_id, piece, start, size, window, offset)``.

    ``window`` names the window within the packing, ``offset`` is where the piece begins in it.
    Rows of one id that are there twice are packed twice. ``packing`` is a table of settings
    that the driver reads; the texts are tokenized once for all of them.
    """
    settings = []
    for r in packing.select("packing_id", "sequence_length", "eos_between_docs").distinct().collect():
        if not r.sequence_length or r.sequence_length < 1:
            raise ValueError(f"packing {r.packing_id}: no sequence length")
        settings.append((r.packing_id, r.sequence_length, bool(r.eos_between_docs)))
    settings.sort(key=lambda s: str(s[0]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("mr_text"))
    # The place is written with the size, so it is the same whenever a lane is packed again.
    sizes = stage(rows.select("doc_id", size_column("mr_text", tokenizer, folder).alias("size"), F.monotonically_increasing_id().alias("place")), "sizes")
    lanes = max(1, -(-sizes.count() // LANE))
    dealt = sizes.where("size > 0").withColumn("mixed", F.xxhash64("doc_id", "place"))
    dealt = dealt.withColumn("lane", F.pmod("mixed", F.lit(lanes)).cast("int"))
    dealt = dealt.withColumn("setting", F.explode(F.array(*(F.lit(k) for k in range(len(settings))))))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        setting, lane = key
        name, length, separator = settings[setting]
        part = part.sort_values(["mixed", "place"], ignore_index=True)
        out = pack_lane(part["doc_id"].to_numpy(), part["size"].to_numpy(dtype=np.int64), length, separator)
        out.insert(0, "packing_id", name)
        out["window"] = f"{lane}-" + out["window"].astype(str)
        return out

    schema = f"packing_id string, doc_id {docs.schema[id_col].dataType.simpleString()}, piece long, start long, size long, window string, offset long"
    packed = dealt.groupBy("setting", "lane").applyInPandas(pack, schema) if settings else docs.sparkSession.createDataFrame([], schema)
    names = F.array(*(F.lit(s[0]).cast("string") for s in settings)) if settings else F.array().cast("array<string>")
    empty = sizes.where("size = 0 or size is null").select(
        F.explode(names).alias("packing_id"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(empty)


def faults(packed: DataFrame, docs: DataFrame, packing: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(packing_id, fault, n)`` of what a packing must not have; expected to be empty.

    tokens: texts whose pieces don't hold all their tokens; split: texts in more pieces than their length asks for; overfull: windows
    over their capacity; loose: a fill below 0.95, where the tokens need 100 windows or more.
    """
    settings = F.broadcast(packing.select("packing_id", "sequence_length", F.coalesce("eos_between_docs", F.lit(False)).cast("int").alias("gap")).distinct())
    size = F.coalesce(size_column(text_col, tokenizer, folder), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).alias("doc_id"), size.alias("size")).groupBy("doc_id").agg(F.sum("size").alias("want"), F.count("*").alias("copies"), F.max("size").alias("most"))
    placed = packed.groupBy("packing_id", "doc_id").agg(F.sum("size").alias("have"), F.count("*").alias("pieces")).join(settings, "packing_id")
    both = placed.join(sizes, placed["doc_id"].eqNullSafe(sizes["doc_id"]))
    fewest = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("most") / F.col("sequence_length")))
    fault = F.when(F.col("have") != F.col("want"), "tokens").when((F.col("copies") == 1) & (F.col("pieces") > fewest), "split")
    texts = both.select("packing_id", fault.alias("fault")).where("fault is not null")
    filled = packed.where("window is not null").groupBy("packing_id", "window").agg(F.sum("size").alias("have"), F.count("*").alias("n")).join(settings, "packing_id")
    windows = filled.where(F.col("have") + F.col("gap") * (F.col("n") - 1) > F.col("sequence_length")).select("packing_id", F.lit("overfull").alias("fault"))
    loose = fill_report(packed, packing).where("fill < 0.95 and least_windows >= 100").select("packing_id", F.lit("loose").alias("fault"))
    return texts.unionByName(windows).unionByName(loose).groupBy("packing_id", "fault").agg(F.count("*").alias("n"))


def fill_report(packed: DataFrame, packing: DataFrame) -> DataFrame:
    """Per packing: windows, tokens, the fill, and the fewest windows that could hold the tokens."""
    used = packed.groupBy("packing_id").agg(F.countDistinct("window").alias("windows"), F.sum("size").alias("tokens"), F.count("offset").alias("pieces"))
    joined = used.join(F.broadcast(packing.select("packing_id", "sequence_length").distinct()), "packing_id")
    capacity = F.col("windows") * F.col("sequence_length")
    least = F.ceil(F.col("tokens") / F.col("sequence_length"))
    return joined.select("packing_id", "windows", "pieces", "tokens", least.alias("least_windows"), F.round(F.col("tokens") / capacity, 6).alias("fill"))
