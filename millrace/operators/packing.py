"""Sequences of fixed length from token lists, and the loader that deals them out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shuffle_order
from .classify import ranked

# Names of the strategies.
STRATEGIES = ("concat_eos", "document_mask", "single_document")


@dataclass(frozen=True)
class Packing:
    packing_id: str
    sequence_length: int
    strategy: str
    eos_between_docs: bool = True
    pad_id: int = 0
    drop_short_below: int | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.sequence_length < 1:
            raise ValueError("the sequence length must be positive")

    def to_json(self) -> str:
        return json.dumps({"schema_id": "packing", "schema_version": 1, **asdict(self)})

    @classmethod
    def from_json(cls, text: str) -> Packing:
        value = json.loads(text)
        if value.pop("schema_id", None) != "packing" or value.pop("schema_version", None) != 1:
            raise ValueError("not a packing of version 1")
        return cls(**value)


def single_document(docs: DataFrame, packing: Packing) -> DataFrame:
    """``(id, tokens, mask)``: one row for each document that isn't too short, cut or padded to the length.

    ``docs`` is ``(id, tokens)``; null token lists are left out. Array functions alone, no shuffle.
    """
    n, length = F.least(F.size("tokens"), F.lit(packing.sequence_length)), packing.sequence_length
    rows = docs.where("tokens is not null")
    if packing.drop_short_below is not None:
        rows = rows.where(F.size("tokens") >= packing.drop_short_below)
    pad = lambda value: F.array_repeat(F.lit(value), length - n)
    return rows.select("id", F.concat(F.slice("tokens", 1, length), pad(packing.pad_id)).alias("tokens"), F.concat(F.array_repeat(F.lit(1), n), pad(0)).alias("mask"))


def concatenated(docs: DataFrame, packing: Packing, eos: int, strict: bool = False) -> DataFrame:
    """``(seq, tokens, mask, document_ids)`` of all documents in the order of ``id``, cut every length.

    A separator stands between documents, empty ones too, and belongs to the document it
    closes. ``document_ids`` counts documents from 0; padding has 0, or null with ``strict``,
    and the column is null unless the strategy is document_mask. Places are worked out over
    ``(id, size)`` alone, as prefix sums of range partitions, one number each; the tokens then move twice,
    to their places and, cut into sequences, to their sequence. Documents of one id stand in the order of the written table.
    """
    from pyspark.sql import Window

    length, between = packing.sequence_length, int(packing.eos_between_docs)
    from ..session import stage

    docs = stage(docs.where("tokens is not null").select("id", "tokens", F.monotonically_increasing_id().alias("row")), "tokens")
    order = F.struct("id", "row")
    rows = ranked(docs.select(order.alias("key"), (F.size("tokens") + between).alias("cost")), "key", keep_part=True).withColumnRenamed("mr_part", "part")
    rows = stage(rows, "places")
    sums = sorted((r.first, r.part, r.cost) for r in rows.groupBy("part").agg(F.min("rank").alias("first"), F.sum("cost").alias("cost")).collect())
    starts, total = [], 0
    for _, part, cost in sums:
        starts.append((part, total))
        total += cost
    total -= between
    base = docs.sparkSession.createDataFrame(starts, "part int, base long")
    inside = F.sum("cost").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(F.broadcast(base), "part").select("key.row", "rank", (F.col("base") + F.coalesce(inside, F.lit(0).cast("long"))).alias("at"))
    placed = docs.select("row", "tokens").join(placed, "row")
    body = F.concat("tokens", F.array(F.lit(eos))) if between else F.col("tokens")
    placed = placed.select("rank", "at", F.when(F.col("at") + F.size(body) > total, F.col("tokens")).otherwise(body).alias("body")).where(F.size("body") > 0)
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.size("body") - 1) / length)
    pieces = placed.select("rank", "at", "body", F.explode(F.sequence(first, last)).alias("seq"))
    begin = F.greatest(F.col("seq") * length - F.col("at"), F.lit(0).cast("long"))
    end = F.least((F.col("seq") + 1) * length - F.col("at"), F.size("body").cast("long"))
    pieces = pieces.select("seq", F.struct((F.col("at") + begin).alias("at"), "rank", F.slice("body", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part")).alias("p"))
    grouped = pieces.groupBy("seq").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most the length
    tokens = F.flatten(F.transform("ps", lambda p: p["part"]))
    ids = F.flatten(F.transform("ps", lambda p: F.array_repeat(p["rank"].cast("int"), F.size(p["part"]))))
    gap = length - F.size(tokens)
    nothing = F.lit(None).cast("int") if strict else F.lit(0)
    return grouped.select(
        "seq", F.concat(tokens, F.array_repeat(F.lit(packing.pad_id), gap)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), gap)).alias("mask"),
        (F.concat(ids, F.array_repeat(nothing, gap)) if packing.strategy == "document_mask" else F.lit(None).cast("array<int>")).alias("document_ids"))


def pack(docs: DataFrame, packing: Packing, eos: int) -> DataFrame:
    if packing.strategy == "single_document":
        return single_document(docs, packing)
    return concatenated(docs, packing, eos)


def epoch_order(sequences: DataFrame, seed: int, epoch: int, exact: bool = True) -> DataFrame:
    """``(pos, seq)``: the order of an epoch.

    The exact order is one sequential exchange and is drawn in one place, so it is for loaders of
    up to some millions of sequences; the other one sorts by a hash and is distributed.
    """
    spark = sequences.sparkSession
    if exact:
        n = sequences.count()

        def draw(batches):
            import pandas as pd

            for _ in batches:
                yield pd.DataFrame({"pos": range(n), "seq": shuffle_order(n, seed, epoch)})

        return spark.range(1).coalesce(1).mapInPandas(draw, "pos long, seq long")
    hashed = sequences.select("seq", F.xxhash64(F.lit(seed), F.lit(epoch), "seq").alias("k"))
    return ranked(hashed, "k").select(F.col("rank").alias("pos"), "seq")


@dataclass(frozen=True)
class LoaderState:
    seed: int
    epoch: int = 0
    shard_offset: int = 0
    tokens_consumed: int = 0
    data_mix_hash: str = ""

    def to_json(self) -> str:
        return json.dumps({"schema_id": "loader_state", "schema_version": 1, **asdict(self)})

    @classmethod
    def from_json(cls, text: str) -> LoaderState:
        value = json.loads(text)
        if not isinstance(value, dict) or value.pop("schema_id", None) != "loader_state" or value.pop("schema_version", None) != 1:
            raise ValueError("not a state of version 1")
        return cls(**value)


def next_batch(sequences: DataFrame, packing: Packing, state: LoaderState, size: int) -> tuple[DataFrame, LoaderState]:
    """``(i, epoch, pos, seq, tokens, mask)`` and the state after it.

    Batches run over the end of an epoch into the next one; padding counts as consumed.
    """
    n = sequences.count()
    if n == 0 or size < 1:
        raise ValueError("there are no sequences, or the batch is empty")
    at = state.epoch * n + state.shard_offset
    epochs = range(at // n, (at + size - 1) // n + 1)
    orders = None
    for e in epochs:
        part = epoch_order(sequences, state.seed, e).withColumn("epoch", F.lit(e))
        orders = part if orders is None else orders.unionByName(part)
    wanted = orders.withColumn("i", F.col("epoch") * F.lit(n).cast("long") + F.col("pos") - at).where((F.col("i") >= 0) & (F.col("i") < size))
    batch = F.broadcast(wanted).join(sequences.select("seq", "tokens", "mask"), "seq").select("i", "epoch", "pos", "seq", "tokens", "mask")
    after = LoaderState(state.seed, (at + size) // n, (at + size) % n, state.tokens_consumed + size * packing.sequence_length, state.data_mix_hash)
    return batch, after


def reconstruct(sequences: DataFrame, packing: Packing, state: LoaderState, size: int, mix_hash: str | None = None) -> DataFrame:
    """The batch that follows a state; with ``mix_hash`` a state of other data raises."""
    if mix_hash is not None and mix_hash != state.data_mix_hash:
        raise ValueError("the state belongs to another mixture")
    return next_batch(sequences, packing, state, size)[0]


def as_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), ",")
