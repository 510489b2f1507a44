"""Hash-chained event logs: hashes, verification, appending, reading with a torn last line."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import fold

GENESIS = "0" * 64
COLUMNS = "chain string, seq long, prev_hash string, hash string, timestamp string, event_type string, payload string, payload_hash string"


def canonical(payload: str) -> str:
    """Compact JSON with sorted names and characters as they are; numbers keep their kind."""
    return json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_payload(payloads: pd.Series) -> pd.Series:
    """Null stays null, and so does what is no JSON."""
    out = []
    for p in payloads:
        try:
            out.append(None if p is None else canonical(p))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


def canonical_whole(payload: Column) -> Column:
    """The same inside the JVM, for payloads without fractions or exponents."""
    return F.to_json(F.try_parse_json(payload))


def payload_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def event_hash(seq: Column, prev: Column, payload_hash: Column, timestamp: Column, event_type: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), prev, payload_hash, timestamp, event_type), 256)


def verify(events: DataFrame, first_seq: int = 0) -> DataFrame:
    """``(chain, seq, fault)`` of faulty events: seq, link, payload or hash; none if all chains hold.

    A chain is checked in the order of ``seq``; chains are independent and run in parallel.
    """
    order = Window.partitionBy("chain").orderBy("seq")
    rows = events.withColumn("want_seq", F.row_number().over(order) - 1 + first_seq).withColumn("want_prev", F.coalesce(F.lag("hash").over(order), F.lit(GENESIS)))
    fault = (
        F.when(F.col("seq") != F.col("want_seq"), "seq")
        .when(~F.col("prev_hash").eqNullSafe(F.col("want_prev")), "link")
        .when(~F.col("payload_hash").eqNullSafe(payload_hash(canonical_payload("payload"))), "payload")
        .when(~F.col("hash").eqNullSafe(event_hash(F.col("seq"), F.col("prev_hash"), F.col("payload_hash"), F.col("timestamp"), F.col("event_type"))), "hash")
    )
    return rows.select("chain", "seq", fault.alias("fault")).where("fault is not null")


def event(chain: str, seq: int, prev: str, timestamp: str, event_type: str, payload: str) -> tuple:
    """An event after the one with the hash ``prev``, with the columns of ``COLUMNS``."""
    payload = canonical(payload)
    digest = hashlib.sha256(payload.encode()).hexdigest()
    h = hashlib.sha256(f"{seq}|{prev}|{digest}|{timestamp}|{event_type}".encode()).hexdigest()
    return chain, seq, prev, h, timestamp, event_type, payload, digest


def append(records: DataFrame, first_seq: int = 0) -> DataFrame:
    """Chains ``(chain, pos, timestamp, event_type, payload)`` into events; each hash needs the one before it.

    One chain is one task, through which its records stream; a log with a single endless chain has to be appended to by a stream.
    """

    def link(state, r):
        made = event(r.chain, *state, r.timestamp, r.event_type, r.payload)
        return (made[1] + 1, made[3]), [made]

    rows = records.select("chain", "pos", "timestamp", "event_type", "payload")
    return fold(rows, "chain", "pos", COLUMNS, lambda key: (first_seq, GENESIS), link)


def read_jsonl(spark, path: str, schema: str | None = None) -> DataFrame:
    """Events of ``chain=<name>`` folders or plain files; a torn last line of a file is left out, a broken one before it raises.

    Without a ``schema``, which has the chain in each line, a file is a chain.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = schema is not None
    schema = schema or "seq long, prev_hash string, hash string, timestamp string, event_type string, payload string, payload_hash string"
    parsed = lines.withColumn("e", F.from_json("value", schema)).withColumn("sound", F.col("e.seq").isNotNull() & F.col("e.hash").isNotNull() & F.try_parse_json("value").isNotNull())
    last = lines.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    both = parsed.join(F.broadcast(last), "file")
    torn = ~F.col("sound") & (F.struct("block", "at") == F.col("last"))
    # One condition, so that no part of it is worked out before the last line is known.
    kept = F.when(torn | (F.col("value") == ""), F.lit(False)).when(F.col("sound"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken line in "), "file")).cast("boolean"))
    return both.where(kept).select("e.*") if own else both.where(kept).select(F.col("file").alias("chain"), "e.*")


def write_jsonl(events: DataFrame, path: str) -> None:
    """One file of lines for each chain, in the order of ``seq``."""
    order = events.repartition("chain").sortWithinPartitions("chain", "seq")
    order.select("chain", F.to_json(F.struct("seq", "prev_hash", "hash", "timestamp", "event_type", "payload", "payload_hash")).alias("value")).write.partitionBy("chain").text(path)
