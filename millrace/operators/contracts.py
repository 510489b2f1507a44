"""Versioned record types: their columns, their constraints, and splitting off what violates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256, RFC3339 = r"^[0-9a-f]{64}$", r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def is_sha256(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(SHA256)), F.lit(False))


def is_rfc3339(c: Column) -> Column:
    """The form and a day and time that exist."""
    moment = F.try_to_timestamp(F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.regexp_like(c, F.lit(RFC3339)) & moment.isNotNull(), F.lit(False))


def filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def natural(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def one_of(*values: str):
    return lambda c: F.coalesce(c.isin(*values), F.lit(False))


def optional(rule):
    return lambda c: c.isNull() | rule(c)


# The record types with their fields and the rule of each.
SCHEMAS: dict[str, dict[str, object]] = {
    "checkpoint": {"checkpoint_id": filled, "step": natural, "content_hash": is_sha256, "created_at": is_rfc3339},
    "data_shard": {"shard_id": filled, "mix_bucket": filled, "n_docs": natural, "n_tokens": natural, "content_hash": is_sha256},
    "env_tool_request": {"request_id": filled, "task_id": filled, "tool": filled},
    "env_tool_response": {"request_id": filled, "status": one_of("ok", "error", "timeout")},
    "eval_result": {"result_id": filled, "suite": filled, "split_name": one_of("held_out", "public"), "checkpoint_id": filled, "n_items": natural,
                    "per_item_hash": optional(is_sha256), "config_hash": optional(is_sha256), "created_at": is_rfc3339},
    "event_log": {"seq": natural, "prev_hash": is_sha256, "hash": is_sha256, "timestamp": is_rfc3339, "event_type": filled, "payload_hash": is_sha256},
    "ledger_record": {"experiment_id": filled, "hypothesis": filled, "prediction": filled, "config_hash": is_sha256, "author_role": filled, "created_at": is_rfc3339, "closed_at": optional(is_rfc3339)},
    "loader_state": {"seed": natural, "epoch": natural, "shard_offset": natural, "tokens_consumed": natural},
    "packing": {"packing_id": filled, "sequence_length": lambda c: F.coalesce(c > 0, F.lit(False)), "strategy": one_of("concat_eos", "document_mask", "single_document"), "pad_id": natural, "drop_short_below": optional(natural)},
    "reward_request": {"request_id": filled, "task_id": filled, "verifier_id": filled},
    "reward_response": {"request_id": filled, "verifier_id": filled, "scored_at": is_rfc3339},
    "rollout": {"rollout_id": filled, "task_id": filled, "policy_version": natural},
    "task_spec": {"task_id": filled, "domain": filled, "prompt": filled},
    "tokenizer": {"tokenizer_id": filled, "vocab_hash": is_sha256, "vocab_size": natural},
    "vocab": {"vocab_id": filled, "vocab_size": natural},
    "weight_export": {"export_id": filled, "checkpoint_id": filled, "content_hash": is_sha256},
}
VERSIONS = {name: [1] for name in SCHEMAS}


# A sound value of each rule's field, by name; the rest are numbers or filled texts.
_SOUND = {"status": "ok", "split_name": "public", "strategy": "concat_eos"}
_HASHES = {"content_hash", "prev_hash", "hash", "payload_hash", "per_item_hash", "config_hash", "vocab_hash"}
_TIMES = {"created_at", "closed_at", "timestamp", "scored_at"}
_NUMBERS = {"step", "n_docs", "n_tokens", "n_items", "seq", "seed", "epoch", "shard_offset", "tokens_consumed", "sequence_length", "pad_id", "drop_short_below", "policy_version", "vocab_size"}


def golden(schema_id: str) -> dict:
    """A record of the type that breaks no rule."""
    supported(schema_id)
    value = lambda name: 1 if name in _NUMBERS else "0" * 64 if name in _HASHES else "2024-02-29T12:00:00Z" if name in _TIMES else _SOUND.get(name, name)
    return {"schema_id": schema_id, "schema_version": current(schema_id), **{name: value(name) for name in SCHEMAS[schema_id]}}


def columns(schema_id: str) -> str:
    """The columns of the type, as a schema for reading."""
    return ", ".join(f"{name} {'bigint' if isinstance(x, int) else 'string'}" for name, x in golden(schema_id).items())


def supported(schema_id: str) -> list[int]:
    if schema_id not in VERSIONS:
        raise KeyError(f"unknown record type {schema_id}")
    return sorted(VERSIONS[schema_id])


def current(schema_id: str) -> int:
    return max(supported(schema_id))


def migrate(rows: DataFrame, schema_id: str, version: int, to: int) -> DataFrame:
    """The same rows at the same version; there is no way between versions."""
    if version not in supported(schema_id) or to != version:
        raise ValueError(f"no way from version {version} to {to} of {schema_id}")
    return rows


def violations(rows: DataFrame, schema_id: str, version: int = 1) -> DataFrame:
    """``rows`` with ``violations``: every field that breaks its rule; a column that isn't there breaks it in every row.

    Rows that carry ``schema_id`` or ``schema_version`` must carry these values.
    """
    if version not in supported(schema_id):
        raise KeyError(f"unknown version {version} of {schema_id}")
    rules = [F.lit(None).cast("string")]
    for name, rule in SCHEMAS[schema_id].items():
        rules.append(F.when(~rule(F.col(f"`{name}`")), F.lit(name)) if name in rows.columns else F.lit(name))
    for name, value in (("schema_id", schema_id), ("schema_version", version)):
        if name in rows.columns:
            rules.append(F.when(~F.col(name).eqNullSafe(F.lit(value)), F.lit(name)))
    return rows.withColumn("violations", F.filter(F.array(*rules), lambda v: v.isNotNull()))


def quarantine(rows: DataFrame, schema_id: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with their violations; none is lost."""
    checked = violations(rows, schema_id, version)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
