"""An append-only ledger of experiments: filters, a restricted query language, similarity search."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
# Words that a restricted query may not hold.
FORBIDDEN = ("SELECT ", "DROP ", "INSERT ", "DELETE ")
# Kinds of records and the beginnings of their hypotheses.
KINDS = {"check": "CHECK:", "prereg": "PREREG:"}


def append(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger and new records; raises on an id that is there or twice among the new, or that supersedes none."""
    twice = new.groupBy("experiment_id").count().where("count > 1").select("experiment_id")
    again = new.join(ledger, "experiment_id", "left_semi").select("experiment_id").unionByName(twice)
    if again.limit(1).count():
        raise ValueError("an experiment is already in the ledger")
    if new.where("supersedes is not null").join(ledger.select(F.col("experiment_id").alias("supersedes")), "supersedes", "left_anti").limit(1).count():
        raise ValueError("a record supersedes one that isn't there")
    return ledger.unionByName(new)


def sql_filter(ledger: DataFrame, where: str, params: list | None = None) -> DataFrame:
    """Records for which a condition holds; values only ever come in as parameters ``?``."""
    condition = where if where.strip() else "true"
    if ";" in condition or "--" in condition:
        raise ValueError("one condition only")
    return ledger.sparkSession.sql(f"SELECT * FROM {{ledger}} WHERE {condition}", args=[_scalar(p) for p in params or []], ledger=ledger)


def _scalar(value):
    """Booleans as 0 or 1, objects and lists as JSON text."""
    import json

    if isinstance(value, bool):
        return int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":")) if isinstance(value, (dict, list)) else value


def parse(query: str) -> list[tuple[str, str, str]]:
    """Predicates ``(field, operator, value)`` of a restricted query; raises ValueError on anything else."""
    stripped = query.strip()
    if stripped in ("", "*", "all"):
        return []
    if any(word in query.upper() for word in FORBIDDEN):
        raise ValueError("forbidden word")
    parts, quoted, begin, k = [], False, 0, 0
    while k < len(stripped):
        if stripped[k] == '"':
            quoted = not quoted
        elif not quoted and stripped.startswith(" AND ", k):
            parts.append(stripped[begin:k])
            k += 4
            begin = k + 1
        k += 1
    if quoted:
        raise ValueError("a quote isn't closed")
    parts.append(stripped[begin:])
    out = []
    for part in map(str.strip, parts):
        if not part:
            raise ValueError("an empty predicate")
        found = re.fullmatch(r"(kind|experiment_id|author_role|rung)(=)(.*)|(hypothesis)(~)(.*)", part, re.S)
        if not found:
            raise ValueError(f"unknown predicate {part}")
        name, sign, value = (g for g in found.groups() if g is not None)
        if value[:1] == '"' and value[-1:] == '"' and len(value) > 1:
            value = value[1:-1]
        elif re.search(r"\s", value) or not value or '"' in value:
            raise ValueError("a value with white space needs quotes")
        if name == "rung" and value != "none" and not (value.isascii() and value.isdigit() and int(value) < 1 << 32):
            raise ValueError("not a rung")
        if name == "kind" and value not in KINDS:
            raise ValueError("unknown kind")
        out.append((name, sign, value))
    return out


def restricted(ledger: DataFrame, query: str) -> DataFrame:
    """Records for which every predicate of a restricted query holds."""

    def condition(name: str, value: str) -> Column:
        if name == "kind":
            return F.startswith("hypothesis", F.lit(KINDS[value]))
        if name == "rung":
            return F.col("rung").isNull() if value == "none" else F.col("rung") == int(value)
        return F.contains("hypothesis", F.lit(value)) if name == "hypothesis" else F.col(name) == value

    return reduce(DataFrame.where, (condition(n, v) for n, _, v in parse(query)), ledger)


def negatives(ledger: DataFrame) -> DataFrame:
    """Records whose results say passed false or negative true, or whose replication failed."""
    field = lambda name: F.get_json_object("results", f"$.{name}")
    return ledger.where(F.coalesce(field("passed") == "false", F.lit(False)) | F.coalesce(field("negative") == "true", F.lit(False)) | F.coalesce(F.col("replication.status") == "failed", F.lit(False)))


def get(ledger: DataFrame, experiment_id: str):
    found = ledger.where(F.col("experiment_id") == experiment_id).limit(1).first()
    if found is None:
        raise KeyError(experiment_id)
    return found


def word_buckets(value: Column) -> Column:
    """The bucket of each word of a text, of ``DIMENSIONS``, in order of size; the empty array for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([0-9a-z]+)"))
    return F.array_sort(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % DIMENSIONS))


def similarity(query: str):
    """A column function: cosine of the counts of a text's buckets with the query's, 0 if one has no words."""
    asked = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMENSIONS for w in re.findall("[0-9a-z]+", query.lower()))
    size = math.sqrt(sum(n * n for n in asked.values()))
    weights = F.create_map(*(F.lit(x) for pair in asked.items() for x in pair)) if asked else F.create_map().cast("map<int,int>")
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"), F.lit(0).cast("long").alias("dot"))

    def add(s: Column, b: Column) -> Column:
        # The k-th word of a bucket adds k squared less (k - 1) squared to the squares.
        run = F.when(s["last"] == b, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(b.alias("last"), run.alias("run"), (s["squares"] + 2 * run - 1).alias("squares"), (s["dot"] + F.coalesce(weights[b.cast("int")].cast("long"), F.lit(0).cast("long"))).alias("dot"))

    def score(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.aggregate(word_buckets(text), start, add, lambda s: F.when((s["squares"] > 0) & F.lit(size > 0), s["dot"] / (F.lit(size) * F.sqrt(s["squares"]))).otherwise(F.lit(0.0)))

    return score


def most_similar(ledger: DataFrame, query: str, k: int) -> DataFrame:
    """``(experiment_id, score)`` of the k best hypotheses, ties in the order of ``rowid``; each task keeps k rows."""
    scored = ledger.select("experiment_id", "rowid", similarity(query)("hypothesis").alias("score"))
    return scored.orderBy(F.desc("score"), "rowid").limit(max(k, 0)).select("experiment_id", "score")


def nearest_vectors(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``(vec_id, score)`` of the k vectors with the largest cosine, ties by id; each task keeps k rows."""
    from .decontam import cosine

    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)
