"""Queries of the training-data operators: name to function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, table
from . import cutoff, encode, formatcopies, leakage, lookalike, safety, sql, windows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "normalize_cases")
    model = lookalike.fit(cases, "in_text", "out_text")
    return lookalike.same_look_pairs(cases, "case_id", "in_text", model).select(F.col("id_a").alias("case_id_a"), F.col("id_b").alias("case_id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row under the smallest id that looks like it: one row a text, whatever the number of pairs."""
    cases = table(spark, d, "normalize_cases")
    return lookalike.look_classes(cases, "case_id", "in_text", lookalike.fit(cases, "in_text", "out_text"))


def p1_normalized(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "normalize_cases")
    normalize = lookalike.normalizer(lookalike.fit(cases, "in_text", "out_text"))
    return cases.select("case_id", normalize("in_text").alias("in_form"), normalize("out_text").alias("out_form"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return formatcopies.copy_pairs(table(spark, d, "corpus"), "id", "text")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatcopies.collapsed(table(spark, d, "corpus"), "id", "text")


def p2_collisions(spark: SparkSession, d: str) -> DataFrame:
    """128-bit hashes that different canonical forms share; expected to be empty."""
    groups = formatcopies.copy_groups(formatcopies.fingerprints(table(spark, d, "corpus"), "id", "text"))
    return formatcopies.collisions(groups).select(F.lower(F.hex("h")).alias("hash128"), "forms")


def p3_hits(spark: SparkSession, d: str) -> DataFrame:
    return leakage.scan(table(spark, d, "corpus"), table(spark, d, "eval_item"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(p3_hits(spark, d))


def p3_reordered(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reordered(p3_hits(spark, d))


def p3_status(spark: SparkSession, d: str) -> DataFrame:
    """What ``decontamination`` of each result says and should say."""
    report = leakage.suite_report(stage(p3_hits(spark, d), "hits"), table(spark, d, "eval_item"))
    return leakage.corrected(table(spark, d, "eval_result"), report)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return safety.scored(docs, safety.fit(docs, table(spark, d, "human_label")), "doc_id", "text", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return safety.found(_scores(spark, d))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d)
    return scores.select("doc_id", *(F.round(c, 6).alias(c) for c in safety.CATEGORIES), F.round(1 - F.col("unsafe"), 6).alias("safety"))


def p4_held(spark: SparkSession, d: str) -> DataFrame:
    """Scores, predictions and labels at the ``safety_threshold`` of each configuration."""
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    scores = safety.scored(docs, safety.fit(docs, table(spark, d, "human_label")), "doc_id", "text", "h")
    return safety.held_against(scores, table(spark, d, "prediction"), table(spark, d, "human_label"), table(spark, d, "classifier_config"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return safety.rates(_scores(spark, d))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text")


def p5_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids don't give the text back; expected to be empty."""
    docs = table(spark, d, "documents")
    ids = encode.encoded(docs.where("text is not null").select(F.struct("doc_id", "text").alias("row"), "text"), "row", "text")
    return encode.decoded(ids, "row").where("text <> row.text").select("row.doc_id")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.fill_windows(table(spark, d, "documents"), table(spark, d, "packing"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    packing = table(spark, d, "packing")
    return windows.fill_report(windows.fill_windows(table(spark, d, "documents"), packing), packing)


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    """What the windows must not have; expected to be empty."""
    docs, packing = table(spark, d, "documents"), table(spark, d, "packing")
    return windows.faults(stage(windows.fill_windows(docs, packing), "windows"), docs, packing)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_documents(table(spark, d, "documents")).select("doc_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return cutoff.rates(docs, cutoff.cut_documents(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p1_normalized, p2_found, p2_collapsed, p2_collisions, p3_found, p3_hits, p3_reordered, p3_status, p4_found, p4_scores, p4_held, p4_rates,
              p5_ids, p5_roundtrip, p6_windows, p6_report, p6_faults, p7_found, p7_rates)
}

#: The others can't be said in SQL; they are tested against brute force, round trips and held-out labels.
SQL: dict[str, str] = {
    "p1_found": sql.looks(),
    "p1_classes": sql.look_classes(),
    "p2_collisions": "SELECT id AS hash128, 2::BIGINT AS forms FROM corpus WHERE false",
    "p3_found": f"WITH {sql.leaks()} SELECT id, suite, item_id FROM leaks",
    "p6_faults": "SELECT packing_id, strategy AS fault, 0::BIGINT AS n FROM packing WHERE false",
    "p5_roundtrip": "SELECT doc_id FROM documents WHERE false",
}
