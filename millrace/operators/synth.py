"""Filters for generated text: fact checks, rejection sampling, trajectories."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Styles of rewrites in their order, and the two prompts.
STYLES = ["encyclopedia", "textbook", "conversational", "news", "technical", "simplified"]
REPHRASE = "Rephrase the document in %s style. Preserve every fact. Do not add facts.\n\nDocument:\n%s"
SOLVE = "Solve the following %s problem. Put the final answer after the reasoning.\n\nProblem:\n%s"
NEGATIONS = ["not", "no"]
MAX_BATCH = 8

Generator = Callable[[list[str]], list[str]]


def check_claim(source: Column, claim: Column) -> Column:
    """supported, contradicted or not_in_source, by ordered rules over words and numbers.

    A blank claim is not in the source; a number that the source, which has some, lacks
    contradicts it; so does a negation right before one of the claim's content words; a claim whose
    content words are all there is supported, and one without any if it stands in the source.
    """
    return text.bound(F.struct(source.alias("s"), claim.alias("c"), text.words(text.collapse(F.lower(source))).alias("w")), _verdict)


def _verdict(given: Column) -> Column:
    source, claim, source_words = given["s"], given["c"], given["w"]
    claim_text = text.collapse(F.lower(claim))
    wanted = text.content_words(text.words(claim_text))
    source_numbers, claim_numbers = text.numbers(source), text.numbers(claim)
    pairs = F.zip_with(F.slice(source_words, 1, F.greatest(F.size(source_words) - 1, F.lit(0))), F.slice(source_words, 2, F.greatest(F.size(source_words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    denied = F.exists(pairs, lambda p: p["a"].isin(NEGATIONS) & F.array_contains(wanted, p["b"]))
    return (
        F.when(claim_text == "", "not_in_source")
        .when((F.size(source_numbers) > 0) & (F.size(F.array_except(claim_numbers, source_numbers)) > 0), "contradicted")
        .when(denied, "contradicted")
        .when(F.size(wanted) == 0, F.when(F.contains(text.collapse(F.lower(source)), claim_text), "supported").otherwise("not_in_source"))
        .when(F.size(F.array_except(wanted, source_words)) == 0, "supported")
        .otherwise("not_in_source")
    )


def fact_check(pairs: DataFrame) -> DataFrame:
    """``(id, n_supported, n_contradicted, n_not_in_source, accepted)`` of ``(id, source, rewrite)``.

    An empty source raises. A rewrite is accepted if no claim is contradicted.
    """
    source = F.when(F.coalesce(F.col("source"), F.lit("")) == "", F.raise_error(F.lit("the source is empty")).cast("string")).otherwise(F.col("source"))
    claims = pairs.select("id", source.alias("source"), F.explode_outer(text.claims(F.col("rewrite"))).alias("claim"))
    verdicts = claims.select("id", F.when(F.col("claim").isNotNull(), check_claim(F.col("source"), F.col("claim"))).alias("v"))
    of = lambda v: F.sum((F.coalesce(F.col("v"), F.lit("")) == v).cast("long"))
    counts = verdicts.groupBy("id").agg(of("supported").alias("n_supported"), of("contradicted").alias("n_contradicted"), of("not_in_source").alias("n_not_in_source"))
    return counts.withColumn("accepted", F.col("n_contradicted") == 0)


def check_precision(examples: DataFrame) -> DataFrame:
    """One row ``(precision)`` over ``(source, claim, gold)``: right among what is called supported, 0 if nothing is."""
    called = check_claim(F.col("source"), F.col("claim")) == "supported"
    right = F.sum((called & (F.col("gold") == "supported")).cast("long"))
    return examples.agg(F.coalesce(right / F.nullif(F.sum(called.cast("long")), F.lit(0)), F.lit(0.0)).alias("precision"))


def rephrase_prompts(docs: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """``(id, style, prompt)``: each document in each style."""
    chosen = STYLES if styles is None else styles
    if set(chosen) - set(STYLES):
        raise ValueError("unknown style")
    rows = docs.select("id", "text", F.explode(F.array(*(F.lit(s) for s in chosen))).alias("style"))
    whole = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.raise_error(F.lit("the source is empty")).cast("string")).otherwise(F.col("text"))
    return rows.select("id", "style", F.format_string(REPHRASE, "style", whole).alias("prompt"))


def solve_prompt(domain: Column, prompt: Column) -> Column:
    return F.format_string(SOLVE, domain, prompt)


def generate(prompts: DataFrame, generator: Generator, batch: int = MAX_BATCH) -> DataFrame:
    """``prompts`` with ``completion``; the generator gets at most ``batch`` at once and must answer each."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("completion", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asked, answers = part["prompt"].tolist(), []
            for at in range(0, len(asked), batch):
                got = generator(asked[at : at + batch])
                if len(got) != len(asked[at : at + batch]):
                    raise ValueError("the generator gave another number of completions than prompts")
                answers += got
            yield part.assign(completion=answers)

    return prompts.mapInPandas(run, schema)


def last_answer(completion: str) -> str:
    """The last non-empty answer line, else the last closed code block, else the last line that isn't blank."""
    body = completion.rstrip()
    lines = re.findall(r"(?im)^answer[^\S\n]*:[^\S\n]*(.*)$", body)
    named = [a.strip() for a in lines if a.strip()]
    if named:
        return named[-1]
    blocks = re.findall(r"(?ms)^```[^\n]*\n(.*?)```", body)
    if blocks:
        return blocks[-1].removesuffix("\n")
    rest = [x for x in body.split("\n") if x.strip()]
    return rest[-1] if rest else ""


@F.pandas_udf(T.StringType())
def extract_answer(completions: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else last_answer(c) for c in completions], dtype=object)


def rejection_sample(problems: DataFrame, n: int, generator: Generator, accept: Callable[[Column, Column], Column]) -> DataFrame:
    """``(problem_id, generated, accepted)``: n completions for each problem, the answers of which are verified."""
    if n < 1:
        raise ValueError("n must be positive")
    asked = problems.select("problem_id", "answer", solve_prompt(F.col("domain"), F.col("prompt")).alias("prompt"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    answered = generate(asked, generator).withColumn("given", extract_answer("completion"))
    return answered.groupBy("problem_id").agg(F.count("*").alias("generated"), F.sum(accept(F.col("answer"), F.col("given")).cast("long")).alias("accepted"))


def verified_rate(results: DataFrame) -> DataFrame:
    """One row: accepted among generated, 0 if nothing was."""
    return results.agg(F.coalesce(F.sum("accepted") / F.nullif(F.sum("generated"), F.lit(0)), F.lit(0.0)).alias("rate"))


def trajectory_outcomes(steps: DataFrame, max_steps: int) -> DataFrame:
    """``(task_id, n_steps, outcome)`` of recorded ``(task_id, step, line, result)``.

    A line without a tool fails; a submit whose result is exactly ``verified`` is Verified, another
    one Failed; a run that used all steps without a submit is Truncated. Steps after the end don't count.
    """
    called = steps.where(F.col("step") < max_steps).withColumn("call", text.parse_tool_call(F.col("line")))
    ending = F.when(F.col("call").isNull(), "Failed").when(F.col("call.tool") == "submit", F.when(F.col("result") == "verified", "Verified").otherwise("Failed"))
    ends = called.withColumn("end", ending)
    return ends.groupBy("task_id").agg(
        F.coalesce(F.min(F.when(F.col("end").isNotNull(), F.col("step"))) + 1, F.count("*")).cast("long").alias("n_steps"),
        F.coalesce(F.min_by("end", F.when(F.col("end").isNotNull(), F.col("step"))), F.lit("Truncated")).alias("outcome"))


def keep_verified(trajectories: DataFrame) -> DataFrame:
    return trajectories.where("outcome = 'Verified'")


def outcome_rate(trajectories: DataFrame) -> DataFrame:
    return trajectories.agg(F.coalesce(F.avg((F.col("outcome") == "Verified").cast("double")), F.lit(0.0)).alias("rate"))


def step_prompt(prompt: Column, steps: Column) -> Column:
    """The prompt followed by tool, arguments and result of each step on lines of their own."""
    return F.concat(prompt, F.array_join(F.transform(steps, lambda s: F.concat(F.lit("\n"), s["tool"], F.lit("\n"), s["args"], F.lit("\n"), s["result"])), ""))
