"""Functions of the user over batches of rows: judges, solvers, predictors and counters of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a function gets at once.
BATCH = 32


def apply(rows: DataFrame, asked: str, answer: str, function: Callable[[list[str]], list], kind: str = "string", batch: int = BATCH) -> DataFrame:
    """``rows`` with ``answer``, what a function gives for the texts of ``asked``.

    It gets lists of at most ``batch`` texts and must give as many answers, else it raises. Nulls are passed over and
    have a null answer.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T._parse_datatype_string(kind))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            there = [k for k, x in enumerate(part[asked]) if x is not None]
            got: list = [None] * len(part)
            for at in range(0, len(there), batch):
                places = there[at : at + batch]
                answers = function([part[asked].iloc[k] for k in places])
                if len(answers) != len(places):
                    raise ValueError("the function gave another number of answers than it was asked for")
                for k, value in zip(places, answers):
                    got[k] = value
            yield part.assign(**{answer: pd.Series(got, dtype=object, index=part.index)})

    return rows.mapInPandas(run, schema)


def judged(outputs: DataFrame, criteria: DataFrame, judge: Callable[[list[str]], list[str]]) -> DataFrame:
    """``(output_id, grader, criterion, weight, reply)``: the judge's reply on each output for each criterion of each grader.

    ``outputs`` is ``(output_id, output)``; ``criteria`` is ``(grader, criterion, text, weight)``, a rubric of a few rows.
    """
    asked = F.concat(F.lit("Grade from 0 to 1.\n\nCriterion:\n"), "text", F.lit("\n\nOutput:\n"), "output")
    rows = outputs.crossJoin(F.broadcast(criteria)).select("output_id", "grader", "criterion", "weight", asked.alias("prompt"))
    return apply(rows, "prompt", "reply", judge).drop("prompt")


def attempts(problems: DataFrame, solver: Callable[[list[str]], list[str]], n: int, right: Callable[[Column, Column], Column]) -> DataFrame:
    """``(task_id, attempt, passed)``: n answers of a solver to each ``(task_id, prompt, answer)``, verified."""
    rows = problems.select("task_id", "prompt", "answer", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("attempt"))
    return apply(rows, "prompt", "given", solver).select("task_id", "attempt", F.coalesce(right(F.col("answer"), F.col("given")), F.lit(False)).alias("passed"))


def predicted(items: DataFrame, predict: Callable[[list[str]], list[str]]) -> DataFrame:
    """``items`` with ``answer``: what a model answers to each item's prompt."""
    return apply(items, "prompt", "answer", predict)


def token_counts(rows: DataFrame, text: str, counter: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """``rows`` with ``n_tokens`` by a counter, or the words between white space; the empty text has none, null has null."""
    if counter is not None:
        return apply(rows, text, "n_tokens", counter, "long")
    from ..functions.text import collapse, words

    return rows.withColumn("n_tokens", F.size(words(collapse(F.col(text)))).cast("long"))
