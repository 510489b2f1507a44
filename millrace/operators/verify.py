"""Verifiers of answers; verdicts are 1.0 or 0.0 unless said otherwise."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_math, collapse

EPSILON = 1e-12
_LIMIT = 1 << 127


class _Reader:
    """A rational from + - * /, signs, parentheses, decimals and ``\\frac``; raises ValueError otherwise."""

    def __init__(self, text: str):
        self.parts = re.findall(r"\\d?frac|\d+(?:\.\d+)?|\.\d+|[-+*/(){}]|.", text)
        self.at = 0

    def _peek(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def _take(self, wanted: str | None = None) -> str:
        part = self._peek()
        if not part or (wanted and part != wanted):
            raise ValueError(part)
        self.at += 1
        return part

    def value(self) -> Fraction:
        out = self._sum()
        if self._peek():
            raise ValueError(self._peek())
        return out

    def _sum(self) -> Fraction:
        out = self._product()
        while self._peek() in ("+", "-") and self._peek():
            out = self._fit(out + self._product() if self._take() == "+" else out - self._product())
        return out

    def _product(self) -> Fraction:
        out = self._atom()
        while self._peek() in ("*", "/") and self._peek():
            if self._take() == "*":
                out = self._fit(out * self._atom())
            else:
                below = self._atom()
                if not below:
                    raise ValueError("zero")
                out = self._fit(out / below)
        return out

    def _atom(self) -> Fraction:
        part = self._take()
        if part == "-":
            return -self._atom()
        if part == "+":
            return self._atom()
        if part in ("(", "{"):
            out = self._sum()
            self._take(")" if part == "(" else "}")
            return out
        if part == "\\frac":
            self._take("{")
            above = self._sum()
            self._take("}")
            self._take("{")
            below = self._sum()
            self._take("}")
            if not below:
                raise ValueError("zero")
            return self._fit(above / below)
        if part[0].isdigit() or part[0] == ".":
            return self._fit(Fraction(part))
        raise ValueError(part)

    @staticmethod
    def _fit(value: Fraction) -> Fraction:
        """Numbers that don't fit 128 bits are equal to nothing."""
        if abs(value.numerator) >= _LIMIT or value.denominator >= _LIMIT:
            raise ValueError("overflow")
        return value


def same_value(left: str, right: str) -> bool:
    """Whether two canonical strings are the same text or the same rational."""
    if left == right:
        return True
    try:
        return _Reader(left).value() == _Reader(right).value()
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def _same(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else same_value(a, b) for a, b in zip(left, right)], dtype=object)


def math_equivalent(left: Column, right: Column) -> Column:
    """Null if one side is."""
    return _same(canonical_math(left), canonical_math(right))


def grid_match(gold: Column, guesses: Column) -> Column:
    """Whether one of at most two guesses is the grid; more raise."""
    checked = F.when(F.size(guesses) > 2, F.raise_error(F.lit("more than two guesses")).cast("boolean"))
    return checked.otherwise(F.exists(guesses, lambda g: g == gold))


def relative_log_score(model: Column, market: Column, outcome: Column) -> Column:
    """Log probability that the model gave to the outcome over the market's; a probability outside [0, 1] raises."""

    def at(p: Column) -> Column:
        checked = F.when(p.between(0, 1), p).otherwise(F.raise_error(F.lit("not a probability")).cast("double"))
        return F.ln(F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.when(outcome, checked).otherwise(1 - checked))))

    return at(model) - at(market)


def task_log_score(guess: Column, market: Column, outcome: Column) -> Column:
    """As above from a text; what is no number scores null, and probabilities are clamped before 1 - p."""

    def at(p: Column) -> Column:
        held = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))
        return F.when(p.isNotNull(), F.ln(F.when(outcome, held).otherwise(1 - held)))

    return at(guess.try_cast("double")) - at(market)


def toy_proof(theorem: Column, proof: Column) -> Column:
    """The two theorems of the toy kernel and their proofs, white space aside; an unknown theorem raises."""
    t, p = collapse(theorem), collapse(proof)
    return F.when(t == "true", p == "trivial").when(t == "id", p == "fun x => x").otherwise(F.raise_error(F.lit("unknown theorem")).cast("boolean"))


def dispatch(verifier: Column, cases: dict[str, Column]) -> Column:
    """The verdict of the verifier named in each row; an unknown name raises."""
    out = None
    for name, verdict in cases.items():
        out = F.when(verifier == name, verdict.cast("double")) if out is None else out.when(verifier == name, verdict.cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown verifier "), verifier)).cast("double"))


def parse_grids(value: Column) -> Column:
    """Grids from ``[[[...]]]`` or a single ``[[...]]``; null if it is neither."""
    many = F.from_json(value, T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
    one = F.from_json(value, T.ArrayType(T.ArrayType(T.IntegerType())))
    whole = lambda g: g.isNotNull() & ~F.exists(g, lambda r: r.isNull() | F.exists(r, lambda c: c.isNull()))
    return F.when(many.isNotNull() & F.forall(many, lambda g: whole(g)), many).when(whole(one), F.array(one))


def task_score(kind: Column, gold: Column, answer: Column, market: Column | None = None, outcome: Column | None = None) -> Column:
    """Whether an answer solves a task of its kind: math, code, grid, market, research, long_horizon or rubric."""
    exact = collapse(answer) == collapse(gold)
    number = F.coalesce(answer.try_cast("double") == gold.try_cast("double"), F.lit(False))
    points = F.from_json(answer, T.ArrayType(T.BooleanType()))
    grids = F.coalesce(F.exists(F.slice(parse_grids(answer), 1, 2), lambda g: g == parse_grids(gold)[0]), F.lit(False))
    won = F.lit(False) if market is None else F.coalesce(task_log_score(answer, market, outcome) > 0, F.lit(False))
    return (
        F.when(kind == "math", F.coalesce(math_equivalent(gold, answer), F.lit(False)))
        .when(kind == "code", exact)
        .when(kind == "grid", grids)
        .when(kind == "market", won)
        .when(kind == "research", number)
        .when(kind == "long_horizon", F.coalesce((F.size(points) > 0) & F.forall(points, lambda p: p), F.lit(False)))
        .when(kind == "rubric", F.coalesce(answer.try_cast("double") > 0.5, F.lit(False)))
        .otherwise(F.raise_error(F.lit("unknown task kind")).cast("boolean"))
    )
