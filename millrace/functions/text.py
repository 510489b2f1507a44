"""Text functions as Columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without width that are removed before texts are compared.
ZERO_WIDTH = "​‌‍⁠﻿᠎"
# Words too common to carry a claim.
STOP_WORDS = ["that", "this", "with", "from", "they", "them", "have", "been", "were", "will", "would", "could", "should", "into", "over", "under", "than", "then", "when", "what", "which", "their"]
# LaTeX environments that hold mathematics.
MATH_ENVIRONMENTS = ["align", "align*", "alignat", "alignat*", "displaymath", "eqnarray", "eqnarray*", "equation", "equation*", "flalign", "flalign*", "gather", "gather*", "math", "multline", "multline*"]


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def collapse(text: Column) -> Column:
    """Single spaces for runs of Unicode white space, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Zero-width characters out, lower case, white space collapsed."""
    return collapse(F.lower(strip_zero_width(text)))


def exact_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often and wherever ``use`` takes it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words of a normalized text; the empty array for a blank one."""
    return bound(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def windows(tokens: Column, n: int) -> Column:
    """Every run of ``n`` tokens joined by spaces; empty if there are fewer or n is 0."""
    if n < 1:
        return F.filter(tokens, lambda _: F.lit(False))
    none = F.array().cast("array<string>")

    def runs(t: Column) -> Column:
        # Shifted copies zipped together: one slice for each of the n words, not one for each window.
        m = F.size(t) - (n - 1)
        out = F.slice(t, 1, m)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(t, k + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(t) < n, none).otherwise(out)

    return bound(tokens, runs)


def shingles(text: Column, n: int) -> Column:
    return windows(words(normalize(text)), n)


def ngrams(text: Column, n: int = 8) -> Column:
    """Lower-case n-grams over white space alone; marks and zero-width characters stay."""
    return windows(words(collapse(F.lower(text))), n)


def regex_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9A-Za-z_]+"), F.lit(0)), F.lower)


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+"), F.lit(0)), F.lower)


def paragraphs(text: Column) -> Column:
    """Normalized paragraphs; blank lines, of white space only, part them."""
    unified = F.regexp_replace(F.lower(strip_zero_width(text)), "\r\n?", "\n")
    parts = F.split(unified, r"\n(?:(?U)\s*)\n")
    return F.filter(F.transform(parts, collapse), lambda p: p != "")


def strip_latex_comments(text: Column) -> Column:
    """Comments from an unescaped percent sign to the end of the line are removed."""
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")


def holds_math(text: Column) -> Column:
    """A display, one of the environments, or two unescaped dollar signs."""
    begins = [F.contains(text, F.lit("\\begin{" + e + "}")) for e in MATH_ENVIRONMENTS]
    found = F.contains(text, F.lit("$$")) | F.regexp_like(text, F.lit(r"(?s)(?<!\\)\$.*(?<!\\)\$"))
    for b in begins:
        found = found | b
    return found


def claims(text: Column) -> Column:
    """Sentences: cut after . ! or ? before white space, trimmed, blanks out."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def content_words(tokens: Column) -> Column:
    """Tokens of four or more characters that aren't stop words."""
    return F.filter(tokens, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))


def parse_tool_call(line: Column) -> Column:
    """``(tool, args)``: the first word, and the rest without the space before it; null for a blank line."""
    trimmed = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    call = F.struct(F.regexp_extract(trimmed, r"(?U)^(\S+)", 1).alias("tool"), F.regexp_replace(F.regexp_replace(trimmed, r"(?U)^\S+", ""), r"(?U)^\s+", "").alias("args"))
    return F.when(trimmed != "", call)


def canonical_math(text: Column) -> Column:
    """Without dollar signs, ``\\left``, ``\\right`` and white space."""
    return F.regexp_replace(F.replace(F.replace(F.replace(text, F.lit("$")), F.lit("\\left")), F.lit("\\right")), r"(?U)\s+", "")


def tokens_per_word(n_tokens: Column, text: Column) -> Column:
    n = F.size(words(collapse(text)))
    return F.when(n > 0, n_tokens / n).otherwise(F.lit(0.0))


def bytes_per_word(text: Column) -> Column:
    """The baseline of one token a byte."""
    return tokens_per_word(F.octet_length(text), text)


def family_id(kind: Column, parameters: Column) -> Column:
    """``kind:k=v,...`` with the parameters of the map in the order of their names."""
    pairs = F.array_sort(F.transform(F.map_entries(parameters), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return F.concat(kind, F.lit(":"), F.array_join(pairs, ","))
