"""Problem 1: one consistent form for texts that look the same.

Method: compatibility folding and deletion of ignorable characters (``glyphs``), then a
Viterbi search over the lattice of look-alike letters. Inside a word the path is scored by
character bigrams learned for each script from the table's own words, with a penalty for
changing the script; over the words of a text a second lattice carries the script on, so
a word made only of ambiguous letters takes the script of its neighbours.

Letters of one class are drawn alike, so any of them may stand for any other at no cost.
Letters that are only near one another may be exchanged at the cost ``NEAR``: the search
does so where a word would otherwise change its script (a Greek nu inside an English word),
and leaves them where the word is of one script. Texts look the same if their forms are equal.
Nulls stay null, blank texts become the empty string, and neither is ever paired.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .glyphs import DRAWN_AS_LATIN, alternatives, clean, near_letters, script_of, skeleton

#: Log penalties for another script inside a word and from word to word, and for a letter that is only near.
INSIDE, BETWEEN, NEAR = -9.0, -2.5, -6.0
SMOOTHING = 0.5
#: Rows of one look that meet in one step of the pair join.
BLOCK = 2_000
#: Words whose readings a worker remembers.
CACHE = 500_000


def _bigrams(word: str, n: int, counts: Counter) -> None:
    """Adds the bigrams of a word that is written in one script."""
    letters = [c for c in unicodedata.normalize("NFD", word) if c.isalpha()]
    scripts = {script_of(c) for c in letters} - {"common"}
    if len(scripts) != 1:
        return
    script, before = scripts.pop(), "^"
    for c in letters:
        counts[script, before, c] += n
        before = c


def script_bigrams(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of letter bigrams by script over all rows; at most the square of the alphabet."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for column in batch:
                for text in batch[column].dropna():
                    words.update(clean(text).split(" "))
            for word, n in words.items():
                _bigrams(word, n, counts)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["script", "before", "char", "n"])

    part = df.select(*columns).mapInPandas(count, "script string, before string, char string, n long")
    return part.groupBy("script", "before", "char").agg(F.sum("n").alias("n"))


class LatticeModel:
    """Scores of letters after letters, and the search for the best reading of a skeleton.

    ``near`` are letters and the Latin ones they resemble; both ways are options of the
    lattice, the way back only for letters that the counted words have.
    """

    def __init__(self, rows: list[tuple[str, str, str, int]], near: dict[str, str] | None = None):
        total: Counter = Counter()
        alphabet: dict[str, set] = {}
        for script, before, char, n in rows:
            total[script, before] += n
            alphabet.setdefault(script, set()).add(char)
        size = {s: len(a) + 1 for s, a in alphabet.items()}
        self.seen = {(s, b, c): log((n + SMOOTHING) / (total[s, b] + SMOOTHING * size[s])) for s, b, c, n in rows}
        self.unseen = {(s, b): log(SMOOTHING / (n + SMOOTHING * size[s])) for (s, b), n in total.items()}
        used = set().union(*alphabet.values()) if alphabet else set()
        self.near: dict[str, list[tuple[str, str, float]]] = {}
        self.drawn: dict[int, str] = {}
        for char, latin in (near or {}).items():
            if unicodedata.name(char, "").startswith(DRAWN_AS_LATIN):
                self.drawn[ord(char)] = latin
                continue
            self.near.setdefault(char, []).append((latin, "latin", NEAR))
            if char in used:
                self.near.setdefault(latin, []).append((char, script_of(char), NEAR))
        self.words: dict[str, tuple] = {}
        self.options: dict[str, list[tuple[str, str, float]]] = {}

    def _score(self, script: str, before: str, char: str) -> float:
        hit = self.seen.get((script, before, char))
        return hit if hit is not None else self.unseen.get((script, before), log(1 / 64))

    def _options(self, rep: str) -> list[tuple[str, str, float]]:
        """Letters that ``rep`` may be, with scripts and costs; none if all belong to every script."""
        out = [(c, s, 0.0) for c, s in alternatives(rep)] + self.near.get(rep, [])
        out = [] if all(s == "common" for _, s, _ in out) else out
        self.options[rep] = out
        return out

    def readings(self, word: str) -> tuple[tuple[str, str, float, str], ...]:
        """(first script, last script, score, text) of the best path of each kind; none if the word has no letter.

        Left out is a path that even two changes of script around a better one can't make the best.
        """
        paths: dict[tuple[str, str], tuple[float, str, str]] = {}  # score, text, last letter
        head = ""
        known = self.options
        for rep in word:
            options = known[rep] if rep in known else self._options(rep)
            if not options:
                if paths:
                    paths = {k: (v, t + rep, last) for k, (v, t, last) in paths.items()}
                else:
                    head += rep
                continue
            step: dict[tuple[str, str], tuple[float, str, str]] = {}
            for char, script, cost in options:
                if not paths:
                    value = cost + self._score(script, "^", char)
                    if (script, script) not in step or value > step[script, script][0]:
                        step[script, script] = (value, head + char, char)
                for (first, now), (value, text, last) in paths.items():
                    value += cost + (self._score(script, last, char) if now == script else INSIDE + self._score(script, "^", char))
                    if (first, script) not in step or value > step[first, script][0]:
                        step[first, script] = (value, text + char, char)
            paths = step
        least = max((v for v, _, _ in paths.values()), default=0.0) + 2 * BETWEEN
        return tuple((first, last, v, t) for (first, last), (v, t, _) in paths.items() if v >= least)

    def _known(self, word: str) -> tuple[str | None, tuple]:
        """The word's only reading, or None and those to choose from."""
        found = self.readings(word)
        out = (word, ()) if not found else (found[0][3], found) if len(found) == 1 else (None, found)
        if len(self.words) < CACHE:  # a cache, not a limit on results
            self.words[word] = out
        return out

    def normalize(self, text: str | None) -> str | None:
        """The best reading of the text, composed (NFC)."""
        if text is None:
            return None
        shape = skeleton(text)
        if self.drawn and not shape.isascii():
            shape = shape.translate(self.drawn)
        words = shape.split(" ")
        get = self.words.get
        known = [get(w) or self._known(w) for w in words]
        forms = [only for only, _ in known]
        if None in forms:
            forms = self._search(words, known)
        return unicodedata.normalize("NFC", " ".join(forms))

    def _search(self, words: list[str], known: list[tuple]) -> list[str]:
        """Viterbi over the words, by the script in which each ends."""
        states: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
        for word, (_, found) in zip(words, known):
            if not found:
                states = {s: (v, (path, word)) for s, (v, path) in states.items()}
                continue
            after: dict[str, tuple[float, tuple]] = {}
            for first, last, value, reading in found:
                best = max((v + (0.0 if s in ("", first) else BETWEEN), s) for s, (v, _) in states.items())
                if last not in after or best[0] + value > after[last][0]:
                    after[last] = (best[0] + value, (states[best[1]][1], reading))
            states = after
        path, out = max(states.items(), key=lambda x: (x[1][0], x[0]))[1][1], []
        while path:
            path, word = path
            out.append(word)
        return out[::-1]


def fit(df: DataFrame, *columns: str) -> LatticeModel:
    """Counts over all rows in Spark; what reaches the driver is bounded by the alphabet, not by the data."""
    rows = sorted((r.script, r.before, r.char, r.n) for r in script_bigrams(df, *columns).collect())
    return LatticeModel(rows, near_letters(df.sparkSession))


def normalizer(model: LatticeModel):
    """A column function: text to its consistent form."""

    @F.pandas_udf(T.StringType())
    def normalize(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else model.normalize(t) for t in texts], dtype=object)

    return normalize


def _looks(df: DataFrame, id_col: str, text_col: str, model: LatticeModel) -> DataFrame:
    """``(id, key, own)``: hashes of the form and of the text itself, of rows that have an id and aren't blank."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null and id is not null")
    rows = rows.withColumn("form", normalizer(model)("t")).where("form <> ''")
    return rows.select("id", F.md5("form").alias("key"), F.md5("t").alias("own"))


def look_classes(df: DataFrame, id_col: str, text_col: str, model: LatticeModel) -> DataFrame:
    """``(id, class_id, n_rows)``: each row under the smallest id of those that look like it, with their number.

    One row for each row that isn't null or blank, however many look alike.
    """
    rows = stage(_looks(df, id_col, text_col, model), "looks")
    classes = rows.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n_rows"))
    return rows.join(classes, "key").select(F.col("id").alias(id_col), "class_id", "n_rows")


def same_look_pairs(df: DataFrame, id_col: str, text_col: str, model: LatticeModel) -> DataFrame:
    """``(id_a, id_b)`` of rows that look the same but differ as strings, the smaller id first.

    Looks under which all strings are identical, the usual hot groups, are dropped before the
    join; what is left is joined on a 128-bit key, and every row of the result is a case. A look
    of many rows is joined in blocks, so a step holds about ``BLOCK`` rows of either side. An id
    that stands twice gives a pair once.
    """
    rows = stage(_looks(df, id_col, text_col, model), "looks")
    mixed = rows.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.ceil(F.count("*") / BLOCK).alias("parts")).where("lo <> hi")
    rows = rows.join(mixed.select("key", "parts"), "key")
    own, every = F.pmod(F.xxhash64("id"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    a = rows.select("key", F.col("id").alias("id_a"), F.col("own").alias("own_a"), own.alias("i"), every.alias("j"))
    b = rows.select("key", F.col("id").alias("id_b"), F.col("own").alias("own_b"), own.alias("j"), every.alias("i"))
    return a.join(b, ["key", "i", "j"]).where("id_a < id_b and own_a <> own_b").select("id_a", "id_b").distinct()
