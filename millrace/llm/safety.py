"""Problem 4: abusive, hateful or sexual content.

Method: a classifier chain of linear models over stretches of up to ``LONG`` words. The links
predict sexual, threat, hate and insult in this order, the last one whether the stretch is
unsafe; each link gets the words, the word pairs and the probabilities of the links before
it, which for training come from models that haven't seen the stretch's document
(out-of-fold). A document's scores are the highest of its stretches, link by link.

Before words are read, disguises are undone: look-alike letters, accents and shapeless
characters, digits and signs for letters, letters set apart by spaces or dots, drawn-out
letters.

Nothing but labels decides what is unsafe. They are those of documents: raters are averaged
and ties dropped, every stretch is first fitted under its document's label, then again with
only the stretches that can have earned it. The labels name no category. ``NAMES`` has a few
words that name each; a model of the other words around them puts every stretch that earned
its label into one category, and the links are fitted to that. The naming words are no features
of their own and have no part in what is unsafe.

The models are fitted on a bounded sample, the ``SAMPLE`` labelled texts with the smallest
hashes and thus at the rate of the labels, once for the same sample; every row of the table is
scored. Null and blank texts score 0, and so does every text if labels of one kind are missing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glyphs import skeleton

#: Most labelled texts that models are fitted on.
SAMPLE = 12000
#: Longest stretch of words that is scored at once.
LONG = 14
FOLDS, ROUNDS, RATE, RIDGE, HEAVY = 3, 25, 0.4, 1e-5, 3.0
#: Probability from which a document is unsafe.
UNSAFE = 0.4
CATEGORIES = ("sexual", "threat", "hate", "insult")
LINKS = (*CATEGORIES, "unsafe")

# Words that name each category in English, French, German and Spanish, without accents.
NAMES = {
    "sexual": "sex sexe sexo porn porno pornos naked nude nudes nue nackt desnuda",
    "threat": "kill die tuer mourir toten sterben matar morir burn house",
    "hate": "race tribe people vermin vermine ungeziefer plaga ratas",
    "insult": "idiot idiote idiota stupid stupide dumm estupido moron imbecile imbecil",
}
# Digits and signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t"})

_MARKS = re.compile("[̀-ͯ]")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:([ ._*\-·|])[^\W_])(?:\1[^\W_])+(?![^\W_])")
_APART_SIGN = re.compile(r"\b\w([ ._*\-·|])\w\1\w\b")
_SPEAKER = re.compile(r"(?m)^\s*(?:[-*•>]+\s+|<?[^\W\d_]\w{0,15}>?:\s+)")
#: Words with the signs that may stand for letters, ends of sentences, and line breaks.
_PIECE = re.compile(r"[a-z0-9@$€*+!]+|[.?](?=[\s\"')»]|$)|\n")
_SPELLED = re.compile(r"(?=[0-9]*[a-z])[a-z0-9]*[@$€!*+0-9][a-z@$€!*+0-9]*[a-z0-9$@*]|[@$*][a-z]+")
_DRAWN = re.compile(r"([a-z])\1+")
_WORD = re.compile(r"[a-z*]+|\d+")


def _spelled(found: re.Match) -> str:
    word = found.group()
    return word if sum(c.isalpha() for c in word) * 3 < len(word) else word.translate(_LEET)


class _Pieces(dict):
    """A piece of text to its words and whether a sentence ends with it; a cache only."""

    def __missing__(self, piece: str) -> tuple[tuple[str, ...], bool]:
        words = _WORD.findall(_DRAWN.sub(r"\1", _SPELLED.sub(_spelled, piece)))
        out = tuple("0" if w[0].isdigit() else w for w in words), piece[-1] in ".?!\n"
        if len(self) < 500_000:
            self[piece] = out
        return out


_PIECES = _Pieces()


def windows(words: list[str]) -> list[list[str]]:
    """A long sentence as overlapping stretches, so what is harmless around an insult can't outweigh it."""
    if len(words) <= LONG:
        return [words]
    return [words[at : at + LONG] for at in range(0, len(words) - LONG // 2, LONG // 2)]


def stretches(text: str) -> list[list[str]]:
    """The words of each sentence or line, as they were meant; long ones in ``windows``."""
    text = text.lower() if text.isascii() else _MARKS.sub("", "\n".join(map(skeleton, text.split("\n")))).lower()
    text = _SPEAKER.sub("\n", text)
    if _APART_SIGN.search(text):
        text = _APART.sub(lambda m: re.sub(r"[ ._*\-·|]", "", m.group()), text)
    out, words = [], []
    for found, ends in map(_PIECES.__getitem__, _PIECE.findall(text)):
        words += found
        if ends and words:
            out += windows(words)
            words = []
    return out + windows(words) if words else out


def _plain(words: str) -> set[str]:
    return {_DRAWN.sub(r"\1", w) for w in words.split()}


class Rows:
    """Sparse binary features of stretches, row by row and column by column."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n: int, width: int):
        self.rows, self.columns, self.n, self.width = rows, columns, n, width

    def take(self, keep: np.ndarray) -> Rows:
        chosen = keep[self.rows]
        return Rows((np.cumsum(keep) - 1)[self.rows[chosen]], self.columns[chosen], int(keep.sum()), self.width)

    def without(self, drop: np.ndarray) -> Rows:
        """The same rows without some columns."""
        chosen = ~drop[self.columns]
        return Rows(self.rows[chosen], self.columns[chosen], self.n, self.width)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.columns], minlength=self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=values[self.rows], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Link:
    """One linear model of the chain: weights of features and of earlier links, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def predict(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return _sigmoid(rows.dot(self.weights) + before @ self.earlier + self.constant)


def fit_link(rows: Rows, before: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Link:
    """Logistic regression with a ridge by Adam over all rows, each with its weights of the two outcomes."""
    n, k = rows.width, before.shape[1]
    theta = np.zeros(n + k + 1)
    all_of = good + bad
    total = max(1.0, float(all_of.sum()))
    share = min(max(float(bad.sum()) / total, 1e-4), 1 - 1e-4)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        error = (all_of * _sigmoid(rows.dot(theta[:n]) + before @ theta[n : n + k] + theta[-1]) - bad) / total
        slope = np.concatenate([rows.back(error), before.T @ error, [error.sum()]]) + RIDGE * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Link(theta[:n], theta[n : n + k], float(theta[-1]))


@dataclass
class Chain:
    """What scoring needs: a number for each feature, and its weights in every link."""

    numbers: dict = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LINKS))))
    earlier: list[np.ndarray] = field(default_factory=list)
    constants: list[float] = field(default_factory=list)

    def features(self, words: list[str]) -> set[int]:
        """The known words and word pairs of a stretch."""
        get = self.numbers.get
        found = set(map(get, words))
        found.update(map(get, zip(["^", *words], words)))
        found.discard(None)
        return found

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text: the highest probability of each link over its stretches."""
        out = np.zeros((len(texts), len(LINKS)))
        if not self.constants:
            return out
        text_of, sizes, columns = [], [], []
        for at, text in enumerate(texts):
            for words in stretches(text) if text else ():
                found = self.features(words)
                if found:
                    text_of.append(at)
                    sizes.append(len(found))
                    columns.extend(found)
        if text_of:
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total = np.add.reduceat(self.weights[columns], starts, axis=0) + self.constants
            p = np.zeros_like(total)
            for k in range(len(LINKS)):
                p[:, k] = _sigmoid(total[:, k] + p[:, :k] @ self.earlier[k])
            np.maximum.at(out, text_of, p)
        return out


def _features(words: tuple[str, ...]) -> set:
    return set(words) | set(zip(("^", *words), words))


def fit_chain(texts: list[str], unsafe: list[bool]) -> Chain:
    """The chain from labelled texts; an empty one if a kind of label is missing."""
    if len(set(unsafe)) < 2:
        return Chain()
    # One row for each different stretch and fold, with the numbers of documents rated unsafe and safe that hold it.
    places: dict[tuple, int] = {}
    counts: list[list[int]] = []
    for d, (text, bad) in enumerate(zip(texts, unsafe)):
        for words in {tuple(w) for w in stretches(text)}:
            at = places.setdefault((words, d % FOLDS), len(places))
            if at == len(counts):
                counts.append([0, 0])
            counts[at][bad] += 1
    good, bad = np.array(counts, dtype=float).T
    fold = np.array([f for _, f in places])
    seen: dict = {}
    for (words, _), n in zip(places, good + bad):
        for name in _features(words):
            seen[name] = seen.get(name, 0) + n
    numbers = {name: at for at, name in enumerate(n for n, c in seen.items() if c > 2)}
    pairs = [(at, numbers[name]) for at, (words, _) in enumerate(places) for name in _features(words) if name in numbers]
    rows = Rows(*np.array(pairs, dtype=np.int64).reshape(-1, 2).T, len(places), len(numbers))
    everything = np.ones(rows.n, dtype=bool)

    def out_of_fold(part: Rows, before: np.ndarray, good: np.ndarray, bad: np.ndarray, use: np.ndarray) -> np.ndarray:
        p = np.zeros(rows.n)
        for f in range(FOLDS):
            train, test = (fold != f) & use, fold == f
            p[test] = fit_link(part.take(train), before[train], good[train], bad[train]).predict(part.take(test), before[test])
        return p

    # What earns the label: first every stretch under its documents' labels, then only those that can have earned it.
    none = np.zeros((rows.n, 0))
    of: dict[tuple, list[int]] = {}
    for at, (words, _) in enumerate(places):
        of.setdefault(words, []).append(at)
    unit = np.zeros(rows.n, dtype=np.int64)
    for k, same in enumerate(of.values()):
        unit[same] = k
    common = (np.bincount(unit, good) > 0.4 * np.bincount(unit, bad))[unit]
    p = out_of_fold(rows, none, good, bad, everything)
    for keep in (0.4, 0.5):
        earned = (bad > 0) & ~common & (p >= keep)
        target = np.where(earned, HEAVY * bad, 0.0)
        safe = np.where(earned, 0.0, good)
        plain = (bad > 0) & ~earned & ((p < 0.1) | common)
        safe[plain] += bad[plain]
        use = (target + safe) > 0
        p = out_of_fold(rows, none, safe, target, use)

    before, links = _category_links(rows, places, numbers, fold, earned, out_of_fold)
    links.append(fit_link(rows.take(use), before[use], safe[use], target[use]))
    table = np.column_stack([x.weights for x in links])
    kept = np.flatnonzero(np.abs(table).max(axis=1) > 1e-3)
    renumbered = {int(at): k for k, at in enumerate(kept)}
    return Chain({name: renumbered[at] for name, at in numbers.items() if at in renumbered}, table[kept], [x.earlier for x in links], [x.constant for x in links])


def _category_links(rows: Rows, places: dict, numbers: dict, fold: np.ndarray, earned: np.ndarray, out_of_fold) -> tuple[np.ndarray, list[Link]]:
    """Out-of-fold probabilities of the categories for all rows, and their links.

    They are fitted on the stretches that earned an unsafe label and as many others, spread evenly.
    """
    others = np.flatnonzero(~earned)
    use = earned.copy()
    use[others[:: max(1, len(others) // max(1, 2 * int(earned.sum())))]] = True
    named = {c: _plain(words) for c, words in NAMES.items()}
    naming = np.zeros(rows.width, dtype=bool)
    for name, at in numbers.items():
        naming[at] = any(w in words for words in named.values() for w in (name if isinstance(name, tuple) else (name,)))
    around = rows.without(naming)
    none = np.zeros((rows.n, 0))
    has = np.array([[any(w in named[c] for w in words) for c in CATEGORIES] for words, _ in places]) & earned[:, None]
    # What surrounds the naming words tells the category of stretches without one; a naming word counts as much as a sure context.
    context = np.column_stack([out_of_fold(around, none, (earned & ~has[:, k]).astype(float), has[:, k].astype(float) * HEAVY, earned) for k in range(len(CATEGORIES))]) + has
    category = context.argmax(axis=1)
    before, links = none, []
    for k in range(len(CATEGORIES)):
        target = (earned & (category == k)).astype(float)
        links.append(fit_link(rows.take(use), before[use], 1 - target[use], target[use]))
        before = np.column_stack([before, out_of_fold(rows, before, 1 - target, target, use)])
    return before, links


def sampled_texts(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, text, unsafe)`` of the sample: different texts with a clear label, by the hash of the text itself.

    Hashes are chosen among the labels alone, so that of the texts only the sample moves.
    """
    votes = labels.where("keep_safety is not null and content_hash is not null").select(F.lower("content_hash").alias("h"), "rater", "keep_safety").distinct()
    votes = votes.groupBy("h").agg(F.avg(F.col("keep_safety").cast("double")).alias("keep")).where("keep <> 0.5").orderBy("h").limit(SAMPLE)
    texts = docs.select(F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("h")).where("text is not null")
    rated = texts.join(F.broadcast(votes), "h")  # at most SAMPLE rows
    return rated.groupBy("h").agg(F.first("text").alias("text"), (F.first("keep") < 0.5).alias("unsafe"))


_FITTED: dict[str, Chain] = {}


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Chain:
    """Fits on the bounded sample, which is the same whatever the partitioning; the same sample isn't fitted again."""
    sample = sorted((r.h, r.text, r.unsafe) for r in sampled_texts(docs, labels, text_col).collect())
    name = hashlib.sha256(repr([(h, u) for h, _, u in sample]).encode()).hexdigest()
    if name not in _FITTED:
        _FITTED.clear()
        _FITTED[name] = fit_chain([t for _, t, _ in sample], [u for _, _, u in sample])
    return _FITTED[name]


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """``(id, *extra, sexual, threat, hate, insult, unsafe)`` of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kept = [F.col(c).alias(f"mr_{k}") for k, c in enumerate((id_col, *extra))]
    rows = docs.select(*kept, F.col(text_col).alias("mr_text"))
    schema = ", ".join([*(f"`mr_{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate((id_col, *extra))), *(f"{c} double" for c in LINKS)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = shared.value
        for batch in batches:
            out = batch.drop(columns="mr_text")
            texts = batch["mr_text"].tolist()
            out[list(LINKS)] = np.concatenate([chain.score(texts[at : at + 500]) for at in range(0, len(texts), 500)] or [np.zeros((0, len(LINKS)))])
            yield out

    done = rows.mapInPandas(score, schema)
    return done.select(*(F.col(f"mr_{k}").alias(c) for k, c in enumerate((id_col, *extra))), *LINKS)


def found(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scores.where(F.col("unsafe") >= UNSAFE).select(id_col)


def rates(scores: DataFrame, source_col: str = "source") -> DataFrame:
    """``(source, n_docs, n_unsafe, unsafe_rate)``; rows without a source are one group."""
    out = scores.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.sum((F.col("unsafe") >= UNSAFE).cast("long")).alias("n_unsafe"))
    return out.withColumn("unsafe_rate", F.round(F.col("n_unsafe") / F.col("n_docs"), 6))


def held_against(scores: DataFrame, predictions: DataFrame, labels: DataFrame, configs: DataFrame, hash_col: str = "h") -> DataFrame:
    """How the scores, earlier predictions and human labels fare at each configuration's ``safety_threshold``.

    One row for each configuration with a threshold: texts with a score here, those kept by it (``1 - unsafe``
    not below the threshold), those with an earlier prediction in range (the last one counts) and kept by that, and for
    texts with a clear label how many agree with each. ``scores`` has one row for each text, or copies that are counted once.
    """
    last = F.max_by("safety", F.struct(F.col("scored_at"), F.col("ingested_at"), F.col("safety")))
    earlier = predictions.where("safety between 0 and 1").groupBy(F.lower("content_hash").alias("h")).agg(last.alias("earlier"))
    votes = labels.where("keep_safety is not null").select(F.lower("content_hash").alias("h"), "rater", "keep_safety").distinct()
    votes = votes.groupBy("h").agg(F.avg(F.col("keep_safety").cast("double")).alias("keep")).where("keep <> 0.5")
    rows = scores.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg((1 - F.max("unsafe")).alias("own"))
    rows = rows.join(earlier, "h", "left").join(votes, "h", "left").withColumn("keep", F.col("keep") > 0.5)
    # The settings are a table that the driver reads, like those of a packing.
    limits = sorted((str(r.config_id), r.t) for r in configs.where("safety_threshold is not null").select("config_id", F.col("safety_threshold").cast("double").alias("t")).distinct().collect())
    settings = F.array(*(F.struct(F.lit(name).alias("config_id"), F.lit(t).alias("threshold")) for name, t in limits)) if limits else F.array().cast("array<struct<config_id: string, threshold: double>>")
    each = rows.withColumn("setting", F.explode(settings)).select("own", "earlier", "keep", "setting.*")
    kept, before = F.col("own") >= F.col("threshold"), F.col("earlier") >= F.col("threshold")
    return each.groupBy("config_id", F.round("threshold", 6).alias("threshold")).agg(
        F.count("*").alias("n_texts"), F.count_if(kept).alias("kept"), F.count("earlier").alias("n_predicted"), F.count_if(before).alias("predicted_kept"),
        F.count("keep").alias("n_labelled"), F.count_if(kept == F.col("keep")).alias("agree"), F.count_if(before == F.col("keep")).alias("predicted_agree"))
