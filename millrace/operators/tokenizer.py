"""A byte-fallback BPE tokenizer: counting pairs, merging, encoding, decoding, and its files."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# Where special, byte, grid and merged ids begin.
N_SPECIAL, FIRST_BYTE, FIRST_COLOR, FIRST_MERGE, N_COLORS = 4, 4, 260, 270, 10


def byte_ids(text: Column) -> Column:
    """Ids of the UTF-8 bytes."""
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int") + FIRST_BYTE)


def pair_counts(ids: DataFrame) -> DataFrame:
    """``(left, right, n)`` of neighbouring ids over all rows of ``(ids)``; overlapping pairs count."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(F.element_at("ids", k).alias("left"), F.element_at("ids", k + 1).alias("right")))
    return ids.where(F.size("ids") > 1).select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n"))


def best_pair(counts: DataFrame):
    """The most frequent pair, of those the smallest; None if there is no pair."""
    return counts.orderBy(F.desc("n"), "left", "right").limit(1).first()


#: Pairs that a round of training looks at.
LOOKED_AT = 4_096


def independent(ranked: list[tuple[int, int, int]], whole: bool) -> list[tuple[int, int]]:
    """Of pairs ``(left, right, n)`` in the order of merging, the first ones that would be merged next in any case.

    A merge changes only counts of pairs that share an id with it, and no pair that it makes is more frequent than the
    one of these that it is made from. So the next pair in the order is safe as long as no pair that shares an
    id with the merges before it is as frequent. ``whole`` says whether the list holds every pair.
    """
    used: set[int] = set()
    chosen: list[tuple[int, int]] = []
    touched = 0  # the greatest count of a pair that shares an id with a chosen one
    for left, right, n in ranked:
        if not chosen:
            pass
        elif n <= touched or (not whole and n == ranked[-1][2]):
            break
        chosen.append((left, right))
        used |= {left, right}
        touched = next((m for x, y, m in ranked if (x, y) not in chosen and (x in used or y in used)), 0)
    return chosen


def merged(ids: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """Each pair, from the left and without overlap, as the new id."""
    at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
    if left == right and len(at):
        # In a run of overlapping pairs, every other one counts.
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, place))
        at = at[(place - first) % 2 == 0]
    out = ids.copy()
    out[at] = new
    return np.delete(out, at + 1)


#: Texts of a batch that are joined to one array.
TEXTS = 200


def _flat(lists: pd.Series) -> np.ndarray:
    """The lists in one array, with -1 after each."""
    return np.concatenate([x for ids in lists for x in (np.asarray(ids, dtype=np.int64), np.array([-1]))])


def train(docs: DataFrame, vocab_size: int, text_col: str = "text", every: int = 8) -> list[tuple[int, int]]:
    """Merges until the vocabulary is full or no pair is left; one aggregate over the corpus for each round of independent merges.

    A round takes all merges that are certain from one count of the pairs, see ``independent``, so there are fewer rounds than
    merges, the more so the larger the vocabulary is. Each round's corpus is written to the shared folder after ``every``
    merges, so the lineage stays short. Different texts are merged once and weigh as often as they are there.
    """
    corpus = docs.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("t")).agg(F.count("*").alias("times"))
    merges: list[tuple[int, int]] = []
    pending: list[tuple[int, int, int]] = []

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.iloc[at : at + TEXTS]
                ids = [np.frombuffer(t.encode(), dtype=np.uint8).astype(np.int32) + FIRST_BYTE for t in batch["t"]]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object, index=batch.index), "times": batch["times"]})

    def applied(batches: Iterator[pd.DataFrame], steps: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, pd.Series]]:
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.iloc[at : at + TEXTS]
                flat = _flat(batch["ids"])
                for step in steps:
                    flat = merged(flat, *step)
                yield flat, batch["times"]

    def keep(steps: list[tuple[int, int, int]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for flat, times in applied(batches, steps):
                ids = [x[:-1].astype(np.int32) for x in np.split(flat, np.flatnonzero(flat == -1) + 1)[:-1]]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object, index=times.index), "times": times})

        return corpus.mapInPandas(run, "ids array<int>, times long")

    def counts(steps: list[tuple[int, int, int]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for flat, times in applied(batches, steps):
                text = np.cumsum(flat == -1)
                inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
                pairs, which = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
                n = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(n, which, times.to_numpy()[text[:-1][inside]])
                yield pd.DataFrame({"left": pairs >> 32, "right": pairs & 0xFFFFFFFF, "n": n})

        return corpus.mapInPandas(run, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))

    corpus = stage(corpus.mapInPandas(first, "ids array<int>, times long"), "bpe")
    while FIRST_MERGE + len(merges) < vocab_size:
        top = counts(pending).orderBy(F.desc("n"), "left", "right").limit(LOOKED_AT).collect()
        if not top:
            break
        for pair in independent([(r.left, r.right, r.n) for r in top], len(top) < LOOKED_AT)[: vocab_size - FIRST_MERGE - len(merges)]:
            pending.append((*pair, FIRST_MERGE + len(merges)))
            merges.append(pair)
        if len(pending) >= every:
            corpus, pending = stage(keep(pending), "bpe"), []
    return merges


class Bpe:
    """Encoding and decoding with a list of merges."""

    def __init__(self, merges: list[tuple[int, int]], frozen_at: str | None = None):
        self.merges = [tuple(m) for m in merges]
        self.ranks = {m: k for k, m in enumerate(self.merges)}
        self.frozen_at = frozen_at
        self.spelled = {FIRST_BYTE + b: bytes([b]) for b in range(256)}
        for k, (left, right) in enumerate(self.merges):
            self.spelled[FIRST_MERGE + k] = self.spelled[left] + self.spelled[right]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The lowest-ranked, leftmost pair is merged until none is left; a queue of (rank, position) makes it n log n."""
        ids = [FIRST_BYTE + b for b in data]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        queue = [(self.ranks[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            rank, k, pair = heapq.heappop(queue)
            nxt = after[k]
            if ids[k] is None or nxt < 0 or (ids[k], ids[nxt]) != pair:
                continue
            ids[k], ids[nxt] = FIRST_MERGE + rank, None
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.ranks:
                    heapq.heappush(queue, (self.ranks[ids[a], ids[b]], a, (ids[a], ids[b])))
        return [i for i in ids if i is not None]

    def encode(self, text: str) -> list[int]:
        return self.encode_bytes(text.encode())

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Special and grid ids have no bytes and raise."""
        try:
            return b"".join(self.spelled[i] for i in ids)
        except KeyError as missing:
            raise ValueError(f"id {missing} has no bytes") from None

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()

    def encode_grid(self, cells: list[int]) -> list[int]:
        if any(not 0 <= c < N_COLORS for c in cells):
            raise ValueError("a color is out of range")
        return [FIRST_COLOR + c for c in cells]

    def freeze(self, at: str) -> Bpe:
        """Again at the same time is fine, at another one it raises."""
        if self.frozen_at not in (None, at):
            raise ValueError("the tokenizer is frozen")
        self.frozen_at = at
        return self

    def save(self, folder: str) -> str:
        """Lines of bytes, colors and merges with a header at the end, and a pointer with their hash."""
        os.makedirs(folder, exist_ok=True)
        lines = [{"kind": "special", "id": k} for k in range(N_SPECIAL)]
        lines += [{"kind": "byte", "id": FIRST_BYTE + b, "byte": b} for b in range(256)]
        lines += [{"kind": "color", "id": FIRST_COLOR + c} for c in range(N_COLORS)]
        lines += [{"kind": "merge", "id": FIRST_MERGE + k, "left": a, "right": b} for k, (a, b) in enumerate(self.merges)]
        lines += [{"kind": "header", "size": FIRST_MERGE + len(self.merges), "frozen_at": self.frozen_at}]
        body = "".join(json.dumps(x, sort_keys=True) + "\n" for x in lines)
        digest = hashlib.sha256(body.encode()).hexdigest()
        for name, content in (("vocab.jsonl", body), ("tokenizer.json", json.dumps({"vocab_hash": digest, "vocab_size": FIRST_MERGE + len(self.merges)}))):
            with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
                out.write(content)
        return digest

    @classmethod
    def load(cls, folder: str) -> Bpe:
        with open(os.path.join(folder, "vocab.jsonl"), encoding="utf-8") as lines:
            body = lines.read()
        with open(os.path.join(folder, "tokenizer.json"), encoding="utf-8") as pointer:
            if json.load(pointer)["vocab_hash"] != hashlib.sha256(body.encode()).hexdigest():
                raise ValueError("the vocabulary doesn't match its hash")
        rows = [json.loads(x) for x in body.splitlines()]
        if not rows or rows[-1]["kind"] != "header":
            raise ValueError("the vocabulary has no header at its end")
        return cls([(r["left"], r["right"]) for r in rows if r["kind"] == "merge"], rows[-1]["frozen_at"])


def encode_column(bpe: Bpe, text: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.array(bpe.encode(t), dtype=np.int32) for t in texts], dtype=object)

    return encode(F.col(text))


def decode_column(bpe: Bpe, ids: str) -> Column:
    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bpe.decode(x.tolist()) for x in lists], dtype=object)

    return decode(F.col(ids))


def grid_ids(grid: Column) -> Column:
    """Cells row by row as ids of colors."""
    return F.transform(F.flatten(grid), lambda c: c.cast("int") + FIRST_COLOR)
