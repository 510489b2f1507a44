"""Problem 3: passages of evaluation items inside a corpus.

Method: greedy string tiling. Seeds of ``SEED`` shared tokens join records to the items they
may hold, in a shuffle join on the seeds' hashes; for every pair that shares as many seeds as
a leak must, the longest non-overlapping matches of ``SEED`` tokens or more are marked again and
again, found by running Karp-Rabin hashes over both token sequences. A pair leaks if one tile, an unbroken run, holds ``RUN`` words of the
item, or the whole item if it has fewer. The share of the item under tiles is its coverage: a
pair without such a run that is covered at ``COVERED`` is a passage put in another order, which
isn't a case of the query ``p3_found`` but taints the item's suite like one.

Words are runs of letters and digits of the look-alike skeleton in lower case, so case,
marks, line markers, shapeless and look-alike characters don't count. Records that are JSON
are read with their escapes undone. Null and blank records leak nothing; items without
words are never found. An empty set of items raises, since a scan against nothing would
pass everything.

Items are never collected. All that is broadcast is a Bloom filter of their seeds with a
fixed number of bits, so that only records with a possible seed, and of those only the seeds
that pass, are shuffled; identical records are tiled once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .glyphs import skeleton

RUN, SEED = 12, 5
#: Share of an item's words under tiles from which a passage in another order is reported.
COVERED = 0.8
#: Bits of the seed filter and probes for each seed; more items only let more records pass.
BITS, PROBES = 1 << 25, 3
BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
# JSON's short escapes.
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}
_MARKS = re.compile("[̀-ͯ]")


def words(text: str) -> list[str]:
    """Tokens in which only the visible letters and digits count."""
    if "\\" in text and text.lstrip()[:1] in ("{", "["):
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)) if m.group(1) else _SHORT.get(m.group(2), m.group(2)), text)
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", skeleton(text)).lower())


class _Hashes(dict):
    """A word to its 64-bit hash; a cache only."""

    def __missing__(self, word: str) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = out
        return out


_HASHES = _Hashes()


def token_hashes(text: str) -> np.ndarray:
    """The 64-bit hashes of the text's words."""
    found = words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64 and mixed, of each window of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n < 1:
        return tokens[:0]
    value = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        value = value * BASE + tokens[k : k + n]
    return (value ^ (value >> np.uint64(32))) * BASE


def tiles(record: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """``(record position, item position, length)`` of greedy tiles, the longest first.

    Running hashes of the least width give the places where matches begin; each is extended
    as far as it goes. The longest match is then marked, what is left of the others after
    each marking goes back into the queue, and this ends when no match of the least length
    is free.
    """
    starts: dict[int, list[int]] = {}
    for at, h in enumerate(rolling(item, least).tolist()):
        starts.setdefault(h, []).append(at)
    found = rolling(record, least)
    places = np.flatnonzero(np.isin(found, np.array(list(starts), dtype=np.uint64)))
    queue: list[tuple[int, int, int]] = []
    n, m = len(record), len(item)
    left, right = record.tolist(), item.tolist()
    for at, h in zip(places.tolist(), found[places].tolist()):
        for start in starts[h]:
            if at and start and left[at - 1] == right[start - 1]:
                continue  # inside a match that began before
            size = 0
            while at + size < n and start + size < m and left[at + size] == right[start + size]:
                size += 1
            if size >= least:
                queue.append((-size, at, start))
    heapify(queue)
    free_r, free_i = bytearray(b"\1" * n), bytearray(b"\1" * m)
    out: list[tuple[int, int, int]] = []
    while queue:
        size, at, start = heappop(queue)
        size = -size
        both = bytes(x & y for x, y in zip(free_r[at : at + size], free_i[start : start + size]))
        if 0 not in both:
            free_r[at : at + size] = free_i[start : start + size] = bytes(size)
            out.append((at, start, size))
            continue
        begin = 0
        for part in both.split(b"\0"):
            if len(part) >= least:
                heappush(queue, (-len(part), at + begin, start + begin))
            begin += len(part) + 1
    return out


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def item_tokens(items: DataFrame) -> DataFrame:
    """``(item, suite, item_id, ids, seeds)`` of the different items that have words; ``item`` is a hash of all of it.

    ``seeds`` has one hash for each place of the item, shorter ones for an item of fewer than ``SEED`` words.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for suite, item_id, text in zip(batch["suite"], batch["item_id"], batch["t"]):
                ids = token_hashes(text)
                if len(ids):
                    name = xxhash.xxh128_hexdigest(f"{suite}\0{item_id}\0{ids.tobytes().hex()}")
                    out.append((name, suite, item_id, _signed(ids), _signed(rolling(ids, min(SEED, len(ids))))))
            yield pd.DataFrame(out, columns=["item", "suite", "item_id", "ids", "seeds"])

    rows = items.select(F.col("suite").cast("string").alias("suite"), F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("t")).where("t is not null").distinct()
    return rows.mapInPandas(read, "item string, suite string, item_id string, ids array<long>, seeds array<long>").dropDuplicates(["item"])


class SeedFilter:
    """A Bloom filter of seed hashes; its size doesn't depend on the items."""

    def __init__(self, rows: pa.Table, widths: list[int]):
        table = np.zeros(BITS // 64, dtype=np.uint64)
        table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        self.table, self.widths, self.bits = table, widths, BITS

    @staticmethod
    def slots(seed: F.Column) -> F.Column:
        """The bit numbers of a seed: different parts of its hash."""
        return F.array(*(F.shiftrightunsigned(seed, 13 * k).bitwiseAND(F.lit(BITS - 1)) for k in range(PROBES)))

    def passing(self, seeds: np.ndarray) -> np.ndarray:
        for k in range(PROBES):
            slot = (seeds >> np.uint64(13 * k)) & np.uint64(self.bits - 1)
            seeds = seeds[(self.table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
        return seeds

    def seeds_of(self, ids: np.ndarray) -> np.ndarray:
        passed = [x for x in (self.passing(rolling(ids, w)) for w in self.widths) if len(x)]
        return np.unique(np.concatenate(passed)) if passed else ids[:0]


def seed_filter(tokens: DataFrame) -> SeedFilter:
    """Bits are set by an aggregate; what reaches the driver is at most the filter itself."""
    widths = sorted(r.w for r in tokens.select(F.least(F.size("ids"), F.lit(SEED)).alias("w")).distinct().collect())
    if not widths:
        raise ValueError("no evaluation items: a scan against nothing can't clear a corpus")
    slots = tokens.select(F.explode("seeds").alias("s")).select(F.explode(SeedFilter.slots(F.col("s"))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    rows = slots.select(F.shiftright("slot", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    return SeedFilter(rows.toArrow(), widths)


def _least_seeds(n: F.Column) -> F.Column:
    """Places of an item of n words whose seeds must be in a record for a leaking run, or for coverage by tiles of ``SEED`` words."""
    run = F.least(n, F.lit(RUN)) - F.least(n, F.lit(SEED)) + 1
    return F.least(run, F.greatest(F.lit(1), F.ceil(F.lit(COVERED) * n / SEED - 1e-9)))


def scan(corpus: DataFrame, items: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, suite, item_id, item_words, longest_run, n_tiles, coverage)`` of each record and item that share as many seeds as a leak, or coverage, needs.

    A record that is there twice is reported once for each different id, a record without an id under a
    null id. Extra columns on either side don't matter.
    """
    tokens = stage(item_tokens(items), "items")
    shared = corpus.sparkSession.sparkContext.broadcast(seed_filter(tokens))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = shared.value
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["t"]):
                ids = token_hashes(t)
                seeds = keep.seeds_of(ids)
                if len(seeds):
                    out.append((i, xxhash.xxh128_hexdigest(ids.tobytes()), _signed(ids), _signed(seeds)))
            yield pd.DataFrame(out, columns=["id", "h", "ids", "seeds"])

    rows = corpus.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    hits = stage(rows.mapInPandas(look, "id string, h string, ids array<long>, seeds array<long>"), "seeds")
    records = hits.select("h", "ids", "seeds").dropDuplicates(["h"])
    ours = records.select("h", F.explode("seeds").alias("seed"))
    theirs = tokens.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").agg(F.count("*").alias("places"))
    pairs = ours.join(theirs, "seed").groupBy("h", "item").agg(F.sum("places").alias("places"))
    pairs = pairs.join(tokens.select("item", "suite", "item_id", F.col("ids").alias("item_ids")), "item").where(F.col("places") >= _least_seeds(F.size("item_ids")))
    pairs = pairs.join(records.select("h", "ids"), "h")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, suite, item_id, mine, theirs in zip(batch["h"], batch["suite"], batch["item_id"], batch["ids"], batch["item_ids"]):
                record, item = (np.asarray(x, dtype=np.int64).view(np.uint64) for x in (mine, theirs))
                marked = tiles(record, item, min(SEED, len(item)))
                if marked:
                    out.append((h, suite, item_id, len(item), max(k for _, _, k in marked), len(marked), sum(k for _, _, k in marked) / len(item)))
            yield pd.DataFrame(out, columns=["h", "suite", "item_id", "item_words", "longest_run", "n_tiles", "coverage"])

    schema = "h string, suite string, item_id string, item_words int, longest_run int, n_tiles int, coverage double"
    tiled = pairs.select("h", "suite", "item_id", "ids", "item_ids").mapInPandas(tile, schema)
    return hits.select("id", "h").distinct().join(tiled, "h").drop("h")


def leaked(hits: DataFrame) -> DataFrame:
    """Pairs whose longest run holds ``RUN`` words of the item, or all of a shorter one."""
    return hits.where(F.col("longest_run") >= F.least(F.lit(RUN), F.col("item_words"))).select("id", "suite", "item_id").distinct()


def reordered(hits: DataFrame, coverage: float = COVERED) -> DataFrame:
    """Pairs without such a run whose tiles still cover the item: passages put in another order."""
    broken = hits.where((F.col("longest_run") < F.least(F.lit(RUN), F.col("item_words"))) & (F.col("coverage") >= coverage))
    return broken.select("id", "suite", "item_id", "n_tiles", F.round("coverage", 6).alias("coverage")).distinct()


def suite_report(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite: items, items leaked whole or in part, items found in another order, records that hold either, and the status they imply."""
    total = items.where("text is not null").groupBy("suite").agg(F.countDistinct("item_id").alias("n_items"))
    both = leaked(hits).withColumn("run", F.lit(True)).unionByName(reordered(hits).select("id", "suite", "item_id").withColumn("run", F.lit(False)))
    of = lambda run: F.countDistinct(F.when(F.col("run") == run, F.col("item_id")))
    found = both.groupBy("suite").agg(of(True).alias("leaked_items"), of(False).alias("reordered_items"), F.countDistinct("id").alias("records"))
    joined = total.join(found, "suite", "left").fillna(0, ["leaked_items", "reordered_items", "records"])
    return joined.withColumn("status", F.when(F.col("records") > 0, "flagged").otherwise("clean"))


def corrected(results: DataFrame, report: DataFrame) -> DataFrame:
    """``(result_id, suite, stated, status, stated_against, against, agrees, leaked_items, reordered_items, records)`` of each different result.

    ``stated`` and ``stated_against`` are what the result says, in one spelling. ``against`` are the suites
    that the corpus was scanned for, which are those of the report, and ``status`` is that of the result's own suite;
    it is null for a suite without items, about which the scan says nothing.
    """
    spelled = lambda x: F.regexp_replace(F.lower(F.trim(x)), "[-\\s]+", "_")
    said = F.array_sort(F.array_distinct(F.transform(F.filter("decontamination.against", lambda x: x.isNotNull()), spelled)))
    rows = results.select("result_id", "suite", spelled(F.col("decontamination.status")).alias("stated"), said.alias("stated_against")).distinct()
    scanned = report.agg(F.array_sort(F.collect_set("suite")).alias("against"))  # as many as there are suites
    out = rows.join(report, "suite", "left").crossJoin(F.broadcast(scanned))
    agrees = F.coalesce((F.col("stated") == F.col("status")) & (F.col("stated_against") == F.col("against")), F.lit(False))
    return out.select("result_id", "suite", "stated", "status", "stated_against", "against", agrees.alias("agrees"), "leaked_items", "reordered_items", "records")
