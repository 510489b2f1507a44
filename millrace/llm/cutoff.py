"""Problem 7: texts that were cut before their end.

Method: near copies are found by min-hash banding over five-word shingles. A text that was cut is
the beginning of its copy, however much is gone, so texts are compared by their beginnings:
each open-ended text has its bands over the longest beginning of a fixed series of lengths that it
fills, every text over all those beginnings. A bucket is a band together with the four words before
the last one of the open-ended text, which a copy must hold about where the other stops. A pair that shares a bucket is verified, ``SIMILARITY``
of the shorter text's shingles being in the other, and aligned; the text is cut where the
alignment ends inside a word or sentence of the copy. Texts without such a copy are scored by the
terminality of their closing words: how often the last words, in the
context of the one or two before them, end a sentence or line elsewhere, against how often
the sentence, or a longer word that begins the same way, goes on. A text that holds one JSON value
is cut exactly if that value is left open.

A sign of omission or a broken character at the end is taken off first; what stands before it
decides. Null and blank texts are never cut. Identical texts are judged once and share the
verdict; all counts are over the different texts, without a text's own ending.

Closing words are read first, from the ends of the texts. One pass over the whole texts then
counts only words and contexts that close some text, and gives only those buckets that some
open-ended text has; both are known by Bloom filters that grow with what they hold, up to ``MOST`` bits.
Only buckets that both sides have and texts that stand in some pair are shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_dropped, stage

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows: a pair at a similarity of 0.8 shares a band with a probability of 0.998.
BANDS, ROWS = 16, 5
#: Lengths in words of the beginnings that are compared: the first, and by how much each is longer than the one before.
FIRST, GROWTH = 12, 1.25
#: Where the closing words of an open-ended text may stand in its copy, as shares of the beginning's length.
AROUND = (0.75, 1.6)
#: Largest share of endings for which a closing word still counts as unfinished.
TERMINALITY = 0.2
#: Texts up to this length without any sentence are titles.
TITLE = 60
#: Texts of a bucket that meet in one step of the join.
BLOCK = 2_000
#: Counts a task holds before it adds them up.
HELD = 1_500_000
#: Bits of a filter for each key, of which about one other key in a hundred passes, and the fewest and most bits; past the most, more pass.
KEY_BITS, FEWEST, MOST = 12, 1 << 16, 1 << 29

# Signs put after a cut.
_INVITES = ("read more", "see more", "weiterlesen", "lire la suite", "leer más")
_OMISSION = re.compile(r"(?:\s|[\x00-\x08\x0b-\x1f\x7f-\x9f�​﻿]|\.\.\.+|…|[\[(<{]\s*(?:\.\.\.+|…|more|cont(?:inued|\.)?|truncated|cut|snip|suite|mehr|más|weiter|gekürzt|continúa|tronqué|read more)\s*[\])>}]|\b(?:" + "|".join(_INVITES) + r")\b)+$", re.I)
_BROKEN = re.compile(r"�|\.\.\.|…|[\[(<{]\s*\w*\s*[\])>}]$")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: Words and numbers, each with the end of the sentence or line after it.
_PIECE = re.compile(r"(?:\d+(?:[.,]\d+)+\w*|\w+)(?:[^\w.!?\n]*(?:[.!?]+[\"'”’»)\]*_]*(?=\s|$)|\n))?")
_BARE = re.compile(r"\d+(?:[.,]\d+)+\w*|\w+")
_LAST = re.compile(r"[^\W_][\w]*$")


def core(text: str) -> tuple[str, bool]:
    """The text without outer space and signs of omission, and whether there was such a sign."""
    end = text[-1:]
    if end.isalnum() and not text[-20:].lower().endswith(_INVITES) or end in ("!", "?", '"', "'") or end == "." and text[-2:] != "..":
        return text, False
    width = 160
    while True:
        found = _OMISSION.search(text[-width:])
        if not found:
            return text, False
        if found.start() or width >= len(text):
            break
        width *= 8
    at = max(0, len(text) - width) + found.start()
    return text[:at], bool(_BROKEN.search(found.group()))


class _Words(dict):
    """A piece to its word, the word's hash, the hash as it is written and whether a sentence or line ends with it; a cache only.

    Numbers are made alike, and so are names: words with digits, and unbroken strings of more than 40 characters.
    """

    def __missing__(self, piece: str) -> tuple[str, int, int, bool]:
        bare = _BARE.match(piece).group()
        word = _NUMBER.sub("0", bare)
        word = "#" if len(word) > 40 or "0" in word and word != "0" and any(c.isalpha() for c in word) else word
        out = word, xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(bare), len(bare) < len(piece)
        if len(self) < 500_000:
            self[piece] = out
        return out


_WORDS = _Words()


def read(text: str) -> list[tuple[str, int, int, bool]]:
    """Words of the text in lower case, with their hashes and whether a sentence or line ends with each."""
    return list(map(_WORDS.__getitem__, _PIECE.findall(text.lower())))


def json_open(text: str) -> bool | None:
    """True if the text is one JSON value left open, False if it is closed, None if it is no JSON."""
    body = text.lstrip()
    if not re.match(r'\{\s*(?:"|$|\})|\[\s*(?:[\[{"\d\-\]]|$)', body):
        return None
    depth, quoted, escaped = 0, False, False
    for c in re.findall(r'[{}\[\]"]|\\.', body):
        if c[0] == "\\":
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if c in "{[" else -1
    return quoted or depth > 0


def in_list(body: str) -> bool:
    """Whether the last line stands for itself: an item, a turn of a chat, a reference or a signature."""
    lines = body.rstrip().rsplit("\n", 2)
    if len(lines) < 2:
        return False
    last, before = lines[-1].strip(), lines[-2].strip()
    if re.match(r"(?:[-*•+>#|]|--|\d+[.)])\s", last) or re.match(r"[a-zà-ÿ]\w*: ", last):
        return True
    if re.match(r"[A-Z]\w*(?: \w+)?: ", last) and len(last.split(": ", 1)[1].split()) <= 2:
        return True
    return bool(before) and len(before.split()) <= 3 and len(last.split()) <= 4 and before[-1] not in ".!?:;,"


def ending(text: str) -> tuple[str, list[tuple[str, int, int, bool]]]:
    """The verdict and, if words must decide, the last five words.

    The verdict is json or mark for a text that is cut at an open JSON value or at a mark no sentence ends in, whole,
    or how the words must decide: open, decimal after a number with a point,
    line if the last line stands for itself and only a broken word counts.
    """
    body, marked = core(text)
    if not body:
        return "whole", []
    state = json_open(body)
    if state is not None:
        return ("json" if state else "whole"), []
    end = body[-1]
    if end in ",;([{":
        # A sentence can't end in these; lines of code, tables and formulas can.
        return ("mark" if re.search(r"[^\W\d_]{2,} [^\W\d_]+[,;(]$", body[-80:]) else "whole"), []
    decimal = end == "." and re.search(r"(?<![\w.])\d{1,2}\.$", body[-8:]) is not None
    if not decimal and not (end.isalnum() or end == "_" and _LAST.search(body[-400:])):
        return "whole", []
    words = read(body[-400:])
    if len(body) > 400:
        words = words[1:]
    if not words:
        return "whole", []
    if len(body) <= TITLE and not any(w[3] for w in words[:-1]) and not marked:
        return "whole", []
    return "decimal" if decimal else "line" if in_list(body) else "open", words[-5:]


#: Multipliers of the polynomial hashes, and one number for each kind of key.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_KINDS = {kind: np.uint64(xxhash.xxh64_intdigest(kind)) for kind in "5321pqctn"}
_START = np.uint64(xxhash.xxh64_intdigest("^"))


def key(kind: str, *words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words in a row, of its own for each kind."""
    out = np.full(words[0].shape, _KINDS[kind])
    for w in words:
        out = (out ^ w) * _P
        out ^= out >> np.uint64(32)
    return out * _Q


_A, _B = (np.random.RandomState(20240607 + k).randint(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for k in range(2))


def _lengths(n: int) -> list[int]:
    """The lengths of the beginnings that a text of n words fills."""
    out, size = [], float(FIRST)
    while int(size) <= n:
        out.append(int(size))
        size *= GROWTH
    return out


def shingle_hashes(words: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """The hash of each five-word shingle, in order."""
    ids = np.array([w[2] for w in words], dtype=np.uint64)
    if len(ids) < SHINGLE:
        return ids[:0]
    out = np.zeros(len(ids) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * _P + ids[k : len(ids) - SHINGLE + 1 + k]
    return (out ^ (out >> np.uint64(31))) * _Q


def band_keys(shingles: np.ndarray, lengths: list[int]) -> np.ndarray:
    """64-bit keys of the bands over each beginning: a row for each length, a column for each band."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    stops = [n - SHINGLE + 1 for n in lengths]
    rows = np.full((len(lengths), BANDS * ROWS), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, stops[-1], 4096):  # a long text is taken in parts
        part = short[at : min(at + 4096, stops[-1]), None] * _A + _B
        starts = [0, *(x - at for x in stops if at < x < at + len(part))]
        lows, first = np.minimum.reduceat(part, starts, axis=0), sum(x <= at for x in stops)
        np.minimum(rows[first : first + len(lows)], lows, out=rows[first : first + len(lows)])
    rows = np.minimum.accumulate(rows, axis=0)
    bands = rows.astype(np.uint64).reshape(len(lengths), BANDS, ROWS)
    out = np.full((len(lengths), BANDS), _Q) + np.arange(BANDS, dtype=np.uint64) * _P + np.array(lengths, dtype=np.uint64)[:, None]
    for k in range(ROWS):
        out = (out ^ bands[:, :, k]) * _P
        out ^= out >> np.uint64(32)
    return out


def context_keys(words: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """The hash of each four words in a row, in order."""
    ids = np.array([w[2] for w in words], dtype=np.uint64)
    return key("c", *(ids[k : len(ids) - SHINGLE + 2 + k] for k in range(SHINGLE - 1))) if len(ids) >= SHINGLE - 1 else ids[:0]


def place_keys(contexts: np.ndarray, length: int) -> np.ndarray:
    """Contexts together with the length of a beginning, whatever its words."""
    return key("n", contexts, np.full(len(contexts), np.uint64(length)))


def bucket_keys(bands: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return key("t", bands, contexts)


def ends_early(text: str, copy: str) -> bool | None:
    """Whether ``text`` stops inside a word or sentence of a copy that holds its shingles; None if they can't be aligned or both stop at the same open word."""
    mine, other = read(core(text)[0]), read(copy)
    a, b = np.unique(shingle_hashes(mine)), np.unique(shingle_hashes(other))
    if len(a) < 1 or np.isin(a, b).sum() < SIMILARITY * len(a):
        return None
    left, right = [w[0] for w in mine], [w[0] for w in other]
    last, tail = left[-1], left[-SHINGLE:-1]
    places = [k for k in range(len(right) - len(tail)) if right[k] == tail[0] and right[k : k + len(tail)] == tail]
    if not places:
        return None
    at = min(places, key=lambda k: abs(k + len(tail) - len(left) + 1)) + len(tail)
    if right[at] != last:
        return True if right[at].startswith(last) else None
    if at + 1 == len(right) and not other[at][3]:
        return None
    return not other[at][3]


class Filter:
    """Which 64-bit keys may be among a set: four bits for each key, in one word of a table sized by the number of keys."""

    _SHIFTS = (40, 46, 52, 58)

    def __init__(self, keys: DataFrame):
        """``keys`` has one column; its bits are set by an aggregate, so the driver gets at most the table."""
        name = keys.columns[0]
        self.bits = min(MOST, max(FEWEST, 1 << (KEY_BITS * keys.count()).bit_length()))
        slots = (F.shiftrightunsigned(name, k).bitwiseAND(F.lit(63)).cast("int") for k in self._SHIFTS)
        bits = functools.reduce(lambda x, y: x.bitwiseOR(y), (F.call_function("shiftleft", F.lit(1).cast("long"), k) for k in slots))
        rows = keys.select(F.col(name).bitwiseAND(F.lit(self.bits // 64 - 1)).alias("at"), bits.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
        self.table = np.zeros(self.bits // 64, dtype=np.uint64)
        with shuffles_dropped(keys.sparkSession):
            found = rows.toArrow()
        self.table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(keys.shape, dtype=np.uint64)
        for k in self._SHIFTS:
            bits |= np.uint64(1) << ((keys >> np.uint64(k)) & np.uint64(63))
        return self.table[(keys & np.uint64(len(self.table) - 1)).astype(np.int64)] & bits == bits


def different_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(h, text)``: each different text that isn't blank, once."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]"))
    return rows.groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"))


class Counts:
    """Counts, by key, of words that go on, end a sentence or line, or end a text; for closing words of some text alone."""

    def __init__(self, closing: Filter):
        self.closing, self.held, self.longer, self.size = closing, [], [], 0
        self.words: dict[str, np.ndarray] = {}
        self.begin: dict[str, np.ndarray] = {}

    def _begun(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the proper beginnings of the words that close some text, one word after the other, and how many each has."""
        out = []
        for word in words:
            known = self.begin.get(word)
            if known is None:
                known = np.array([xxhash.xxh64_intdigest(word[:k]) for k in range(1, len(word))], dtype=np.uint64)
                known = known[self.closing.has(key("1", known))]
                if len(self.begin) < 500_000:  # a cache only
                    self.begin[word] = known
            out.append(known)
        return np.concatenate([*out, np.zeros(0, dtype=np.uint64)]), np.array([len(x) for x in out], dtype=np.int64)

    def _hold(self, keys: np.ndarray, kind: np.ndarray) -> None:
        self.held.append((keys, kind))
        self.size += len(keys)

    def add(self, texts: list[list[tuple[str, int, int, bool]]]) -> None:
        """Counts the words of some texts, each with its context in its own text."""
        numbers: dict[str, int] = {}
        ids = np.array([numbers.setdefault(w[0], len(numbers)) for words in texts for w in words], dtype=np.int64)
        if not len(ids):
            return
        # 0: the sentence goes on, 1: it ends, 2: the text ends.
        kind = np.array([w[3] for words in texts for w in words], dtype=np.int8)
        sizes = np.array([len(words) for words in texts])
        n, place = len(ids), np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = (np.cumsum(sizes) - 1)[sizes > 0]
        kind[last] = np.where(kind[last] == 0, 2, kind[last])
        for word, row in zip(numbers, np.bincount(ids * 3 + kind, minlength=3 * len(numbers)).reshape(-1, 3)):
            known = self.words.get(word)
            self.words[word] = row if known is None else known + row
        names = list(numbers)
        own = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
        c = own[ids]
        before = []
        for back in range(1, 5):
            moved = np.full(n, _START)
            moved[back:] = c[:-back] if back < n else c[:0]
            moved[place < back] = _START
            before.append(moved)
        b, a, z, y = before
        pair = key("2", b, c)
        some = self.closing.has(pair)
        self._hold(pair[some], kind[some])
        # Longer contexts of closing words, where they close some text themselves.
        at = np.flatnonzero(some)
        three = key("3", a[at], b[at], c[at])
        some = self.closing.has(three)
        self._hold(three[some], kind[at[some]])
        at = at[some & (kind[at] < 2)]
        five = key("5", y[at], z[at], a[at], b[at], c[at])
        some = self.closing.has(five)
        self._hold(five[some], kind[at[some]])
        # Words that begin as a closing word does, after the same word; each different pair of words once.
        first = np.where(place == 0, len(names), np.roll(ids, 1))
        pairs, times = np.unique(first[kind < 2] * len(names) + ids[kind < 2], return_counts=True)
        flat, many = self._begun(names)
        b, second = np.append(own, _START)[pairs // len(names)], pairs % len(names)
        each = many[second]
        at = np.repeat((np.cumsum(many) - many)[second] - np.cumsum(each) + each, each) + np.arange(each.sum())
        begun = key("p", np.repeat(b, each), flat[at])
        some = self.closing.has(begun)
        self.longer.append((begun[some], np.repeat(times, each)[some]))
        self.size += int(some.sum())

    @property
    def full(self) -> bool:
        return self.size > HELD or len(self.words) > HELD

    def sums(self) -> pd.DataFrame:
        """``(k, mid, term, fin)`` of what is held, which is then let go; of words alone and of those that begin longer ones, too."""
        kinds = np.array([self.words[w] for w in self.words], dtype=np.int64).reshape(-1, 3)
        one = key("1", np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64))
        begun, many = self._begun(list(self.words))
        some = self.closing.has(one)
        self.longer.append((key("q", begun), np.repeat(kinds[:, 0] + kinds[:, 1], many)))
        kind, times = np.concatenate([np.zeros(0, dtype=np.int8), *(x[1] for x in self.held)]), np.concatenate([x[1] for x in self.longer])
        keys = np.concatenate([x[0] for x in self.held] + [one[some]] + [x[0] for x in self.longer])
        self.held, self.longer, self.size, self.words = [], [], 0, {}
        keys, at = np.unique(keys, return_inverse=True)
        short, alone, longer = np.split(at, [len(kind), len(kind) + int(some.sum())])
        sums = {}
        for k, name in enumerate(("mid", "term", "fin")):
            sums[name] = np.bincount(short[kind == k], minlength=len(keys))
            sums[name] += np.bincount(alone, kinds[some, k], minlength=len(keys)).astype(np.int64)
        sums["mid"] += np.bincount(longer, times, minlength=len(keys)).astype(np.int64)
        return pd.DataFrame({"k": keys.view(np.int64), **sums})


def closing_scores(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """``ends`` with ``terminality``, the share of endings among what follows the closing words, and ``broken``.

    Four words of context are taken where they occur inside other texts, else two, one or none.
    If even with one word of context the last word never occurs, longer words that begin like it
    count as going on. ``broken`` is true if only such longer words are known. Null if nothing is known.
    """
    hits = ends.select("h", F.explode("keys").alias("key")).select("h", "key.kind", "key.k").join(counts, "k")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, F.col(x)).otherwise(0)).alias(f"{x}{kind}")
    wide = hits.groupBy("h").agg(*(of(kind, x) for kind in "5321" for x in ("mid", "term", "fin")), of("p", "mid"), of("q", "mid"))
    wide = ends.join(wide, "h", "left")
    inside = lambda kind: F.col(f"term{kind}") + F.col(f"mid{kind}")
    share = lambda kind: F.when(inside(kind) > 0, F.col(f"term{kind}") / inside(kind))
    others = lambda kind: F.col(f"fin{kind}") - 1
    alike = lambda kind, longer: F.when((others(kind) > 0) | (F.col(longer) > 0), others(kind) / (others(kind) + F.col(longer)))
    score = F.coalesce(share("5"), share("3"), F.when(others("3") > 0, alike("3", "midp")))
    score = F.when(score.isNotNull(), score).when(~F.col("named"), F.coalesce(share("2"), alike("2", "midp"), share("1"), alike("1", "midq")))
    broken = ((inside("2") == 0) & (F.col("midp") > others("2"))) | ((inside("1") == 0) & (F.col("midq") > others("1")))
    return wide.select(*ends.columns, score.alias("terminality"), F.coalesce(broken & ~F.col("named"), F.lit(False)).alias("broken"))


def near_copies(asked: DataFrame, given: DataFrame) -> DataFrame:
    """``(h, copy)``: each open-ended text with every other text that it shares a bucket with.

    ``asked`` and ``given`` are ``(h, key)``, the buckets of open-ended texts and of all texts. Buckets are
    joined in blocks, so that a step of the join holds about ``BLOCK`` texts of either side whatever the size of the bucket.
    """
    blocks = F.ceil(F.count("*") / BLOCK)
    asked = asked.join(given.groupBy("key").agg(blocks.alias("ms")), "key")
    sizes = asked.groupBy("key", "ms").agg(blocks.alias("os"))
    own = lambda parts: F.pmod(F.xxhash64("h"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    ours = asked.drop("ms").join(sizes, "key").select("key", "h", own("os").alias("i"), every("ms").alias("j"))
    others = given.join(sizes, "key").select("key", F.col("h").alias("copy"), every("os").alias("i"), own("ms").alias("j"))
    return ours.join(others, ["key", "i", "j"]).where("h <> copy").select("h", "copy").distinct()


_UNDECIDED = ("open", "line", "decimal")


def _closings(texts: DataFrame) -> DataFrame:
    """``(h, verdict, named, keys, bands, places, buckets)`` of texts that aren't whole: keys of the closing words, bands, place and buckets of open-ended ones."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, text in zip(batch["h"], batch["text"]):
                verdict, closing = ending(text)
                if verdict not in _UNDECIDED:
                    if verdict != "whole":
                        out.append((h, verdict, False, [], [], [], []))
                    continue
                ids = [_START] * (5 - len(closing)) + [np.uint64(w[1]) for w in closing]
                words = [np.array([x], dtype=np.uint64) for x in ids]
                keys = [(kind, int(key(kind, *words[-size:]).view(np.int64)[0])) for kind, size in (("5", 5), ("3", 3), ("2", 2), ("1", 1), ("p", 2), ("q", 1))]
                whole = read(core(text)[0])
                lengths = _lengths(len(whole))[-1:]
                bands = band_keys(shingle_hashes(whole), lengths).ravel() if lengths else np.zeros(0, dtype=np.uint64)
                places = place_keys(context_keys(whole)[-2:-1], lengths[0]) if lengths else bands
                buckets = bucket_keys(bands, np.repeat(context_keys(whole)[-2], len(bands))) if lengths else bands
                # The second half meets texts whose own last word begins with this one.
                buckets = np.concatenate([buckets, bucket_keys(buckets, np.full(len(buckets), np.uint64(whole[-1][1])))]) if lengths else bands
                out.append((h, verdict, closing[-1][0] == "#", keys, bands.view(np.int64).tolist(), places.view(np.int64).tolist(), buckets.view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["h", "verdict", "named", "keys", "bands", "places", "buckets"])

    return texts.mapInPandas(look, "h string, verdict string, named boolean, keys array<struct<kind: string, k: long>>, bands array<long>, places array<long>, buckets array<long>")


def _given_buckets(words: list[tuple[str, int, int, bool]], bands: np.ndarray, passed: np.ndarray, places: Filter) -> np.ndarray:
    """Buckets of a text: each of its bands that passed, with the words that stand about where that beginning ends and before an open end of some text of that length.

    The words before its own last one, if no sentence ends there, count only for texts that stop inside that last
    word: two texts that stop at the same open word say nothing about each other.
    """
    contexts = context_keys(words)[:-1]
    last = len(contexts) - (not words[-1][3])
    begun = np.array([xxhash.xxh64_intdigest(words[-1][0][:k]) for k in range(1, len(words[-1][0]))], dtype=np.uint64)
    out = []
    for length, row, some in zip(_lengths(len(words)), bands, passed):
        if some.any():
            first, stop = max(0, int(AROUND[0] * length) - SHINGLE + 1), int(AROUND[1] * length)
            near = contexts[first : min(stop, last)]
            near = near[places.has(place_keys(near, length))]
            out.append(bucket_keys(np.repeat(row[some], len(near)), np.tile(near, int(some.sum()))))
            if first <= last < min(stop, len(contexts)) and places.has(place_keys(contexts[last : last + 1], length))[0]:
                own = bucket_keys(row[some], np.repeat(contexts[last], int(some.sum())))
                out.append(bucket_keys(np.repeat(own, len(begun)), np.tile(begun, len(own))))
    return np.concatenate(out)


def _read_whole(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """One pass over whole texts: rows ``(k, mid, term, fin)`` of counts, and rows ``(k, h)`` of buckets that some open-ended text has.

    ``shared`` are the filters of keys of closing words, bands, places and buckets.
    """

    def given(names: pd.Series, held: list) -> pd.DataFrame:
        long = [(h, words) for h, words in zip(names, held) if len(words) >= FIRST]
        found = [band_keys(shingle_hashes(words[: _lengths(len(words))[-1]]), _lengths(len(words))) for _, words in long]
        ends = np.cumsum([x.size for x in found])
        out, owners = [np.zeros(0, dtype=np.uint64)], []
        passed = np.split(shared.value[1].has(np.concatenate([x.ravel() for x in found])), ends[:-1]) if found else []
        for (h, words), own, some in zip(long, found, passed):
            if some.any():
                keys = _given_buckets(words, own, some.reshape(own.shape), shared.value[2])
                keys = np.unique(keys[shared.value[3].has(keys)])
                out.append(keys)
                owners += [h] * len(keys)
        return pd.DataFrame({"k": np.concatenate(out).view(np.int64), "mid": 0, "term": 0, "fin": 0, "h": pd.Series(owners, dtype=object)})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(shared.value[0])
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                held = [read(core(text)[0]) for text in part["text"]]
                counts.add(held)
                if counts.full:
                    yield counts.sums().assign(h=None)
                yield given(part["h"], held)
        if counts.words:
            yield counts.sums().assign(h=None)

    return texts.mapInPandas(look, "k long, mid long, term long, fin long, h string")


def _sifted(rows: DataFrame, key_col: str | Column, among: DataFrame, name: str) -> DataFrame:
    """Rows whose 64-bit key may be among the keys of another table, as a staged table."""
    shared = rows.sparkSession.sparkContext.broadcast(Filter(among))

    @F.pandas_udf("boolean")
    def known(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(keys.to_numpy(dtype=np.int64).view(np.uint64)))

    out = stage(rows.where(known(key_col)), name, lean=True)
    shared.destroy()
    return out


def cut_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(h, how)`` of each different text that is cut; how is json, mark, copy or closing."""
    texts = stage(different_texts(docs, text_col), "texts", lean=True)
    ends = stage(_closings(texts), "closings", lean=True)
    undecided = ends.where(F.col("verdict").isin(*_UNDECIDED))
    of = lambda x: Filter(undecided.select(F.explode(x)))
    shared = docs.sparkSession.sparkContext.broadcast((of(F.transform("keys", lambda x: x["k"])), of("bands"), of("places"), of("buckets")))
    whole = stage(_read_whole(texts, shared), "counts", lean=True)
    shared.destroy()
    counts = whole.where("h is null").groupBy("k").agg(*(F.sum(x).alias(x) for x in ("mid", "term", "fin")))
    # Tables of their own, so that the plan knows their sizes: where few buckets are shared, texts aren't shuffled.
    given = stage(whole.where("h is not null").select("h", F.col("k").alias("key")), "given", lean=True)
    asked = _sifted(undecided.select("h", F.explode("buckets").alias("key")), "key", given.select("key"), "asked")
    links = stage(near_copies(asked, given), "links", lean=True)
    met = _sifted(texts, F.xxhash64("h"), links.select(F.explode(F.array(F.xxhash64("h"), F.xxhash64("copy")))), "met")
    pairs = links.join(met, "h").join(met.select(F.col("h").alias("copy"), F.col("text").alias("other")), "copy")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": batch["h"], "early": pd.Series([ends_early(a, b) for a, b in zip(batch["text"], batch["other"])], dtype="boolean")})

    aligned = pairs.select("h", "text", "other").mapInPandas(align, "h string, early boolean").where("early is not null").groupBy("h").agg(F.max("early").alias("early"))
    scored = closing_scores(undecided.select("h", "verdict", "named", "keys"), counts).join(aligned, "h", "left")
    limit = F.when(F.col("verdict") == "decimal", F.lit(TERMINALITY / 2)).otherwise(F.lit(TERMINALITY))
    words = F.when(F.col("verdict") == "line", F.col("broken")).otherwise(F.col("terminality") < limit)
    cut = scored.select("h", F.when(F.col("early"), "copy").when(F.col("early").isNull() & words, "closing").alias("how")).where("how is not null")
    return cut.unionByName(ends.where(~F.col("verdict").isin(*_UNDECIDED)).select("h", F.col("verdict").alias("how")))


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, how)`` of every row whose text is cut, copies included."""
    cut = cut_texts(docs, text_col)
    rows = docs.select(F.col(id_col).alias("mr_id"), F.md5(F.col(text_col)).alias("h")).where("h is not null")
    return rows.join(cut, "h").select(F.col("mr_id").alias(id_col), "how")


def rates(docs: DataFrame, cut: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(source, n_docs, n_cut, cut_rate)``; rows without a source are one group."""
    flagged = cut.select(F.col(id_col).alias("mr_id")).distinct().withColumn("hit", F.lit(1))
    rows = docs.select(F.col(id_col).alias("mr_id"), F.col(source_col).alias("source")).join(flagged, "mr_id", "left")
    out = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_cut"))
    return out.withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_docs"), 6))
