"""Problem 2: records that are the same but for their formatting.

Method: canonicalize characters, case, white space, punctuation and the order of fields,
hash the canonical form to 128 bits, and aggregate with map-side combining; a second,
independent hash keeps records apart whose 128 bits collide.

Canonical form of prose: NFC, case folded, only letters and digits kept; a decimal point
inside a number and a minus sign directly before one stay, and two numbers side by side
stay apart. A record with fields, as JSON or as names with values, becomes the sorted list of
its fields; lists keep their order. Null and blank texts are in no group; texts of marks only
are compared as they stand.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .glyphs import SHAPELESS

_TOKEN = re.compile(r"(?<![^\W_])-?\d+(?:\.\d+)*|\d+(?:\.\d+)*|[^\W\d_]+")
_FIELD = re.compile(r"(?:(?<=^)|(?<=[\s|;,&]))([^\W\d]\w*)\s*[:=](?=\s|\S)")
_JSON = re.compile(r'\s*([{}\[\],:]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)', re.S)


class _Shapeless(dict):
    def __missing__(self, code: int) -> int | None:
        char = chr(code)
        gone = (unicodedata.category(char) in ("Cf", "Cc") and not char.isspace()) or any(a <= code <= b for a, b in SHAPELESS)
        self[code] = None if gone else 0x2D if code == 0x2212 else code
        return self[code]


_SHAPELESS = _Shapeless()


def canonical_text(text: str) -> str:
    """Letters and digits of ``text`` in order, case folded; '' if it has none."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(_SHAPELESS)).casefold())
    else:
        text = text.lower()
    out: list[str] = []
    number = False
    for token in _TOKEN.findall(text):
        if number and token[0].isdigit():
            out.append(" ")
        out.append(token)
        number = token[-1].isdigit()
    return "".join(out)


def _parse(text: str):
    """A value from JSON whose case or spacing was changed: objects as lists of pairs. None if it isn't JSON."""
    tokens = _JSON.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text) and re.sub(r"\s+", "", "".join(tokens)) != re.sub(r"\s+", "", text):
        return None
    at, stack, root = 0, [], None
    key, done = None, False
    for at, token in enumerate(tokens):
        if done:
            return None
        if token in "{[":
            stack.append((token, [], key))
            key = None
        elif token in "}]":
            if not stack or (stack[-1][0] == "{") != (token == "}"):
                return None
            kind, value, own = stack.pop()
            node = (kind, value)
            if not stack:
                root, done = node, True
            else:
                stack[-1][1].append((own, node) if stack[-1][0] == "{" else node)
            key = None
        elif token == ",":
            key = None
        elif token == ":":
            continue
        else:
            if not stack:
                return None
            if token[0] == '"':
                try:
                    token = json.loads(token, strict=False)
                except ValueError:
                    token = token[1:-1]
            if stack[-1][0] == "[":
                stack[-1][1].append(token)
            elif key is None:
                key = token
            else:
                stack[-1][1].append((key, token))
                key = None
    return root if done else None


def _flat(node) -> str:
    if isinstance(node, str):
        return canonical_text(node)
    kind, value = node
    if kind == "[":
        return "[" + "\x1d".join(_flat(v) for v in value) + "]"
    return "{" + "\x1e".join(sorted(f"{canonical_text(k)}\x1f{_flat(v)}" for k, v in value)) + "}"


def canonical_record(text: str) -> str | None:
    """The sorted fields of a record written with fields, None for other texts."""
    begin, end = text.find("{"), text.rfind("}")
    if 0 <= begin < 12 and end > len(text) - 12 and not canonical_text(text[:begin] + " " + text[end + 1 :]):
        node = _parse(text[begin : end + 1])
        if node is not None and node[1]:
            return _flat(node)
    if ":" not in text and "=" not in text:
        return None
    body = text.lstrip(" \t\r\n﻿​\xa0-*•#>\"'([")
    starts = list(_FIELD.finditer(body))
    if len(starts) < 2 or starts[0].start() > 0:
        return None
    names = [m.group(1).casefold() for m in starts]
    if len(set(names)) < 2 or 2 * len(set(names)) < len(names) + 1:
        return None
    fields = []
    for m, after in zip(starts, [*starts[1:], None]):
        value = body[m.end() : after.start() if after else len(body)].strip()
        node = _parse(value.rstrip(" \t\r\n|;,.&")) if value[:1] in ("{", "[") else None
        fields.append(f"{canonical_text(m.group(1))}\x1f{_flat(node) if node is not None else canonical_text(value)}")
    return "{" + "\x1e".join(sorted(fields)) + "}"


def canonical(text: str) -> str:
    return canonical_record(text) or canonical_text(text) or " ".join(text.split())


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, check)`` of each row with a text that isn't blank: 128-bit hash of the canonical form and 64 bits of another."""

    @F.pandas_udf(T.StructType([T.StructField("h", T.BinaryType()), T.StructField("check", T.LongType())]))
    def hashed(texts: pd.Series) -> pd.DataFrame:
        h, check = [], []
        for text in texts:
            raw = canonical(text).encode("utf-8", "surrogatepass")
            h.append(hashlib.blake2b(raw, digest_size=16).digest())
            check.append(int.from_bytes(hashlib.md5(raw).digest()[:8], "big", signed=True))
        return pd.DataFrame({"h": pd.Series(h, dtype=object), "check": pd.Series(check, dtype="int64")})

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    rows = rows.where(F.col("id").isNotNull() & F.col("t").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]"))
    return rows.select("id", hashed("t").alias("f")).select("id", "f.h", "f.check")


def copy_groups(prints: DataFrame) -> DataFrame:
    """``(h, check, kept_id, copies)``, one row for each record however often it is there.

    The aggregate is combined on the map side, so a group of any size sends one row from each
    task. Different canonical forms that share the 128 bits differ in ``check``; ``collisions`` lists them.
    """
    groups = prints.groupBy("h", "check").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))
    return groups


def collisions(groups: DataFrame) -> DataFrame:
    """128-bit hashes with more than one canonical form behind them; expected to be empty."""
    return groups.groupBy("h").agg(F.count("*").alias("forms")).where("forms > 1")


def collapsed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(kept_id, copies, hash128)`` of every distinct record."""
    groups = copy_groups(fingerprints(df, id_col, text_col))
    return groups.select("kept_id", "copies", F.lower(F.hex("h")).alias("hash128"))


def copy_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(kept_id, copy_id)``: the smallest id of each group with each other id of it.

    Repeated rows of one id are one record. Only groups with copies reach the join; a hot
    group is one row on its small side and is split by the adaptive skew join on the other.
    """
    prints = stage(fingerprints(df, id_col, text_col), "formatcopies")
    groups = copy_groups(prints).where("copies > 1").select("h", "check", "kept_id")
    pairs = prints.join(groups, ["h", "check"]).where(F.col("id") != F.col("kept_id"))
    return pairs.select("kept_id", F.col("id").alias("copy_id"))
