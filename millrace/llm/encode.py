"""Problem 5: ids of a public byte-level BPE tokenizer for a whole corpus.

Method: a sentencepiece BPE model is serialised straight from the vocabulary. Each piece is
the byte-mapped spelling of a token, its score the negative rank, the normalisation the
identity. Texts are split by the tokenizer's public pattern, each pre-token is mapped to the
byte alphabet and encoded by the model; decoding looks the pieces up and maps them back.

Null, empty and only-marks texts: null and empty texts give the empty list, every other text,
blank ones included, gives at least one id. Surrogates that can't be UTF-8 become U+FFFD, as
in the public tokenizer.
"""

from __future__ import annotations

import base64
import os
import struct
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter, never copied into the repository.
VOCABULARIES = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest pre-token kept in the cache, and how many are kept; neither changes a result.
CACHED_LENGTH, CACHED = 48, 200_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; one unknown piece follows the last."""
    letters = byte_alphabet()
    model = bytearray()
    for at, (token, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if rank != at:
            raise ValueError(f"ranks must be 0..n-1; {at} is missing")
        spelled = "".join(letters[b] for b in token).encode()
        model += _field(1, _field(1, spelled) + _field(2, float(-rank)) + _field(3, 1))
    model += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(ranks)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(model + _field(2, trainer) + _field(3, normalizer))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceTokenizer:
    """Byte-level BPE carried by a serialised sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        letters = byte_alphabet()
        self.table = {b: letters[b] for b in range(256)}
        self.bytes_of = {letters[b]: b for b in range(256)}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def spell(self, text: str) -> str:
        return text.encode("utf-8", "replace").decode("latin-1").translate(self.table)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        ids: list[int] = []
        known = self.known
        for token in self.split(text):
            part = known.get(token)
            if part is None:
                part = self.model.encode(self.spell(token))
                if len(token) <= CACHED_LENGTH and len(known) < CACHED:
                    known[token] = part
            ids += part
        return ids

    def decode(self, ids: list[int]) -> str:
        spelled = "".join(self.model.id_to_piece(i) for i in ids)
        return bytes(self.bytes_of[c] for c in spelled).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One model for each Python worker and vocabulary."""
    return PieceTokenizer(path)


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, f"{name}.tiktoken")


def ids_column(text: str, name: str = "byte_bpe_50k", folder: str | None = None):
    """Column of ids of the text column; ids are INT, the list is never null."""
    path = vocabulary_path(name, folder)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([t.encode(x) for x in texts], dtype=object)

    return encode(F.col(text))


def size_column(text: str, name: str = "byte_bpe_50k", folder: str | None = None):
    """Column of the number of ids."""
    path = vocabulary_path(name, folder)

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([len(t.encode(x)) for x in texts], dtype="int32")

    return count(F.col(text))


def encoded(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(id, ids)`` of every row; no shuffle, one pass."""
    rows = df.select(F.col(id_col).alias("mr_id"), F.col(text_col).alias("mr_text"))
    return rows.select(F.col("mr_id").alias(id_col), ids_column("mr_text", name, folder).alias("ids"))


def decoded(df: DataFrame, id_col: str, ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(id, text)``: the inverse mapping; null lists give null."""
    path = vocabulary_path(name, folder)

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([None if x is None else t.decode([int(i) for i in x]) for x in lists], dtype=object)

    return df.select(F.col(id_col), decode(F.col(ids_col)).alias("text"))
