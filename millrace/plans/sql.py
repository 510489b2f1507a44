"""Pieces of DuckDB SQL that say what the text functions do."""

from ..functions.hashing import MIX_A, MIX_B
from ..functions.text import MATH_ENVIRONMENTS, STOP_WORDS, ZERO_WIDTH

SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalize(x: str) -> str:
    return collapse(f"lower(translate({x}, '{ZERO_WIDTH}', ''))")


def words(x: str) -> str:
    """Words of an expression that is collapsed already."""
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split({x}, ' ') END)"


def windows(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def first_u64_le(h: str) -> str:
    return "(" + " || ".join(f"substr({h}, {at}, 2)" for at in range(15, 0, -2)) + ")"


#: Two to the 64th, for unsigned arithmetic in UHUGEINT.
U64 = f"{1 << 64}::UHUGEINT"


def mix64(x: str) -> str:
    """The finalizer of SplitMix64 over an unsigned 64-bit number in UHUGEINT; each step is a list of one, so that nothing is worked out twice."""
    steps = [f"(xor(z, z >> 30) * {MIX_A}) % {U64}", f"(xor(z, z >> 27) * {MIX_B}) % {U64}", "xor(z, z >> 31)"]
    out = f"[{x}]"
    for step in steps:
        out = f"list_transform({out}, lambda z: {step})"
    return f"({out})[1]"


def literal(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOPS = literal(STOP_WORDS)
MATH = " OR ".join(f"contains(text, '\\begin{{{e}}}')" for e in MATH_ENVIRONMENTS)

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, sha256(text) AS content_hash, source, doc_id FROM documents WHERE text IS NOT NULL)"
