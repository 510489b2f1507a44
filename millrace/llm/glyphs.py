"""What the eye reads in a string: ignorable characters, compatibility forms and look-alike letters.

``clean`` removes what has no shape and folds compatibility forms that look like plain
letters; raised and lowered digits, fractions and circled forms are left alone because
they look different. ``skeleton`` further maps every letter to the representative of its
look-alike class. Classes hold letters that are drawn alike in any text; letters that are
only close to one another (nu and v, Armenian vo and n) are ``near_letters``, read from the
confusables of Unicode that Spark's own ICU carries, and it takes a word's script to read them.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import SparkSession

# Classes of letters that look alike. The first of each class stands for it.
LOOKALIKES = [
    "aаɑ", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iі", "jјϳ", "lӏ", "oоοօ", "pр", "qԛ", "sѕ", "wԝ", "xх", "yу", "vѵ",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ",
    "WԜ", "XХΧ", "YҮΥУ", "ZΖ", "VѴ", "ΦФ", "ΠП", "ΓГ", "μµ", "ƏӘ", "əә", "æӕ", "ÆӔ",
    "-‐‑", "'ʹ",
]

# Decomposition kinds whose result looks like the character itself.
FOLDED_KINDS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}

# Characters without a shape that are neither of category Cf nor controls, as ranges.
SHAPELESS = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2800, 0x2800), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]

_REP = {c: group[0] for group in LOOKALIKES for c in group}
_MEMBERS = {group[0]: group for group in LOOKALIKES}


@functools.lru_cache(maxsize=100_000)
def script_of(char: str) -> str:
    """latin, cyrillic, greek, other letters, or common for what belongs to every script."""
    if not char.isalpha():
        return "common"
    name = unicodedata.name(char, "")
    for script in ("LATIN", "CYRILLIC", "GREEK"):
        if name.startswith(script):
            return script.lower()
    return "common" if name.startswith(("MICRO", "MODIFIER")) else "other"


class _Clean(dict):
    """Code point to its replacement, worked out when first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)
        if char.isspace() or kind in ("Zs", "Zl", "Zp"):
            out = " "
        elif kind in ("Cf", "Cc") or any(a <= code <= b for a, b in SHAPELESS):
            out = ""
        else:
            out = char
            decomposed = unicodedata.decomposition(char)
            if decomposed.startswith("<"):
                parts = decomposed.split()
                if parts[0] in FOLDED_KINDS and parts[1] not in ("0020", "0640"):
                    out = "".join(self[int(p, 16)] for p in parts[1:])
            elif decomposed and " " not in decomposed:  # Kelvin, Angstrom and Ohm signs
                out = self[int(decomposed, 16)]
        self[code] = out
        return out


class _Skeleton(dict):
    """As ``_Clean``, and each letter becomes the representative of its class."""

    def __missing__(self, code: int) -> str:
        # A letter of a class is looked up before compatibility folding, which would make a lunate sigma a final one.
        known = _REP.get(chr(code))
        out = known or "".join(_REP.get(c, c) for d in _CLEAN[code] for c in unicodedata.normalize("NFD", d))
        self[code] = out
        return out


_CLEAN = _Clean()
_SKELETON = _Skeleton()


def clean(text: str) -> str:
    """Composed text without ignorable characters, with single spaces and plain compatibility forms."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split(" ")) if "  " not in text and text[:1] != " " and text[-1:] != " " else " ".join(text.split())
    return " ".join(unicodedata.normalize("NFC", text.translate(_CLEAN)).split())


def skeleton(text: str) -> str:
    """Decomposed string of class representatives: equal for texts that look the same."""
    return " ".join(unicodedata.normalize("NFD", text.translate(_SKELETON)).split())


def alternatives(rep: str) -> list[tuple[str, str]]:
    """The letters that look like ``rep``, each with its script."""
    return [(c, script_of(c)) for c in _MEMBERS.get(rep, rep)]


#: Scripts whose letters are drawn as Latin capitals, so that a whole word of them reads as Latin.
DRAWN_AS_LATIN = ("LISU ", "CHEROKEE ")


def near_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts to the Latin letter they resemble, by the confusables table of Spark's ICU.

    The table says which shape a character shares; the case of the Latin letter is that of the
    character, since the table itself takes I, l and 1 as one. Latin variants, digits, marks and
    letters of the classes above aren't in it.
    """
    letters = [c for c in map(chr, range(0x370, 0x10000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Lt") and c not in _REP and not _no_candidate(c)]
    between = "\ue000"
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shapes = checker.getSkeleton(between.join(letters)).split(between)
    out = {}
    for letter, shape in zip(letters, shapes):
        if len(shape) == 1 and shape.isascii() and shape.isalpha():
            drawn = unicodedata.name(letter, "").startswith(DRAWN_AS_LATIN)
            if letter.isupper() or drawn:
                shape = {"l": "I", "o": "O"}.get(shape, shape)
            out[letter] = shape
    return out


def _no_candidate(char: str) -> bool:
    return script_of(char) == "latin" or 0x3400 <= ord(char) <= 0x9FFF or 0xAC00 <= ord(char) <= 0xD7FF or unicodedata.decomposition(char) != ""
