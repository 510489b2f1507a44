"""DuckDB SQL of what the training-data queries find, where SQL can say it."""

from __future__ import annotations

import unicodedata

from .glyphs import _SKELETON
from .leakage import RUN


def _folds() -> tuple[str, str, list[tuple[str, str]], str]:
    """Characters that look like one other character, with those; others that look like several; characters without a shape."""
    one, to, more, none = [], [], [], []
    for code in [*range(1, 0x20), *range(0x7F, 0x3400), *range(0xA640, 0xABFF), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)]:
        char = chr(code)
        if unicodedata.category(char) in ("Cn", "Cs", "Co"):
            continue
        shape = unicodedata.normalize("NFC", _SKELETON[code])
        if shape == unicodedata.normalize("NFC", char):
            continue
        if not shape:
            none.append(char)
        elif len(shape) == 1:
            one.append(char)
            to.append(shape)
        else:
            more.append((char, shape))
    return "".join(one), "".join(to), more, "".join(none)


def _looks(text: str) -> str:
    """The text as the eye sees it, with single spaces: folded, without shapeless characters, composed."""
    one, to, more, none = _folds()
    quoted = lambda x: x.replace("'", "''")
    out = f"translate(translate(nfc_normalize({text}), '{quoted(one)}', '{quoted(to)}'), '{quoted(none)}', '')"
    for char, shape in more:
        if unicodedata.name(char, "").startswith(("LATIN SMALL LIGATURE", "HORIZONTAL ELLIPSIS", "TWO DOT LEADER", "NUMERO", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")):
            out = f"replace({out}, '{char}', '{shape}')"
    return f"nfc_normalize(trim(regexp_replace({out}, ' +', ' ', 'g')))"


def _words(text: str) -> str:
    """Words of a text as ``leakage.words`` takes them."""
    codes = f"list_prepend({text}, list_distinct(regexp_extract_all({text}, '\\\\u[0-9a-fA-F]{{4}}')))"
    unescaped = f"regexp_replace(list_reduce({codes}, lambda t, c: replace(t, c, chr(CAST('0x' || substr(c, 3) AS INTEGER)))), '\\\\[ntrbf]', ' ', 'g')"
    out = f"CASE WHEN regexp_matches({text}, '^\\s*[{{\\[]') AND contains({text}, chr(92)) THEN regexp_replace({unescaped}, '\\\\(.)', '\\1', 'g') ELSE {text} END"
    return f"regexp_extract_all(lower(strip_accents({_looks(out)})), '[\\p{{L}}\\p{{N}}]+')"


def leaks() -> str:
    """Records that hold ``RUN`` words in a row of an item, or the whole of a shorter one: joined on the runs themselves."""
    run = lambda w, n: f"list_transform(range(1, len({w}) - {n} + 2), lambda k: array_to_string({w}[k:k + {n} - 1], ' '))"
    return f"""i AS (SELECT suite, item_id, w, least({RUN}, len(w)) AS n FROM (SELECT DISTINCT suite, item_id, {_words('text')} AS w FROM eval_item WHERE text IS NOT NULL) WHERE len(w) > 0),
g AS (SELECT DISTINCT suite, item_id, unnest({run('w', 'n')}) AS gram FROM i), n AS (SELECT DISTINCT n FROM i),
m AS (SELECT DISTINCT id, unnest({run('w', 'n')}) AS gram FROM (SELECT id, {_words('text')} AS w FROM corpus WHERE text IS NOT NULL), n),
leaks AS (SELECT DISTINCT id, suite, item_id FROM m JOIN g USING (gram))"""


_FORMS = "x AS (SELECT case_id, in_text, {} AS form FROM normalize_cases WHERE in_text IS NOT NULL)"


def looks() -> str:
    """Pairs of different strings that look the same."""
    return f"""WITH {_FORMS.format(_looks('in_text'))}
SELECT DISTINCT a.case_id AS case_id_a, b.case_id AS case_id_b FROM x a JOIN x b USING (form) WHERE form <> '' AND a.case_id < b.case_id AND a.in_text <> b.in_text"""


def look_classes() -> str:
    """Each text under the smallest id that looks like it, and how many do."""
    return f"WITH {_FORMS.format(_looks('in_text'))} SELECT case_id, min(case_id) OVER (PARTITION BY form) AS class_id, count(*) OVER (PARTITION BY form) AS n_rows FROM x WHERE form <> ''"
