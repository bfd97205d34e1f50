"""Normal forms of names. Each rule is written once and serves both as a column expression and in Python (for the Arrow stage that expands variants)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with marks, and their bases: Spark has no Unicode normalisation.
_PAIRS = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(a, b) if unicodedata.normalize("NFD", chr(i))[0].isascii() and unicodedata.normalize("NFD", chr(i))[0].isalpha()}
MARKED, BARE = "".join(_PAIRS), "".join(_PAIRS.values())
_FOLD = str.maketrans(_PAIRS) | {i: None for i in range(0x300, 0x370)} | {ord("ß"): "ss"}

#: Word edges as ASCII sees them.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

DESCRIPTOR_WORDS = ["black", "body only", "body", "box & lens set", "boxed", "brown", "bundle", "chrome", "kit", "lot", "no meter", "outfit", "silver", "w/ ?case", "with case"]

#: For batch matching, after lower case and folding.
MATCH_RULES = [
    (r" ", " "),
    (r"[µμ]:?", "mju "),
    (r"[αΑ]:?", "alpha "),
    (B0 + r"alpha\s+a(?=[0-9])", "alpha "),
    (r"([0-9]),([0-9])", "$1.$2"),
    (B0 + r"no\.?\s+(?=[0-9])", "n "),
    (r"[®™©]", ""),
    (r"\([^)]*\)", " "),
    (B0 + "(?:" + "|".join(DESCRIPTOR_WORDS) + ")" + B1, " "),
    (r"[^a-z0-9.\- ]+", " "),
    (r"([0-9])\s*mm" + B1, "$1mm"),
    (r"[-\s]+", " "),
]
ROMAN = {numeral: str(n) for n, numeral in enumerate("i ii iii iv v vi vii viii ix x".split(), 1)}

#: For typeahead: roman numerals stay, letters and digits part, a mark of generation has one form.
TYPE_RULES = [
    (r" ", " "),
    (r"[µμ]:?", "mju "),
    (r"([0-9]),([0-9])", "$1.$2"),
    (B0 + r"n(?:o\.?|°)\s*(?=[0-9])", "n "),
    (B0 + r"(?:mark|mk)\.?[ -]?(iii|ii|iv|v|i)" + B1, "mk $1"),
    (B0 + r"(?:mark|mk)\.?[ -]?([1-5])" + B1, "mk $1"),
    (B0 + r"mk 1" + B1, "mk i"), (B0 + r"mk 2" + B1, "mk ii"), (B0 + r"mk 3" + B1, "mk iii"), (B0 + r"mk 4" + B1, "mk iv"), (B0 + r"mk 5" + B1, "mk v"),
    (r"(?<![0-9])\.|\.(?![0-9])", " "),
    (r"[^a-z0-9.]+", " "),
    (r"([0-9])([a-z])", "$1 $2"),
    (r"([a-z])([0-9])", "$1 $2"),
    (r"\s+", " "),
]
CM = r"([0-9]+)(?:\.([0-9]))?\s*cm(?![A-Za-z0-9_])"


def _java_to_python(rep: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", rep)


_COMPILED = {id(rules): [(re.compile(p, re.ASCII), _java_to_python(r)) for p, r in rules] for rules in (MATCH_RULES, TYPE_RULES)}


def fold_text(s: str) -> str:
    return unicodedata.normalize("NFD", s.lower()).translate(_FOLD).translate(_FOLD)


def fold(c: Column) -> Column:
    """Lower case without marks (MN1, MN2, TN1, FMT6)."""
    return F.regexp_replace(F.replace(F.translate(F.lower(c), MARKED, BARE), F.lit("ß"), F.lit("ss")), r"[̀-ͯ]", "")


def _apply(c: Column, rules: list) -> Column:
    for pattern, rep in rules:
        c = F.regexp_replace(c, pattern, rep)
    return F.trim(c)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: inside a lambda, Spark would else work it out anew for each element."""
    return F.transform(F.array(value), body)[0]


def match_normalize(c: Column) -> Column:
    """MN1 to MN11; '' for null."""
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])

    def numerals(t: Column) -> Column:
        last = F.size(t) - 1
        return F.array_join(F.transform(t, lambda x, i: F.when(x.isin(*ROMAN) & ((F.length(x) > 1) | (i == last)), table[x]).otherwise(x)), " ")

    return let(F.split(_apply(fold(F.coalesce(c, F.lit(""))), MATCH_RULES), " "), numerals)


def match_normalize_text(s: str | None) -> str:
    t = fold_text(s or "")
    for pattern, rep in _COMPILED[id(MATCH_RULES)]:
        t = pattern.sub(rep, t)
    return numerals_text(t)


def numerals_text(t: str) -> str:
    parts = t.strip(" ").split(" ")
    return " ".join(ROMAN[x] if x in ROMAN and (len(x) > 1 or i == len(parts) - 1) else x for i, x in enumerate(parts))


_MARKS = str.maketrans(_PAIRS) | {ord("ß"): "ss"} | {i: None for i in range(0x300, 0x370)}


def match_normalize_as_column(s: str | None) -> str:
    """As match_normalize() does it, with fold()'s marks alone."""
    t = (s or "").lower().translate(_MARKS)
    for pattern, rep in _COMPILED[id(MATCH_RULES)]:
        t = pattern.sub(rep, t)
    return numerals_text(t)


@F.pandas_udf(StringType())
def match_normalize_long(texts: pd.Series) -> pd.Series:
    """match_normalize for running text, over which Python's passes take far less time than Spark's."""
    return texts.map(match_normalize_as_column)


def words_of(norm: Column) -> Column:
    """Tokens of a normal form (MN12)."""
    return F.filter(F.split(norm, " "), lambda x: x != "")


def digits_of(norm: Column) -> Column:
    """Numbers in a normal form (MN13)."""
    return F.regexp_extract_all(norm, F.lit(r"([0-9]+(\.[0-9]+)?)"), F.lit(1))


def type_normalize(c: Column) -> Column:
    """TN1 to TN9."""
    t = fold(F.coalesce(c, F.lit("")))
    # centimetres to millimetres, number by number: 5cm is 50mm, 13.5cm 135mm
    t = F.regexp_replace(t, r"([0-9]),([0-9])", "$1.$2")
    t = F.regexp_replace(t, r"(?<![0-9.])([0-9]+)\.([0-9])\s*cm(?![A-Za-z0-9_])", "$1$2mm")
    t = F.regexp_replace(t, r"(?<![0-9.])([0-9]+)\s*cm(?![A-Za-z0-9_])", "$1\u00010mm")  # the mark keeps the 0 from the group's number
    return _apply(F.replace(t, F.lit("\u0001"), F.lit("")), TYPE_RULES)


def type_normalize_text(s: str | None) -> str:
    t = re.sub(r"([0-9]),([0-9])", r"\1.\2", fold_text(s or ""))
    t = re.sub(r"(?<![0-9.])([0-9]+)\.([0-9])\s*cm(?![A-Za-z0-9_])", r"\1\2mm", t)
    t = re.sub(r"(?<![0-9.])([0-9]+)\s*cm(?![A-Za-z0-9_])", r"\g<1>0mm", t)
    for pattern, rep in _COMPILED[id(TYPE_RULES)]:
        t = pattern.sub(rep, t)
    return t.strip(" ")


def slugify(c: Column) -> Column:
    """TN10."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def first_only(c: Column, pattern: str, rep: str) -> Column:
    """Replaces the first hit alone; pattern must have no groups of its own."""
    return F.regexp_replace(c, rf"(?s)^(.*?)(?:{pattern})", "$1" + rep)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
