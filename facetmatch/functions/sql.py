"""The normal forms as DuckDB expressions, written apart from the column versions."""

from __future__ import annotations

STOP = "with case|w/ ?case|silver|outfit|no meter|lot|kit|chrome|bundle|brown|boxed|box & lens set|body only|body|black"


def norm(x: str) -> str:
    e = f"replace(strip_accents(lower(coalesce({x}, ''))), 'ß', 'ss')"
    for p, r in (
        (" ", " "), ("[µμ]:?", "mju "), ("[αΑ]:?", "alpha "), (r"\balpha\s+a(\d)", r"alpha \1"), (r"(\d),(\d)", r"\1.\2"), (r"\bno\.?\s+(\d)", r"n \1"), ("[®™©]", ""), (r"\([^)]*\)", " "),
        (rf"\b({STOP})\b", " "), ("[_/,+&]", " "), (r"[^a-z0-9.\- ]", " "), (r"(\d)\s*mm\b", r"\1mm"), ("-", " "), (r"\s+", " "),
    ):
        e = f"regexp_replace({e}, '{p}', '{r}', 'g')"
    t = f"string_split(trim({e}, ' '), ' ')"
    names, values = "['i','ii','iii','iv','v','vi','vii','viii','ix','x']", "['1','2','3','4','5','6','7','8','9','10']"
    return f"(SELECT array_to_string(list_transform(t, lambda x, i: CASE WHEN list_contains({names}, x) AND (length(x) > 1 OR i = len(t)) THEN ({values})[list_position({names}, x)] ELSE x END), ' ') FROM (SELECT {t} AS t))"


def words(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda x: x <> '')"


def digits(n: str) -> str:
    return rf"regexp_extract_all({n}, '(\d+(\.\d+)?)', 1)"


def grams(n: str) -> str:
    return f"(SELECT list_distinct(list_transform(range(1, length(g) - 1), lambda i: substr(g, i, 3))) FROM (SELECT '  ' || replace({n}, ' ', '') || ' ' AS g))"


def dice(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
