"""Names of one product in several markets (MK1 to MK5), as small dimension tables."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession

#: brand -> groups of words of one meaning, in order; u, i, e, j: the market.
TOKENS = {
    "minolta": ["u:freedom i:riva j:capios", "u:maxxum e:dynax j:alpha"],
    "pentax": ["u:iqzoom i:espio", "u:zx i:mz"],
    "olympus": ["u:stylus i:mju"],
    "nikon": ["i:nikkormat j:nikomat"],
    "canon": ["u:sure shot e:prima j:autoboy"],
    "exakta": ["u:vx i:varex"],
    "ihagee": ["u:vx i:varex"],
    "samsung": ["u:maxima i:af zoom e:vega"],
    "ricoh": ["u:kr i:xr"],
}

#: brand -> whole models, in order: American name, then the international one; where markets are marked, as marked.
MODELS = {
    "nikon": "n50=f50;n55=f55;n60=f60;n65=f65;n70=f70;n75=f75;n80=f80;n90=f90;n90s=f90x;n2000=f301;n2020=f501;n4004=f401;n4004s=f401s;n5005=f401x;n6000=f601m;n6006=f601;n8008=f801;n8008s=f801s",
    "canon": """rebel 2000=eos 300;rebel ti=eos 300v;rebel t2=eos 300x;rebel k2=eos 3000v;rebel g=eos 500n;rebel gii=eos 500n;rebel x=eos 500;rebel s=eos 1000f;rebel sii=eos 1000fn;rebel ii=eos 1000fn;elan=eos 100;
        elan ii=eos 50;elan iie=eos 50e;elan 7=eos 30;elan 7e=eos 30;elan 7n=eos 30v;elan 7ne=eos 30v;a2=eos 5;a2e=eos 5;digital rebel=eos 300d;rebel xt=eos 350d;rebel xti=eos 400d;rebel xsi=eos 450d;
        rebel t1i=eos 500d;rebel t2i=eos 550d;rebel t3i=eos 600d;rebel t3=eos 1100d;rebel t4i=eos 650d;rebel t5i=eos 700d;rebel t5=eos 1200d;rebel sl1=eos 100d;rebel t6=eos 1300d;rebel t6i=eos 750d;
        rebel t6s=eos 760d;rebel t7=eos 2000d;rebel t7i=eos 800d;rebel sl2=eos 200d;rebel sl3=eos 250d""",
    "minolta": """x-570=x-500;x-370=x-300;x-370s=x-300s;xd-11=xd-7;xe-7=xe-1;xg-7=xg-2;xg-9=xg-s;srt-102=srt-303;srt-202=srt-303;srt-201=srt-101b;maxxum 7000=j:alpha 7000;maxxum 9000=j:alpha 9000;
        i:riva zoom 70w=u:freedom zoom explorer 70w=j:capios 25;i:riva zoom 75w=u:freedom zoom explorer ex=j:capios 75;i:riva zoom 140ex=u:freedom zoom 140ex=j:capios 140;
        i:riva zoom 150=u:freedom zoom 150=j:capios 150;i:riva zoom 125=u:freedom zoom 125=j:capios 125s""",
    "pentax": "super program=super a;program plus=program a;iqzoom 70xl=espio af zoom;iqzoom 115v=espio 115m",
    "yashica": "sensation zoom=microtec zoom;imagination micro=micro elite",
    "olympus": """i:mju-ii=u:stylus epic;i:mju-ii=u:infinity stylus epic;i:mju-i=u:infinity stylus;i:mju zoom 105=u:stylus zoom 105;i:mju zoom 115=u:stylus zoom 115;i:mju-ii 170=u:stylus epic zoom 170;
        i:mju-iii wide 100=u:stylus 100 wide""",
    "fuji": "i:dl=u:discovery",
}
MARKETS = {"u": "us", "i": "intl", "e": "eu", "j": "jp"}


def _tokens(group: str) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for w in group.split():
        if w[1:2] == ":":
            out.append([MARKETS[w[0]], w[2:]])
        else:
            out[-1][1] += " " + w
    return [tuple(x) for x in out]


def _models(line: str) -> list[tuple[str, str]]:
    names = line.strip().split("=")
    return [(MARKETS[n[0]], n[2:]) if n[1:2] == ":" else ("us" if i == 0 else "intl", n) for i, n in enumerate(names)]


def rows() -> list[tuple[str, str, int, int, str, str]]:
    """level, brand, group, position, market, term."""
    out = []
    for brand, groups in TOKENS.items():
        out += [("token", brand, g, i, m, t) for g, line in enumerate(groups) for i, (m, t) in enumerate(_tokens(line))]
    for brand, text in MODELS.items():
        out += [("model", brand, g, i, m, t) for g, line in enumerate(text.split(";")) for i, (m, t) in enumerate(_models(line))]
    return out


def market_terms(spark: SparkSession) -> DataFrame:
    """MK1, MK2."""
    return spark.createDataFrame(rows(), "level string, brand string, grp int, pos int, market string, term string")


def token_swaps(brand: str) -> list[tuple[str, str]]:
    """MK4: unordered pairs."""
    return [pair for line in TOKENS.get(brand, []) for pair in combinations([t for _, t in _tokens(line)], 2)]


def model_map(brand: str) -> dict[str, list[str]]:
    """MK5: ordered pairs, hyphens as spaces; a name of several groups leads to each."""
    out: dict[str, list[str]] = {}
    flat = lambda t: t.replace("-", " ")
    for line in MODELS[brand].split(";") if brand in MODELS else []:
        for a, b in permutations([t for _, t in _models(line)], 2):
            if a != b:
                out.setdefault(flat(a), []).append(flat(b))
    return out


def synonym_groups() -> list[list[str]]:
    """MK3: without brand, hyphens as spaces; groups of two at least."""
    groups: dict[tuple, list[str]] = {}
    for level, brand, g, _, _, term in rows():
        term = term.replace("-", " ")
        group = groups.setdefault((level, brand, g), [])
        if term not in group:
            group.append(term)
    return [g for g in groups.values() if len(g) > 1]


def type_variants(tokens: list[str]) -> list[tuple[list[str], str | None]]:
    """TN12: the query's tokens with no label, then each rewriting by a synonym, with the synonym as label; generation numbers in both forms. Kiss and rebel aren't swapped (TN13)."""
    from facetmatch.functions.text import ROMAN, type_normalize_text

    seen, out = {tuple(tokens)}, [(tokens, None)]
    for group in synonym_groups():
        for a in group:
            old = type_normalize_text(a).split()
            for at in range(len(tokens) - len(old) + 1):
                if tokens[at : at + len(old)] != old:
                    continue
                for b in group:
                    new = type_normalize_text(b).split()
                    for form in (new, [ROMAN.get(x, x) if len(x) > 1 else x for x in new]):
                        made = tokens[:at] + form + tokens[at + len(old) :]
                        if b != a and tuple(made) not in seen:
                            seen.add(tuple(made))
                            out.append((made, b))
    return out
