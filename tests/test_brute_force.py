"""The matcher and the typeahead search against plain loops over small catalogues, on random queries: every gate of the rules is met, and all rows agree."""

import math
import random
import re
from collections import Counter

import pytest

from facetmatch.functions.market import type_variants
from facetmatch.functions.similarity import WEIGHTS
from facetmatch.functions.text import match_normalize_text as norm
from facetmatch.functions.text import type_normalize_text
from facetmatch.functions.variants import sub_queries, variants
from facetmatch.operators.catalog import build, index_rows_of, stored
from facetmatch.operators.matching import FILLER, GENERIC, MAKERS, match_batch
from facetmatch.operators.search import Limits, search_batch
from facetmatch.sources.testdata import Asset

CAMERAS = """Canon Canonet G-III QL17;Canon New Canonet QL17;Canon P;Canon AE-1;Canon AE-1 Program;Canon EOS 1100D;Canon EOS 500;Yashica Yashica-Mat 124 G;Yashica Mat EM;Nikon F3;Nikon F3 HP;Nikon F90X;Nikon F100;Minolta X-700;Minolta X-300;Minolta Dynax 7000
Olympus mju II;Olympus OM-1;Olympus OM-10;Leica M3;Leica M2;Rolleicord IV;Leotax F;Rolleiflex 2.8 E2;Rolleiflex 2.8 E3;Polaroid 100;Sony alpha 77;Meyer Trioplan 2016 reissue camera;Zorki 4;Zorki 4K;Kiev-IIa;Argus C3;Exakta Varex IIa;Kodak Medalist;Praktice Super
Canon Sure Shot Owl;Fed 2;Zenit E;Zenit EM;Voigtlander Bessa R;Voigtlander Bessa R2""".replace("\n", ";").split(";") + [f"Praktica L{i}" for i in range(55)]
LENSES = """Helios-44M 58 mm f/2;Nikon Nikkor 50mm f/1.4;Nikon Nikkor 50mm f/1.8;Canon FD 50mm f/1.4;Canon EF 50mm f/1.4;Jupiter-9 85mm f/2 (SLR);Vivitar 70-200mm f/3.5;Vivitar Macro 55mm f/2.8;Pentax SMC Takumar 55mm f/1.8;Minolta Rokkor 50mm f/1.4;Tamron 28mm f/2.8;Sigma 28mm f/2.8;Kiron 28mm f/2.8 V""".split(";")


@pytest.fixture(scope="module")
def asset(spark):
    every = [("camera", n) for n in CAMERAS] + [("lens", n) for n in LENSES]
    rows = [(i, f"{i:016x}", k, n, n, ["high", "medium", "low"][i % 3]) for i, (k, n) in enumerate(every)]
    records = spark.createDataFrame(rows, "ord long, id string, kind string, name string, recommended_name string, confidence string")
    of = {n: (i, k, f"{i:016x}") for i, (k, n) in enumerate(every)}
    said = [("Nikon F90X", "Nikon N90s", "market", "us"), ("Olympus mju II", "Olympus Stylus Epic", "market", "us"), ("Canon P", "Canon P", "name", None), ("Minolta X-300", "Minolta X-370", "market", "us"), ("Canon EOS 500", "Canon Rebel X", "market", "us"), ("Zorki 4", "Zorki-4 (FED)", "name", None), ("Zorki 4K", "Zorki-4 (FED)", "name", None), ("Canon Canonet G-III QL17", "Canonet 17", "shorthand", None)]
    aliases = spark.createDataFrame([(of[n][0], j, a, of[n][1], of[n][2], v, m) for j, (n, a, v, m) in enumerate(said)], "ord long, slot int, alias string, kind string, id string, via string, market string")
    return Asset(records, aliases, spark.createDataFrame([], "ord long, from_id string, kind string, to_id string"))


def distance(a, b):
    """Edits and swaps of neighbours, by the whole table."""
    t = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i, j] = min(t[i, j], t[i - 2, j - 2] + 1)
    return t[len(a), len(b)]


def grams(s):
    s = "  " + norm(s).replace(" ", "") + " "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def dice(a, b):
    return 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0


def numbers(s):
    return re.findall(r"[0-9]+(?:\.[0-9]+)?", norm(s))


def has(words, s):
    return re.search(rf"\b(?:{words})\b", s, re.I | re.A)


def conflict(query, title):
    if (has("rf|rangefinder", query) and has("slr", title)) or (has("slr", query) and has("rf|rangefinder", title)):
        return True
    if has("new|reissue", re.sub(r"\b(?:like|brand)[- ]new\b|\bnew\s+(?:in\s+box|old\s+stock)\b|\bnib\b|\bnos\b", " ", query, flags=re.I)):
        return False
    if has("reissue", title):
        return True
    found = re.search(r"\bnew\b[\s)/-]*([a-z0-9]+)?", re.sub(r"\bnew\s+(?:york|haven|jersey)\b", " ", title, flags=re.I), re.I)
    return bool(found and (not found[1] or re.search(rf"\b{found[1]}", query, re.I)))


class Matcher:
    def __init__(self, asset):
        self.met = Counter()
        said = {}
        for r in asset.aliases.orderBy("slot").collect():
            said.setdefault(r["id"], []).append(r["alias"])
        self.entries = [{"id": r["id"], "kind": r["kind"], "title": r["name"], "norm": norm(r["name"]), "aliases": [norm(a) for a in said.get(r["id"], []) if a != r["name"]]} for r in asset.records.orderBy("ord").collect()]
        self.vocab = Counter(t for e in self.entries for t in e["norm"].split() if len(t) >= 3 and not re.search("[0-9]", t))
        self.first = {}
        for e in self.entries:
            for t in e["norm"].split():
                self.first.setdefault(t, len(self.first))

    def nearest(self, t, most, ratio=0):
        close = [(distance(t, w), -n, self.first[w], w) for w, n in self.vocab.items() if w != t and (w[0] == t[0] or len(t) >= 6) and (not ratio or n >= max(50, ratio * self.vocab[t])) and abs(len(w) - len(t)) <= most]
        close = [c for c in close if c[0] <= most]
        return min(close)[3] if close else None

    def fixes(self, query):
        toks, out = norm(query).split(), []
        able = lambda t: len(t) >= 4 and not re.search("[0-9]", t)
        one = [self.nearest(t, 2 if len(t) >= 7 else 1) if able(t) and t not in self.vocab else None for t in toks]
        two = [self.nearest(t, 1, 20) if able(t) and self.vocab[t] <= 3 else None for t in toks]
        for name, line in (("typo", one), ("rare", two)):
            if any(line):
                self.met[name] += 1
                out.append(" ".join(n or t for n, t in zip(line, toks)))
        return out

    def candidates(self, form, kind):
        toks = [*dict.fromkeys(form.split())]
        seen = {}
        for at, t in enumerate(toks):
            for i, e in enumerate(self.entries):
                if t in e["norm"].split() or any(t in a.split() for a in e["aliases"]):
                    seen.setdefault(i, [0, at])[0] += 1
        rows = [(-n, len(self.entries[i]["norm"]), at, i) for i, (n, at) in seen.items() if not kind or self.entries[i]["kind"] == kind]
        return [self.entries[i] for *_, i in sorted(rows)[:25]]

    def score(self, q, e):
        qt, et, qd, ed = q.split(), e["norm"].split(), numbers(q), numbers(e["title"])
        title = dice(q, e["norm"])
        x = [1, title, jaccard(qt, et), float(q == e["norm"] or q in e["aliases"]), float(bool(et) and et[0] in qt), jaccard(qd, ed) if qd or ed else 0.5, float(q.startswith(e["norm"]) or e["norm"].startswith(q)), max([title, *(dice(q, a) for a in e["aliases"])])]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, WEIGHTS))))

    def match(self, query, kind, inner=False):
        forms = [*dict.fromkeys(norm(v) for f in [query, *self.fixes(query)] for v in variants(f, kind))]
        best = {}
        for f in forms:
            for e in self.candidates(f, kind):
                s = self.score(f, e)
                if e["id"] not in best or s > best[e["id"]][0]:
                    best[e["id"]] = [s, e]
        rows = sorted(best.values(), key=lambda r: -r[0])
        if len(rows) > 1:
            band = [r for r in rows if rows[0][0] - r[0] <= 0.12]
            close = max(band, key=lambda r: (jaccard(norm(query).split(), r[1]["norm"].split()), r[0]))
            self.met["band"] += close is not rows[0]
            rows = [close, *(r for r in rows if r is not close)]
        against = {id(r): conflict(query, r[1]["title"]) for r in rows}
        for r in rows:
            if against[id(r)]:
                self.met["conflict"] += r[0] > 0.4
                r[0] = min(r[0], 0.4)
        rows.sort(key=lambda r: -r[0])
        top = rows[0] if rows else None

        def promote(chosen, name, top):
            if not chosen:
                return top
            first = max(chosen, key=lambda r: r[0])
            self.met[name] += first[0] < 0.9
            first[0] = max(first[0], 0.9)
            return first if top is None or first[0] >= top[0] else top

        heart = lambda s: [t for t in s.split() if t not in FILLER]
        core = [r for r in rows if not against[id(r)] and len(heart(r[1]["norm"])) >= 2 and any(heart(f) == heart(r[1]["norm"]) for f in forms)]
        top = promote(core, "core", top)
        if kind == "lens":
            wordy = lambda s: [t for t in s.split() if not t[0].isdigit() and len(t) > 1]
            asked = {t for f in forms for t in wordy(f)}
            counts = [d for d in (numbers(f) for f in forms) if len(d) >= 2]
            kinds = "macro|micro|fisheye|soft|shift|tilt|mirror|reflex|zoom"

            def fits(r):
                e = r[1]
                mine, own = wordy(e["norm"]), numbers(re.sub(r"\s+v$", "", e["title"], flags=re.I))
                makers = [{MAKERS[t] for t in side if t in MAKERS} for side in (asked, mine)]
                typed = any(re.search(kinds, t) and t not in asked for t in mine) or any(re.search(kinds, t) and t not in mine for t in asked)
                return not against[id(r)] and any(len(d) == len(own) and {*d} <= {*own} for d in counts) and any(t in asked and t not in GENERIC for t in mine) and not (all(makers) and not makers[0] & makers[1]) and not typed

            top = promote([r for r in rows if fits(r)], "lens", top)
        named = [r for r in rows if not against[id(r)] and {*r[1]["aliases"]} & {*forms}]
        self.met["several aliases"] += len(named) > 1
        top = promote(named if len(named) == 1 else [], "alias", top)
        after = next((r for r in rows if r is not top), None)
        ambiguous = bool(top and after and top[0] - after[0] < 0.05 and after[0] > 0.45 and not core)
        s = top[0] if top else 0.0
        decision = "no-match" if s < 0.45 else "auto" if s >= 0.9 else "review"
        out = (decision, ambiguous, top[1] if top else None, s, [r[1]["id"] for r in rows[:5]])
        if decision == "no-match" and not inner:
            alt = None
            for sub, safe in sub_queries(query):
                r = self.match(sub, kind, True)
                if r[0] != "no-match" and not conflict(query, r[2]["title"]) and (alt is None or r[3] > alt[0][3]):
                    alt = (r, safe, sub)
            if alt:
                r, safe, sub = alt
                keep = safe and r[0] == "auto" and not r[1] and numbers(sub) == numbers(r[2]["title"])
                self.met["kept" if keep else "fallback"] += 1
                return ("auto" if keep else "review", not keep, *r[2:])
        self.met["ambiguous"] += ambiguous
        self.met[decision] += 1
        return out


def stream(rng):
    """Names, spoiled and adorned in every way that the rules know."""
    every = [("camera", n) for n in CAMERAS[:41]] + [("lens", n) for n in LENSES]
    out = [("Praktice L5", "camera"), ("Zorki-4 (FED)", "camera"), ("Canon P rangefinder", "camera"), ("", None), ("qwzx vvbn", None), ("xqvw zzkq old Praktica L5 jjjj kkkk llll mmmm nnnn oooo pppp", "camera"), ("Jupiter-9 85mm f/2 RF", "lens"), ("Nikon 50mm f/1.4", "lens"), ("Vivitar 55mm f/2.8", "lens"), ("Meyer Trioplan", "camera"), ("Rolleiflex 2.8 E", "camera"), ("Nikon Nikkor 50mm", "lens"), ("Canonet QL17", "camera"), ("Vivitar zoom 70-200 3.5", "lens"), ("Tamron f/2.8 28mm multi coated", "lens"), ("Minolta MD Rokkor 50 1.4", "lens"), ("Minolta X 370", "camera"), ("Canon Rebel X", "camera"), ("Canonet 17", "camera"), ("Zeiss Ikon Praktica L7", "camera"), ("Nikon F3 Company", "camera"), ("Kodak Medalist vintage works", "camera"), ("Leica M3 professional titanium russian soviet vintage view camera made in Germany", "camera")]
    for _ in range(110):
        kind, name = rng.choice(every)
        words = name.split()
        for _ in range(rng.randint(0, 2)):
            k, i = rng.randrange(6), rng.randrange(len(words))
            w = words[i]
            if k == 0 and len(words) > 2:
                del words[i]
            elif k == 1 and len(w) > 4:
                words[i] = w[:2] + w[3] + w[2] + w[4:]
            elif k == 2:
                words.insert(rng.randint(0, len(words)), rng.choice("rangefinder,slr,35mm,new,camera,black,soviet,(boxed),RF,kit".split(",")))
            elif k == 3:
                words += ["/", *rng.choice(every)[1].split()]
            elif k == 4:
                words += rng.choice(["lorem ipsum dolor sit amet consectetur", "f/2", "1975 II", "Nikon", "zzz"]).split()
            elif len(w) > 4:
                words[i] = w[:-1]
        out.append((" ".join(words), rng.choice([kind, kind, kind, None])))
    return out


def test_matches_equal_plain_loops(spark, asset):
    queries = stream(random.Random(21))
    catalog = stored(build(asset))
    got = {r["query_id"]: r for r in match_batch(spark.createDataFrame([(i, q, k) for i, (q, k) in enumerate(queries)], "query_id long, query string, kind string"), catalog).collect()}
    m = Matcher(asset)
    assert len(got) == len(queries)
    for i, (q, k) in enumerate(queries):
        decision, ambiguous, best, s, listed = m.match(q, k)
        r = got[i]
        assert (r["decision"], r["ambiguous"], r["best_id"]) == (decision, ambiguous, best and best["id"]), (q, k, r, best)
        assert abs(r["best_score"] - s) < 1e-9 and [x["id"] for x in r["scored"]] == listed, (q, k)
    assert {"typo", "rare", "band", "conflict", "core", "lens", "alias", "several aliases", "ambiguous", "fallback", "kept", "no-match", "auto", "review"} <= {x for x, n in m.met.items() if n}, m.met


#: A bound that a lone token of the small catalogue exceeds.
SMALL = Limits(single_cover=50)


class Searcher:
    def __init__(self, asset):
        rows = index_rows_of(asset).collect()
        self.index = sorted((r["n"], r["id"], r["kind"], r["shown"]) for r in rows)
        self.words = sorted({w for n, *_ in self.index for w in n.split()})
        self.meta = {r["id"]: (r["name"], {"high": 0, "low": 2}.get(r["confidence"], 1)) for r in asset.records.collect()}
        self.met = Counter()

    def covered(self, tok):
        return [e for e in self.index if any(w.startswith(tok) for w in e[0].split())]

    def collect(self, toks, label, offset, out):
        q = " ".join(toks)
        for e in self.index:
            if e[0].startswith(q):
                out.append((offset + (e[0] != q), e, label))
        sets = [self.covered(t) for t in toks]
        if len(toks) == 1 and len(sets[0]) > SMALL.single_cover:
            self.met["broad token"] += 1
            return
        whole = [e for e in sets[0] if all(e in s for s in sets)]
        self.met["cover"] += bool(whole)
        out += [(offset + 2, e, label) for e in whole if not e[0].startswith(q)]

    def corrected(self, toks, had):
        for i, t in enumerate(toks):
            if len(t) < 3 or t.isdigit() or (had and any(w.startswith(t) for w in self.words)):
                continue
            most = 1 if len(t) < 7 else 2
            letters = t[0] if len(t) < 6 else "abcdefghijklmnopqrstuvwxyz0123456789"
            close = [(distance(t, w), letters.index(w[0]), len(w), w) for w in self.words if len(w) > 1 and w[0] in letters and w != t and abs(len(w) - len(t)) <= most]
            for *_, w in sorted(c for c in close if c[0] <= most)[:4]:
                yield [*toks[:i], w, *toks[i + 1 :]]

    def search(self, raw, limit=10):
        toks = type_normalize_text(raw[:80]).split()
        if not 0 < len(toks) <= 8:
            return []
        out = []
        for t, label in type_variants(toks):
            self.collect(t, label, 3 if label else 0, out)
            self.met["market"] += bool(label)
        had = len({e[1] for _, e, _ in out})
        if had < 3:
            for fixed in self.corrected(toks, had > 0):
                self.met["corrected"] += 1
                for t, label in type_variants(fixed):
                    self.collect(t, label, 13 if label else 10, out)
        best = {}
        for tier, (n, i, kind, _), _ in out:
            key = (tier, len(n), self.meta[i][1], kind != "camera", self.meta[i][0].lower())
            best[i] = min(best.get(i, key), key)
        return [(i, k[0]) for i, k in sorted(best.items(), key=lambda x: x[1])[:limit]]


def test_searches_equal_plain_loops(spark, asset):
    rng = random.Random(22)
    raws = ["canon", "124", "stylus epic", "µ-II", "Rolleiflex 2,8", "Cannon AE-1", "Minotla X-700", "n90s", "?!", "", "a " * 9, "nikon " * 20, "x" * 100, "praktica", "praktica l", "rebel x", "zz"]
    for _ in range(60):
        name = rng.choice(CAMERAS[:41] + LENSES)
        words = name.split()
        k = rng.randrange(5)
        if k == 0:
            words = rng.sample(words, len(words))
        elif k == 1:
            words = [w[: rng.randint(1, len(w))] for w in words]
        elif k == 2:
            w = words[0]
            words[0] = w[:2] + w[3:4] + w[2:3] + w[4:]
        elif k == 3:
            words = words[1:] or words
        raws.append(" ".join(words)[: rng.randint(3, 40)])
    raws = [*dict.fromkeys(raws)]
    s = Searcher(asset)
    q = spark.createDataFrame([*enumerate(raws)], "query_id long, raw string")
    got = {}
    for r in search_batch(q, index_rows_of(asset), asset.records.select("id", "name", "confidence"), limits=SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["tier"]))
    for i, raw in enumerate(raws):
        assert got.get(i, []) == s.search(raw), raw
    assert all(s.met[x] for x in ("cover", "corrected", "market", "broad token")), s.met
