"""Language ID, secrets, LM scoring and PII: against brute force, finite differences and held-out accuracy; and the defined results of odd rows."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from facetmatch.llm import language_id as L
from facetmatch.llm import lm_scoring as LM
from facetmatch.llm import minhash as M
from facetmatch.llm import pii as P
from facetmatch.llm import secrets as S
from facetmatch.llm.common import words

SYL = {"xx": "ka lo mi tu ren sol".split(), "yy": "sch ein ung ach ver zß".split(), "zz": "é eau que tion ñ aux".split()}


def prose(lang: str, n: int, rng: random.Random) -> str:
    return " ".join("".join(rng.choice(SYL[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "   \n\t", None, None, None), (4, "!!! 123", "en", "s", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clash(df):
    """Further columns whose names differ from needed ones in case, or are those of results."""
    return df.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS TEXT", "'x' AS score", "'y' AS Doc_Id")


# language ID


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in L.initial(3, 2, 1).items()}
    x, y = rng.integers(97, 123, (4, 6)), np.array([0, 1, 1, 0])
    _, g = L.loss_and_gradient(w, x, y)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        if name[1:] == "x":
            at = (x[0, 2], 1)
        eps = 1e-6
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += eps
        down[name][at] -= eps
        slope = (L.loss_and_gradient(up, x, y)[0] - L.loss_and_gradient(down, x, y)[0]) / (2 * eps)
        assert abs(slope - g[name][at]) < 1e-5, name


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    p = L.Params(steps=120, batch=96)
    rows = [(w, l) for l in SYL for i in range(20) for w in L.windows_of(prose(l, rng.choice([4, 60, 200]), rng).encode(), p, i)]
    return L.train(*zip(*rows), p)


def test_held_out_accuracy_and_noise(model):
    rng = random.Random(2)
    truth = [l for l in SYL for _ in range(40)]
    names, confidence, good, _ = L.verdicts(model, pa.array([prose(l, 40, rng) for l in truth]))
    assert np.mean([a == b for a, b in zip(names, truth)]) > 0.95 and good.mean() > 0.97 and (confidence <= 1.0001).all()
    shuffled = ["".join(rng.sample(t, len(t))) for t in (prose(rng.choice([*SYL]), 40, rng) for _ in range(40))]
    random_ = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)) for _ in range(40)]
    names, _, good, _ = L.verdicts(model, pa.array(shuffled + random_))
    assert good[40:].mean() < 0.05 and good[:40].mean() < 0.4 and all(n is None for n, g in zip(names, good) if not g)


def states(w, d, x):
    """The states of one direction over a row of bytes, step by step, by byte."""
    h, out = np.zeros((1, w["fu"].shape[0]), np.float32), {}
    for i in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        h = out[i] = L.step(w, d, x[i : i + 1], h)[0]
    return out


def brute_probabilities(model, text: bytes):
    """Class probabilities at each byte of a text, window by window, with the plain steps over the bytes that a window reads."""
    p, w, out = model.p, model.weights, []
    for lo in range(0, len(text), p.core):
        x = np.frombuffer((bytes(p.margin) + text + bytes(p.width))[lo : lo + p.width], np.uint8)
        f, b = states(w, "f", x), states(w, "b", x)
        for i in range(p.margin, p.margin + min(p.core, len(text) - lo)):
            v = (np.concatenate([f[i], b[i]], 1) @ w["o"] + w["c"])[0].astype(float)
            e = np.exp(v - v.max())
            out.append(e / e.sum())
    return np.array(out)


def test_fast_inference_equals_the_plain_steps(model):
    x = np.frombuffer(prose("yy", 40, random.Random(3)).encode()[:96], np.uint8)
    f, b, w = states(model.weights, "f", x), states(model.weights, "b", x), model.weights
    logits = np.concatenate([np.concatenate([f[i], b[i]], 1) @ w["o"] + w["c"] for i in range(96)])
    e = np.exp(logits - logits.max(1, keepdims=True))
    assert np.allclose(L.probabilities(model, x[:, None])[:, :, 0], e / e.sum(1, keepdims=True), atol=1e-4)


def test_spans_and_pooling_equal_brute_force(spark, model):
    rng = random.Random(5)
    texts = [prose("xx", 50, rng) + " " + prose("zz", 50, rng), prose("yy", 3, rng), "é", "7 " + prose("zz", 20, rng) + " 99 !!", prose("xx", 40, rng)[:128], "QzXv9" * 30]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    names = [*model.labels, None]
    for i, t in enumerate(texts):
        raw = t.encode()
        prob = brute_probabilities(model, raw)
        pooled = prob[L.LETTER[np.frombuffer(raw, np.uint8)]].mean(0)
        best = int(pooled[:-1].argmax())
        spoken = pooled[best] >= pooled[-1]
        assert rows[i]["language"] == (names[best] if spoken else None) and abs(rows[i]["confidence"] - pooled[best]) < 2e-4
        assert rows[i]["accepted"] == (spoken and pooled[best] >= model.p.min_confidence)
        close = np.sort(prob, 1)
        sure = close[:, -1] - close[:, -2] > 1e-3
        got = [s["lang"] for s in rows[i]["spans"] for _ in range(s["start"], s["end"])]
        assert len(got) == len(raw) and all(names[k] == g for k, g, ok in zip(prob.argmax(1), got, sure) if ok)


def test_every_position_is_labelled_and_odd_rows_are_rejected(spark, model):
    rng = random.Random(4)
    long = prose("xx", 20_000, rng) + " " + prose("zz", 20_000, rng)
    docs = clash(spark.createDataFrame([*ODD, (5, long, "xx", "s", len(long)), (6, prose("yy", 30, rng), "yy", "s", 9), (6, prose("yy", 30, rng), "yy", "s", 9), (None, prose("yy", 30, rng), "yy", "s", 9)], SCHEMA))
    rows = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    for i in (1, 2, 3, 4):
        assert bool(rows[i]["spans"]) == (i > 2)
        assert rows[i]["language"] is None and rows[i]["confidence"] == 0 and not rows[i]["accepted"]
    spans = rows[5]["spans"]
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(long.encode()) and all(a["end"] == b["start"] and a["lang"] != b["lang"] for a, b in zip(spans, spans[1:]))
    size = Counter()
    for s in spans:
        size[s["lang"]] += s["end"] - s["start"]
    assert size["xx"] > 0.3 * len(long) and size["zz"] > 0.3 * len(long)
    kept = L.accepted(docs, model)
    assert kept.columns == docs.columns and sorted((r[0] or 0) for r in kept.collect()) == [0, 5, 6, 6]
    assert L.identify(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded_and_holds_rare_languages(spark):
    rng = random.Random(6)
    rows = [(i, prose("xx", 400, rng), "xx", "s", 1) for i in range(300)] + [(1000 + i, prose("zz", 400, rng), "zz", "s", 1) for i in range(3)] + [(7, prose("xx", 400, rng), "xx", "s", 1)] * 50 + [(2000, None, "zz", "s", 1), (2001, "", "q", "s", 1)]
    p = L.Params(train_rows=20)
    windows, labels = L.sample(clash(spark.createDataFrame(rows, SCHEMA)), p)
    n = Counter(labels)
    assert set(n) == {"xx", "zz"} and n["zz"] == 3 * p.train_windows and 0 < n["xx"] <= 40 * p.train_windows and {len(w) for w in windows} == {p.width}
    texts = [t.encode() for _, t, *_ in rows if t]
    at = [t.find(w) for w in windows if 0 not in w for t in texts if w in t]
    assert max(at) > 1000  # from all over


def test_without_labels_there_is_no_language(spark):
    docs = spark.createDataFrame([(1, "some words here", None, "s", 3)], SCHEMA)
    m = L.fit(docs)
    assert m.labels == [] and L.identify(docs, m).first()["language"] is None
    assert L.accepted(docs, m).count() == 0


# secrets


def test_secrets_held_out():
    """Samples of another draw; UUIDs by their form, and keys of 16 characters."""
    import uuid

    m = S.fit()
    random_, ordinary = S.labelled(S.Params(seed=99))
    found = lambda texts: np.mean([bool(S.within(m, t.encode())) for t in texts])
    assert found([t for t in random_ if len(t) >= 20]) > 0.97 and found(ordinary) < 0.005
    rng = random.Random(1)
    uuids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(1000)]
    assert found(uuids) == 0 and found([f"/user/{u.upper()}/items" for u in uuids]) < 0.01
    for chars in ("0123456789abcdef", S.ALPHABET[:62]):
        assert found(["".join(rng.choice(chars) for _ in range(16)) for _ in range(300)]) > 0.85
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    run = f"{uuids[0]}/{key}"
    assert [(a, b) for a, b, _ in S.within(m, run.encode())] == [(37, 77)]


def test_samples_from_a_table(spark):
    r, o = S.labelled(S.Params(samples=300))
    rows = [(t, True, 1) for t in r] + [(t, False, 1) for t in o] + [(None, True, 1), ("", False, 1), ("x", None, 1)]
    df = spark.createDataFrame(rows, "text string, secret boolean, SECRET_ int")
    m = S.fit_table(df, S.Params(samples=300))
    assert np.allclose(m.ratio, S.train(r, o).ratio) and 0 < m.threshold < 100
    assert S.fit_table(df.limit(0)).threshold == np.inf and S.fit_table(df.where("secret")).threshold == np.inf


def test_scan_equals_brute_force(spark):
    import re

    m = S.fit()
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(6)]
    texts = [f'é token = "{hexes[0]}" end', hexes[1], hexes[2] + " " + hexes[3] + "\n", prose("yy", 40, rng), "averyveryverylongordinarywordindeedthatgoeson", None, "", "ab1", "x" * 5000 + " " + hexes[5] + " " + "xyz/" * 300_000 + hexes[4]]
    docs = clash(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 1), (None, texts[1], "en", "s", 1)], SCHEMA))
    want = [(i, len(t[: x.start()].encode()) + a, len(t[: x.start()].encode()) + b) for i, t in enumerate(texts) if t for x in re.finditer(r"[A-Za-z0-9+/=_-]+", t) for a, b, _ in S.within(m, x.group().encode())]
    got = [(r["doc_id"], r["start"], r["end"]) for r in S.found(docs, m).collect()]
    assert Counter(got) == Counter([*want, (1, 0, 40), (None, 0, 40)]) and {i for i, _, _ in got} == {0, 1, 2, 8, None}
    clean = S.redacted(docs.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "score", "other"), m)
    rows = {r[0]: r for r in clean.collect()}
    assert len(rows) == len(texts) + 1 and rows[0][1] == 'é token = "[SECRET]" end' and rows[0][4] == len(rows[0][1]) and rows[2][1] == "[SECRET] [SECRET]\n" and rows[3][1] == texts[3] and rows[5][1] is None
    assert S.found(docs.limit(0), m).count() == 0 and S.redacted(spark.createDataFrame([], SCHEMA), m).count() == 0


def test_secrets_glued_to_something_ordinary():
    m, rng, path = S.fit(), random.Random(8), "/home/user/projects/service/config/"
    for before in (path, path + "modules/authentication/providers/internal/keys", "https_proxy_settings_of_the_service_token="):
        before = before if before[-1] in "/=" else before + "/"
        for n, chars in ((20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (20, S.ALPHABET[:62]), (32, "0123456789abcdef"), (40, "0123456789abcdef")):
            whole = 0
            for after in ("", "/documents/information/overview") * 50:
                key = "".join(rng.choice(chars) for _ in range(n))
                raw = np.frombuffer(f"see {before}{key}{after} here".encode(), np.uint8)
                s, e, _ = S.scan(m, raw, np.array([0, len(raw)]))
                whole += any(a <= 4 + len(before) and b >= 4 + len(before) + n for a, b in zip(s, e))
            assert whole >= 97
    _, ordinary = S.labelled(S.Params(seed=98))
    raw = np.frombuffer(" ".join(ordinary).encode(), np.uint8)
    assert len(S.scan(m, raw, np.array([0, len(raw)]))[0]) < 0.01 * len(ordinary)


# LM scoring


def brute_scores(rows, p):
    """rows: (id, text, target). The same formulas, word by word in dictionaries; each row is scored by models counted anew without it."""
    def toks(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return words(raw, np.array([0, len(raw)]))[0].tolist()

    seen = Counter(w for _, t, _ in rows for w in toks(t))
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    vocab = sorted(sorted(seen, key=lambda w: (-seen[w], signed(w)))[: p.vocabulary])
    ids, v = {w: i for i, w in enumerate(vocab)}, len(vocab)
    whole = [Counter(), Counter()], [Counter(), Counter()]
    split = {}
    for n, (_, t, target) in enumerate(rows):
        seq = [ids.get(w, v) for w in toks(t)] + [v + 1]
        split[n] = seq
        for a, b in zip([v + 1, *seq], seq):
            _, k = LM.bigrams(np.array([a, b]), np.array([0, 2]), v + 1, p.bucket_bits)
            whole[0][0 if target else 1][b] += 1
            whole[1][0 if target else 1][int(k[1])] += 1
    out = []
    for n, (i, _, target) in enumerate(rows):
        seq, loss = split[n], [0.0, 0.0]
        uni, pair = ([Counter(c) for c in x] for x in whole)
        for a, b in zip([v + 1, *seq], seq):
            _, k = LM.bigrams(np.array([a, b]), np.array([0, 2]), v + 1, p.bucket_bits)
            uni[0 if target else 1][b] -= 1
            pair[0 if target else 1][int(k[1])] -= 1
        for m in range(2):
            total = sum(uni[m].values())
            for a, b in zip([v + 1, *seq], seq):
                _, k = LM.bigrams(np.array([a, b]), np.array([0, 2]), v + 1, p.bucket_bits)
                single = (uni[m][b] + p.alpha) / (total + p.alpha * (v + 2))
                loss[m] -= math.log2((pair[m][int(k[1])] + p.mu * single) / (uni[m][a] + p.mu))
        out.append((i, len(seq), loss[0] / len(seq), loss[1] / len(seq)))
    return out


@pytest.mark.parametrize("p", [LM.Params(), LM.Params(vocabulary=12, bucket_bits=6, held=5)])
def test_scores_equal_brute_force(spark, p):
    rng = random.Random(6)
    rows = [(i, prose(rng.choice([*SYL]), rng.randint(0, 30), rng), i % 3 == 0) for i in range(40)] + [(100, None, False), (101, "", True), (7, "Ka lo, ka-lo", False), (7, "Ka lo, ka-lo", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    got = sorted((r["doc_id"], r["tokens"], r["loss_target"], r["loss_background"]) for r in LM.score(df, LM.fit(df, p), p).collect())
    for a, b in zip(got, sorted(brute_scores(rows, p))):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 and abs(a[3] - b[3]) < 1e-4


def test_targets_and_odd_rows(spark):
    docs = clash(spark.createDataFrame([*ODD, (5, "ka lo ka lo mi", "xx", "s", 3), (6, "ein ung ein ung", "yy", "s", 3), (None, "ka", "x", "s", 1)], SCHEMA))
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, None), (6, 0, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS Quality_", "'z' AS text")
    rows = {r["doc_id"]: r for r in LM.cross_entropy_difference(docs, labels).collect()}
    assert len(rows) == 7 and rows[1]["tokens"] == rows[2]["tokens"] == rows[3]["tokens"] == 1 and rows[5]["difference"] < rows[6]["difference"]
    none = LM.cross_entropy_difference(docs, labels.limit(0))
    assert none.count() == 7 and LM.cross_entropy_difference(docs.limit(0), labels).count() == 0


def test_every_word_and_bigram_has_its_own_count(spark):
    """200,000 words, each seen once: none is <unk>, and no two bigrams share a count. The losses in closed form, for rows that the models haven't seen, and for rows left out of them."""
    p, per = LM.Params(), 2000
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(per)), False) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    d, v = len(rows), len(rows) * per
    low = v + d + p.alpha * (v + 2)
    word, end = (1 + p.alpha) / low, (d + p.alpha) / low
    each = [math.log2((1 + p.mu * word) / (d + p.mu)), *[math.log2((1 + p.mu * word) / (1 + p.mu))] * (per - 1), math.log2((1 + p.mu * end) / (1 + p.mu))]
    other = spark.createDataFrame([(7, rows[0][1], True)], "doc_id long, text string, target boolean")
    (r,) = LM.score(other, LM.fit(df, p), p).collect()
    assert r["doc_id"] == 7 and r["tokens"] == per + 1 and abs(r["loss_background"] + sum(each) / (per + 1)) < 1e-5
    low -= per + 1
    word, end = p.alpha / low, (d - 1 + p.alpha) / low
    each = [math.log2(p.mu * word / (d - 1 + p.mu)), *[math.log2(word)] * (per - 1), math.log2(end)]
    got = LM.score(df, LM.fit(df, p), p).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(100)] and all(abs(r["loss_background"] + sum(each) / (per + 1)) < 1e-5 for r in got)


def chance(scores):
    """scores: (difference, label). The gap between the mean differences, and by how many standard deviations the lowest quarter's share of labels is off chance."""
    scores = sorted(scores)
    means = [np.mean([d for d, l in scores if l == x]) for x in (True, False)]
    low, share = scores[: len(scores) // 4], np.mean([l for _, l in scores])
    return means[0] - means[1], (np.mean([l for _, l in low]) - share) / math.sqrt(share * (1 - share) / len(low))


def test_scores_tell_nothing_of_random_labels(spark):
    rng = random.Random(31)
    rows = [(i, prose("xx", rng.randint(30, 300), rng), rng.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    label = {i: t for i, _, t in rows}
    gap, off = chance([(r["difference"], label[r["doc_id"]]) for r in LM.score(df, LM.fit(df)).collect()])
    assert abs(gap) < 0.1 and abs(off) < 4


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="needs the given tables")
def test_scores_of_documents_tell_nothing_of_random_labels(spark):
    """Copies aside: a copy is like what it copies, whatever their labels."""
    docs = M.deduplicated(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("length(text) > 200").cache()
    labels = docs.selectExpr("doc_id", "cast(xxhash64(doc_id) % 2 = 0 as int) AS quality", "0 AS toxic").where("quality = 1")
    chosen = {r[0] for r in labels.collect()}
    gap, off = chance([(r["difference"], r["doc_id"] in chosen) for r in LM.cross_entropy_difference(docs, labels).collect()])
    assert abs(gap) < 0.1 and abs(off) < 4


# PII


def luhn(n, rng):
    """A card number of n digits with a right check digit."""
    while not P.card_ok(v := "".join(rng.choice("0123456789") for _ in range(n))):
        pass
    return v


def wrong(n, rng):
    while P.card_ok(v := "".join(rng.choice("0123456789") for _ in range(n))):
        pass
    return v


def test_bootstrapping_finds_what_no_validator_knows(spark):
    """Numbers with a wrong check digit or area code, by the words before them; and nothing of numbers alike in other contexts."""
    rng = random.Random(7)
    rows, planted = [], {}
    for i in range(80):
        kind = ["phone", "card", "email", "ip"][i % 4]
        known = i % 8 < 4
        value = {
            "phone": f"+1 ({rng.choice('23' if known else '01')}{rng.randint(10, 99)}) {rng.randint(222, 999)}-{rng.randint(1000, 9999)}", "card": (luhn if known else wrong)(16, rng),
            "email": f"{prose('xx', 1, rng)}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com", "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        }[kind]
        rows.append((i, f"{prose('xx', 5, rng)} {({'phone': 'call', 'card': 'card'}).get(kind, prose('xx', 1, rng))} {value}, {prose('xx', 5, rng)}", "xx", "s", 1))
        planted[i] = (kind, value)
    rows += [(100 + i, prose("xx", 20, rng) + " in 1987 and 3 times, v1.2.3", "xx", "s", 1) for i in range(20)] + [(200 + i, f"{prose('xx', 6, rng)} {wrong(16, rng)} {prose('xx', 6, rng)}", "xx", "s", 1) for i in range(40)] + [(1000 + i, *r) for i, *r in ODD]
    rows += [rows[0], rows[1], (None, rows[1][1], "xx", "s", 1)]
    got = P.extract(clash(spark.createDataFrame(rows, SCHEMA))).collect()
    found = {(r["doc_id"], r["kind"]) for r in got}
    right = sum((i, k) in found for i, (k, _) in planted.items())
    assert right >= 0.95 * len(planted) and sum(not r["seed"] for r in got) >= 15
    assert all(r["doc_id"] is None or r["doc_id"] < 100 for r in got)
    times = Counter(r["doc_id"] for r in got)
    assert times[0] == times[1] == 2 and times[None] == 1
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert text[r["doc_id"]].encode()[r["start"] : r["end"]].decode() == planted[r["doc_id"]][1]
    assert P.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unknown_numbers_weigh_against_a_shape(spark):
    rng = random.Random(9)
    rows = [(0, f"{prose('xx', 4, rng)} card {luhn(16, rng)} {prose('xx', 4, rng)}", "xx", "s", 1)] + [(1 + i, f"{prose('xx', 4, rng)} parcel {wrong(16, rng)} {prose('xx', 4, rng)}", "xx", "s", 1) for i in range(50)]
    assert [(r["doc_id"], r["kind"], r["seed"]) for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, "card", True)]


def test_long_identifiers_and_long_words_are_whole(spark):
    local, word = "ab" * 110 + "1", "w" * 70
    rows = [(0, f"x {local}@example.com y", "xx", "s", 1)] + [(1 + i, f"{word}{'a' if i < 6 else 'b'} {luhn(16, random.Random(i)) if i < 5 else wrong(16, random.Random(i))}", "xx", "s", 1) for i in range(30)]
    got = {r["doc_id"]: r for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["start"] == 2 and got[0]["end"] == 2 + len(local) + 12
    assert set(got) == {*range(7)} and not got[6]["seed"]  # told by the word's last letter


def test_extraction_equals_brute_force(spark):
    """All candidates with their patterns, counted and scored in dictionaries."""
    rng = random.Random(10)
    rows = []
    for i in range(120):
        v = rng.choice([luhn(16, rng), wrong(16, rng), f"{rng.randint(1, 3)}.{rng.randint(0, 400)}.0.1", f"a{rng.randint(1, 30)}@b.com", f"v{rng.randint(1, 9)}", f"+1 ({rng.choice('012')}22) 555-{rng.randint(1000, 1020)}"])
        rows.append((i, f"{rng.choice(['card', 'no', 'mail', ''])} {v} {rng.choice(['ok', 'or', ''])}", "xx", "s", 1))
    p, seen, seeds = P.Params(), [], {}
    edges: dict = {}
    for i, t, *_ in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        for _, s, e, v, left, right in P.candidates(raw, np.array([0, len(raw)]), p.blob):
            v = v.lower()
            seen.append((i, s, e, v))
            edges.setdefault(v, set()).update(P.patterns(v, left, right))
            if P.seed_kind(v):
                seeds[v] = P.seed_kind(v)
    known = brute_confidences([(v, q) for v, qs in edges.items() for q in qs], seeds, p)
    best = {}
    for (v, k), c in sorted(known.items()):
        if round(c, 6) > best.get(v, (0, ""))[0]:
            best[v] = (round(c, 6), k)
    want = sorted((i, s, e, best[v][1], best[v][0], v in seeds) for i, s, e, v in seen if v in best and best[v][1] != "plain" and best[v][0] >= p.min_instance)
    assert sorted(map(tuple, P.extract(spark.createDataFrame(rows, SCHEMA)).collect())) == want and len({w[3] for w in want}) == 4


def brute_confidences(edges, seeds, p):
    known = {(v, k): 1.0 for v, k in seeds.items()}
    size = Counter(q for _, q in edges)
    for _ in range(p.rounds):
        pos = Counter()
        for v, q in edges:
            for (x, k), c in known.items():
                if x == v and (q[0] != "S" or v in seeds):
                    pos[q, k] += c
        conf = {(q, k): c / (size[q] + p.prior) for (q, k), c in pos.items() if c / (size[q] + p.prior) >= p.min_pattern}
        new, enough = {}, set()
        for v, q in edges:
            for (x, k), c in conf.items():
                if x == q and v not in seeds:
                    new[v, k] = new.get((v, k), 1.0) * (1 - c)
                    if q[0] != "S" or c >= p.min_instance:
                        enough.add((v, k))
        known = {(v, k): 1.0 for v, k in seeds.items()} | {vk: 1 - c for vk, c in new.items() if vk in enough}
    return known


def test_confidences_equal_brute_force(spark):
    p = P.Params(rounds=3)
    edges = [("a", "L p1"), ("b", "L p1"), ("c", "L p1"), ("c", "L p2"), ("d", "L p2"), ("e", "R p3"), ("d", "R p3"), ("f", "L p1"), ("f", "R p3"), ("a", "S 1"), ("b", "S 1"), ("g", "S 1"), ("h", "S 2"), ("a", "S 2"), ("i", "S 2"), ("i", "L p1")]
    seeds = {"a": "card", "b": "card", "e": "plain"}
    got = P.instances(spark.createDataFrame(edges, "value string, pattern string"), spark.createDataFrame([*seeds.items()], "value string, kind string"), p)
    want = brute_confidences(edges, seeds, p)
    assert {(r["value"], r["kind"]): round(r["confidence"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert ("g", "card") in want and ("h", "card") not in want


def test_neighbouring_identifiers_stand_apart():
    t = "call +1 (826) 555-4081 190.137.223.204 or +1 (222) 555-1111 +1 (333) 555-2222, 4111 1111 1111 1111 a.b@c.com 12 x"
    data = np.frombuffer(t.encode(), np.uint8)
    got = [v for _, _, _, v, _, _ in P.candidates(data, np.array([0, len(data)]), 200)]
    assert got == ["+1 (826) 555-4081", "190.137.223.204", "+1 (222) 555-1111", "+1 (333) 555-2222", "4111 1111 1111 1111", "a.b@c.com", "12"]


def test_a_long_text_without_spaces(spark):
    """Is one value, and no identifier."""
    docs = spark.createDataFrame([(1, "a" * 300_000 + "1" + "b" * 300_000, "x", "s", 1), (2, "x 4111111111111111 y", "x", "s", 1)], SCHEMA)
    assert [r["doc_id"] for r in P.extract(docs).collect()] == [2]


def test_identifiers_in_long_and_glued_runs():
    def found(t):
        data = np.frombuffer(t.encode(), np.uint8)
        got = [(s, e, v) for _, s, e, v, _, _ in P.candidates(data, np.array([0, len(data)]), P.Params().blob)]
        assert all(data[s:e].tobytes().decode() == v for s, e, v in got)
        return [v for _, _, v in got if P.seed_kind(v) not in (None, "plain")]

    assert found("a@b.com,c@d.com") == ["a@b.com", "c@d.com"] and found("ip=1.2.3.4;mail=a@b.com") == ["1.2.3.4", "a@b.com"]
    assert found("é/1.2.3.4,5.6.7.8:80/x(a@b.com)'4111-1111-1111-1111'tel:222-555-1234/") == ["1.2.3.4", "5.6.7.8", "a@b.com", "4111-1111-1111-1111", "222-555-1234"]
    row = '{"n":7,"mail":"x.y@mail.example.com","ip":"10.1.2.3","card":"4111111111111111","phone":"+1 (222) 555-1111"}'
    want = ["x.y@mail.example.com", "10.1.2.3", "4111111111111111", "+1 (222) 555-1111"]
    assert found(",".join([row] * 50)) == want * 50 and found("<td>é" * 100 + row) == want
    assert found("z" * 300_000 + "/a@b.com/" + "-" * 300_000 + "1") == ["a@b.com"] and found("1,234,567 v1.2.3.4 12:30") == []
