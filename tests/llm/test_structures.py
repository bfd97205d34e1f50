"""Near-duplicates, decontamination, packing, sharding, top-k and the link graph: against brute force, and the defined results of odd rows."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from facetmatch.llm import decontaminate as D
from facetmatch.llm import link_graph as G
from facetmatch.llm import minhash as M
from facetmatch.llm import packing as K
from facetmatch.llm import sharding as H
from facetmatch.llm import topk as T
from facetmatch.llm.common import pick, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "tu") for b in ("r", "n", "st") for c in ("a", "e", "ing", "on")]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, share, rng):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)


def clash(df):
    return df.selectExpr("*", "1 AS TEXT", "'x' AS score", "2 AS key", "3 AS shard")


# near-duplicates


def shingles(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    h = words(raw, np.array([0, len(raw)]))[0].tolist()
    return set(zip(h, h[1:])) if len(h) > 1 else set(h)


def corpus(rng):
    rows, i = [], 0
    for g in range(12):
        base = prose(rng.choice([40, 120, 400]), rng)
        for _ in range(rng.choice([2, 3, 8])):
            rows.append((i, edited(base, rng.choice([0, 0.01, 0.04]), rng)))
            i += 1
    rows += [(i + k, prose(60, rng)) for k in range(60)]
    return rows


def roots(pairs):
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in {*up}}


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    rows = corpus(rng)
    sets = {i: shingles(t) for i, t in rows}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    sure = [(a, b) for a in sets for b in sets if a < b and jac(a, b) >= 0.7]
    never = {(a, b) for a in sets for b in sets if a < b and jac(a, b) < 0.45}
    got = M.duplicates(clash(docs_of(spark, rows)).repartition(5)).collect()
    root = {r["doc_id"]: r["kept_doc_id"] for r in got}
    of = lambda x: root.get(x, x)
    assert sum(of(a) == of(b) for a, b in sure) >= 0.95 * len(sure)
    for r in got:
        assert abs(r["similarity"] - jac(r["doc_id"], r["kept_doc_id"])) < 0.2
        assert (r["kept_doc_id"], r["doc_id"]) not in never
    kept = {r[0] for r in M.deduplicated(docs_of(spark, rows)).collect()}
    assert kept == set(sets) - set(root)


def test_similarity_is_corrected_for_chance():
    p = M.Params()
    rng = np.random.default_rng(0)
    m = rng.integers(0, 1 << 63, (200, p.perms), np.uint64)
    a = M.pack(m[:100], p)
    assert abs(M.similarity(a, M.pack(m[100:], p), p).mean()) < 0.02 and (M.similarity(a, a, p) == 1).all()
    half = m[:100].copy()
    half[:, ::2] = m[100:, ::2]
    assert abs(M.similarity(a, M.pack(half, p), p).mean() - 0.5) < 0.02


def test_bucket_parts_equal_all_pairs():
    p = M.Params(threshold=0.75)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, p.perms), np.uint64)
    m = base[rng.integers(0, 6, 60)].copy()
    noise = rng.random(m.shape) < 0.2
    m[noise] = rng.integers(0, 1 << 63, int(noise.sum()), np.uint64)
    sigs, ids = M.pack(m, p), np.arange(60)
    pairs = [(i, j) for i in range(60) for j in range(i) if M.similarity(sigs[i], sigs[j], p) >= p.threshold]
    assert roots(M.bucket_edges(ids, sigs, p)) == roots(pairs)


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 80)
    edges = list(zip(ids[:50], ids[1:50])) + list(zip(ids[50:], ids[51:]))
    edges += [(b, a) for a, b in edges[:5]] + [(ids[0], ids[0])]
    got = {r["node"]: r["root"] for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots(edges).items() if k != v}
    assert M.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_thousands_of_copies(spark):
    rng = random.Random(4)
    same, long = prose(50, rng), prose(100_000, rng)
    rows = [(None, same), (1, None), (2, ""), (3, "!!! ..."), (4, "one"), (5, "One!"), (6, long), (7, long), (8, same), (8, same)] + [(100 + i, same) for i in range(1500)]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: (r["kept_doc_id"], r["similarity"]) for r in M.duplicates(clash(docs)).collect()}
    assert got == {5: (4, 1.0), 7: (6, 1.0)} | {100 + i: (8, 1.0) for i in range(1500)}
    left = M.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter(r[0] for r in left.collect()) == Counter([None, 1, 2, 3, 4, 6, 8])
    empty = docs.limit(0)
    assert M.duplicates(empty).count() == 0 and M.deduplicated(empty).count() == 0


def test_large_buckets_are_cut_and_lose_no_link(spark):
    """A chain of near copies, a crowd of them, and copies that share a bucket with neither."""
    rng = random.Random(15)
    base = prose(120, rng)
    rows = [(i, edited(base, 0.01, rng)) for i in range(150)]
    chain = [edited(base, 0.25, rng)]
    for _ in range(40):
        chain.append(edited(chain[-1], 0.05, rng))
    rows += [(200 + i, t) for i, t in enumerate(chain)] + [(300 + i, t) for i, t in enumerate([prose(60, rng)] * 30)] + [(400 + i, t) for i, (_, t) in enumerate(corpus(rng))]
    docs = docs_of(spark, rows).repartition(4)
    whole = {tuple(r) for r in M.duplicates(docs).collect()}
    for size in (4, 25):
        assert {tuple(r) for r in M.duplicates(docs, M.Params(bucket=size)).collect()} == whole
    p = M.Params(bucket=3)
    m = np.random.default_rng(5).integers(0, 1 << 63, (6, p.perms), np.uint64)
    m[3], m[4] = m[0], m[0]
    sig = M.pack(m, p).view(np.int64).tolist()
    members = spark.createDataFrame([(1, i, sig[i], r) for i, r in enumerate([0, 1, 1, 1, 0, 5])], "key long, id long, sig array<bigint>, root long")
    assert {tuple(sorted(r)) for r in M.cross_edges(members, p).collect()} <= {(0, 3), (3, 4)} and M.cross_edges(members, p).count() >= 1


def test_an_id_with_two_texts_counts_once(spark):
    rng = random.Random(14)
    a, b = prose(60, rng), prose(60, rng)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, prose(60, rng))]
    assert {(r["doc_id"], r["kept_doc_id"]) for r in M.duplicates(docs_of(spark, rows)).collect()} == {(2, 1), (3, 1)}
    assert sorted(r[0] for r in M.deduplicated(docs_of(spark, rows)).collect()) == [1, 4]


def test_buckets_that_cross_arrow_batches(spark):
    rng = random.Random(5)
    base = prose(300, rng)
    rows = [(i, edited(base, 0.01, rng)) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r["kept_doc_id"] for r in M.duplicates(docs_of(spark, rows)).collect()} == {0}
        assert M.duplicates(docs_of(spark, rows)).count() == 299
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# decontamination


def fewest(a, b):
    """Edits between a and the nearest stretch of b, cell by cell."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for c in b:
        new = [0]
        for i, x in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def spoiled(t, n, rng):
    t = list(t)
    for _ in range(n):
        j = rng.randrange(len(t))
        k = rng.randrange(3)
        if k == 0:
            del t[j]
        elif k == 1:
            t.insert(j, rng.choice("abcxyz"))
        else:
            t[j] = rng.choice("abcxyz")
    return "".join(t)


def test_found_items_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng.randint(10, 30), rng)) for i in range(20)] + [(50, None), (51, ""), (52, "...!"), (54, "Xyz qux"), (53, "é" * 30 + " " + prose(8, rng))]
    rows = []
    for i in range(60):
        k, t = items[rng.choice([*range(20), 24])]
        n = [0, int(0.02 * len(t)), int(0.05 * len(t)), int(0.05 * len(t)) + 1, int(0.12 * len(t)) + 2][i % 5]
        rows.append((i, f"{prose(8, rng)} {spoiled(t, n, rng).upper() if i % 7 == 0 else spoiled(t, n, rng)}\n{prose(8, rng)}"))
    rows += [(100 + i, prose(30, rng)) for i in range(20)] + [(200, None), (201, ""), (202, "x"), (204, "and xyz, Qux!"), (205, "vxyz qux and xyz quxes xyz"), (203, prose(5000, rng) + " " + items[3][1] + " " + prose(5000, rng)), (3, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS Item_Id_", "2 AS TEXT")
    p = D.Params()
    want = set()
    for i, t in rows:
        for k, x in items:
            f = D.fold_text(x) if x else b""
            if f and t and i != 203:
                e = fewest(f, D.fold_text(t)) if len(f) >= 20 else 9 * (b" " + f + b" " not in b" " + D.fold_text(t) + b" ")
                if e <= int(p.max_edits * len(f)):
                    want.add((i, k, e))
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in D.found(clash(docs_of(spark, rows)), bench).collect())
    assert (203, 3, 0) in got and all(n == (2 if i == 3 else 1) for (i, _, _), n in got.items())
    found = {(i, k) for i, k, _ in got} - {(203, 3)}
    sure = {(i, k) for i, k, _ in want}
    assert found <= sure and len(found) >= 0.95 * len(sure)
    assert {x for x in got if x[0] != 203} <= want
    left = D.clean(docs_of(spark, rows), bench)
    assert sorted(r[0] for r in left.collect()) == sorted(i for i, _ in rows if i not in {i for i, _ in found} | {203})
    assert D.found(docs_of(spark, []), bench).count() == 0 and D.found(docs_of(spark, rows), bench.limit(0)).count() == 0 and D.clean(docs_of(spark, rows), bench.limit(0)).count() == len(rows)
    named = pick(bench, "item_id", "text").selectExpr("concat('i', item_id) AS item_id", "text")
    passes = D.found(docs_of(spark, rows).selectExpr("concat('d', doc_id) AS doc_id", "text"), named, D.Params(items_per_pass=7))
    assert len({(r["doc_id"], r["item_id"]) for r in passes.collect()} ^ {(f"d{i}", f"i{k}") for i, k, _ in got}) <= 0.1 * len(sure)
    assert {r[0] for r in D.clean(docs_of(spark, rows), named, D.Params(bytes_per_pass=1500)).collect()} >= {r[0] for r in left.collect()}
    twice = D.found(docs_of(spark, [(1, "xyz qux")]), pick(bench, "item_id", "text").union(pick(bench, "item_id", "text"))).collect()
    assert [tuple(r) for r in twice] == [(1, 54, 0)] * 2


@pytest.mark.parametrize("size, copies", [(20, 400), (60, 400), (200, 400), (2000, 150), (20_000, 40)])
def test_recall_at_the_limit_by_length(size, copies):
    """Copies with as many edits as are allowed, in context, beside items of other lengths."""
    rng = random.Random(size)
    items = [(i, prose(rng.choice([4, 20, 70]), rng)) for i in range(30)] + [(100 + i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(size - 2)) + "qq") for i in range(20)]
    items = [(i, t) for i, t in items if i < 100 or len(D.fold_text(t)) > 0.8 * size]
    index, found, tried = D.Index(items), 0, 0
    for n in range(copies):
        i, t = items[30 + n % (len(items) - 30)]
        f = D.fold_text(t).decode()
        raw = f"{prose(30, rng)} {spoiled(f, int(0.05 * len(f)), rng)} {prose(30, rng)}".encode()
        found += any(k == i for _, k, _ in index.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        tried += 1
    assert found >= 0.99 * tried


def test_memory_is_free_of_the_items_length():
    import tracemalloc

    rng = random.Random(14)
    item = prose(18_000, rng)
    f = D.fold_text(item).decode()
    assert len(f) > 90_000
    raw = f"{prose(30, rng)} {spoiled(f, 50, rng)} {prose(30, rng)}".encode()
    tracemalloc.start()
    got = D.Index([(1, item), (2, prose(20, rng))]).find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r, i) for r, i, e in got if 0 < e <= 50] == [(0, 1)] and peak < 500e6


def test_edits_equal_the_plain_table():
    rng = random.Random(13)
    for _ in range(40):
        a, b = spoiled(prose(4, rng), 3, rng), prose(6, rng)
        assert D.best_edits(a.encode(), b.encode(), 1000) == fewest(a, b)


def test_capitals_with_marks_are_the_same_letters():
    item = "Été à l'école où le garçon ÇÀ et là des œuvres naïves, très élevées"
    raw = ("x " + item.upper().replace(" ", "!! ") + " y").encode()
    found = D.Index([(9, item)]).find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [(r, i) for r, i, _ in found] == [(0, 9)]
    assert shingles("Été Çà et là ×") == shingles("ÉTÉ ÇÀ ET LÀ ×")


# packing


def test_packing_keeps_limits_and_all_tokens(spark):
    rng = random.Random(7)
    p = K.Params(max_tokens=120, max_segments=5, max_loss=80, group_size=40)
    rows = [(c, t, ["user", "assistant"][t % 2], prose(rng.choice([1, 5, 20, 90]), rng)) for c in range(80) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "x"), (200, 0, "user", None), (201, 0, "assistant", ""), (202, 0, "assistant", prose(900, rng)), (203, 1, None, "hello there"), (203, 1, None, "hello there")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS TURN", "2 AS bin_id", "3 AS id")
    got = K.packed_conversations(conv, p).collect()
    use = defaultdict(lambda: np.zeros(3, int))
    for r in got:
        use[r["bin_id"]] += (r["tokens"], r["segments"], r["loss_tokens"])
    assert all((u <= (p.max_tokens, p.max_segments, p.max_loss)).all() for u in use.values())
    enc = K.encoder(p.vocabulary)
    tokens, loss = Counter(), Counter()
    for c, _, role, t in rows:
        if c is not None and t:
            n = len(enc.encode_ordinary(t))
            tokens[c] += n
            loss[c] += n * (role == "assistant")
    assert Counter({r["conv_id"]: 0 for r in got}) | tokens == tokens
    seen, bears = Counter(), Counter()
    by = defaultdict(list)
    for r in got:
        seen[r["conv_id"]] += r["tokens"]
        bears[r["conv_id"]] += r["loss_tokens"]
        by[r["conv_id"]].append((r["piece"], r["first_token"], r["tokens"]))
    assert seen == tokens and +bears == +loss
    for parts in by.values():
        at = 0
        for k, (piece, first, n) in enumerate(sorted(parts)):
            assert piece == k and first == at
            at += n
    places = defaultdict(list)
    for r in got:
        places[r["bin_id"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    filled = sum(max(u / (p.max_tokens, p.max_segments, p.max_loss)) >= p.full for u in use.values())
    assert filled >= len(use) - 4
    assert K.packed_conversations(conv.limit(0), p).count() == 0


def brute_pack(demand):
    """One bin after another: the fitting example with the largest weighted product, the first of equals."""
    left, bins, w = list(range(len(demand))), {}, demand.mean(0)
    b = -1
    while left:
        b, room = b + 1, np.ones(3)
        while True:
            fits = [i for i in left if (demand[i] <= room + 1e-9).all()]
            if not fits:
                break
            best = max(fits, key=lambda i: (round(float((w * demand[i] * room).sum()), 12), -i))
            bins[best] = b
            room = room - demand[best]
            left.remove(best)
    return [bins[i] for i in range(len(demand))]


def test_heuristic_equals_brute_force_and_fills_well():
    rng = np.random.default_rng(8)
    for _ in range(10):
        d = rng.integers(1, 60, (60, 3)) / 100
        bins, _ = K.pack(d)
        assert bins.tolist() == brute_pack(d)
    assert bins.max() + 1 <= 1.4 * d.sum(0).max() + 2


def test_documents_of_every_kind(spark):
    rng = random.Random(9)
    p = K.Params(max_tokens=200, max_loss=200)
    rows = [(1, None), (2, ""), (None, "x"), (3, "hello"), (3, "hello"), (4, prose(2000, rng)), (5, "y" * 20_000)]
    got = K.packed_documents(clash(docs_of(spark, rows)), p).collect()
    assert {r["doc_id"] for r in got} == {3, 4, 5} and sum(r["doc_id"] == 3 for r in got) == 2
    assert sum(r["tokens"] for r in got if r["doc_id"] == 4) == len(K.encoder(p.vocabulary).encode_ordinary(rows[5][1]))
    assert all(r["tokens"] <= 200 for r in got)
    assert sum(r["tokens"] for r in got if r["doc_id"] == 5) == len(K.encoder(p.vocabulary).encode_ordinary("y" * 20_000))


# sharding


def test_shards_equal_sql_and_hold_the_mixture(spark):
    rng = random.Random(10)
    rows = [(i, None, "en", rng.choice(["a"] * 8 + ["b"] * 3 + [None]), 0) for i in range(500)] + [(None, "t", "en", "b", 0), (7, "t", "en", "a", 0), (7, "t", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    p = H.Params(shards=7)
    got = H.interleaved(docs.selectExpr("*", "1 AS SOURCE", "2 AS h", "3 AS r", "4 AS position"), p).toPandas()
    assert sorted(got["position"]) == list(range(len(rows)))
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = con.sql(f"""WITH r AS (SELECT doc_id, source, md5(concat_ws(':', '17', CAST(doc_id AS BIGINT))) AS h FROM documents),
        f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM r)
        SELECT doc_id, source, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST) - 1 AS position FROM f""").df()
    key = lambda df: sorted((x.position, -1 if np.isnan(float(x.doc_id)) else int(x.doc_id), x.source or "") for x in df.astype(object).where(df.notna(), None).itertuples() if x.doc_id is not None)
    assert key(got) == key(want)
    whole = Counter(r[3] for r in rows)
    for _, part in got.groupby("shard"):
        mix = Counter(x if isinstance(x, str) else None for x in part["source"])
        assert all(abs(mix[s] - len(part) * n / len(rows)) <= 2 for s, n in whole.items())
    assert H.interleaved(docs.limit(0), p).count() == 0 and H.interleaved(docs.limit(3), p).count() == 3


# top-k


def brute_top(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and not any(x is None or x != x for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(v)
    out = {}
    for i, a in good.items():
        s = sorted((-round(float(a @ b), 9), j) for j, b in good.items() if j != i)
        out[i] = [(j, -x + 0.0) for x, j in s[:k]]
    return out


@pytest.mark.parametrize("p", [T.Params(k=5, block_rows=32), T.Params(k=5, bins=4, slack=1, block_rows=16, rounds=20), T.Params(k=500, block_rows=64), T.Params(k=5, block_rows=16, every=20)])
def test_top_k_equals_brute_force(spark, p):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(0, rows[0][1]), (300, None), (301, [0.0] * 8), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (None, rows[1][1]), (304, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS Block", "2 AS score", "3 AS EMBEDDING").repartition(5)
    got = defaultdict(list)
    for r in sorted(T.top_k(df, p).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {q: v for q, v in brute_top(rows, p.k).items() if q % p.every == 0}
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-9)


def test_an_id_with_two_vectors_is_two_queries(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), T.Params(k=1)).collect())
    assert got == [(1, 1, 2), (1, 1, 3), (2, 1, 1), (3, 1, 1)]


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(empty).count() == 0
    assert T.top_k(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).count() == 0


# link graph


def hosts_of(spark, names):
    return spark.createDataFrame([(n, "x") for n in names], "host string, HOST_ string")


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    hosts = [f"h{i}.example.com" for i in range(12)] + ["good.example.org", "www.good.example.org", "m.bad.example.net", "bets.example.com"]
    trusted, blocked = ["GOOD.example.org", "h3.example.com", "good.example.org", None, "nowhere.example.org"], ["www.bad.example.net", "bets.example.com", "bets.example.com"]
    rows = []
    for i in range(80):
        h = rng.choice(hosts)
        links = "".join(f"<p><a class='x' href=\"{rng.choice(['http://', 'https://', '//', 'HTTPS://'])}{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}{rng.choice(['', '/a?b', ':80/'])}\">t</a> <a href='/own'>o</a>" for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{h}/p{i}", links))
    rows += [(100, None, "<a href='http://h1.example.com'>"), (101, "no host", "x"), (102, "http://h2.example.com/", None), (103, "http://h2.example.com/", ""), (None, "http://h2.example.com/", "x" * 2_000_000 + "<a href=//only.example.com>"), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = hosts_of(spark, trusted), hosts_of(spark, blocked)
    con = duckdb.connect()
    pages = df.toPandas()  # noqa: F841
    con.register("pages", pages)
    key = lambda r: (r[0] is None or r[0] != r[0], r[0] or 0, r[1] or "")
    want = sorted(con.sql("SELECT CAST(page_id AS BIGINT), host, trust, distrust, blocked FROM (" + G.sql([t for t in trusted if t], blocked) + ")").fetchall(), key=key)
    got = sorted((tuple(r) for r in G.page_verdicts(df.selectExpr("*", "1 AS HOST", "2 AS trust", "3 AS URL"), *seeds).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[4] == b[4] and abs(a[2] - b[2]) < 2e-6 and abs(a[3] - b[3]) < 2e-6
    by = {r[0]: r for r in got}
    assert by[100][1] is None and not by[100][4] and (None, "only.example.com") in {r[:2] for r in got}
    # and by plain matrices
    names, edges = G.host_graph(df)
    e = [(r["src"], r["dst"], r["weight"]) for r in edges.collect()]
    all_ = sorted(r["host"] for r in names.collect())
    at = {h: i for i, h in enumerate(all_)}
    w = np.zeros((len(all_), len(all_)))
    for a, b, x in e:
        w[at[a], at[b]] += x
    p = G.Params()
    shares = {}
    for name, m, of in (("trust", w, {"good.example.org", "www.good.example.org", "h3.example.com"}), ("distrust", w.T, {"bad.example.net", "m.bad.example.net", "bets.example.com"})):
        seed = np.array([h in of for h in all_], float)
        step = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        s, u = seed, np.ones(len(all_))
        for _ in range(p.iterations):
            r, v = p.damping * (s @ step), p.damping * (u @ step)
            s, u = (1 - p.damping) * seed + r, (1 - p.damping) + v
        shares[name] = np.where(seed > 0, 1, np.divide(r, v, out=np.zeros_like(r), where=v > 0))
    for r in G.host_verdicts(df, *seeds).collect():
        assert abs(r["trust"] - shares["trust"][at[r["host"]]]) < 1e-5 and abs(r["distrust"] - shares["distrust"][at[r["host"]]]) < 1e-5
    assert G.page_verdicts(df.limit(0), *seeds).count() == 0
    unseeded = G.page_verdicts(df, hosts_of(spark, []), hosts_of(spark, [])).agg({"trust": "max", "distrust": "max"}).first()
    assert tuple(unseeded) == (0, 0)


@pytest.mark.parametrize("seeds", [1, 10_000])
def test_neighbours_of_blocked_hosts_whatever_the_number_of_seeds_and_links(spark, seeds):
    """300 hosts link to one blocked hub, and one host links to each of those; hosts that link to ordinary ones stay."""
    a = lambda h: f"<a href='http://{h}/'>"
    rows = [(i, f"http://fan{i}.example.com/", a("hub.example.com")) for i in range(300)] + [(400, "http://far.example.com/", a("fan0.example.com")), (401, "http://clean.example.com/", a("paper.example.com"))]
    rows += [(402, "http://mixed.example.com/", a("hub.example.com") + "".join(a(f"one{i}.example.com") for i in range(20)))]
    rows += [(1000 + i, f"http://seed{i}.example.com/", a("hub.example.com")) for i in range(1, seeds)]
    blocked = ["hub.example.com"] + [f"seed{i}.example.com" for i in range(1, seeds)]
    got = {r["host"]: r for r in G.host_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), hosts_of(spark, ["paper.example.com"]), hosts_of(spark, blocked)).collect()}
    assert all(got[f"fan{i}.example.com"]["blocked"] for i in range(300)) and got["hub.example.com"]["blocked"]
    assert not any(got[f"{h}.example.com"]["blocked"] for h in ("clean", "paper", "mixed", "one3"))
