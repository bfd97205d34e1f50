"""Steps that must not grow with the square of rows that are alike."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from facetmatch.functions import text
from facetmatch.operators import browse, matching
from facetmatch.operators.catalog import build, stored
from facetmatch.operators.search import Limits, Lookup, cover_hits, prefix_hits, search_batch
from facetmatch.plans import searches
from facetmatch.registry import QUERIES, SQL
from facetmatch.sources import testdata
from facetmatch.sources.testdata import Asset
from tests.test_queries import canon

COPIES = 40
NAMES = ["canon ae 1", "canon ae 2", "canon f 1", "nikon f 1", "nikon fa"]


def copied(spark):
    """Each name under many ids. Names in rows of meta differ, so that rows of one text have an order of their own."""
    rows = [(n, "lens" if i % 3 == 0 else "camera", f"{i * 7919 % 1009:04d}-{j}", "") for j, n in enumerate(NAMES) for i in range(COPIES)]
    index = spark.createDataFrame(rows, "n string, kind string, id string, shown string")
    meta = {i: (f"name {int(i[:4]) * 31 % 17}", ["high", "low", "medium"][int(i[:4]) % 3]) for _, _, i, _ in rows}
    return rows, index, meta, spark.createDataFrame([(i, *m) for i, m in meta.items()], "id string, name string, confidence string")


def plain(rows, meta, q, scan, limit):
    """Tiers of one text by loops, with the bound on a beginning's rows in order of text and id."""
    hits = [(int(n != q), n, k, i) for n, k, i, _ in sorted(rows, key=lambda r: (r[0], r[2])) if n.startswith(q)][:scan]
    hits += [(2, n, k, i) for n, k, i, _ in rows if not n.startswith(q) and all(any(w.startswith(t) for w in n.split()) for t in q.split())]
    keyed = sorted((t, len(n), {"high": 0, "low": 2}.get(meta[i][1], 1), k != "camera", meta[i][0], i) for t, n, k, i in hits)
    return [(r[5], r[0]) for r in keyed[:limit]]


def test_copies_of_a_text_are_met_once(spark):
    rows, index, meta, table = copied(spark)
    queries = ["canon ae", "canon", "f 1", "canon f 1", "nik f", "c 2", "nikon f"]
    for scan in (6000, 2 * COPIES + 9, 13):
        limits = Limits(prefix_scan=scan)
        forms = spark.createDataFrame([(q, q, 0, None) for q in queries], "query_id string, q string, offset int, label string")
        hits = Lookup(index, table, limits, 5).hits(forms)
        assert hits.groupBy("query_id", "n").count().agg(F.max("count")).first()[0] <= 5
        got = {}
        for r in search_batch(spark.createDataFrame([(i, q) for i, q in enumerate(queries * 2)], "query_id long, raw string"), index, table, 5, limits).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["tier"]))
        for i, q in enumerate(queries * 2):
            assert got[i] == plain(rows, meta, q, scan, 5), (q, scan)


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_related_records_do_not_pair_all_rows_of_a_maker(spark):
    rows = [(i, f"{i:05d}", "camera", "M", f"T{i % 3}", [["a", "b"], ["a"], ["c"], []][i % 4], 0 if i % 50 == 0 else 1000 + i * 17 % 1500) for i in range(1500)]
    r = spark.createDataFrame(rows, "ord long, id string, kind string, manufacturer string, body_type string, traits array<string>, year int")
    before = shuffled(spark)
    got = {}
    for x in browse.same_maker(r).orderBy("id", "rank").collect():
        got.setdefault(x["id"], []).append(x["related"])
    assert shuffled(spark) - before < 3_000_000
    for a in rows[::97]:
        far = lambda b: 0 if a[6] == 0 else 1_000_000 if b[6] == 0 else abs(b[6] - a[6])
        near = sorted((b[4] != a[4], -len({*a[5]} & {*b[5]}), far(b), b[0], b[1]) for b in rows if b[1] != a[1])
        assert got[a[1]] == [x[4] for x in near[:4]], a


def test_added_aliases_keep_to_their_record(spark):
    """At sf0.1 records share names; an alias is its own record's alone."""
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    want = con.sql(SQL["corrected_aliases"]).fetchall()
    assert sorted(map(str, map(tuple, QUERIES["corrected_aliases"](spark, "/root/testdata/sf0.1").collect()))) == sorted(map(str, want))


def copies(at, times):
    """sf0.001 so many times, with shifted keys."""
    at.mkdir()
    shift = {"part": {"p_partkey": 200}, "events": {"user_id": 1500}, "lineitem": {"l_partkey": 200}, "supplier": {}, "nation": {}}
    for t, by in shift.items():
        moved = f" REPLACE ({', '.join(f'{c} + {n} * i AS {c}' for c, n in by.items())})" if by else ""
        duckdb.sql(f"COPY (SELECT * EXCLUDE (i) {moved} FROM '/root/testdata/sf0.001/{t}.parquet', range({times if by else 1}) r(i)) TO '{at}/{t}.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["ranked_hits", "token_cover", "prefix_search"])
def test_searches_of_copies_equal_sql(spark, tmp_path, name):
    """Texts with 64 rows and queries each."""
    at = copies(tmp_path / "64", 64)
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got, want = QUERIES[name](spark, at).toPandas(), con.sql(SQL[name]).df()
    assert len(want) > 1000 and canon(got) == canon(want)


@pytest.mark.parametrize("hits, tier, most", [(prefix_hits, 1, 4_000_000), (cover_hits, 2, 4_000_000)])
def test_callers_travel_as_bare_ids(spark, hits, tier, most):
    """Each of the texts meets 1,000 callers, whose list goes with it; offsets and labels stay each caller's own."""
    texts = [f"{'' if tier == 1 else 'old '}canon model {i}" for i in range(400)]
    index = spark.createDataFrame([(n, "camera", f"{i:04d}", "") for i, n in enumerate(texts)], "n string, kind string, id string, shown string")
    callers = [(i * 7919 % 1000, "canon mod", i % 2 * 3, ["eu", None][i % 2]) for i in range(1000)]
    forms = spark.createDataFrame(callers, "query_id long, q string, offset int, label string")
    before = shuffled(spark)
    got = hits(forms, index, Limits()).select("query_id", "n", "tier", "label").collect()
    assert shuffled(spark) - before < most
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, n, o + tier, x)) for i, _, o, x in callers for n in texts)


@pytest.mark.parametrize("hits", [prefix_hits, cover_hits])
def test_callers_are_exploded_apart_from_the_join(spark, hits):
    """Compiled into one step, a text's rows times its callers would be held at once."""
    index = spark.createDataFrame([("old canon", "camera", "a", "")], "n string, kind string, id string, shown string")
    forms = spark.createDataFrame([(1, "canon", 0, None), (2, "old", 0, None)], "query_id long, q string, offset int, label string")
    lines = hits(forms, index, Limits())._jdf.queryExecution().executedPlan().toString().split("\n")
    below = lines[next(i for i, x in enumerate(lines) if "Generate explode(callers" in x) + 1 :]
    assert next(i for i, x in enumerate(below) if "Coalesce" in x) < next(i for i, x in enumerate(below) if "Join" in x)


@pytest.mark.parametrize("typed", [False, True])
def test_queries_alike_are_normalised_once(spark, tmp_path, monkeypatch, typed):
    """In 64 copies the queries repeat; the form of each, or of its beginnings, is worked out once, not for everyone who asks."""
    at, made = copies(tmp_path / "64", 64), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(searches, "type_normalize", F.udf(lambda x: made.add(1) or x.lower()))
    queries = [(r["query_id"], r["query"]) for r in testdata.match_queries(spark, at).collect()]
    begun = lambda x: {" ".join(x.lower().split(" ")[:k]) for k in range(2, len(x.split(" ")) + 1)} if typed else {x.lower()}
    got = searches.literal(spark, at, typed).collect()
    assert sorted((r["query_id"], r["q"]) for r in got) == sorted((i, x) for i, t in queries for x in begun(t))
    distinct = {t for _, t in queries}
    assert len(distinct) < len(queries) / 4 and made.value <= sum(len(begun(t)) for t in distinct)


def test_aliases_of_repeated_parts_equal_sql(spark, tmp_path):
    """A part that stands twice has each alias twice, not four times: aliases are made row by row, without a join of the parts with themselves."""
    at = copies(tmp_path / "twice", 1)
    duckdb.sql(f"COPY (SELECT * EXCLUDE (i) FROM '/root/testdata/sf0.001/part.parquet', range(2) r(i)) TO '{at}/part.parquet'")
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got, want = QUERIES["alias_orphans_anti"](spark, at).toPandas(), con.sql(SQL["alias_orphans_anti"]).df()
    assert len(want) > 0 and canon(got) == canon(want)


@pytest.mark.parametrize("name", ["index_rows", "engine_inputs"])
def test_names_are_worked_out_once(spark, name):
    """The normal form stands once in the plan, above an exchange that spreads the names, not in a filter and again in each branch."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


ODD = [None, "", "ß ẞ İI ά Å Å é é Σς", " no. 5 µ: 3 x (a\nb) No 7", "5 \t mm\x0b 5\x85mm", "1,5 II iv i", "\x1c a \x1d", "ﬁ ǅ Ⅳ", "𝒜 mm", "kit-box BODY ONLY", "VIII x", "İstanbul no.5", "ΑΣ Σ: α a7", "alpha a7 ®x"]


def test_running_text_is_normalised_in_python_alike(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").repartition(3)
    both = rows.select("i", text.match_normalize(F.col("text")).alias("a"), text.match_normalize_long(F.col("text")).alias("b")).collect()
    assert len(both) == len(ODD) and all(r["a"] == r["b"] is not None for r in both), both


@pytest.mark.parametrize("name", ["norm_documents", "digit_seqs"])
def test_documents_are_normalised_once_in_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("match_normalize_long(") >= 1 and "translate(" not in plan


def test_queries_alike_are_matched_once(spark, monkeypatch):
    passes, real = [], matching.match_pass
    monkeypatch.setattr(matching, "match_pass", lambda q, *x: passes.append(q.count()) or real(q, *x))
    records = spark.createDataFrame([(0, "a", "camera", "Canon AE-1", "Canon AE-1", "high"), (1, "b", "camera", "Nikon F3", "Nikon F3", "high")], "ord long, id string, kind string, name string, recommended_name string, confidence string")
    none = spark.createDataFrame([], "ord long, slot int, alias string, kind string, id string, via string, market string")
    catalog = stored(build(Asset(records, none, spark.createDataFrame([], "ord long, from_id string, kind string, to_id string"))))
    rows = [(i, ["Canon AE-1", "Nikon F3", None][i % 3], [None, "camera"][i % 2]) for i in range(30)]
    got = {r["query_id"]: r for r in matching.match_batch(spark.createDataFrame(rows, "query_id long, query string, kind string"), catalog).collect()}
    assert len(got) == 30 and passes[0] == 6
    assert all(got[i]["best_id"] == ["a", "b", None][i % 3] and got[i]["query"] == (q or "") for i, q, _ in rows)
