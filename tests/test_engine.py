"""The engine on small catalogues: golden cases of matching, search, browsing, names, the contract and corrections."""

import json

import pytest
from pyspark.sql import functions as F

from facetmatch.functions.text import type_normalize
from facetmatch.operators import browse, contract, names, overlay
from facetmatch.operators.browse import Filters
from facetmatch.operators.matching import Policy, match_batch, qualifier_conflict
from facetmatch.operators.search import search_batch
from facetmatch.operators.catalog import build, index_rows_of, stored
from facetmatch.sources import jsonl
from facetmatch.sources.testdata import Asset
from facetmatch.streaming.match_stream import match_stream, windowed_events

CAMERAS = ["Canon Canonet G-III QL17", "Canon New Canonet QL17", "Canon P", "Canon AE-1", "Canon EOS 1100D", "Yashica Yashica-Mat 124 G", "Nikon F3", "Nikon F90X", "Minolta X-700", "Olympus mju II", "Leica M3", "Rolleicord IV", "Leotax F", "Rolleiflex 2.8 E2", "Polaroid 100", "Sony alpha 77", "Meyer Trioplan 2016 reissue camera"]
LENSES = ["Helios-44M 58 mm f/2", "Nikon Nikkor 50mm f/1.4", "Canon FD 50mm f/1.4", "Jupiter-9 85mm f/2 (SLR)", "Vivitar 70-200mm f/3.5"]


@pytest.fixture(scope="module")
def asset(spark):
    rows = [(i, f"{i:016x}", "camera", n, n, "high") for i, n in enumerate(CAMERAS)] + [(100 + i, f"{100 + i:016x}", "lens", n, n, "medium") for i, n in enumerate(LENSES)]
    records = spark.createDataFrame(rows, "ord long, id string, kind string, name string, recommended_name string, confidence string")
    by = {n: f"{i:016x}" for i, n in enumerate(CAMERAS)}
    aliases = spark.createDataFrame([(0, "Nikon N90s", "camera", by["Nikon F90X"], "market", "us"), (1, "Olympus Stylus Epic", "camera", by["Olympus mju II"], "market", "us"), (2, "gone", "camera", "ffff", "name", None), (3, "Canon P", "camera", by["Canon P"], "name", None)], "slot int, alias string, kind string, id string, via string, market string").withColumn("ord", F.col("slot").cast("long"))
    return Asset(records, aliases, spark.createDataFrame([], "ord long, from_id string, kind string, to_id string"))


@pytest.fixture(scope="module")
def catalog(asset):
    return stored(build(asset))


def matched(spark, catalog, rows, policy=Policy()):
    return {r["query"]: r for r in match_batch(spark.createDataFrame([(i, q, k) for i, (q, k) in enumerate(rows)], "query_id long, query string, kind string"), catalog, policy).collect()}


def test_matches(spark, catalog):
    r = matched(spark, catalog, [("Canon G-III QL17", "camera"), ("Yashica Mat-124G", "camera"), ("Helios 44-M 58mm f/2", "lens"), ("Nikon 50mm f/1.4", "lens"), ("Nikon N90s", "camera"), ("qwzx vvbn", None), ("", None), ("Rolleicord IV Type 2", "camera"), ("Canon P rangefinder", "camera"), ("Canonn AE-1", "camera"), ("Meyer Trioplan", "camera"), ("Canon EOS Rebel T3 1100D Kiss X50", "camera"), ("Minolta X-700", "lens"), ("Jupiter-9 85mm f/2 RF", "lens")])
    title = {q: x["best_title"] for q, x in r.items()}
    assert title["Canon G-III QL17"] == "Canon Canonet G-III QL17" and r["Canon G-III QL17"]["decision"] == "auto"
    assert title["Yashica Mat-124G"] == "Yashica Yashica-Mat 124 G" and r["Yashica Mat-124G"]["decision"] == "auto"
    assert title["Helios 44-M 58mm f/2"] == "Helios-44M 58 mm f/2" and r["Helios 44-M 58mm f/2"]["decision"] == "auto"
    assert title["Nikon 50mm f/1.4"] == "Nikon Nikkor 50mm f/1.4"
    assert title["Nikon N90s"] == "Nikon F90X" and r["Nikon N90s"]["decision"] == "auto"
    assert r["qwzx vvbn"]["decision"] == r[""]["decision"] == "no-match" and r[""]["scored"] == []
    assert r["Rolleicord IV Type 2"]["decision"] != "auto"
    assert title["Canon P rangefinder"] == "Canon P"
    assert title["Canonn AE-1"] == "Canon AE-1" and r["Canonn AE-1"]["decision"] != "no-match"
    assert r["Meyer Trioplan"]["best_score"] < 0.45 and r["Meyer Trioplan"]["decision"] == "no-match"
    assert r["Canon EOS Rebel T3 1100D Kiss X50"]["decision"] == "review"
    assert r["Minolta X-700"]["decision"] == "no-match"  # of the other kind
    assert r["Jupiter-9 85mm f/2 RF"]["best_score"] <= 0.4
    assert all(len(x["scored"]) <= 5 for x in r.values())


def test_broad_tokens_are_left_out(spark, catalog):
    """A token with more postings than the bound counts for nothing (trap 8)."""
    r = matched(spark, catalog, [("Canon", "camera"), ("Canon P", "camera")], Policy(broad=3))
    assert r["Canon"]["best_id"] is None and r["Canon P"]["best_title"] == "Canon P"
    assert matched(spark, catalog, [("Canon", "camera")])["Canon"]["best_id"] is not None


def test_qualifiers(spark):
    rows = [("Canonet QL17", "New Canonet QL17", True), ("New Canonet QL17", "New Canonet QL17", False), ("Canonet like new", "New Canonet QL17", True), ("Autoboy 2", "(New) Sure Shot/AF35M II/Autoboy 2", False), ("Jupiter 9 rf", "Jupiter 9 (SLR)", True), ("Trioplan", "Trioplan reissue", True), ("Sun camera", "New York Sun", False), ("x", "Kodak (new)", True)]
    df = spark.createDataFrame(rows, "q string, t string, want boolean").select("q", "want", qualifier_conflict(F.col("q"), F.col("t")).alias("got"))
    assert [(r["q"], r["got"]) for r in df.collect()] == [(q, w) for q, _, w in rows]


def hits(spark, asset, raws, limit=10):
    q = spark.createDataFrame([(r, r) for r in raws], "query_id string, raw string")
    out = {r: [] for r in raws}
    name = {r["id"]: r["name"] for r in asset.records.collect()}
    for h in search_batch(q, index_rows_of(asset), asset.records.select("id", "name", "confidence"), limit).orderBy("query_id", "rank").collect():
        out[h["query_id"]].append((name.get(h["id"]), h["matched_alias"], h["corrected"]))
    return out


def test_search(spark, asset):
    got = hits(spark, asset, ["Nikkon F3", "Cannon AE-1", "Minotla X-700", "Leotax", "Rolleiflex 2,8", "Rolleiflex 2.8", "mju ii", "µ-II", "stylus epic", "canon", "124", "?!", "a " * 9, "n90s"])
    for q, n in (("Nikkon F3", "Nikon F3"), ("Cannon AE-1", "Canon AE-1"), ("Minotla X-700", "Minolta X-700")):
        assert n in [x[0] for x in got[q][:3]] and got[q][0][2]
    assert got["Leotax"][0][0] == "Leotax F" and not got["Leotax"][0][2]
    assert got["Rolleiflex 2,8"] == got["Rolleiflex 2.8"] != []
    assert got["mju ii"][0][0] == got["µ-II"][0][0] == got["stylus epic"][0][0] == "Olympus mju II"
    assert got["?!"] == got["a " * 9] == []
    assert got["124"][0][0] == "Yashica Yashica-Mat 124 G" and got["n90s"][0][:2] == ("Nikon F90X", "Nikon N90s")
    assert {x[0] for x in got["canon"]} >= {"Canon P", "Canon AE-1"}


def test_browse(spark):
    rows = [(0, "a", "camera", "M", "slr", ["x", "y"], ["M42"], 1960), (1, "b", "camera", "N", "slr", ["x"], [], 0), (2, "c", "camera", "M", "tlr", ["y"], [], 1950), (3, "d", "lens", "M", "zoom", [], ["m42", "PK"], 1961), (4, "e", "camera", "M", None, None, None, 1970)]
    r = spark.createDataFrame(rows, "ord long, id string, kind string, manufacturer string, body_type string, traits array<string>, mounts array<string>, year int")
    counts = {(x["facet"], x["value"]): x["n"] for x in browse.facet_counts(r, Filters(kind="camera", body="slr")).collect()}
    assert counts == {("manufacturer", "M"): 1, ("manufacturer", "N"): 1, ("body", "slr"): 2, ("body", "tlr"): 1, ("mount", "M42"): 1}
    assert {x["value"]: x["n"] for x in browse.trait_counts(r, Filters(traits=("x",))).collect()} == {"x": 2, "y": 1}
    assert [x["id"] for x in browse.page(r, Filters(), sort="year").collect()] == ["c", "a", "d", "e", "b"]
    assert r.where(Filters().where()).count() == 5 and r.where(Filters(traits=("x",)).where()).count() == 2
    related = {(x["id"], x["rank"]): x["related"] for x in browse.same_maker(r).collect()}
    assert related[("a", 1)] == "c" and ("b", 1) not in related
    assert {(x["id"], x["related"]) for x in browse.mount_matches(r).collect()} == {("a", "d"), ("d", "a")}


def test_redirects(spark):
    r = spark.createDataFrame([(1, "a", "camera", "b"), (2, "b", "camera", "c"), (3, "p", "lens", "q"), (4, "q", "lens", "p"), (5, "s", "lens", "t"), (6, "s", "camera", "u"), (7, "z", "lens", "z")] + [(100 + i, f"n{i}", "lens", f"n{i + 1}") for i in range(20)], "ord long, from_id string, kind string, to_id string")
    ids = spark.createDataFrame([(x, None) for x in ("a", "p", "unknown", "s", "z", "n0")] + [("s", "lens"), ("a", "lens")], "id string, kind string")
    got = {(x["id"], x["kind"]): x["resolved"] for x in names.resolve(ids, r).collect()}
    assert got == {("a", None): "c", ("p", None): "q", ("unknown", None): "unknown", ("s", None): "u", ("z", None): "z", ("n0", None): "n16", ("s", "lens"): "t", ("a", "lens"): "a"}


def test_contract(spark):
    schema = "id string, kind string, name string, recommended_name string, body_type string, traits array<string>, folding int, market_names array<struct<name:string,market:string,primary:boolean>>"
    rows = [("1", "camera", "A", "A", "slr", ["folding", "stereo"], 1, None), ("2", "camera", "B", "B", "odd", [], None, None), ("3", "camera", "C", "C", "slr", ["stereo", "folding"], 0, None), ("4", "lens", "D", None, "slr", None, None, None), ("5", "camera", "E", "E", None, None, 1, [("X", "us", True)]), ("6", "camera", "F", "F", "slr", ["toy", "toy", "zzz"], None, None)]
    records = spark.createDataFrame(rows, schema)
    aliases = spark.createDataFrame([("q", "camera", "99", "name", None), ("a/b", "camera", "1", "market", "us"), ("n", "camera", "1", "name", "us")], "alias string, kind string, id string, via string, market string")
    redirects = spark.createDataFrame([("7", "camera", "7"), ("8", "camera", "1"), ("8", "camera", "2"), ("9", "camera", "nowhere")], "from_id string, kind string, to_id string")
    got = sorted((r["code"], r["id"]) for r in contract.validate(records, aliases, redirects, ("slr",), ("folding", "stereo", "toy")).collect())
    assert got == sorted([("body_type.enum", "2"), ("traits.shape", "2"), ("traits.unsorted", "3"), ("folding.contradiction", "3"), ("body_type.on-lens", "4"), ("recommended_name.missing", "4"), ("market_names.unreachable", "5"), ("traits.duplicate", "6"), ("traits.enum", "6"), ("alias.orphan", "99"), ("alias.separator", "1"), ("alias.market-without-via", "1"), ("redirect.self", "7"), ("redirect.ambiguous", "8"), ("redirect.dangling", "9")])
    ok = contract.validate(records.limit(0), aliases.limit(0), redirects.limit(0), (), ())
    assert contract.formatted(ok, {"cameras": 1200}, "asset") == "✓ asset satisfies contract v1 (1,200 cameras)" and contract.labels_cover(("a",), {"a": "A"})


def test_corrections(spark, tmp_path):
    lines = [{"kind": "camera", "name": "A", "set": {"maker": None, "year": 1950}, "aliases": ["Alpha"]}, {"kind": "camera", "name": "A", "set": {"year": 1951}}, {"kind": "camera", "name": "B", "set": {"year": 1}, "merge_into": "A"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    c = jsonl.corrections(spark, str(tmp_path / "c.jsonl"))
    records = spark.createDataFrame([("1", "A", "camera", "M", 1900), ("2", "B", "camera", "N", None), ("3", "C", "camera", None, 1970)], "id string, name string, kind string, maker string, year int")
    out = {r["name"]: (r["maker"], r["year"]) for r in overlay.apply_sets(records, c, ["maker", "year"]).collect()}
    assert out == {"A": (None, 1951), "B": ("N", None), "C": (None, 1970)}
    assert [tuple(r) for r in overlay.added_aliases(records, c).collect()] == [("Alpha", "camera", "1", "correction", None)]
    merges = spark.createDataFrame([("2", "camera", "1", 1), ("1", "camera", "3", 2), ("3", "camera", "nowhere", 3)], "from_id string, kind string, to_id string, ord long")
    kept, redirects, lost = overlay.merge(records, merges, ["maker", "year"])
    assert [(r["id"], r["maker"], r["year"]) for r in kept.collect()] == [("3", "N", 1970)]
    assert {(r["from_id"], r["to_id"]) for r in redirects.collect()} == {("2", "3"), ("1", "3")} and [r["reason"] for r in lost.collect()] == ["missing target"]
    loop = spark.createDataFrame([("1", "camera", "2", 1), ("2", "camera", "1", 2)], "from_id string, kind string, to_id string, ord long")
    kept, redirects, lost = overlay.merge(records, loop, ["year"])
    assert kept.count() == 3 and redirects.count() == 0 and {r["reason"] for r in lost.collect()} == {"cycle"}


def test_jsonl_round_trip(spark, tmp_path):
    good = {"id": "aa11", "name": "Canon P", "data": {"traits": ["folding"], "fixed_lens": {"focal_length": 50}}}
    (tmp_path / "cameras.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({"name": "no id"}) + "\n")
    (tmp_path / "lenses.jsonl").write_text(json.dumps({"id": "bb22", "name": "Helios"}) + "\n")
    r = jsonl.records_from_jsonl(spark, str(tmp_path / "cameras.jsonl"), str(tmp_path / "lenses.jsonl"))
    rows = r.orderBy("ord").collect()
    assert [(x["kind"], x["id"]) for x in rows] == [("camera", "aa11"), ("lens", "bb22")] and rows[0]["data"]["fixed_lens"]["focal_length"] == "50"
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "cameras.jsonl"), jsonl.RECORD).collect()
    index = r.select(type_normalize(F.col("name")).alias("n"), "id")
    jsonl.write_outputs(r.drop("ord"), index, r.select("id", "name"), index.agg(F.count("*").alias("n")), str(tmp_path / "out"))
    assert jsonl.load_record(spark, str(tmp_path / "out"), "aa11").first()["name"] == "Canon P" and jsonl.load_record(spark, str(tmp_path / "out"), "aaff").count() == 0
    twice = spark.createDataFrame([(1, "a", "old"), (2, "b", "x"), (3, "a", "new")], "ord long, id string, name string")
    assert [tuple(x) for x in jsonl.latest_by_id(twice).orderBy("ord").collect()] == [(1, "a", "new"), (2, "b", "x")]
    inputs = jsonl.engine_inputs(twice, jsonl.latest_by_id(twice).withColumn("confidence", F.lit(None).cast("string")), spark.createDataFrame([("a", "low")], "id string, confidence string"))
    assert {(x["id"], x["confidence"]) for x in inputs.collect()} == {("a", "low"), ("b", "medium")}


def test_streams(spark, catalog, tmp_path):
    spark.createDataFrame([(1, "Canon P", "camera"), (2, "zzz", None)], "query_id long, query string, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id long, query string, kind string").parquet(f"{tmp_path}/in")
    match_stream(stream, catalog, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r["query_id"], r["decision"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "auto"), (2, "no-match")}
    assert windowed_events(spark, "/root/testdata/sf0.001/events.parquet").isStreaming
