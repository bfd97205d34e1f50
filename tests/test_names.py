"""Normal forms, variants, similarities and display lines: golden cases, and columns against their Python counterparts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmatch.functions import display, market, similarity, text, variants


def col(spark, rows, f, kind="s string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], kind).select(f).collect()]


MATCH = {
    "Voigtländer Bessa III": "voigtlander bessa 3", "Olympus µ: Zoom 140": "olympus mju zoom 140", "Sony Alpha A77": "sony alpha 77", "Sony α77": "sony alpha 77", "Rolleiflex 2,8 E2": "rolleiflex 2.8 e2",
    "Kodak No. 2 Brownie": "kodak n 2 brownie", "Canon P (black) body only": "canon p", "Leica M3 chrome boxed": "leica m3", "50 mm f/1.4": "50mm f 1.4", "Kiev-4 v": "kiev 4 5", "v series": "v series", "Großformat X": "grossformat 10", "": "", "   ": "", "®™©": "",
    "Зенит E": "e", "A & B + C_D/E": "a b c d e", "No-2": "no 2",
}


def test_match_forms(spark):
    assert [text.match_normalize_text(k) for k in MATCH] == [*MATCH.values()]
    assert col(spark, [*MATCH], text.match_normalize(F.col("s"))) == [*MATCH.values()]
    assert col(spark, [None], text.match_normalize(F.col("s"))) == [""]
    assert text.match_normalize_text(text.match_normalize_text("No-2")) == "n 2"  # not idempotent, on purpose


TYPE = {"Voigtländer": "voigtlander", "µ-II": "mju ii", "2,8": "2.8", "No. 2": "n 2", "No 2": "n 2", "N° 2": "n 2", "5cm": "50 mm", "50mm": "50 mm", "13.5 cm": "135 mm", "F3HP": "f 3 hp", "F3 HP": "f 3 hp", "44-M": "44 m", "44M": "44 m", "MkII": "mk ii", "Mk2": "mk ii", "Mark 2": "mk ii", "Mark II": "mk ii", "f/1.4": "f 1.4", "S.S.C.": "s s c", "": "", "  ?! ": "", "x" * 300: "x" * 300}


def test_type_forms(spark):
    assert [text.type_normalize_text(k) for k in TYPE] == [*TYPE.values()]
    assert col(spark, [*TYPE], text.type_normalize(F.col("s"))) == [*TYPE.values()]


def test_column_and_python_forms_agree(spark):
    chars = st.text(alphabet="abcxyzMKNOno.0123456789 ,-/()µμα&®éüßÅ°_+'\n\t", max_size=30)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(chars, min_size=150, max_size=150))
    def check(rows):
        assert col(spark, rows, text.match_normalize(F.col("s"))) == [text.match_normalize_text(r) for r in rows]
        assert col(spark, rows, text.type_normalize(F.col("s"))) == [text.type_normalize_text(r) for r in rows]

    check()


def test_slug_digits_escape_first(spark):
    assert col(spark, ["Canon AE-1!", "--x--"], text.slugify(F.col("s"))) == ["canon-ae-1", "x"]
    assert col(spark, ["2.8 80mm 35"], text.digits_of(F.col("s"))) == [["2.8", "80", "35"]]
    assert col(spark, ['<a href="x">&'], text.html_escape(F.col("s"))) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert col(spark, ["a-b-c"], text.first_only(F.col("s"), "-", "+")) == ["a+b-c"]


def plain_grams(s):
    s = "  " + s.replace(" ", "") + " "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def test_similarities(spark):
    pairs = [("canon ae 1", "canon a 1"), ("", ""), ("leica m3", "nikon f"), ("aaa", "aaaa")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.dice(similarity.trigrams(F.col("a")), similarity.trigrams(F.col("b")))).collect()]
    for (a, b), g in zip(pairs, got):
        x, y = (plain_grams(text.match_normalize_text(v)) for v in (a, b))
        assert abs(g - 2 * len(x & y) / (len(x) + len(y))) < 1e-12
    assert got[1] == 1
    j = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>").select(similarity.jaccard(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in j] == [1 / 3, 0]


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_osa_against_recursion(a, b, most):
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(1 + d(i, j - 1), 1 + d(i - 1, j), (a[i - 1] != b[j - 1]) + d(i - 1, j - 1))
        if min(i, j) > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    assert similarity.osa(a, b, most) == min(d(len(a), len(b)), most + 1)


def test_osa_is_not_the_unrestricted_distance():
    assert similarity.osa("ca", "abc", 5) == 3


LENS = [
    ("Helios f2 58mm", "Helios-44 f2 58mm"), ("Nikon 50mm f1.4", "Nikon Nikkor 50mm f1.4"), ("Zeiss 5 cm", "Zeiss 50mm"), ("Sonnar aus Jena", "Sonnar aus Jena"), ("Vivitar 70.200mm", "Vivitar 70-200mm"), ("Nikkor-S.C 50mm", "Nikkor 50mm"),
    ("Helios 44-M", "Helios 44M"), ("Canon 50mm", "Canon FD 50mm"), ("KMZ Jupiter 9", "Jupiter 9"), ("Jupiter 9", "Jupiter-9"), ("Mir-26B", "Mir-26"), ("OM Zuiko 50", "OM-System Zuiko 50"), ("Summicron 50", "Summicron-M 50"), ("FD 50", "FDn 50"),
    ("Takumar 55", "Asahi Takumar 55"), ("Pentax Takumar 55", "Asahi Takumar 55"), ("FD 50 S.S.C.", "FD 50 SSC"), ("Nikkor 50 f/1", "Nikkor 50 f/1.0"), ("Planar (mint) chrome", "Planar"), ("Nikkor 1:1.8", "Nikkor f/1.8"), ("Sonnar Carl Zeiss aus Jena", "Sonnar Carl Zeiss Jena"),
]
CAMERA = [
    ("Nikon F3HP", "Nikon F 3 HP"), ("Olympus OM-10", "Olympus OM10"), ("KMZ Zenit E", "Zenit E"), ("Zorki 4 C", "Zorki 4 S"), ("Sputnik", "Spoutnik"), ("Exacta VX", "Exakta VX"), ("Nikon Nikonos I", "Nikonos"), ("Leica Leica M3", "Leica M3"), ("Asahi Spotmatic", "Pentax Spotmatic"),
    ("Fuji GW690", "Fujica GW690"), ("Olympus SP 590 UZ", "Olympus SP 590 Ultra Zoom"), ("Polaroid Land Camera 100", "Polaroid 100"), ("Nikon Lite Touch", "Nikon Lite.Touch"), ("Panasonic TZ10", "Panasonic Lumix DMC-TZ10"), ("Rolleiflex Planar 2.8", "Rolleiflex 2.8"), ("Canon Sureshot", "Canon Sure Shot"),
    ("Samsung L100", "Samsung Digimax L100"), ("Canon G-III QL17", "Canon Canonet QL17 GIII"), ("Zeiss Ikon Nettar 515/2", "Nettar"), ("VPK", "Vest Pocket Kodak"), ("Minca C3", "Argus C3"), ("Argus C21 the brick", "Argus 21"), ("Contarex Bullseye", "Contarex I"), ("Super Ikonta BX", "Super Ikonta 533/16"),
    ("Zeiss Nettar 53216", "Zeiss Nettar 532/16"), ("Kiev 2a", "Kiev-IIa"), ("Konica Minolta Dimage", "minolta Dimage"), ("Leica IIIc red dial (nice)", "Leica IIIc"), ("Yashica Mat-124G", "yashica yashica-mat 124g"), ("Nikon N90s", "nikon f90x"), ("Canon Rebel XS", "canon eos 1000d"), ("Pentax Spotmatic SP II", "Pentax Spotmatic II"),
    ("Olympus Stylus Epic", "Olympus mju II"), ("Canon F-1 Mk2", "Canon F-1 Mark II"), ("Canon 5D", "Canon EOS 5D"), ("Minolta Maxxum 7000", "minolta dynax 7000"), ("Exakta VX", "exakta varex"),
]


@pytest.mark.parametrize("query, want", LENS)
def test_lens_rules(query, want):
    made = variants.lens_variants(query)
    assert made[0] == query and len(made) <= 18 and len(set(made)) == len(made) and want in made


@pytest.mark.parametrize("query, want", CAMERA)
def test_camera_rules(query, want):
    made = variants.camera_variants(query)
    assert made[0] == query and len(made) <= 24 and len(set(made)) == len(made) and want in made


def test_sub_queries():
    assert variants.strip_descriptors("Canon P rangefinder") == "Canon P" and variants.strip_descriptors("Leica camera") is None and variants.strip_descriptors("Canon P") is None
    assert "Canon Rebel T3i" in variants.market_splits("Canon EOS 600D / Rebel T3i")
    assert variants.sub_queries("Canon P rangefinder")[0] == ("Canon P", True)


def test_market_tables():
    assert ("maxxum", "dynax") in market.token_swaps("minolta") and len(market.token_swaps("minolta")) == 6
    assert market.model_map("nikon")["n90s"] == ["f90x"] and market.model_map("nikon")["f90x"] == ["n90s"]
    assert sum(1 for r in {(r[1], r[2]) for r in market.rows() if r[0] == "model"}) == 87
    out = market.type_variants(["stylus", "epic"])
    assert out[0] == (["stylus", "epic"], None) and ["mju", "2"] in [t for t, _ in out] and ["mju", "ii"] in [t for t, _ in out]
    assert not any("kiss" in t for t, _ in market.type_variants(["rebel", "x", "rebel"]))


def test_facts_lines(spark):
    rows = [("film", "35mm", None, "rangefinder", ["folding"]), ("digital", None, 12.0, "slr", None), ("film", "35mm", None, "compact", ["point-and-shoot"]), ("film", "120", None, "box", ["stereo"]), ("film", "35mm", None, "pseudo-tlr", None), ("digital", None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "medium string, format string, sensor_resolution_mp double, body_type string, traits array<string>")
    df = df.selectExpr("*", "cast(null AS struct<focal_length:string,focal_min_mm:double,focal_max_mm:double,max_aperture:string>) AS fixed_lens", "cast(null AS string) AS focal_length", "cast(null AS double) AS focal_min_mm", "cast(null AS double) AS focal_max_mm", "cast(null AS string) AS max_aperture", "cast(null AS array<string>) AS mounts")
    got = [r[0] for r in df.select(display.facts_line(F.lit("camera"), F.col)).collect()]
    assert got == ["35mm folding · rangefinder", "Digital SLR · 12MP", "35mm · compact", "120 stereo · box", "35mm · Pseudo TLR", "Digital camera"]


def test_focal_and_years(spark):
    df = spark.createDataFrame([("x", 70.0, 200.0), ("5 cm", None, None), ("50", None, None), ("50 mm", None, None), (None, None, None), ("odd", None, None), ("x", 50.0, 50.0), ("", 28.0, None), ("x", 35.04, 105.06)], "raw string, lo double, hi double")
    assert [r[0] for r in df.select(display.focal(F.col("raw"), F.col("lo"), F.col("hi"))).collect()] == ["70–200mm", "50mm", "50mm", "50mm", "", "odd", "50mm", "", "35–105.1mm"]
    df = spark.createDataFrame([(1950, 1960), (0, None), (1950, None), (None, 1960), (1950, 1950)], "a int, b int")
    assert [r[0] for r in df.select(display.years_range(F.col("a"), F.col("b"))).collect()] == ["1950 – 1960", "", "1950", "", "1950 – 1950"]


def test_hazards(spark):
    df = spark.createDataFrame([("126", None), ("120", ["LR44"]), ("35mm", ["PX625"]), (" APS ", ["PX625A", "MR 9"]), (None, ["V625", "mercury cell"])], "film string, cells array<string>")
    got = [[(h["kind"], h["detail"]) for h in r[0]] for r in df.select(display.hazards(F.col("film"), F.col("cells"))).collect()]
    assert [[k for k, _ in h] for h in got] == [["film"], [], ["battery"], ["film", "battery"], ["battery"]]
    assert "PX625A" not in got[3][1][1] and "MR 9" in got[3][1][1] and "1999" in got[0][0][1]


def test_routes_and_legacy_links(spark):
    df = spark.createDataFrame([("#/",), ("#/search?q=canon%20p",), ("#/camera/ab12",), ("#/browse?kind=camera&type=slr",), ("",)], "h string").select(display.route(F.col("h")).alias("r"))
    got = [r[0] for r in df.collect()]
    assert [g["page"] for g in got] == ["landing", "search", "detail", "browse", "landing"] and got[1]["q"] == "canon p" and (got[2]["kind"], got[2]["id"]) == ("camera", "ab12")
    legacy = spark.createDataFrame([({"type": "slr"},), ({"type": "folder", "traits": "stereo"},), ({"type": "instant"},), ({"type": "half-frame", "kind": "camera"},), ({"type": "zoom"},), ({"kind": "lens"},)], "p map<string,string>").select(display.legacy_params(F.col("p")))
    assert [r[0] for r in legacy.collect()] == [{"body": "slr"}, {"traits": "stereo,folding"}, {"medium": "instant"}, {"kind": "camera"}, {"ltype": "zoom"}, {"kind": "lens"}]
