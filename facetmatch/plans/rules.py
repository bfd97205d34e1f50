"""Queries of the rules that the made catalogue never meets: one case or more a rule, whose expected results were worked out by hand from the rules themselves, in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions import display, market
from facetmatch.functions.text import match_normalize, type_normalize
from facetmatch.functions.variants import market_splits, strip_descriptors, variants
from facetmatch.operators import contract
from facetmatch.registry import query


def values(rows: list[tuple], *names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({', '.join(names)})"


#: rule, query, a variant that it makes
LENS_CASES = [
    ("LV1", "Nikkor 50mm f1.8", "Nikkor 50mm f/1.8"), ("LV1", "Nikkor 50mm 1:1.8", "Nikkor 50mm f/1.8"), ("LV1", "Nikkor 50mm f/ 1.8", "Nikkor 50mm f/1.8"), ("LV2", "aus Jena Biotar 58mm", "Carl Zeiss Jena Biotar 58mm"), ("LV2", "Carl Zeiss aus Jena Tessar", "Carl Zeiss Jena Tessar"),
    ("LV3", "Elmar 13.5 cm f/4", "Elmar 135mm f/4"), ("LV4", "Vivitar 70.210mm f/4", "Vivitar 70-210mm f/4"), ("LV5", "Nikon Nikkor-H 50mm", "Nikon Nikkor 50mm"), ("LV5", "W-Nikkor.C 3.5", "Nikkor 3.5"), ("LV5", "Reflex-Nikkor 500mm", "Reflex Nikkor 500mm"),
    ("LV6", "Nikon 28mm f/2.8", "Nikon Nikkor 28mm f/2.8"), ("LV6", "Minolta 50mm", "Minolta Rokkor 50mm"), ("LV6", "Olympus 50mm", "Olympus Zuiko 50mm"), ("LV6", "Konica 40mm", "Konica Hexanon 40mm"), ("LV6", "Fujifilm GX 100mm", "Fujinon GX 100mm"), ("LV7", "Helios 44-M 58mm", "Helios 44M 58mm"),
    ("LV8", "Canon 85mm f/1.8", "Canon EF 85mm f/1.8"), ("LV8", "Canon 85mm f/1.8", "Canon FD 85mm f/1.8"), ("LV9", "KMZ/LZOS Jupiter-9", "Jupiter-9"), ("LV10", "Jupiter 9 85mm", "Jupiter-9 85mm"), ("LV11", "Mir-26B 45mm", "Mir-26 45mm"), ("LV12", "Helios MC 58mm f/2", "Helios-44 MC 58mm f/2"),
    ("LV12", "Helios MC 85mm", "Helios-40 MC 85mm"), ("LV13", "OM Zuiko 50mm", "OM-System Zuiko 50mm"), ("LV14", "Leica Summicron 50mm", "Leica Summicron-M 50mm"), ("LV15", "Canon FD 50mm", "Canon FDn 50mm"), ("LV15", "Canon FDn 50mm", "Canon FD 50mm"), ("LV15", "Canon New FD 50mm", "Canon FDn 50mm"),
    ("LV16", "Pentax Takumar 55mm", "Asahi Takumar 55mm"), ("LV16", "Super-Takumar 55mm", "Asahi Super-Takumar 55mm"), ("LV17", "Canon FD 55mm S.S.C.", "Canon FD 55mm SSC"), ("LV17", "Canon FD 55mm SSC", "Canon FD 55mm S.S.C."), ("LV18", "Tokina f/4.0", "Tokina f/4"), ("LV18", "Tokina f/4", "Tokina f/4.0"),
    ("LV19", 'Elmar "red" (boxed) rigid 50', "Elmar red 50"),
]
CAMERA_CASES = [
    ("CV1", "Nikon F3HP", "Nikon F 3 HP"), ("CV2", "Olympus OM-10", "Olympus OM10"), ("CV3", "Kyocera Samurai X3", "Samurai X3"), ("CV3", "Tokyo Kogaku Primo", "Primo"), ("CV4", "Zorki 3 C", "Zorki 3 S"), ("CV5", "Lubitel Sputnik", "Lubitel Spoutnik"), ("CV6", "Exacta Varex", "Exakta Varex"), ("CV6", "Exakta VX", "Exacta VX"),
    ("CV7", "Nikon Nikonos I", "Nikonos"), ("CV8", "Rollei Rollei 35 S", "Rollei 35 S"), ("CV9", "Asahi Pentax K1000", "Pentax K1000"), ("CV9", "Asahi Spotmatic", "Pentax Spotmatic"), ("CV10", "Fujica GW690", "Fuji GW690"), ("CV10", "Fujica GW690", "Fujifilm GW690"), ("CV11", "Olympus SP-590 UZ", "Olympus SP-590 Ultra Zoom"),
    ("CV11", "Olympus SP-590 Ultra Zoom", "Olympus SP-590UZ"), ("CV12", "Polaroid Land Camera 250", "Polaroid 250"), ("CV13", "Nikon Zoom Touch 500", "Nikon Zoom.Touch 500"), ("CV13", "Nikon Lite.Touch", "Nikon Lite Touch"), ("CV14", "Panasonic LX100", "Panasonic Lumix DMC-LX100"), ("CV14", "Panasonic Lumix GH5", "Panasonic Lumix DC-GH5"),
    ("CV15", "Rolleiflex Carl Zeiss 2.8", "Rolleiflex 2.8"), ("CV16", "Canon Sureshot Owl", "Canon Sure Shot Owl"), ("CV17", "Samsung L200", "Samsung Digimax L200"), ("CV18", "Canon QL19", "Canon Canonet QL19"), ("CV18", "Canonet G-III QL17", "Canonet QL17 GIII"), ("CV19", "Zeiss Ikon Contessa 533/24", "Contessa 533/24"),
    ("CV19", "Zeiss Ikon Contessa 533/24", "Zeiss Ikon Contessa"), ("CV19", "Zeiss Ikon Contessa 533/24", "Contessa"), ("CV20", "Kodak VPK Autographic", "Vest Pocket Kodak Autographic"), ("CV21", "Argus Minca C3", "Argus C3"), ("CV21", "Golden Shield by Argus", "Argus C3"), ("CV21", "Argus C3 the brick", "Argus C3"), ("CV21", "Argus C21 Markfinder", "Argus 21"),
    ("CV22", "Zeiss Contarex Cyclops", "Zeiss Contarex I"), ("CV23", "Super Ikonta A", "Super Ikonta 531"), ("CV23", "Zeiss Ikon Super Ikonta D", "Super Ikonta 530/15"), ("CV24", "Zeiss Ikonta 52116", "Zeiss Ikonta 521/16"), ("CV25", "Kiev 3a", "Kiev-IIIa"), ("CV25", "Kiev-2", "Kiev-II"), ("CV26", "Konica Minolta Z1", "minolta Z1"), ("CV26", "Fujifilm X10", "fujica X10"),
    ("CV27", "Leica IIIf red dial (1951)", "Leica IIIf"), ("CV27", "Voigtlander Bessa early folding camera", "Voigtlander Bessa"), ("CV27", "Kodak Retina with case", "Kodak Retina"), ("CV27", "Ricoh 500 half-frame late model", "Ricoh 500"), ("CV27", "Nikon F Model F", "Nikon F"), ("CV28", "Minolta Maxxum 5", "minolta dynax 5"), ("CV28", "Pentax ZX-5", "pentax mz 5"),
    ("CV28", "Yashica Mat 124", "yashica yashica-mat 124"), ("CV28", "Olympus Stylus Zoom", "olympus µ zoom"), ("CV29", "Nikon N6006", "nikon f601"), ("CV29", "Minolta X-570", "minolta x 500"), ("CV29", "Minolta SRT-303", "minolta srt 202"), ("CV29", "Canon Rebel XS", "canon eos 1000d"), ("CV29", "Canon EOS 30", "canon elan 7e"), ("CV29", "Leica R5", "leica r4-r7"),
    ("CV30", "Pentax Spotmatic SPII", "Pentax Spotmatic II"), ("CV30", "Asahi Spotmatic SP F", "Asahi Spotmatic F"), ("CV30", "Pentax Spotmatic SP", "Pentax Spotmatic"), ("CV31", "Olympus Stylus Epic", "Olympus mju II"), ("CV31", "Olympus Mju-I", "Olympus mju"), ("CV31", "Olympus mju II", "Olympus Stylus Epic"), ("CV31", "Olympus Stylus 800", "Olympus mju 800"),
    ("CV32", "Canon F-1 Mk2", "Canon F-1 Mark II"), ("CV32", "Ricoh GR Mark iii", "Ricoh GR Mk III"), ("CV33", "Canon 5D", "Canon EOS 5D"), ("CV33", "Canon EOS R5", "Canon R5"), ("CV34", "Asahi iqzoom 105", "asahi espio 105"),
]
VARIANTS = [("lens", *c) for c in LENS_CASES] + [("camera", *c) for c in CAMERA_CASES]


@query(f"SELECT kind, rule, query, variant, true AS made FROM {values(VARIANTS, 'kind', 'rule', 'query', 'variant')}")
def variant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LV1 to LV19, CV1 to CV34."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(made=[v in variants(q, k) for k, q, v in zip(pdf["kind"], pdf["query"], pdf["variant"])])

    return spark.createDataFrame(VARIANTS, "kind string, rule string, query string, variant string").mapInPandas(run, "kind string, rule string, query string, variant string, made boolean")


#: query, what is left without descriptors (null: nothing to try), one of the parts by market
SPLITS = [
    ("Canon P rangefinder", "Canon P", None), ("Leica camera", None, None), ("Zorki 4 Soviet rangefinder 35mm", "Zorki 4", "Zorki 4 Soviet"), ("Pentax point and shoot", None, "Pentax point and"), ("Nikon N90s / F90x", None, "Nikon F90x"), ("Canon EOS 600D aka Rebel T3i", None, "Canon Rebel T3i"),
    ("Kodak Brownie 127 box camera", "Kodak Brownie", "Kodak 127 box"), ("Minolta X-370 made in Japan", "Minolta X-370", "Minolta X-370 made"), ("Agfa 6x9 view camera", None, "Agfa 6x9"),
]


@query(f"SELECT query, stripped, part, CASE WHEN part IS NOT NULL THEN 1 ELSE 0 END AS made FROM {values(SPLITS, 'query', 'stripped', 'part')}")
def split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM18, BM19."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"query": pdf["query"], "stripped": [strip_descriptors(q) for q in pdf["query"]], "part": pdf["part"], "made": [int(p is not None and p in market_splits(q)) for q, p in zip(pdf["query"], pdf["part"])]})

    return spark.createDataFrame([(q, p) for q, _, p in SPLITS], "query string, part string").mapInPandas(run, "query string, stripped string, part string, made int")


#: raw, its batch form, its typeahead form
FORMS = [
    ("MN1", "NIKON F", "nikon f", "nikon f"), ("MN2", "Voigtländer", "voigtlander", "voigtlander"), ("TN2", "Olympus µ-II", "olympus mju 2", "olympus mju ii"), ("TN3", "Rolleiflex 2,8", "rolleiflex 2.8", "rolleiflex 2.8"), ("TN4", "Kodak No. 3", "kodak n 3", "kodak n 3"), ("TN4", "Kodak No 3", "kodak n 3", "kodak n 3"),
    ("TN4", "Kodak N° 3", None, "kodak n 3"), ("TN5", "Nikkor 5cm", None, "nikkor 50 mm"), ("TN5", "Sonnar 13,5 cm", None, "sonnar 135 mm"), ("TN6", "F3HP", None, "f 3 hp"), ("TN6", "F3 HP", None, "f 3 hp"), ("TN6", "44-M", None, "44 m"), ("TN7", "5D MkII", None, "5 d mk ii"), ("TN7", "5D Mk2", None, "5 d mk ii"), ("TN7", "5D Mark 2", None, "5 d mk ii"),
    ("TN7", "5D Mark II", None, "5 d mk ii"), ("TN8", "f/1.4", "f 1.4", "f 1.4"), ("TN8", "S.S.C.", None, "s s c"), ("TN9", "", "", ""), ("TN9", " - ", None, ""), ("TN9", None, "", ""), ("MN3", "α7", "alpha 7", None), ("MN7", "Zorki (1956) 4", "zorki 4", None), ("MN8", "Leica M3 black body only", "leica m3", None), ("MN10", "50 mm", "50mm", None), ("MN11", "Canon Mark II", "canon mark 2", None),
]


@query(f"SELECT rule, raw, batch, typed FROM {values(FORMS, 'rule', 'raw', 'batch', 'typed')}")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TN1 to TN9 and rare branches of MN: a null form isn't stated for that case."""
    df = spark.createDataFrame([(r, x, b is not None, t is not None) for r, x, b, t in FORMS], "rule string, raw string, b boolean, t boolean")
    return df.select("rule", "raw", F.when(F.col("b"), match_normalize(F.col("raw"))).alias("batch"), F.when(F.col("t"), type_normalize(F.col("raw"))).alias("typed"))


#: brand, market, word of the groups of words, by hand
WORDS = [
    ("minolta", 0, "us", "freedom"), ("minolta", 0, "intl", "riva"), ("minolta", 0, "jp", "capios"), ("minolta", 1, "us", "maxxum"), ("minolta", 1, "eu", "dynax"), ("minolta", 1, "jp", "alpha"), ("pentax", 0, "us", "iqzoom"), ("pentax", 0, "intl", "espio"), ("pentax", 1, "us", "zx"), ("pentax", 1, "intl", "mz"),
    ("olympus", 0, "us", "stylus"), ("olympus", 0, "intl", "mju"), ("nikon", 0, "intl", "nikkormat"), ("nikon", 0, "jp", "nikomat"), ("canon", 0, "us", "sure shot"), ("canon", 0, "eu", "prima"), ("canon", 0, "jp", "autoboy"), ("exakta", 0, "us", "vx"), ("exakta", 0, "intl", "varex"), ("ihagee", 0, "us", "vx"),
    ("ihagee", 0, "intl", "varex"), ("samsung", 0, "us", "maxima"), ("samsung", 0, "intl", "af zoom"), ("samsung", 0, "eu", "vega"), ("ricoh", 0, "us", "kr"), ("ricoh", 0, "intl", "xr"),
]


@query(f"SELECT brand, grp, market, term FROM {values(WORDS, 'brand', 'grp', 'market', 'term')}")
def market_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK1."""
    return market.market_terms(spark).where("level = 'token'").select("brand", "grp", "market", "term")


#: brand, how many groups of models there are, and one of them
MODEL_GROUPS = [("nikon", 18, "us:n90s intl:f90x"), ("canon", 38, "us:elan 7ne intl:eos 30v"), ("minolta", 17, "intl:riva zoom 75w us:freedom zoom explorer ex jp:capios 75"), ("pentax", 4, "us:iqzoom 115v intl:espio 115m"), ("yashica", 2, "us:imagination micro intl:micro elite"), ("olympus", 7, "intl:mju-ii us:stylus epic"), ("fuji", 1, "intl:dl us:discovery")]


@query(f"SELECT brand, n, sample, true AS there FROM {values(MODEL_GROUPS, 'brand', 'n', 'sample')}")
def market_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK2."""
    terms = market.market_terms(spark).where("level = 'model'")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "market", "term"))), lambda x: F.concat(x["market"], F.lit(":"), x["term"])), " ")
    groups = terms.groupBy("brand", "grp").agg(named.alias("line")).groupBy("brand").agg(F.count("*").cast("int").alias("n"), F.collect_list("line").alias("lines"))
    cases = spark.createDataFrame([(b, s) for b, _, s in MODEL_GROUPS], "brand string, sample string")
    return groups.join(cases, "brand").select("brand", "n", "sample", F.array_contains("lines", F.col("sample")).alias("there"))


#: from, to: what the derived tables hold
DERIVED = [
    ("synonyms", None, "freedom|riva|capios"), ("synonyms", None, "mju ii|stylus epic"), ("synonyms", None, "srt 201|srt 101b"), ("swaps", "minolta", "freedom>riva|freedom>capios|riva>capios|maxxum>dynax|maxxum>alpha|dynax>alpha"), ("swaps", "canon", "sure shot>prima|sure shot>autoboy|prima>autoboy"), ("swaps", "leica", ""),
    ("models", "minolta", "srt 303>srt 102,srt 202"), ("models", "minolta", "x 570>x 500"), ("models", "olympus", "mju ii>stylus epic,infinity stylus epic"), ("models", "canon", "eos 5>a2,a2e"), ("models", "minolta", "freedom zoom 150>riva zoom 150,capios 150"),
]


@query(f"SELECT name, brand, line, true AS there FROM {values(DERIVED, 'name', 'brand', 'line')}")
def market_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MK3 to MK5."""
    rows = [("synonyms", None, "|".join(g)) for g in market.synonym_groups()]
    brands = {b for _, b, _ in DERIVED if b}
    rows += [("swaps", b, "|".join(f"{x}>{y}" for x, y in market.token_swaps(b))) for b in brands] + [("models", b, f"{k}>{','.join(v)}") for b in brands for k, v in market.model_map(b).items()]
    made = spark.createDataFrame(rows, "name string, brand string, line string").distinct()
    cases = spark.createDataFrame(DERIVED, "name string, brand string, line string")
    return cases.join(made.withColumn("there", F.lit(True)), (cases["name"] == made["name"]) & cases["brand"].eqNullSafe(made["brand"]) & (cases["line"] == made["line"]), "left").select(cases["name"], cases["brand"], cases["line"], F.coalesce("there", F.lit(False)).alias("there"))


#: tokens, label, rewriting
TYPED = [("stylus epic", None, "stylus epic"), ("stylus epic", "mju ii", "mju ii"), ("minolta maxxum 7000", "dynax", "minolta dynax 7000"), ("nikon f 90 x", "n90s", "nikon n 90 s"), ("canon rebel xt", "eos 350d", "canon eos 350 d")]


@query(f"SELECT q, label, made, true AS there FROM {values(TYPED, 'q', 'label', 'made')}")
def typed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TN12."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(there=[(m.split(), l) in market.type_variants(q.split()) for q, l, m in zip(pdf["q"], pdf["label"], pdf["made"])])

    return spark.createDataFrame(TYPED, "q string, label string, made string").mapInPandas(run, "q string, label string, made string, there boolean")


@query("SELECT 'rebel x' AS q, 0 AS swapped UNION ALL SELECT 'canon kiss x 4', 0")
def kiss_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TN13: no rewriting puts one of the two words for the other."""
    rows = [(q, sum(other in t for t, _ in market.type_variants(q.split()))) for q, other in (("rebel x", "kiss"), ("canon kiss x 4", "rebel"))]
    return spark.createDataFrame(rows, "q string, swapped int")


#: hash, page, q, kind, id
ROUTES = [("", "landing", None, None, None), ("#/", "landing", None, None, None), ("#/search?q=canon%20p", "search", "canon p", None, None), ("#/search", "search", "", None, None), ("#/camera/ab12", "detail", None, "camera", "ab12"), ("#/lens/cd34", "detail", None, "lens", "cd34"), ("#/camera", "landing", None, None, None), ("#/browse?kind=lens", "browse", None, None, None), ("#/other", "landing", None, None, None)]


@query(f"SELECT hash, page, q, kind, id FROM {values(ROUTES, 'hash', 'page', 'q', 'kind', 'id')}")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL1."""
    df = spark.createDataFrame([(r[0],) for r in ROUTES], "hash string")
    return df.select("hash", display.route(F.col("hash")).alias("r")).select("hash", "r.page", "r.q", "r.kind", "r.id")


#: type, traits before; body, traits, medium, ltype after
LEGACY = [("slr", None, "slr", None, None, None), ("folding", "stereo", None, "stereo,folding", None, None), ("folder", None, None, "folding", None, None), ("folder", "folding", None, "folding", None, None), ("instant", None, None, None, "instant", None), ("half-frame", "toy", None, "toy", None, None), ("zoom", None, None, None, None, "zoom"), (None, "toy", None, "toy", None, None)]


@query(f"SELECT type, before, body, traits, medium, ltype FROM {values(LEGACY, 'type', 'before', 'body', 'traits', 'medium', 'ltype')}")
def legacy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL2."""
    df = spark.createDataFrame([r[:2] for r in LEGACY], "type string, before string")
    params = F.map_filter(F.create_map(F.lit("type"), F.col("type"), F.lit("traits"), F.col("before")), lambda k, v: v.isNotNull())
    new = df.select("type", "before", display.legacy_params(params).alias("p"))
    return new.select("type", "before", *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("body", "traits", "medium", "ltype")])


LINKS = [("camera", "ab12", "Nikon F", "#/camera/ab12", "https://issues.example.org/new?title=Correction%3A+Nikon+F&labels=camera"), ("lens", "c d", "f/2", "#/lens/c+d", "https://issues.example.org/new?title=Correction%3A+f%2F2&labels=lens")]


@query(f"SELECT kind, id, record, correction FROM {values(LINKS, 'kind', 'id', 'name', 'record', 'correction')}")
def record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL3."""
    df = spark.createDataFrame([r[:3] for r in LINKS], "kind string, id string, name string")
    return df.select("kind", "id", display.record_href(F.col("kind"), F.col("id")).alias("record"), display.correction_href("https://issues.example.org/new", F.col("kind"), F.col("name")).alias("correction"))


#: kind, then what is unlike a sound record, then the rules broken
SOUND = {"name": "Nikon F", "recommended_name": "Nikon F", "manufacturer": "Nikon", "format": "35mm"}
BROKEN: list[tuple[str, str, dict, tuple[str, ...]]] = [
    ("a0", "camera", {}, ()), ("a1", "camera", {"body_type": "blob"}, ("body_type.enum",)), ("a2", "camera", {"traits": ["shiny"]}, ("traits.enum",)), ("a3", "camera", {"traits": []}, ("traits.shape",)), ("a4", "camera", {"traits": ["toy", "folding"]}, ("traits.unsorted",)),
    ("a5", "camera", {"traits": ["toy", "toy"]}, ("traits.duplicate",)), ("a6", "camera", {"traits": ["folding"], "folding": 0}, ("folding.contradiction",)), ("a7", "camera", {"folding": 1}, ()), ("a8", "lens", {"body_type": "slr", "max_aperture": "f/2"}, ("body_type.on-lens",)), ("a9", "camera", {"mounts": ["M42"]}, ("mounts.on-camera",)),
    ("b0", "lens", {"mounts": ["M42, M39"], "lens_type": "zoom"}, ("mounts.comma",)), ("b1", "lens", {"mount": "M42", "mounts": ["M39", "M42"]}, ("mount.joined",)), ("b2", "camera", {"recommended_name": ""}, ("recommended_name.missing",)), ("b3", "lens", {}, ("lens.no-optics",)), ("b4", "lens", {"filter_size": "52"}, ()),
    ("b5", "lens", {"name": "Carl Carl 50", "recommended_name": "Carl 50", "focal_length": "50mm"}, ("lens.doubled-brand",)), ("b6", "camera", {"manufacturer": "SMC"}, ("manufacturer.prefix",)), ("b7", "camera", {"manufacturer": " Colour "}, ("manufacturer.prefix",)), ("b8", "camera", {"manufacturer": "Ernst"}, ("manufacturer.half",)), ("b9", "camera", {"manufacturer": "Inconnue"}, ("manufacturer.placeholder",)),
    ("c0", "camera", {"manufacturer": "KW"}, ()), ("c1", "camera", {"name": "Rolleiflex 2,8"}, ()), ("c2", "camera", {"recommended_name": "Rolleiflex 2,8"}, ("name.decimal-comma",)), ("c3", "camera", {"recommended_name": "Foca 2e Modèle"}, ("name.french-noun",)), ("c4", "camera", {"recommended_name": "Heiland Premiere"}, ()), ("c5", "camera", {"name": "Bronica lenses"}, ("record.index-page",)),
    ("c6", "lens", {"name": "DKL lens mount", "min_focus": "1 m"}, ("record.index-page",)), ("c7", "camera", {"iso_manual_range": "25�400"}, ("iso_manual_range.replacement-character",)), ("c8", "camera", {"dx_range": "�"}, ("dx_range.replacement-character",)), ("c9", "camera", {"also_takes": [("120", "glue")]}, ("also_takes.via",)),
    ("d0", "camera", {"format": "620"}, ("also_takes.respool",)), ("d1", "camera", {"format": "620", "also_takes": [("120", "respool")]}, ()), ("d2", "camera", {"market_names": [("Nikon F", "mars")]}, ("market_names.label", "market_names.only-itself")), ("d3", "camera", {"exposure_modes": ["wizard"]}, ("exposure.enum",)), ("d4", "camera", {"market_names": [("Nikon F", "us"), ("Nikon Ef", "jp")]}, ("market_names.unreachable",)),
]
SCHEMA = """id string, kind string, name string, recommended_name string, manufacturer string, format string, body_type string, traits array<string>, folding int, mounts array<string>, mount string, focal_length string, focal_min_mm double, max_aperture string, min_aperture string,
    filter_size string, elements_groups string, min_focus string, lens_type string, iso_manual_range string, dx_range string, also_takes array<struct<format:string,via:string>>, market_names array<struct<name:string,market:string>>, exposure_modes array<string>"""
ALIASES = [("x1", "a0", "market", "us", None, ()), ("x2", "a0", "name", "us", None, ("alias.market-without-via",)), ("x3/y", "a0", "market", "us", None, ("alias.separator",)), ("x4", "a0", "guess", None, None, ("alias.via",)), ("x5", "b4", "market", "eu", None, ("alias.market-on-lens",)), ("x6", "zz", "name", None, None, ("alias.orphan",)), ("x7", "a0", "name", None, "nikon-f", ("alias.legacy-slug",))]
REDIRECTS = [("r1", "camera", "a0", ()), ("r2", "camera", "a0", ("redirect.ambiguous",)), ("r2", "camera", "a1", ()), ("r3", "camera", "r3", ("redirect.self",)), ("r4", "camera", "gone", ("redirect.dangling",)), ("a2", "camera", "a0", ("redirect.from-live",)), ("r5", "camera", "r1", ())]
FOUND = [(code, i) for i, _, _, codes in BROKEN for code in codes] + [(code, a[1]) for a in ALIASES for code in a[-1]] + [(code, r[0]) for r in REDIRECTS for code in r[-1]]


@query(f"SELECT code, id FROM {values(FOUND, 'code', 'id')}")
def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VA1 to VA15, each rule by a record that breaks it alone, and by sound ones."""
    names = [c.split()[0] for c in re.split(r",\s+", SCHEMA)]
    records = spark.createDataFrame([tuple(({"id": i, "kind": k} | SOUND | unlike).get(n) for n in names) for i, k, unlike, _ in BROKEN], SCHEMA)
    aliases = spark.createDataFrame([(a, "lens" if i == "b4" else "camera", i, via, m, slug) for a, i, via, m, slug, _ in ALIASES], "alias string, kind string, id string, via string, market string, record_slug string")
    redirects = spark.createDataFrame([r[:3] for r in REDIRECTS], "from_id string, kind string, to_id string")
    return contract.validate(records, aliases, redirects, display.BODY_TYPES, tuple(display.TRAITS))
