"""Queries of the display lines, over records with all fields of cameras and lenses, dealt to parts by number. The fields are the same SQL in both engines; the lines' SQL is written from the rules, not from the functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions import display
from facetmatch.registry import query
from facetmatch.sources.testdata import table


def dealt(n: int, *values: str | None) -> str:
    """A value by number modulo n; null beyond the last."""
    kinds = [repr(v) if isinstance(v, str) else v for v in values]
    return f"CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(kinds) if v is not None) + " ELSE NULL END"


FIELDS = {
    "kind": "CASE WHEN p_partkey % 4 = 0 THEN 'lens' ELSE 'camera' END", "medium": dealt(7, "digital", "instant", None, "film", "film", "film", "film"), "format": dealt(5, "35mm", "120", "digital", None, "126"), "frame_size": dealt(3, "6x6"),
    "body_type": dealt(11, "slr", "tlr", "pseudo-tlr", "compact", "viewfinder", None, "rangefinder", "compact"), "traits_s": dealt(13, "folding", "point-and-shoot", "stereo,folding", "toy,stereo,point-and-shoot", "point-and-shoot,toy"),
    "mounts_s": dealt(9, "Nikon F", "M42,Nikon F", "Canon FD & FL", "M39,M42,Nikon F"), "lens_mount": dealt(6, "Nikon F", "", "M42 (Praktica)"), "fl_name": dealt(10, "Tessar -", "-", None, "Elmar", "Tessar", "Novar", None, "Xenar"),
    "fl_focal": dealt(7, "5 cm", "45 mm", "50", "10.5CM", None, "about 40"), "fl_low": dealt(8, "35.0", None, "38.04", "45.0", "0.0").replace("'", ""), "fl_high": dealt(8, "70.0", None, "105.96", "45.0", "90.0").replace("'", ""), "fl_widest": dealt(5, "f/2.8", None, "f/3.5"),
    "focal_length": dealt(9, "50mm", "13.5 cm", "  85 ", "", None, "70-210 MM"), "focal_low": dealt(11, "28.0", "70.0", None, "50.25").replace("'", ""), "focal_high": dealt(11, "28.0", "210.0", "80.0", "50.25").replace("'", ""),
    "widest": dealt(5, "f/1.4", "f/2", None, ""), "smallest": dealt(3, "f/16", "f/22"), "filter_size": dealt(4, "52", None, "", "49"), "elements": dealt(7, "6/4", "4/3"), "min_focus": dealt(5, "0.5 m"), "lens_type": dealt(9, "zoom", "macro", "wide angle"),
    "shutter_type": dealt(5, "focal-plane", "leaf"), "speeds": dealt(3, "1/1000 - 1s"), "metered": dealt(7, "1", "0", None, "1").replace("'", ""), "meter_type": dealt(5, "CdS", None, "selenium"), "batteries_s": dealt(9, "none", "LR44,PX625", None, "LR44"),
    "mp": dealt(6, "12.0", "6.1", "0.0").replace("'", ""), "sensor_tech": dealt(7, "CCD", "CMOS"), "sensor_size": dealt(9, "APS-C"), "country": dealt(4, "Japan", "Germany"), "year_from": dealt(5, "1950", "0", "1971", None, "1962").replace("'", ""),
    "year_to": dealt(3, "1962", "0").replace("'", ""), "maker": dealt(6, "Nikon", "Carl Zeiss Jena", None, "E. Leitz"),
}
NAMES = {"focal_low": "focal_min_mm", "focal_high": "focal_max_mm", "widest": "max_aperture", "smallest": "min_aperture", "elements": "elements_groups", "speeds": "shutter_speeds", "mp": "sensor_resolution_mp", "year_from": "year_introduced", "year_to": "year_discontinued", "maker": "manufacturer"}
HAS_FIXED = "p_partkey % 6 IN (1, 3, 5)"


def gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ("fl_low", "fl_high", "focal_low", "focal_high", "mp")
    made = table(spark, sf_dir, "part").selectExpr("p_partkey AS part", f"{HAS_FIXED} AS fixed", *[f"cast({v} AS double) AS {k}" if k in numbers else f"{v} AS {k}" for k, v in FIELDS.items()])
    lens = F.when(F.col("fixed"), F.struct(F.col("fl_name").alias("name"), F.col("fl_focal").alias("focal_length"), F.col("fl_low").alias("focal_min_mm"), F.col("fl_high").alias("focal_max_mm"), F.col("fl_widest").alias("max_aperture")))
    lists = [F.split(f"{c}_s", ",").alias(c) for c in ("traits", "mounts", "batteries")]
    return made.select("part", *[F.col(c).alias(NAMES.get(c, c)) for c in FIELDS if not c.endswith("_s") and not c.startswith("fl_")], *lists, lens.alias("fixed_lens"))


def field(name: str) -> Column:
    return F.col(name)


def joined(sep: str, *parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL AND x <> ''), '{sep}')"


def plain(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def mm(raw: str, low: str, high: str, sep: str) -> str:
    one = lambda x: plain(f"round({x}, 1)")
    t = f"trim({raw})"
    return rf"""(CASE WHEN coalesce({low}, 0) <> 0 AND coalesce({high}, 0) <> 0 THEN CASE WHEN {low} = {high} THEN {one(low)} || 'mm' ELSE {one(low)} || '{sep}' || {one(high)} || 'mm' END WHEN {raw} IS NULL OR {raw} = '' THEN ''
      WHEN regexp_full_match({t}, '(?i)\d+(\.\d+)?\s*cm') THEN {one(f"(10 * CAST(regexp_extract({t}, '^[0-9.]+') AS DOUBLE))")} || 'mm' WHEN regexp_matches({t}, '(?i)mm$') THEN regexp_replace({t}, '(?i)\s*mm$', 'mm')
      WHEN regexp_full_match({t}, '\d+(\.\d+)?') THEN {t} || 'mm' ELSE {t} END)"""


def big(x: str) -> str:
    return f"(upper(left({x}, 1)) || substr({x}, 2))"


BODY = f"(CASE body_type WHEN 'slr' THEN 'SLR' WHEN 'tlr' THEN 'TLR' WHEN 'pseudo-tlr' THEN 'Pseudo TLR' ELSE {big('body_type')} END)"
LOW_BODY = "(CASE WHEN body_type IN ('slr', 'tlr', 'pseudo-tlr') THEN " + BODY + " ELSE body_type END)"
FORMAT = "nullif(format, 'digital')"
#: each listed trait in the vocabulary's order, as it stands in a line
LINE_TRAITS = "array_to_string(list_transform(list_filter(['folding', 'point-and-shoot', 'stereo', 'toy'], lambda t: list_contains(traits, t) AND NOT (t = 'point-and-shoot' AND coalesce(body_type, '') = 'compact'))[1:2], lambda t: replace(t, 'point-and-shoot', 'point & shoot')), ' ')"
TRAIT_NAMES = f"list_transform(traits, lambda t: CASE t WHEN 'point-and-shoot' THEN 'Point & shoot' ELSE {big('t')} END)"
ZOOM = "CASE WHEN coalesce(fl_low, 0) <> 0 AND coalesce(fl_high, 0) <> 0 AND fl_low <> fl_high THEN ' zoom' ELSE '' END"
FIXED = f"CASE WHEN fixed THEN {joined(' ', mm('fl_focal', 'fl_low', 'fl_high', '–') + ' || ' + ZOOM, 'fl_widest')} END"
SPACED = f"regexp_replace({mm('focal_length', 'focal_low', 'focal_high', ' – ')}, 'mm$', ' mm')"
TAKES = f"(CASE WHEN medium IS NULL THEN '' WHEN medium = 'film' THEN coalesce({FORMAT} || ' film', 'film') ELSE medium END)"
YEARS = "(CASE WHEN coalesce(year_from, 0) = 0 THEN '' WHEN coalesce(year_to, 0) = 0 THEN CAST(year_from AS VARCHAR) ELSE year_from || ' – ' || year_to END)"
APERTURES = f"(CASE WHEN coalesce(widest, '') = '' THEN '' ELSE {joined(' – ', 'widest', 'smallest')} END)"
CELLS = "coalesce(array_to_string(batteries, ' / '), '')"
GLANCE = f"(CASE WHEN coalesce(lens_mount, '') <> '' THEN lens_mount WHEN fixed THEN {joined(' · ', chr(39) + 'Fixed' + chr(39), 'fl_widest')} ELSE '' END)"
TYPE = joined(" ", FORMAT, BODY)
G = "WITH dealt AS (SELECT p_partkey AS part, " + HAS_FIXED + " AS fixed, " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM part), g AS (SELECT *, " + ", ".join(f"string_split({c}_s, ',') AS {c}" for c in ("traits", "mounts", "batteries")) + " FROM dealt) "


@query(G + f"SELECT part, {mm('focal_length', 'focal_low', 'focal_high', '–')} AS own, CASE WHEN fixed THEN {mm('fl_focal', 'fl_low', 'fl_high', ' – ')} END AS fixed FROM g")
def focal_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FMT1."""
    fl = F.col("fixed_lens")
    fixed = F.when(fl.isNotNull(), display.focal(fl["focal_length"], fl["focal_min_mm"], fl["focal_max_mm"], " – "))
    return gear(spark, sf_dir).select("part", display.focal(F.col("focal_length"), F.col("focal_min_mm"), F.col("focal_max_mm")).alias("own"), fixed.alias("fixed"))


@query(
    G + f"""SELECT part, CASE WHEN kind = 'lens' THEN {joined(' · ', joined(' ', mm('focal_length', 'focal_low', 'focal_high', '–'), 'widest'), 'mounts[1]')}
    WHEN medium = 'digital' THEN 'Digital ' || coalesce({LOW_BODY}, 'camera') || CASE WHEN coalesce(mp, 0) <> 0 THEN ' · ' || {plain('mp')} || 'MP' ELSE '' END
    ELSE {joined(' · ', joined(' ', FORMAT, LINE_TRAITS), LOW_BODY, FIXED)} END AS facts FROM g"""
)
def facts_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FMT2 to FMT4."""
    return gear(spark, sf_dir).select("part", display.facts_line(F.col("kind"), field).alias("facts"))


@query(G + f"SELECT part, {CELLS} AS cells, {TYPE} AS type, {TAKES} AS takes, CASE WHEN {TAKES} <> '' THEN {joined(' · ', TAKES, chr(39) * 2 + ' || frame_size || ' + chr(39) + ' frame' + chr(39))} ELSE '' END AS medium, {GLANCE} AS lens, {APERTURES} AS apertures, {YEARS} AS years FROM g")
def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FMT7."""
    return gear(spark, sf_dir).select(
        "part", display.battery_text(field).alias("cells"), display.type_bits(field).alias("type"), display.takes(field).alias("takes"), display.medium_full(field).alias("medium"), display.lens_glance(field).alias("lens"),
        display.aperture_range(F.col("max_aperture"), F.col("min_aperture")).alias("apertures"), display.years_range(F.col("year_introduced"), F.col("year_discontinued")).alias("years"),
    )


def listed(*pairs: tuple[str, str]) -> str:
    """label=value of what is known."""
    return "list_filter([" + ", ".join(f"'{k}=' || nullif({v}, '')" for k, v in pairs) + "], lambda x: x IS NOT NULL)"


NAME = r"trim(regexp_replace(coalesce(fl_name, ''), '\s*-\s*$', ''))"
METER = f"CASE WHEN metered <> 0 THEN {joined(' · ', chr(39) + 'Metered' + chr(39), 'meter_type || ' + chr(39) + ' meter' + chr(39))} WHEN metered = 0 THEN 'Unmetered' END"
CAMERA_SPECS = listed(
    ("Type", TYPE), ("Traits", f"array_to_string({TRAIT_NAMES}, ', ')"), ("Medium · Format", f"CASE WHEN {TAKES} <> '' THEN {joined(' · ', TAKES, 'frame_size || ' + chr(39) + ' frame' + chr(39))} END"), ("Lens mount", "lens_mount"),
    ("Fixed lens", f"CASE WHEN coalesce(lens_mount, '') = '' AND fixed THEN {joined(' · ', NAME, mm('fl_focal', 'fl_low', 'fl_high', '–'), 'fl_widest')} END"), ("Shutter", big("shutter_type")), ("Speeds", "speeds"), ("Metering", METER), ("Battery", CELLS),
    ("Sensor", joined(" · ", f"CASE WHEN mp <> 0 THEN {plain('mp')} || ' MP' END", "sensor_tech", "sensor_size")), ("Country", "country"), ("Years", YEARS),
)
LENS_SPECS = listed(("Mount", "array_to_string(mounts, ', ')"), ("Focal length", SPACED), ("Type", big("lens_type")), ("Aperture", APERTURES), ("Filter size", "nullif(filter_size, '') || ' mm'"), ("Elements / groups", "elements"), ("Min focus", "min_focus"), ("Years", YEARS))


def lines(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r["label"], F.lit("="), r["value"])), "|")


@query(G + f"SELECT part, array_to_string(CASE WHEN kind = 'lens' THEN {LENS_SPECS} ELSE {CAMERA_SPECS} END, '|') AS specs FROM g")
def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT4."""
    return gear(spark, sf_dir).select("part", lines(display.spec_rows(F.col("kind"), field)).alias("specs"))


LENS_FACTS = listed(("Mount", "mounts[1] || CASE WHEN len(mounts) > 1 THEN ' +' || (len(mounts) - 1) ELSE '' END"), ("Focal", SPACED), ("Aperture", APERTURES), ("Type", big("lens_type")))
CAMERA_FACTS = listed(("Takes", TAKES), ("Battery", CELLS), ("Lens", GLANCE), ("Type", TYPE))
BAND_FACTS = listed(("Takes", TAKES), ("Frame", "frame_size"), ("Battery", CELLS), ("Lens", GLANCE), ("Type", TYPE))


@query(G + f"SELECT part, array_to_string((CASE WHEN kind = 'lens' THEN {LENS_FACTS} ELSE {CAMERA_FACTS} END)[1:4], '|') AS glance, array_to_string((CASE WHEN kind = 'lens' THEN {LENS_FACTS} ELSE {BAND_FACTS} END)[1:3], '|') AS band FROM g")
def glance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT5."""
    return gear(spark, sf_dir).select("part", lines(display.facts(F.col("kind"), field)).alias("glance"), lines(display.facts(F.col("kind"), field, True)).alias("band"))


SHOOT_C = joined(
    " ", f"CASE WHEN medium = 'film' THEN 'Takes ' || {TAKES} || '.' WHEN medium = 'digital' THEN CASE WHEN mp <> 0 THEN 'Captures digitally, ' || {plain('mp')} || ' MP.' ELSE 'Captures digitally.' END END",
    f"CASE WHEN lower({CELLS}) = 'none' THEN 'No battery required — it runs mechanically.' WHEN {CELLS} <> '' THEN 'Runs on ' || {CELLS} || '.' END", "'Shutter speeds: ' || speeds || '.'",
    "CASE metered WHEN 0 THEN 'Unmetered — bring a separate meter.' WHEN 1 THEN coalesce('Built-in ' || meter_type || ' meter.', 'Built-in meter.') END",
)
CHECK_C = joined(
    " ", "CASE WHEN coalesce(lens_mount, '') <> '' THEN 'Interchangeable ' || lens_mount || ' mount — confirm the lens on it separately.' WHEN fixed THEN coalesce('Fixed ' || fl_widest || ' lens', 'Fixed lens') || ' — no aperture ring to inspect.' END",
    "CASE WHEN speeds IS NOT NULL THEN 'Confirm every listed shutter speed fires.' END", "CASE WHEN list_contains(traits, 'folding') THEN 'Folding body — check the bellows for light leaks and the struts for play.' END",
)
SHOOT_L = joined(" ", f"nullif({SPACED}, '') || ' focal length.'", "'Maximum aperture ' || nullif(widest, '') || '.'", f"'A ' || {big('lens_type')} || ' lens.'")
CHECK_L = joined(
    " ", "CASE WHEN len(mounts) > 1 THEN 'Sold in ' || len(mounts) || ' mounts (' || array_to_string(mounts, ', ') || ') — confirm which one this is.' WHEN len(mounts) = 1 THEN mounts[1] || ' mount — confirm fit before buying.' END",
    "CASE WHEN coalesce(widest, '') <> '' THEN 'Run the aperture ring through its full range and check the blades for oil.' END", "elements || ' elements/groups — count them against the glass.'",
)


@query(G + f", s AS (SELECT part, CASE WHEN kind = 'lens' THEN {SHOOT_L} ELSE {SHOOT_C} END AS shooting, CASE WHEN kind = 'lens' THEN {CHECK_L} ELSE {CHECK_C} END AS checking FROM g) SELECT * FROM s WHERE shooting <> '' AND checking <> ''")
def advice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT6."""
    return gear(spark, sf_dir).select("part", display.advice(F.col("kind"), field).alias("a")).where("a is not null").select("part", "a.shooting", "a.checking")


def tag(key: str, value: str, label: str) -> str:
    return f"'#/browse?{key}=' || replace(replace(replace(nullif({value}, ''), '&', '%26'), ' ', '%20'), '/', '%2F') || '=' || {label}"


SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
TAGS_C = f"list_concat([{tag('format', FORMAT, FORMAT)}, {tag('body', 'body_type', BODY)}], list_transform(coalesce(traits, []), lambda t: {tag('traits', 't', 'CASE t WHEN ' + chr(39) + 'point-and-shoot' + chr(39) + ' THEN ' + chr(39) + 'Point & shoot' + chr(39) + ' ELSE ' + big('t') + ' END')}), [{tag('medium', 'medium', big('medium'))}, {tag('mount', SLUG.format('lens_mount'), 'lens_mount')}])"
TAGS_L = f"list_transform(coalesce(mounts, []), lambda m: {tag('mount', SLUG.format('m'), 'm')})"


@query(G + f"SELECT part, array_to_string(list_filter(list_concat(CASE WHEN kind = 'lens' THEN {TAGS_L} ELSE {TAGS_C} END, [{tag('manufacturer', SLUG.format('maker'), 'maker')}]), lambda x: x IS NOT NULL), '|') AS tags FROM g")
def browse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT7."""
    links = display.browse_links(F.col("kind"), field)
    return gear(spark, sf_dir).select("part", F.array_join(F.transform(links, lambda r: F.concat(r["href"], F.lit("="), r["label"])), "|").alias("tags"))


#: What is split out of a camera's mount, and a lens' own mounts.
@query(G + "SELECT part, CASE WHEN kind = 'lens' THEN array_to_string(coalesce(mounts, []), '|') ELSE array_to_string(list_filter(list_transform(string_split(coalesce(mounts_s, ''), ','), lambda m: trim(m)), lambda m: m <> ''), '|') END AS mounts FROM g")
def mounts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FMT5."""
    g = gear(spark, sf_dir)
    return g.select("part", F.array_join(display.mounts_of(F.col("kind"), F.array_join("mounts", ", "), F.col("mounts")), "|").alias("mounts"))
