"""Lines for display: facts, focal lengths, years, hazards, explanations, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetmatch.functions.text import fold, slugify

DOT = " · "
TRAITS = sorted("magazine aerial instant-print press panoramic underwater movie toy detective stereo subminiature motorized folding point-and-shoot".split())
#: Discontinued film: the last year it was widely sold, where known.
DEAD_FILM = {"disc": 1999, "aps": 2011, "828": 1985, "620": 1995, "127": 1995, "126": 1999, "117": None, "116": 1984, "110": None}
MERCURY = r"(?i)(?<![A-Za-z0-9_])(?:PX ?(?:825|675|640|625|400|27|23|21|14|13|1)|MR ?(?:44|9)|V625|HG|mercury)(?![A-Za-z0-9_])"
MARKET_WORDING = {"jp": "the Japanese name", "eu": "the European name", "intl": "the international name", "us": "the US name"}
BODY_TYPES = tuple("box bridge compact mirrorless other pinhole pseudo-tlr rangefinder slr tlr view viewfinder".split())


def joined(sep: str, *parts: Column) -> Column:
    """concat_ws without empty strings."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def body_label(body: Column) -> Column:
    return F.when(body == "slr", "SLR").when(body == "tlr", "TLR").when(body == "pseudo-tlr", "Pseudo TLR").otherwise(cap(body))


def trait_label(trait: Column) -> Column:
    return F.when(trait == "point-and-shoot", "Point & shoot").otherwise(cap(trait))


def facts_traits(traits: Column, body: Column) -> Column:
    """FMT3: at most two, in the vocabulary's order, as labels for within a line; point-and-shoot says nothing beside compact."""
    known = F.filter(F.array(*map(F.lit, TRAITS)), lambda t: F.array_contains(traits, t) & ~((t == "point-and-shoot") & (F.coalesce(body, F.lit("")) == "compact")))
    return F.transform(F.slice(known, 1, 2), lambda t: case_for_line(trait_label(t)))


def case_for_line(label: Column) -> Column:
    """FMT4."""
    return F.when(label.isin("SLR", "TLR", "Pseudo TLR"), label).otherwise(F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 999)))


def number(x: Column) -> Column:
    """Whole numbers without .0."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def known(x: Column) -> Column:
    """Null for 0."""
    return F.nullif(x, F.lit(0.0))


def film_format(d) -> Column:
    return F.when(d("format") != "digital", d("format"))


def fixed_lens_facts(d) -> Column:
    """Focal length, zoom if it is a range, and aperture, of a fixed lens; null without one."""
    fl = d("fixed_lens")
    length = focal(fl["focal_length"], fl["focal_min_mm"], fl["focal_max_mm"])
    zoom = F.when(known(fl["focal_min_mm"]).isNotNull() & known(fl["focal_max_mm"]).isNotNull() & (fl["focal_min_mm"] != fl["focal_max_mm"]), F.concat(length, F.lit(" zoom"))).otherwise(length)
    return F.when(fl.isNotNull(), joined(" ", zoom, fl["max_aperture"]))


def facts_line(kind: Column, d) -> Column:
    """FMT2. d: a function from a field's name to its column. Never the year."""
    label = case_for_line(body_label(d("body_type")))
    mp = known(d("sensor_resolution_mp"))
    digital = joined(DOT, F.concat(F.lit("Digital "), F.coalesce(F.nullif(label, F.lit("")), F.lit("camera"))), F.when(mp.isNotNull(), F.concat(number(mp), F.lit("MP"))))
    front = F.concat(F.array(film_format(d)), facts_traits(F.coalesce(d("traits"), F.array().cast("array<string>")), d("body_type")))
    film = joined(DOT, F.array_join(F.filter(front, lambda x: x != ""), " "), label, fixed_lens_facts(d))
    lens = joined(DOT, joined(" ", focal(d("focal_length"), d("focal_min_mm"), d("focal_max_mm")), d("max_aperture")), F.try_element_at(d("mounts"), F.lit(1)))
    return F.when(kind == "lens", lens).when(d("medium") == "digital", digital).otherwise(film)


def focal(raw: Column, low: Column, high: Column, sep: str = "–") -> Column:
    """FMT1: the range if both ends are known; else cm as mm, mm without a blank, a bare number as mm, or as it is."""
    one = lambda x: number(F.round(x, 1))
    low, high = known(low), known(high)
    text = F.trim(raw)
    cm = F.regexp_extract(text, r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*cm$", 1)
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low == high), F.concat(one(low), F.lit("mm")))
        .when(low.isNotNull() & high.isNotNull(), F.concat(one(low), F.lit(sep), one(high), F.lit("mm")))
        .when(raw.isNull() | (raw == ""), F.lit("")).when(cm != "", F.concat(one(cm.try_cast("double") * 10), F.lit("mm")))
        .when(text.rlike(r"(?i)mm$"), F.regexp_replace(text, r"(?i)\s*mm$", "mm")).when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(text, F.lit("mm"))).otherwise(text)
    )


def spaced_focal(d) -> Column:
    return F.regexp_replace(focal(d("focal_length"), d("focal_min_mm"), d("focal_max_mm"), " – "), "mm$", " mm")


def mounts_of(kind: Column, lens_mount: Column, mounts: Column) -> Column:
    """FMT5."""
    split = F.filter(F.transform(F.split(F.coalesce(lens_mount, F.lit("")), ","), lambda m: F.trim(m)), lambda x: x != "")
    return F.when(kind == "camera", split).otherwise(F.coalesce(mounts, F.array().cast("array<string>")))


def years_range(first: Column, last: Column) -> Column:
    """FMT7; 0 and null are unknown, and a last year alone says nothing."""
    a, b = F.nullif(first, F.lit(0)), F.nullif(last, F.lit(0))
    return F.when(a.isNull(), F.lit("")).when(b.isNull(), a.cast("string")).otherwise(F.concat(a, F.lit(" – "), b))


def aperture_range(widest: Column, smallest: Column) -> Column:
    return F.when(F.coalesce(widest, F.lit("")) == "", F.lit("")).otherwise(joined(" – ", widest, smallest))


def cap(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 9999))


def type_bits(d) -> Column:
    return joined(" ", film_format(d), body_label(d("body_type")))


def takes(d) -> Column:
    """What goes into it: '' if the medium isn't known."""
    film = F.coalesce(F.concat(F.nullif(film_format(d), F.lit("")), F.lit(" film")), F.lit("film"))
    return F.when(F.coalesce(d("medium"), F.lit("")) == "", F.lit("")).when(d("medium") == "film", film).otherwise(d("medium"))


def medium_full(d) -> Column:
    frame = F.nullif(d("frame_size"), F.lit(""))
    return F.when(takes(d) != "", joined(DOT, takes(d), F.concat(frame, F.lit(" frame")))).otherwise("")


def battery_text(d) -> Column:
    return F.coalesce(F.array_join(d("batteries"), " / "), F.lit(""))


def lens_glance(d) -> Column:
    return F.when(F.coalesce(d("lens_mount"), F.lit("")) != "", d("lens_mount")).when(d("fixed_lens").isNotNull(), joined(DOT, F.lit("Fixed"), d("fixed_lens")["max_aperture"])).otherwise("")


def hazards(film: Column, batteries: Column) -> Column:
    """HZ1, HZ2: an array of struct kind, detail."""
    key = F.lower(F.trim(F.coalesce(film, F.lit(""))))
    since = F.create_map(*[F.lit(x) for k, v in DEAD_FILM.items() for x in (k, v or 0)])
    year = F.nullif(since[key], F.lit(0))
    dead = F.when(key.isin(*DEAD_FILM), F.struct(F.lit("film").alias("kind"), F.concat_ws(" ", key, F.lit("film is no longer made"), F.when(year.isNotNull(), F.concat(F.lit("(since "), year, F.lit(")")))).alias("detail")))
    cells = F.filter(F.coalesce(batteries, F.array().cast("array<string>")), lambda b: b.rlike(MERCURY))
    mercury = F.when(F.size(cells) > 0, F.struct(F.lit("battery").alias("kind"), F.concat(F.lit("made for mercury cells: "), F.array_join(cells, ", ")).alias("detail")))
    return F.filter(F.array(dead, mercury), lambda h: h.isNotNull())


def explain(shown: Column, alias: Column, via: Column, market: Column) -> Column:
    """NM4: why a query landed on a record; just what is shown if no other alias matched."""
    by_market = reduce(lambda c, kv: c.when(market == kv[0], kv[1]), MARKET_WORDING.items(), F.when(F.lit(False), "")).otherwise("another market’s name")
    quoted = F.concat(F.lit("“"), alias, F.lit("”"))
    said = (
        F.when(via == "market", F.concat(F.lit("matched "), quoted, F.lit(" — "), by_market))
        .when(via == "superseded", F.concat(F.lit("matched "), quoted, F.lit(" — an earlier name for this record")))
        .when(via == "shorthand", F.concat(F.lit("matched the shorthand "), quoted))
        .otherwise(F.concat(F.lit("matched "), quoted))
    )
    return F.when(alias.isNull() | (alias == shown), shown).otherwise(said)


def record_href(kind: Column, rec_id: Column) -> Column:
    return F.concat(F.lit("#/"), kind, F.lit("/"), F.url_encode(rec_id))


def correction_href(base: str, kind: Column, name: Column) -> Column:
    return F.concat(F.lit(base + "?title="), F.url_encode(F.concat(F.lit("Correction: "), name)), F.lit("&labels="), F.url_encode(kind))


def route(hash_: Column) -> Column:
    """URL1: struct page, q, kind, id, params."""
    path, qs = F.regexp_extract(hash_, r"^#?/?([^?]*)", 1), F.regexp_extract(hash_, r"\?(.*)$", 1)
    parts = F.split(path, "/")
    params = F.when(qs == "", F.create_map().cast("map<string,string>")).otherwise(F.transform_values(F.str_to_map(qs, F.lit("&"), F.lit("=")), lambda k, v: F.try_url_decode(F.coalesce(v, F.lit("")))))
    detail = parts[0].isin("camera", "lens") & (F.size(parts) > 1)
    page = F.when(path == "", "landing").when(parts[0] == "search", "search").when(detail, "detail").when(parts[0] == "browse", "browse").otherwise("landing")
    return F.struct(page.alias("page"), F.when(page == "search", F.coalesce(F.try_element_at(params, F.lit("q")), F.lit(""))).alias("q"), F.when(detail, parts[0]).alias("kind"), F.when(detail, F.get(parts, F.lit(1))).alias("id"), params.alias("params"))


def legacy_params(p: Column) -> Column:
    """URL2: type= is rewritten to what it became."""
    old = F.try_element_at(p, F.lit("type"))
    rest = F.map_filter(p, lambda k, v: k != "type")
    trait = F.when(old == "folder", "folding").when(old.isin(*TRAITS), old)
    appended = F.array_join(F.array_distinct(F.concat(F.filter(F.split(F.coalesce(F.try_element_at(rest, F.lit("traits")), F.lit("")), ","), lambda x: x != ""), F.array(trait))), ",")
    put = lambda k, v: F.map_concat(F.map_filter(rest, lambda a, b: a != k), F.create_map(F.lit(k), v))
    return F.when(old.isNull() | (old == "half-frame"), rest).when(old.isin(*BODY_TYPES), put("body", old)).when(trait.isNotNull(), put("traits", appended)).when(old == "instant", put("medium", old)).otherwise(put("ltype", old))


def search_key(c: Column) -> Column:
    return fold(c)


def _rows(pairs: list[tuple[str, Column]]) -> Column:
    """label and value of what is known, in the order given."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")) for label, value in pairs])
    return F.filter(rows, lambda r: r["value"].isNotNull() & (r["value"] != ""))


def spec_rows(kind: Column, d) -> Column:
    """DT4."""
    text = lambda c: F.nullif(c, F.lit(""))
    fl, mp = d("fixed_lens"), known(d("sensor_resolution_mp"))
    fixed = joined(DOT, F.trim(F.regexp_replace(F.coalesce(fl["name"], F.lit("")), r"\s*-\s*$", "")), focal(fl["focal_length"], fl["focal_min_mm"], fl["focal_max_mm"]), fl["max_aperture"])
    mount = text(d("lens_mount"))
    metering = F.when(d("metered") != 0, joined(DOT, F.lit("Metered"), F.concat(text(d("meter_type")), F.lit(" meter")))).when(d("metered") == 0, "Unmetered")
    camera = _rows([
        ("Type", type_bits(d)), ("Traits", F.array_join(F.transform(d("traits"), trait_label), ", ")), ("Medium · Format", medium_full(d)), ("Lens mount", mount), ("Fixed lens", F.when(mount.isNull() & fl.isNotNull(), fixed)),
        ("Shutter", cap(d("shutter_type"))), ("Speeds", d("shutter_speeds")), ("Metering", metering), ("Battery", battery_text(d)),
        ("Sensor", joined(DOT, F.when(mp.isNotNull(), F.concat(number(mp), F.lit(" MP"))), d("sensor_tech"), d("sensor_size"))), ("Country", d("country")), ("Years", years_range(d("year_introduced"), d("year_discontinued"))),
    ])
    lens = _rows([
        ("Mount", F.array_join(d("mounts"), ", ")), ("Focal length", spaced_focal(d)), ("Type", cap(d("lens_type"))), ("Aperture", aperture_range(d("max_aperture"), d("min_aperture"))),
        ("Filter size", F.concat(text(d("filter_size")), F.lit(" mm"))), ("Elements / groups", d("elements_groups")), ("Min focus", d("min_focus")), ("Years", years_range(d("year_introduced"), d("year_discontinued"))),
    ])
    return F.when(kind == "lens", lens).otherwise(camera)


def facts(kind: Column, d, band: bool = False) -> Column:
    """DT5: the first four facts at a glance; band: the first three of the header's order, which has the frame."""
    more = F.size(d("mounts")) - 1
    mount = F.when(more > 0, F.concat(d("mounts")[0], F.lit(" +"), more.cast("string"))).otherwise(F.try_element_at(d("mounts"), F.lit(1)))
    lens = _rows([("Mount", mount), ("Focal", spaced_focal(d)), ("Aperture", aperture_range(d("max_aperture"), d("min_aperture"))), ("Type", cap(d("lens_type")))])
    camera = _rows([("Takes", takes(d)), *([("Frame", d("frame_size"))] * band), ("Battery", battery_text(d)), ("Lens", lens_glance(d)), ("Type", type_bits(d))])
    return F.slice(F.when(kind == "lens", lens).otherwise(camera), 1, 3 if band else 4)


def advice(kind: Column, d) -> Column:
    """DT6: struct shooting, checking, each of sentences from recorded fields; null unless both sides say something."""
    say = lambda before, x, after: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after)))
    mp, cells, speeds, metered = known(d("sensor_resolution_mp")), battery_text(d), F.nullif(d("shutter_speeds"), F.lit("")), d("metered")
    fl, widest = d("fixed_lens"), d("max_aperture")
    camera = joined(
        " ", F.when(d("medium") == "film", say("Takes ", takes(d), ".")).when(d("medium") == "digital", F.coalesce(F.concat(F.lit("Captures digitally, "), number(mp), F.lit(" MP.")), F.lit("Captures digitally."))),
        F.when(F.lower(cells) == "none", "No battery required — it runs mechanically.").otherwise(say("Runs on ", cells, ".")), say("Shutter speeds: ", speeds, "."),
        F.when(metered == 0, "Unmetered — bring a separate meter.").when(metered == 1, F.coalesce(say("Built-in ", d("meter_type"), " meter."), F.lit("Built-in meter."))),
    )
    camera_check = joined(
        " ", F.coalesce(say("Interchangeable ", d("lens_mount"), " mount — confirm the lens on it separately."), F.when(fl.isNotNull(), F.coalesce(say("Fixed ", fl["max_aperture"], " lens — no aperture ring to inspect."), F.lit("Fixed lens — no aperture ring to inspect.")))),
        F.when(speeds.isNotNull(), "Confirm every listed shutter speed fires."), F.when(F.array_contains(d("traits"), "folding"), "Folding body — check the bellows for light leaks and the struts for play."),
    )
    lens = joined(" ", say("", spaced_focal(d), " focal length."), say("Maximum aperture ", widest, "."), say("A ", cap(d("lens_type")), " lens."))
    many = F.concat(F.lit("Sold in "), F.size(d("mounts")).cast("string"), F.lit(" mounts ("), F.array_join(d("mounts"), ", "), F.lit(") — confirm which one this is."))
    lens_check = joined(
        " ", F.when(F.size(d("mounts")) > 1, many).otherwise(say("", F.try_element_at(d("mounts"), F.lit(1)), " mount — confirm fit before buying.")),
        F.when(F.coalesce(widest, F.lit("")) != "", "Run the aperture ring through its full range and check the blades for oil."), say("", d("elements_groups"), " elements/groups — count them against the glass."),
    )
    a, b = (F.when(kind == "lens", x).otherwise(y) for x, y in ((lens, camera), (lens_check, camera_check)))
    return F.when((a != "") & (b != ""), F.struct(a.alias("shooting"), b.alias("checking")))


def browse_links(kind: Column, d) -> Column:
    """DT7: struct href, label for each recorded field that browsing has a facet for."""
    link = lambda key, value, label: F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.concat(F.lit(f"#/browse?{key}="), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))).alias("href"), label.alias("label")))
    none = F.array().cast("array<struct<href:string,label:string>>")
    mounts = lambda c: F.transform(c, lambda m: link("mount", slugify(m), m))
    camera = F.concat(
        F.array(link("format", film_format(d), film_format(d)), link("body", d("body_type"), body_label(d("body_type")))), F.coalesce(F.transform(d("traits"), lambda t: link("traits", t, trait_label(t))), none),
        F.array(link("medium", d("medium"), cap(d("medium"))), link("mount", slugify(d("lens_mount")), d("lens_mount"))),
    )
    rest = F.array(link("manufacturer", slugify(d("manufacturer")), d("manufacturer")))
    return F.array_compact(F.concat(F.when(kind == "lens", F.coalesce(mounts(d("mounts")), none)).otherwise(camera), rest))
