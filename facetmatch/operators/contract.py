"""The data contract, as rows of violations (VA1 to VA16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of a record by code: what breaks them. Expressions over the columns kind, name, recommended_name, manufacturer, body_type, traits, mounts, folding, mount, focal_length, max_aperture, lens_type, also_takes, market_names, exposure_modes, format.
VIAS = ("name", "market", "superseded", "shorthand", "punctuation", "correction", "maker")
MARKETS = ("us", "intl", "eu", "jp")
EXPOSURE = ("manual", "semi-auto", "aperture-priority", "shutter-priority", "program", "auto", "bulb")
OPTICS = ("mount", "focal_length", "focal_min_mm", "max_aperture", "min_aperture", "filter_size", "elements_groups", "min_focus", "lens_type")
#: What isn't a company: prefixes of lenses, halves of names, and stand-ins.
NO_MAKER = {
    "prefix": "af|apo|auto|colou?r|ed|hd|macro|mc|mf|ms|multi|new|re|reflex|sc|shmc|smc|super|tele|wide|zoom|мс",
    "half": "as|au|aus|carl|ernst|la|nippon|voigt",
    "placeholder": r"inconnue?|n/a|nanars|sans marque|unknown|-+|\\?+",
}
TAKES_VIA = ("adapter", "back", "insert", "mask", "respool")


def record_rules(columns: set[str], body_types: tuple[str, ...], traits: tuple[str, ...]) -> dict[str, str]:
    """code -> SQL that holds for a violation; only rules whose columns are there."""
    some = lambda xs: ", ".join(f"'{x}'" for x in xs) or "''"
    rules = {
        "body_type.enum": ("body_type", f"body_type IS NOT NULL AND kind = 'camera' AND body_type NOT IN ({some(body_types)})"),
        "traits.enum": ("traits", f"exists(traits, t -> t NOT IN ({some(traits)}))"),
        "traits.shape": ("traits", "size(traits) = 0"),
        "traits.unsorted": ("traits", "traits <> array_sort(traits)"),
        "traits.duplicate": ("traits", "size(traits) <> size(array_distinct(traits))"),
        "folding.contradiction": ("traits folding", "traits IS NOT NULL AND folding IS NOT NULL AND array_contains(traits, 'folding') <> (folding = 1)"),
        "body_type.on-lens": ("body_type", "kind = 'lens' AND body_type IS NOT NULL"),
        "mounts.on-camera": ("mounts", "kind = 'camera' AND size(mounts) > 0"),
        "mounts.comma": ("mounts", "exists(mounts, m -> contains(m, ','))"),
        "mount.joined": ("mount mounts", "mount IS NOT NULL AND mounts IS NOT NULL AND mount <> array_join(mounts, ', ')"),
        "recommended_name.missing": ("recommended_name", "recommended_name IS NULL OR recommended_name = ''"),
        "lens.no-optics": ("focal_length max_aperture lens_type", "kind = 'lens' AND " + " AND ".join(f"nullif(cast({c} AS string), '') IS NULL" for c in OPTICS if c in columns)),
        "lens.doubled-brand": ("manufacturer", r"kind = 'lens' AND name RLIKE '(?i)^([a-z]+) +\\1( |$)'"),
        "record.index-page": ("name", r"name RLIKE '(?i)(?<![A-Za-z0-9_])(lenses|cameras|lens mounts?)$'"),
        **{f"manufacturer.{code}": ("manufacturer", f"trim(manufacturer) RLIKE '(?i)^({words})$'") for code, words in NO_MAKER.items()},
        "name.decimal-comma": ("recommended_name", "recommended_name RLIKE '[0-9],[0-9]'"),
        "name.french-noun": ("recommended_name", "recommended_name RLIKE '(?iu)(modèle|première|évolution|édition|génération|boîtier)'"),
        **{f"{c}.replacement-character": (c, f"contains({c}, '�')") for c in ("iso_manual_range", "dx_range")},
        "also_takes.via": ("also_takes", f"exists(also_takes, a -> a.format IS NULL OR (a.via IS NOT NULL AND a.via NOT IN ({some(TAKES_VIA)})))"),
        "also_takes.respool": ("also_takes format", "format = '620' AND NOT exists(coalesce(also_takes, array()), a -> a.format = '120' AND a.via = 'respool')"),
        "market_names.label": ("market_names", f"exists(market_names, m -> m.market IS NULL OR m.market NOT IN ({some(MARKETS)}))"),
        "market_names.only-itself": ("market_names", "size(market_names) > 0 AND forall(market_names, m -> m.name = name)"),
        "exposure.enum": ("exposure_modes", f"exists(exposure_modes, x -> x NOT IN ({some(EXPOSURE)}))"),
    }
    return {code: sql for code, (needs, sql) in rules.items() if set(needs.split()) <= columns}


def record_issues(records: DataFrame, body_types: tuple[str, ...], traits: tuple[str, ...]) -> DataFrame:
    """One scan for all rules of a record: code, id."""
    rules = record_rules(set(records.columns), body_types, traits)
    codes = F.array_compact(F.array(*[F.when(F.expr(sql), code) for code, sql in rules.items()]))
    return records.select("id", F.explode(codes).alias("code")).select("code", "id")


def validate(records: DataFrame, aliases: DataFrame, redirects: DataFrame | None, body_types: tuple[str, ...], traits: tuple[str, ...]) -> DataFrame:
    """code, id: every violation of the asset. aliases: alias, kind, id, via, market. redirects: from_id, kind, to_id."""
    live = records.select("id").distinct()
    bad = lambda df, code, col="id": df.select(F.lit(code).alias("code"), F.col(col).alias("id"))
    parts = [
        record_issues(records, body_types, traits),
        bad(records.groupBy("id").count().where("count > 1"), "id.repeated"),
        bad(aliases.where("via <> 'market' and market is not null"), "alias.market-without-via"),
        bad(aliases.where("via = 'market' and alias rlike '[/;]'"), "alias.separator"),
        bad(aliases.where(~F.col("via").isin(*VIAS)), "alias.via"),
        *[bad(aliases.where(F.col(c).isNotNull()), "alias.legacy-slug") for c in aliases.columns if c.endswith("_slug")],
        bad(aliases.where("kind = 'lens' and via = 'market'"), "alias.market-on-lens"),
        bad(aliases.join(live, "id", "left_anti"), "alias.orphan"),
    ]
    if "market_names" in records.columns:
        named = records.select("id", F.explode("market_names").alias("m")).select("id", F.col("m.name").alias("alias"))
        reach = aliases.select("id", "alias").union(records.select("id", F.col("name")))
        parts.append(bad(named.join(reach, ["id", "alias"], "left_anti"), "market_names.unreachable"))
    if redirects is not None:
        parts += [
            bad(redirects.groupBy("from_id", "kind").agg(F.countDistinct("to_id").alias("n")).where("n > 1"), "redirect.ambiguous", "from_id"),
            bad(redirects.where("from_id = to_id"), "redirect.self", "from_id"),
            bad(redirects.join(live.union(redirects.select("from_id")).distinct().withColumnRenamed("id", "to_id"), "to_id", "left_anti"), "redirect.dangling", "from_id"),
            bad(redirects.join(live.withColumnRenamed("id", "from_id"), "from_id", "left_semi"), "redirect.from-live", "from_id"),
        ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def formatted(issues: DataFrame, counts: dict[str, int], label: str) -> str:
    """One line for people: whether label satisfies the contract."""
    n = issues.count()
    held = ", ".join(f"{v:,} {k}" for k, v in counts.items())
    return f"✗ {label} breaks contract v1 ({n:,} issues)" if n else f"✓ {label} satisfies contract v1 ({held})"


def labels_cover(vocabulary: tuple[str, ...], labels: dict[str, str]) -> bool:
    """VA16."""
    return set(vocabulary) == set(labels)

