"""Faceted browsing (BR1 to BR8) and related records (DT1 to DT3)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetmatch.functions.text import fold, slugify
from facetmatch.session import checkpoint, spread

PAGE, TOP, EXPANDED, FOUND = 60, 10, 200, 50


@dataclass(frozen=True)
class Filters:
    kind: str | None = None
    body: str | None = None
    ltype: str | None = None
    traits: tuple[str, ...] = ()
    mount: str | None = None
    manufacturer: str | None = None
    more: dict[str, str] = field(default_factory=dict)  # format, medium: column -> value

    def predicates(self) -> dict[str, Column]:
        """BR1: by facet, those that are set. A row in which the column is missing stays out once a value is picked."""
        out: dict[str, Column] = {}
        if self.kind:
            out["kind"] = F.col("kind") == self.kind
        if self.body:
            out["body"] = (F.col("kind") == "camera") & (F.col("body_type") == self.body)
        if self.ltype:
            out["ltype"] = (F.col("kind") == "lens") & (F.col("body_type") == self.ltype)
        if self.traits:
            out["traits"] = reduce(lambda a, b: a & b, [F.array_contains("traits", t) for t in self.traits])
        if self.mount:
            out["mount"] = F.exists("mounts", lambda m: slugify(m) == self.mount)
        if self.manufacturer:
            out["manufacturer"] = slugify(F.col("manufacturer")) == self.manufacturer
        return out | {k: F.col(k) == v for k, v in self.more.items()}

    def where(self, *leave: str) -> Column:
        """All predicates but those of the facets left out (BR2)."""
        active = [F.coalesce(p, F.lit(False)) for k, p in self.predicates().items() if k not in leave]
        return reduce(lambda a, b: a & b, active, F.lit(True))


#: facet -> kind of the rows that it is about, and their values
FACETS = {
    "manufacturer": (None, "array(manufacturer)"), "body": ("camera", "array(body_type)"), "ltype": ("lens", "array(body_type)"), "mount": (None, "mounts"),
}


def facet_counts(records: DataFrame, f: Filters) -> DataFrame:
    """BR2, BR3: facet, value, n, first. One scan: each row carries its values for every facet whose own filter is left out."""
    per = []
    for name, (kind, values) in FACETS.items():
        ok = f.where(name) & (F.lit(True) if kind is None else F.col("kind") == kind)
        named = f"transform({values}, v -> named_struct('facet', '{name}', 'value', v))"
        per.append(F.when(ok, F.expr(named)).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    rows = records.select("ord", F.posexplode(F.concat(*per)).alias("pos", "x")).select("ord", "pos", "x.facet", "x.value").where("value <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first"))


def trait_counts(records: DataFrame, f: Filters) -> DataFrame:
    """BR4: value, n. Candidates are the traits of all rows that the other facets leave; a picked one shows the size of the whole choice."""
    chosen = reduce(lambda a, b: a & b, [F.array_contains("traits", t) for t in f.traits], F.lit(True))
    base = records.where(f.where("traits") & (F.col("kind") == "camera")).select("traits", chosen.alias("all"))
    rows = base.select(F.explode(F.array_distinct("traits")).alias("value"), "all")
    counted = rows.groupBy("value").agg(F.count_if("all").alias("n"))
    return counted.where((F.col("n") > 0) | F.col("value").isin(*f.traits))


def shortened(counts: DataFrame, active: Column, expanded: bool = False) -> DataFrame:
    """BR5: the top of each facet, with picked values folded back in."""
    place = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where((F.col("place") <= (EXPANDED if expanded else TOP)) | active)


def facet_search(counts: DataFrame, text: str) -> DataFrame:
    """BR6."""
    hit = counts.where(F.contains(fold(F.col("value")), fold(F.lit(text))))
    return hit.withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "first"))).where(F.col("place") <= FOUND)


def by_year(order: str = "ord") -> list[Column]:
    """BR7: unknown years last."""
    return [F.asc_nulls_last(F.nullif(F.col("year"), F.lit(0))), F.col(order)]


def page(records: DataFrame, f: Filters, number: int = 1, sort: str | None = None) -> DataFrame:
    """BR8: a page of the rows, with their place, by a distributed sort."""
    rows = records.where(f.where()).orderBy(*(by_year() if sort == "year" else [F.col("ord")]))
    return rows.offset((number - 1) * PAGE).limit(PAGE)


def year_distance(year: Column, base: Column) -> Column:
    """DT3: unknown is farthest; without a base all dated ones are alike."""
    return F.when(F.coalesce(year, F.lit(0)) == 0, 1_000_000).when(F.coalesce(base, F.lit(0)) == 0, 0).otherwise(F.abs(year - base))


def same_maker(records: DataFrame, most: int = 4) -> DataFrame:
    """DT1: id, rank, related. Rows of one maker, kind, body type and traits (a look) are reduced to the first few a year. Looks of a maker are compared by counts alone, to find how far down a look must go for
    enough rows; only the rows of the looks that it reaches are then read, once for each year that is asked for."""
    look, profile = ["kind", "manufacturer", "body_type", "traits"], ["kind", "manufacturer", "body_type", "traits", "year"]
    known = records.where("manufacturer <> ''")
    nth = F.row_number().over(W.partitionBy(*profile).orderBy("ord"))
    short = known.select(*profile, "ord", "id").withColumn("n", nth).where(F.col("n") <= most + 1)
    looks = short.groupBy(*look).agg(F.collect_list(F.struct("year", "ord", "id")).alias("rows"))
    looks = checkpoint(looks.select(F.monotonically_increasing_id().alias("no"), *look, F.size("rows").alias("n"), "rows"))
    b = looks.select("kind", "manufacturer", F.struct("no", "n", F.col("body_type").alias("t"), F.col("traits").alias("x")).alias("b"))
    level = F.struct((~F.col("b.t").eqNullSafe(F.col("body_type"))).alias("other"), (-F.coalesce(F.size(F.array_intersect("traits", "b.x")), F.lit(0))).alias("apart"))
    pairs = spread(looks.drop("rows", "n"), "no").join(b, ["kind", "manufacturer"]).select("no", "b.n", F.col("b.no").alias("met"), level.alias("level"))
    # a level whose rows before it are enough can't be reached
    before = F.coalesce(F.sum("n").over(W.partitionBy("no").orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = pairs.groupBy("no", "level").agg(F.sum("n").alias("n")).withColumn("before", before).where(F.col("before") < most + 1).groupBy("no").agg(F.max("level").alias("last"))
    reached = pairs.join(last, "no").where(F.col("level") <= F.col("last")).select("no", "met", "level")
    asked = looks.select("no", F.explode(F.array_distinct(F.transform("rows", lambda r: r["year"]))).alias("year"))
    near = lambda r: F.when(F.coalesce("year", F.lit(0)) == 0, 0).otherwise(year_distance(r["year"], F.col("year")))
    nearest = F.slice(F.array_sort(F.transform("rows", lambda r: F.struct(F.col("level").alias("level"), near(r).alias("near"), r["ord"].alias("ord"), r["id"].alias("id")))), 1, most + 1)
    some = spread(asked.join(reached, "no"), "met").join(looks.select(F.col("no").alias("met"), "rows"), "met").select("no", "year", nearest.alias("some"))
    best = some.groupBy("no", "year").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, most + 1).alias("best"))
    listed = best.join(looks.select("no", *look), "no").select(*[F.col(c).alias(f"p_{c}") for c in profile], F.transform("best", lambda x: x["id"]).alias("ids"))
    on = [known[c].eqNullSafe(F.col(f"p_{c}")) for c in profile]
    own = known.join(listed, on).select("id", F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, most).alias("ids"))
    return own.select("id", F.posexplode("ids").alias("rank", "related")).select("id", (F.col("rank") + 1).alias("rank"), "related")


def mount_matches(records: DataFrame, most: int = 4) -> DataFrame:
    """DT2: id, rank, related: of the other kind, sharing a mount whatever its case; a camera with a column lens_mount has that one, unsplit. By the same maker first, then by year, then ord.

    What fits depends on mount, kind, maker and year alone, and ranks by maker, year and ord. So of each mount, kind, maker and year only the first few rows can be chosen, and lists are made for each
    (mount, kind, maker, year) that is asked for: of the same maker, and of others. A record then meets a few rows for each of its mounts, however many share them."""
    mounts = F.col("mounts")
    if "lens_mount" in records.columns:
        whole = F.when(F.coalesce("lens_mount", F.lit("")) != "", F.array("lens_mount")).otherwise(F.array().cast("array<string>"))
        mounts = F.when(F.col("kind") == "camera", whole).otherwise(mounts)
    keyed = checkpoint(records.select("ord", "id", "kind", F.col("manufacturer").alias("f"), F.coalesce("year", F.lit(0)).alias("year"), F.explode(F.array_distinct(F.transform(mounts, F.lower))).alias("m")))
    b = keyed.select("m", F.when(F.col("kind") == "camera", "lens").otherwise("camera").alias("kind"), "f", F.col("year").alias("y"), "ord", "id")
    few = b.withColumn("n", F.row_number().over(W.partitionBy("m", "kind", "f", "y").orderBy("ord"))).where(F.col("n") <= most).drop("n")
    # by year, first rows of all makers: of twice as many, at most so many a maker, enough are left whatever maker is left out
    wide = few.withColumn("n", F.row_number().over(W.partitionBy("m", "kind", "y").orderBy("ord"))).where(F.col("n") <= 2 * most).drop("n")
    asked = keyed.select("m", "kind", "f", "year").distinct()
    far = year_distance(F.col("y"), F.col("year"))
    item = F.struct(far.alias("far"), "ord", "id")
    top = lambda rows, n, *key: rows.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("item.far", "item.ord"))).where(F.col("n") <= n).drop("n")
    # bounded by the number of years
    by_maker = few.groupBy("m", "kind", "f").agg(F.collect_list(F.struct("y", "ord", "id")).alias("rows"))
    own = asked.join(by_maker.withColumnRenamed("f", "g"), (asked["m"] == by_maker["m"]) & (asked["kind"] == by_maker["kind"]) & asked["f"].eqNullSafe(F.col("g"))).select(asked["m"], asked["kind"], "f", "year", "rows")
    nearest = lambda r: F.struct(year_distance(r["y"], F.col("year")).alias("far"), r["ord"].alias("ord"), r["id"].alias("id"))
    own = own.select("m", "kind", "f", "year", F.slice(F.array_sort(F.transform("rows", nearest)), 1, most).alias("same"))
    others = asked.select("m", "kind", "year").distinct().join(wide.withColumnRenamed("f", "g"), ["m", "kind"]).select("m", "kind", "year", "g", item.alias("item"))
    others = top(top(others, most, "m", "kind", "year", "g"), 2 * most, "m", "kind", "year")
    others = others.groupBy("m", "kind", "year").agg(F.collect_list(F.struct("g", "item")).alias("rows"))
    kept = F.filter("rows", lambda r: ~r["g"].eqNullSafe(F.col("f")))
    both = asked.join(others, ["m", "kind", "year"], "left").select("m", "kind", "f", "year", F.transform(kept, lambda r: r["item"]).alias("others"))
    same_key = (both["m"] == own["m"]) & (both["kind"] == own["kind"]) & (both["year"] == own["year"]) & both["f"].eqNullSafe(own["f"])
    none = F.array().cast("array<struct<far:int,ord:bigint,id:string>>")
    tagged = lambda c, other: F.transform(F.coalesce(c, none), lambda r: F.struct(F.lit(other).alias("other"), r["far"].cast("int").alias("far"), r["ord"].cast("bigint").alias("ord"), r["id"].alias("id")))
    lists = both.join(own, same_key, "left").select(both["m"], both["kind"].alias("k"), both["f"].alias("g"), both["year"].alias("y"), F.concat(tagged(own["same"], 0), tagged(both["others"], 1)).alias("found")).where("size(found) > 0")
    pairs = keyed.join(lists, (keyed["m"] == lists["m"]) & (keyed["kind"] == F.col("k")) & (keyed["year"] == F.col("y")) & keyed["f"].eqNullSafe(F.col("g")))
    gathered = pairs.groupBy(keyed["id"]).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, most).alias("found"))
    return gathered.select("id", F.posexplode("found").alias("rank", "r")).select("id", (F.col("rank") + 1).alias("rank"), F.col("r.id").alias("related"))
