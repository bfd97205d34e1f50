"""Trust and distrust over the links between hosts.

An edge from one host to another counts the anchors on the first's pages that name the other (absolute and protocol-relative links). A host
under a service prefix (www., m., blog. ...) and the host without it vouch for each other by one edge each way, so that a verdict reaches all
names of a site. Trust is personalised PageRank from the trusted seeds along the edges; distrust is the same from the blocked seeds against them:
s' = (1 - damping) * seed + damping * sum over incoming edges of s * weight / outgoing weight, where a walk that has no edge to go by ends.

Each seed starts with a mass of 1. Beside each walk goes one in which every host starts with a mass of 1, and a host's trust and distrust are shares: of all the mass that reaches it over its edges,
what comes from the seeds (0 if none reaches it); for a seed itself 1. So neither the number of seeds nor how many others link to the same host changes what a share means. A host is blocked if it is a blocked seed, or if its distrust is
at least `threshold` and more than its trust.

Seeds are tables with a column host; a seed stands for that host and those with a service prefix before it.

Defined results: pages with a null url, or one without scheme and host, are left out of the graph, and aren't blocked; a null or empty html has no links; html of any length is read whole. Links of a host to itself are no edges. Rows that
repeat a page, and links that repeat, count again; repeated seeds once, null seeds and seeds that aren't hosts of the graph not at all. A host that is a seed of both kinds is blocked. Hosts are in lower case, without port or user. Rows with a null page_id are pages like others.
Empty tables give no rows; without seeds all shares are 0. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmatch.llm.common import checkpoint, pick, sized


@dataclass(frozen=True)
class Params:
    services: str = "www|m|blog|news|shop|mobile|amp"
    damping: float = 0.85
    iterations: int = 12
    threshold: float = 0.3
    checkpoint_every: int = 4


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#@:]+)"
LINK = r"""<[aA]\s[^>]*[hH][rR][eE][fF]\s*=\s*["']?\s*(?:[hH][tT][tT][pP][sS]?:)?//([^/"'\s>?#:@]+)"""


def host_graph(pages: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """host, pages; and src, dst, weight."""
    rows = pick(pages, "url", "html").select(F.lower(F.regexp_extract("url", HOST, 2)).alias("host"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("links")).where("host <> ''")
    # one pass over the pages: each host with its number of pages, and each of its links with theirs
    counted = checkpoint(rows.select("host", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.transform("links", F.lower), F.array().cast("array<string>")))).alias("to")).groupBy("host", "to").count())
    links = counted.where("to is not null and to <> host").select(F.col("host").alias("src"), F.col("to").alias("dst"), F.col("count").cast("double").alias("weight"))
    names = counted.where("to is null").select("host", F.col("count").alias("pages")).union(links.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("pages"))).groupBy("host").agg(F.sum("pages").alias("pages"))
    bare = F.regexp_extract("host", rf"^(?:{p.services})\.(.+\..+)$", 1)
    under = names.select("host", bare.alias("bare")).where("bare <> ''")
    hosts = names.union(under.select("bare", F.lit(0).cast("long"))).groupBy("host").agg(F.sum("pages").alias("pages"))
    edges = links.union(under.select("host", "bare", F.lit(1.0))).union(under.select("bare", "host", F.lit(1.0)))
    return hosts, edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _bare(services: str) -> F.Column:
    return F.regexp_replace("host", rf"^(?:{services})\.(.+\..+)$", "$1")


def marked(hosts: DataFrame, trusted: DataFrame, blocked: DataFrame, p: Params = Params()) -> DataFrame:
    """host, pages, t, x: whether it is a trusted, a blocked seed."""
    out = hosts.select("host", "pages", _bare(p.services).alias("bare"))
    for name, seeds in (("t", trusted), ("x", blocked)):
        listed = pick(seeds, "host").where("host is not null").select(F.lower("host").alias("host")).select(_bare(p.services).alias("seed")).distinct()
        out = out.join(sized(listed), F.col("bare") == F.col("seed"), "left").withColumn(name, F.col("seed").isNotNull()).drop("seed")
    return out.drop("bare")


def propagate(hosts: DataFrame, edges: DataFrame, p: Params = Params()) -> DataFrame:
    """host, pages, trust, distrust, blocked, by host. hosts: as marked() gives them."""
    total = lambda c: F.sum("weight").alias(c)
    out = edges.groupBy("src").agg(total("o")).withColumnRenamed("src", "s")
    into = edges.groupBy("dst").agg(total("i")).withColumnRenamed("dst", "d")
    whole = edges.join(out, F.col("src") == F.col("s")).join(into, F.col("dst") == F.col("d"))
    forth = whole.select(F.lit(True).alias("along"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("weight") / F.col("o")).alias("share"))
    back = whole.select(F.lit(False).alias("along"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("weight") / F.col("i")).alias("share"))
    steps = checkpoint(forth.union(back))
    hosts = checkpoint(hosts)
    # s: mass from the seeds, u: from all hosts; what has come over edges also apart, in r and v
    seed = hosts.select("host", F.explode(F.create_map(F.lit(True), F.col("t").cast("double"), F.lit(False), F.col("x").cast("double"))).alias("along", "seed"))
    none = [F.lit(0.0).alias(c) for c in "rv"]
    start = seed.select("host", "along", (F.col("seed") * (1 - p.damping)).alias("s"), F.lit(1 - p.damping).alias("u"), *none)
    score = seed.select("host", "along", F.col("seed").alias("s"), F.lit(1.0).alias("u"), *none)
    for i in range(1, p.iterations + 1):
        over = [(F.col(c) * F.col("share") * p.damping) for c in "su"]
        moved = score.withColumnRenamed("host", "a").join(steps, ["a", "along"]).select(F.col("b").alias("host"), "along", *[c.alias(n) for c, n in zip(over * 2, "surv")])
        score = start.union(moved).groupBy("host", "along").agg(*[F.sum(c).alias(c) for c in "surv"])
        if i % p.checkpoint_every == 0:
            score = checkpoint(score)
    part = F.when(F.col("v") > 0, F.col("r") / F.col("v")).otherwise(0.0)
    both = score.groupBy("host").agg(F.sum(F.when(F.col("along"), part)).alias("t_share"), F.sum(F.when(~F.col("along"), part)).alias("d_share"))
    trust, distrust = (F.when(F.col(flag), 1.0).otherwise(F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)) for flag, c in (("t", "t_share"), ("x", "d_share")))
    scored = hosts.join(both, "host", "left").select("host", "pages", trust.alias("trust"), distrust.alias("distrust"), "x")
    return scored.select("host", "pages", "trust", "distrust", (F.col("x") | ((F.col("distrust") >= p.threshold) & (F.col("distrust") > F.col("trust")))).alias("blocked"))


def host_verdicts(pages: DataFrame, trusted: DataFrame, blocked: DataFrame, p: Params = Params()) -> DataFrame:
    """A row a host."""
    hosts, edges = host_graph(pages, p)
    return checkpoint(propagate(marked(hosts, trusted, blocked, p), edges, p))


def page_verdicts(pages: DataFrame, trusted: DataFrame, blocked: DataFrame, p: Params = Params()) -> DataFrame:
    """A row a page, and one, with a null page_id, for each host that has no page (a link's target, or a name without its service prefix): page_id, host, trust, distrust, blocked, by its host's verdict.
    A page without host has a null one, no scores, and isn't blocked."""
    every = host_verdicts(pages, trusted, blocked, p)
    verdicts = every.select(F.col("host").alias("h"), "trust", "distrust", "blocked")
    rows = pick(pages, "page_id", "url").select("page_id", F.nullif(F.lower(F.regexp_extract("url", HOST, 2)), F.lit("")).alias("host"))
    joined = rows.join(sized(verdicts), F.col("host") == F.col("h"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    of_pages = joined.select("page_id", "host", zero("trust"), zero("distrust"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    return of_pages.union(every.where("pages = 0").select(F.lit(None).cast(rows.schema["page_id"].dataType), "host", "trust", "distrust", "blocked"))


def sql(trusted: list[str], blocked: list[str], p: Params = Params()) -> str:
    """The same for DuckDB, the iterations one after the other."""
    steps = "".join(
        f",\ns{i} AS (SELECT host, along, sum(s) AS s, sum(u) AS u, sum(r) AS r, sum(v) AS v FROM (SELECT host, along, seed * (1 - {p.damping}) AS s, 1 - {p.damping} AS u, 0.0::DOUBLE AS r, 0.0::DOUBLE AS v FROM seed"
        f" UNION ALL SELECT b, q.along, s * share * {p.damping}, u * share * {p.damping}, s * share * {p.damping}, u * share * {p.damping} FROM s{i - 1} q JOIN steps t ON q.host = t.a AND q.along = t.along) GROUP BY ALL)"
        for i in range(1, p.iterations + 1)
    )
    link = LINK.replace("'", "''")
    listed = lambda names: "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") l(n)" if names else "(SELECT '' AS n WHERE false)"
    bare = lambda c: rf"regexp_replace({c}, '^(?:{p.services})\.(.+\..+)$', '\1')"
    return rf"""
WITH raw AS MATERIALIZED (SELECT lower(regexp_extract(url, '{HOST}', 2)) AS host, regexp_extract_all(html, '{link}', 1) AS links FROM pages),
found AS (SELECT * FROM raw WHERE host <> ''),
links AS MATERIALIZED (SELECT host AS src, lower(l) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT host, unnest(links) AS l FROM found) WHERE lower(l) <> host GROUP BY ALL),
names AS (SELECT host, sum(pages) AS pages FROM (SELECT host, count(*) AS pages FROM found GROUP BY host UNION ALL SELECT dst, 0 FROM links) GROUP BY host),
under AS (SELECT * FROM (SELECT host, regexp_extract(host, '^(?:{p.services})\.(.+\..+)$', 1) AS bare FROM names) WHERE bare <> ''),
hosts AS MATERIALIZED (SELECT host, CAST(sum(pages) AS BIGINT) AS pages, {bare('host')} IN (SELECT {bare('lower(n)')} FROM {listed(trusted)}) AS t, {bare('host')} IN (SELECT {bare('lower(n)')} FROM {listed(blocked)}) AS x
  FROM (SELECT * FROM names UNION ALL SELECT bare, 0 FROM under) GROUP BY host),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT host, bare, 1 FROM under UNION ALL SELECT bare, host, 1 FROM under) GROUP BY ALL),
steps AS MATERIALIZED (SELECT true AS along, src AS a, dst AS b, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT false, dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM edges),
seed AS MATERIALIZED (SELECT host, true AS along, t::INT::DOUBLE AS seed FROM hosts UNION ALL SELECT host, false, x::INT::DOUBLE FROM hosts),
s0 AS (SELECT host, along, seed AS s, 1.0::DOUBLE AS u, 0.0::DOUBLE AS r, 0.0::DOUBLE AS v FROM seed){steps},
part AS (SELECT host, along, CASE WHEN v > 0 THEN r / v ELSE 0 END AS part FROM s{p.iterations}),
fin AS MATERIALIZED (SELECT h.host, pages, CASE WHEN t THEN 1 ELSE round(coalesce(a.part, 0), 6) END AS trust, CASE WHEN x THEN 1 ELSE round(coalesce(b.part, 0), 6) END AS distrust, x
  FROM hosts h LEFT JOIN part a ON a.host = h.host AND a.along LEFT JOIN part b ON b.host = h.host AND NOT b.along),
own AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 2)), '') AS host FROM pages),
every AS (SELECT page_id, own.host, trust, distrust, x FROM own LEFT JOIN fin USING (host) UNION ALL SELECT NULL, host, trust, distrust, x FROM fin WHERE pages = 0)
SELECT page_id, host, coalesce(trust, 0)::DOUBLE AS trust, coalesce(distrust, 0)::DOUBLE AS distrust, coalesce(x OR (distrust >= {p.threshold} AND distrust > trust), false) AS blocked FROM every
"""
