"""Queries of the batch matcher, over the catalogue and query stream made of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.functions import sql as S
from facetmatch.functions.similarity import WEIGHTS, osa_distance, trigrams
from facetmatch.functions.text import digits_of, match_normalize, words_of
from facetmatch.operators import matching
from facetmatch.operators.matching import Policy
from facetmatch.operators.catalog import stored
from facetmatch.plans.catalog import CTE, entries_of
from facetmatch.registry import query
from facetmatch.session import checkpoint
from facetmatch.sources import testdata

QUERY_SQL = r""", users AS (SELECT DISTINCT user_id FROM events), np AS (SELECT count(*) AS n FROM part),
queries AS (SELECT user_id AS query_id, kind, CASE WHEN user_id % 2 = 0 THEN array_to_string(list_concat(string_split(name, ' ')[1:2], string_split(name, ' ')[4:]), ' ') ELSE regexp_replace(name, '^(\S+ .)(.)(.)', '\1\3\2') END AS query
  FROM users, np, part_x WHERE p_partkey = (user_id * 13) % n)"""
PLAIN = CTE + QUERY_SQL + f""", q AS (SELECT *, {S.norm('query')} AS qn FROM queries), qt AS (SELECT query_id, kind, qn, unnest(list_distinct({S.words('qn')})) AS token, {S.words('qn')} AS toks FROM q),
aw AS (SELECT id, unnest({S.words('norm')}) AS token FROM alias_n),
post AS (SELECT DISTINCT e.ord, e.kind, length(e.norm) AS size, token FROM (SELECT ord, unnest(tokens) AS token FROM entries UNION SELECT e.ord, token FROM aw JOIN entries e USING (id)) w JOIN entries e USING (ord)),
keep AS (SELECT token FROM post GROUP BY token HAVING count(*) <= {{broad}}),
hit AS (SELECT query_id, ord, count(*) AS shared, any_value(size) AS size, min(list_position(toks, token)) AS spot FROM qt JOIN post USING (token) JOIN keep USING (token) WHERE qt.kind = post.kind GROUP BY query_id, ord),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, size, spot, ord) AS nth FROM hit) WHERE nth <= 25)"""
PLAIN = PLAIN.replace("{broad}", "2000")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query as it is, without variants."""
    q = testdata.match_queries(spark, sf_dir)
    return checkpoint(q.select("query_id", "kind", F.lit(0).alias("pos"), match_normalize(F.col("query")).alias("norm")))


@query(PLAIN + " SELECT query_id, ord, shared, nth FROM cand")
def candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(forms(spark, sf_dir), stored(entries_of(spark, sf_dir)), Policy()).select("query_id", "ord", "shared", "nth")


SCORED = PLAIN + f""", g AS (SELECT e.ord, e.norm, e.tokens, {S.grams(S.norm('e.norm'))} AS eg, {S.digits('e.norm')} AS ed FROM entries e),
ag AS (SELECT e.ord, list(a.norm) AS ans, list({S.grams(S.norm('a.norm'))}) AS ags FROM alias_n a JOIN entries e USING (id) GROUP BY e.ord),
qg AS (SELECT query_id, qn, {S.words('qn')} AS qt, {S.grams(S.norm('qn'))} AS qg, {S.digits('qn')} AS qd FROM q),
f AS (SELECT c.query_id, c.ord, c.nth, {S.dice('qg', 'eg')} AS f1, {S.jaccard('qt', 'g.tokens')} AS f2, CASE WHEN qn = g.norm OR list_contains(coalesce(ans, []), qn) THEN 1.0 ELSE 0.0 END AS f3,
  CASE WHEN list_contains(qt, g.tokens[1]) THEN 1.0 ELSE 0.0 END AS f4, CASE WHEN len(qd) + len(ed) = 0 THEN 0.5 ELSE {S.jaccard('qd', 'ed')} END AS f5,
  CASE WHEN starts_with(qn, g.norm) OR starts_with(g.norm, qn) THEN 1.0 ELSE 0.0 END AS f6, coalesce(list_max(list_transform(ags, lambda x: {S.dice('qg', 'x')})), 0.0) AS f7
  FROM cand c JOIN g USING (ord) JOIN qg USING (query_id) LEFT JOIN ag USING (ord)),
s AS (SELECT query_id, ord, nth, 1 / (1 + exp(-({WEIGHTS[0]} + {WEIGHTS[1]} * f1 + {WEIGHTS[2]} * f2 + {WEIGHTS[3]} * f3 + {WEIGHTS[4]} * f4 + {WEIGHTS[5]} * f5 + {WEIGHTS[6]} * f6 + {WEIGHTS[7]} * greatest(f1, f7)))) AS s FROM f)"""


@query(SCORED + " SELECT query_id, ord, round(s, 6) AS score FROM s")
def score_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.scored_candidates(forms(spark, sf_dir), stored(entries_of(spark, sf_dir)), Policy()).select("query_id", "ord", F.round("s", 6).alias("score"))


def decided(policy: Policy) -> str:
    w = "".join(f" + {x} * {f}" for x, f in zip(policy.weights[1:], ("f1", "f2", "f3", "f4", "f5", "f6", "greatest(f1, f7)")))
    return SCORED + f""", p AS (SELECT query_id, 1 / (1 + exp(-({policy.weights[0]}{w}))) AS s FROM f), b AS (SELECT query_id, max(round(s, 9)) AS s FROM p GROUP BY query_id)
SELECT q.query_id, round(coalesce(s, 0), 6) AS score, CASE WHEN coalesce(s, 0) < {policy.review} THEN 'no-match' WHEN s >= {policy.auto} THEN 'auto' ELSE 'review' END AS decision FROM q LEFT JOIN b USING (query_id)"""


def decisions(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    f = forms(spark, sf_dir)
    best = matching.scored_candidates(f, stored(entries_of(spark, sf_dir)), policy).groupBy("query_id").agg(F.max(F.round("s", 9)).alias("s"))
    return f.select("query_id").join(best, "query_id", "left").select("query_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"), matching.decision(F.coalesce("s", F.lit(0.0)), policy).alias("decision"))


@query(decided(Policy()))
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM9, BM17, without variants and gates."""
    return decisions(spark, sf_dir, Policy())


#: Other weights and thresholds than the usual ones.
STRICT = Policy(weights=(-6.0, 3.5, 1.0, 1.0, -0.5, 2.0, 0.5, 2.5), auto=0.8, review=0.3)


@query(decided(STRICT))
def match_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM4."""
    return decisions(spark, sf_dir, STRICT)


@query()
def match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = stored(entries_of(spark, sf_dir))
    return matching.match_batch(testdata.match_queries(spark, sf_dir), catalog)


@query()
def variants_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = testdata.match_queries(spark, sf_dir)
    return matching.expand(q.select("query_id", "kind", F.array("query").alias("forms")))


@query(CTE + QUERY_SQL + f""", q AS (SELECT {S.norm('query')} AS qn FROM queries), t AS (SELECT DISTINCT unnest({S.words('qn')}) AS token FROM q),
v AS (SELECT token AS word, count(*) AS freq, min(ord * 100 + spot) AS first FROM (SELECT ord, unnest(tokens) AS token, unnest(range(len(tokens))) AS spot FROM entries) WHERE length(token) >= 3 AND NOT regexp_matches(token, '\\d') GROUP BY token),
u AS (SELECT token, CASE WHEN length(token) >= 7 THEN 2 ELSE 1 END AS most FROM t WHERE length(token) >= 4 AND NOT regexp_matches(token, '\\d') AND token NOT IN (SELECT word FROM v)),
p AS (SELECT token, word, freq, first, damerau_levenshtein(token, word) AS d, most FROM u, v WHERE left(token, 1) = left(word, 1) OR length(token) >= 6)
SELECT token, arg_min(word, d * 1000000000000 - freq * 10000000 + first) AS fixed FROM p WHERE d <= most GROUP BY token""")
def typo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM5, BM7, over the stream's unknown words (each is two swapped letters, where both metrics agree)."""
    q = testdata.match_queries(spark, sf_dir)
    vocab = entries_of(spark, sf_dir).vocab
    toks = q.select(F.explode(words_of(match_normalize(F.col("query")))).alias("token")).distinct().where("length(token) >= 4 and not token rlike '[0-9]'")
    unknown = toks.join(vocab, "token", "left_anti").select("token", F.when(F.length("token") >= 7, 2).otherwise(1).alias("most"), F.lit(False).alias("frequent"), F.lit(0).alias("tf"))
    return matching.nearest_tokens(unknown, vocab).select("token", "fixed")
