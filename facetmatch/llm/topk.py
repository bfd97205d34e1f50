"""Exact top-k search by distributed histogram selection. Queries are the rows whose id is divisible by `every` (1: all), each against all rows.

Vectors are packed in blocks, and each pair of blocks is scored in one matrix product. A round counts, for each query, its scores in `bins` parts of an interval
that holds the kth greatest one, at first all of [-1, 1]; the part with the kth becomes the next interval. Once few scores lie at or above
an interval's lower end, or it can't be told from a point, all scores there are kept, at most k a block, and ranked. Scores are cosines rounded to
9 digits; ties go by the smaller id.

Defined results: a vector that is null, holds a null or NaN, is all zero, or differs in length from the most frequent (the longest, of equally frequent ones) is neither query nor
answer, like a row with a null id. A query's own id is no answer to it. Rows that repeat an id with equal vectors count once; with several vectors they
are several queries, told apart by nothing, and none an answer to another. With fewer than k others all are given. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetmatch.llm.common import checkpoint, pick

DIGITS = 9


@dataclass(frozen=True)
class Params:
    k: int = 10
    bins: int = 128
    block_rows: int = 2048
    #: A query is settled once so many times k of its scores are at or above its interval.
    slack: int = 8
    rounds: int = 6
    every: int = 1


def blocks(vectors: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """block, ids, mat (unit rows), as bytes: of the queries and of all rows."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x)) and exists(v, x -> x <> 0)")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = size["d"] if size else 1
    rows = rows.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    asked = rows.where(F.col("id") % p.every == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            m = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            m = m / np.sqrt((m * m).sum(1, keepdims=True))
            for lo in range(0, len(ids), p.block_rows):
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo : lo + p.block_rows].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m[lo : lo + p.block_rows]).tobytes()], pa.binary())], ["ids", "mat"])

    packed = lambda df: checkpoint(df.mapInArrow(run, "ids binary, mat binary").select(F.monotonically_increasing_id().alias("block"), "ids", "mat"))
    every = packed(rows)
    return (every if p.every == 1 else packed(asked)), every


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.round(q @ x.T, DIGITS) + 0.0


def _pairs(queries: DataFrame, packed: DataFrame) -> DataFrame:
    return queries.crossJoin(packed.select(F.col("ids").alias("xi"), F.col("mat").alias("xm")))


def _load(row: dict) -> tuple[np.ndarray, ...]:
    qi, xi = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["xi"], np.int64)
    s = scores(np.frombuffer(row["mat"]).reshape(len(qi), -1), np.frombuffer(row["xm"]).reshape(len(xi), -1))
    return qi, xi, s, qi[:, None] != xi[None, :]


def histograms(queries: DataFrame, packed: DataFrame, p: Params) -> DataFrame:
    """block, hist: of each open query of the block (int64, queries by bins + 1; the last is what lies above the interval)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "hist"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    if now is not None:
                        yield give()
                    now, total = row["block"], 0
                qi, xi, s, other = _load(row)
                lo, hi = np.frombuffer(row["lo"]), np.frombuffer(row["hi"])
                at = np.floor((s - lo[:, None]) * (p.bins / (hi - lo))[:, None]).astype(np.int64)
                np.clip(at, -1, p.bins, out=at)
                at[~other] = -1
                at += 1 + (p.bins + 2) * np.arange(len(qi))[:, None]
                total = total + np.bincount(at.ravel(), minlength=len(qi) * (p.bins + 2)).reshape(len(qi), -1)[:, 1:]
        if now is not None:
            yield give()

    return _pairs(queries, packed).mapInArrow(run, "block long, hist binary")


def refine(parts: DataFrame, queries: DataFrame, p: Params) -> DataFrame:
    """block, lo, hi, open: the next intervals, and how many of the block's queries aren't settled."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hist = sum(np.frombuffer(x, np.int64) for x in left["hist"]).reshape(-1, p.bins + 1)
        lo, hi, done = np.frombuffer(right["lo"].iloc[0]), np.frombuffer(right["hi"].iloc[0]), np.frombuffer(right["done"].iloc[0], bool)
        least = np.cumsum(hist[:, ::-1], 1)[:, ::-1]  # how many lie at or above each part's lower end
        part = (least[:, : p.bins] >= p.k).sum(1) - 1
        rows = np.arange(len(lo))
        few = part < 0  # fewer than k scores: all are kept
        part = np.maximum(part, 0)
        width = (hi - lo) / p.bins
        new_lo = np.where(few, -2.0, lo + part * width)
        new_hi = np.where(few, 2.0, lo + (part + 1) * width)
        settled = done | few | (least[rows, part] <= p.slack * p.k) | (new_hi - new_lo < 10.0**-DIGITS)
        lo, hi = np.where(done, lo, new_lo), np.where(done, hi, new_hi)
        return pd.DataFrame({"block": [int(right["block"].iloc[0])], "lo": [lo.tobytes()], "hi": [hi.tobytes()], "done": [settled.tobytes()], "open": [int((~settled).sum())]})

    return parts.groupBy("block").cogroup(queries.groupBy("block")).applyInPandas(run, "block long, lo binary, hi binary, done binary, open long")


def top_k(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    asked, packed = blocks(vectors, p)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x.as_py()) // 8 for x in batch.column(1)]
            full = lambda v: pa.array([np.full(i, v).tobytes() for i in n], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), full(-1 - 1e-6), full(1 + 1e-6), full(False)], ["block", "lo", "hi", "done"])

    bounds = asked.select("block", "ids").mapInArrow(start, "block long, lo binary, hi binary, done binary").withColumn("open", F.lit(1).cast("long"))
    for _ in range(p.rounds):
        # blocks whose queries are all settled aren't scored again
        now = bounds.where("open > 0")
        parts = histograms(asked.join(now.select("block", "lo", "hi"), "block"), packed, p)
        bounds = checkpoint(refine(parts, now.select("block", "lo", "hi", "done"), p).union(bounds.where("open = 0").select("block", "lo", "hi", "done", "open")))
        if not bounds.agg(F.sum("open")).first()[0]:
            break

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, xi, s, other = _load(row)
                a, b = np.nonzero((s >= np.frombuffer(row["lo"])[:, None] - 10.0**-DIGITS) & other)
                v = s[a, b]
                order = np.lexsort((xi[b], -v, a))
                a, b, v = a[order], b[order], v[order]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                a, b, v = a[nth < p.k], b[nth < p.k], v[nth < p.k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["block"])), pa.array(a), pa.array(qi[a]), pa.array(xi[b]), pa.array(v)], ["block", "row", "query_id", "vec_id", "score"])

    kept = _pairs(asked.join(bounds.select("block", "lo"), "block"), packed).mapInArrow(keep, "block long, row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


#: The registered query's.
QUERIES = Params(every=20)

SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
""".format(k=QUERIES.k, every=QUERIES.every)
