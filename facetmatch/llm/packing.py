"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

Examples are spread by a hash of their ids over groups of about `group_size`, and each group is packed by itself, so that the work grows in
proportion to the input. Within a group the dot-product heuristic (Panigrahy et al. 2011) fills one bin at a time: of the examples that
still fit in each dimension it takes the one with the largest sum of weight * remaining room * demand (both as shares of the
limits; the weights are the group's mean demands), ties by id and piece, until none fits. What lies in bins that are less than `full` in all three dimensions, as the last ones of each
group are, is taken out again and packed in groups of its own, so that only those last groups leave bins unfilled.

An example beyond a limit is cut into consecutive pieces, each as long as the limits allow, so that no token is lost or repeated.

Defined results: null and empty texts have no tokens and are left out, as are rows with a null id. A conversation that repeats a turn number keeps each
row, ordered by turn, role, text; a null role bears no loss. Texts are tokenised whole, of any length. Rows that repeat a document are packed each. Ties by all else are in the order of their pieces. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.llm.common import checkpoint, pick
from facetmatch.session import spread

#: What the byte-level vocabularies cut texts into, before their merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Params:
    max_tokens: int = 4096
    max_segments: int = 32
    max_loss: int = 3072
    group_size: int = 2000
    full: float = 0.9
    #: A file on the driver, which is sent to the executors once.
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"


_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(spark: SparkSession, text: Column, p: Params = Params()) -> Column:
    """Tokens of whole texts; 0 for null."""
    spark.sparkContext.addFile(p.vocabulary)
    name = os.path.basename(p.vocabulary)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(SparkFiles.get(name))
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype=np.int32)

    return count(text)


def pieces(turns: list[tuple[int, bool]], p: Params) -> list[tuple[int, int, int, int]]:
    """(first token, tokens, turns touched, loss-bearing tokens) of consecutive pieces of an example of (tokens, loss-bearing) turns; more than one only where it is beyond a limit."""
    out, begin, tokens, loss, n = [], 0, 0, 0, 0
    for size, bears in turns:
        while size > 0:
            room = min(p.max_tokens - tokens, p.max_loss - loss if bears else size, size)
            if room <= 0 or n == p.max_segments:
                out.append((begin, tokens, n, loss))
                begin, tokens, loss, n = begin + tokens, 0, 0, 0
                continue
            tokens, loss, size, n = tokens + room, loss + room * bears, size - room, n + 1
    return [*out, (begin, tokens, n, loss)] if tokens else out


def pack(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each row of demands (shares of the limits, each at most 1), in the order of ties."""
    n = len(demand)
    bins, place = np.full(n, -1), np.zeros(n, np.int64)
    left = np.arange(n)
    weighted = demand * demand.mean(0) if n else demand
    b = -1
    while len(left):
        b, room, k = b + 1, np.ones(demand.shape[1]), 0
        open_ = np.ones(len(left), bool)
        sizes, weights = demand[left], weighted[left]
        while True:
            open_ &= (sizes <= room + 1e-9).all(1)
            if not open_.any():
                break
            j = int(np.where(open_, np.round(weights @ room, 12), -1).argmax())
            bins[left[j]], place[left[j]], open_[j] = b, k, False
            room, k = room - sizes[j], k + 1
        left = left[bins[left] < 0]
    return bins, place


PIECE = "{id} long, piece int, first_token long, tokens long, segments int, loss_tokens long"
SCHEMA = "bin_id long, place int, " + PIECE


def grouped(rows: DataFrame, key: str, p: Params) -> DataFrame:
    """rows with g, their group, parted by it over all cores."""
    return spread(rows.withColumn("g", F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // p.group_size))))), "g").groupBy("g")


def packed(examples: DataFrame, id_name: str, p: Params = Params()) -> DataFrame:
    """examples: id, turns (array of struct tokens, loss). A row a piece: its bin, its place in it, where it begins, and what it takes of each limit."""
    limits = np.array([p.max_tokens, p.max_segments, p.max_loss], float)
    columns = [id_name, "piece", "first_token", "tokens", "segments", "loss_tokens"]

    def placed(out: pd.DataFrame, first: int) -> pd.DataFrame:
        demand = out[columns[3:]].to_numpy(float) / limits
        bins, place = pack(demand)
        use = np.zeros((int(bins.max(initial=-1)) + 1, 3))
        np.add.at(use, bins, demand)
        out["bin_id"], out["place"], out["full"] = bins + first, place, (use.max(1) >= p.full)[bins]
        return out[["bin_id", "place", *columns, "full"]]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((int(i), k, *part) for i, turns in zip(pdf["id"], pdf["turns"]) for k, part in enumerate(pieces([(t["tokens"], t["loss"]) for t in turns], p)))
        return placed(pd.DataFrame(rows, columns=columns), int(pdf["g"].iloc[0]) << 32)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        # bins of later groups have negative numbers
        return placed(pdf[columns].sort_values(columns, ignore_index=True), -1 - int(pdf["g"].iloc[0]) << 32)

    schema = SCHEMA.format(id=id_name) + ", full boolean"
    first = checkpoint(grouped(examples, "id", p).applyInPandas(cut, schema))
    rest = grouped(first.where("not full").select(*columns), id_name, p).applyInPandas(again, schema)
    return first.where("full").union(rest).drop("full")


def packed_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Each document is one example of one turn, all of its tokens bearing loss."""
    rows = pick(docs, "doc_id", "text").where("doc_id is not null and length(text) > 0")
    counted = rows.select(F.col("doc_id").cast("long").alias("id"), token_count(docs.sparkSession, F.col("text"), p).alias("n"))
    return packed(counted.select("id", F.array(F.struct(F.col("n").alias("tokens"), F.lit(True).alias("loss"))).alias("turns")), "doc_id", p)


def packed_conversations(conversations: DataFrame, p: Params = Params(), loss_role: str = "assistant") -> DataFrame:
    """Each conversation is one example; its turns are its segments, and those of loss_role bear loss."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null and length(text) > 0")
    counted = rows.select(F.col("conv_id").cast("long").alias("id"), "turn", "role", F.xxhash64("text").alias("h"), token_count(conversations.sparkSession, F.col("text"), p).alias("tokens"))
    turn = F.struct("turn", "role", "h", "tokens", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"))
    whole = counted.groupBy("id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return packed(whole.select("id", F.transform("all", lambda t: F.struct(t["tokens"].alias("tokens"), t["loss"].alias("loss"))).alias("turns")), "conv_id", p)
