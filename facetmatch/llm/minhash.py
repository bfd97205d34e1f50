"""Near-duplicates by b-bit MinHash.

A document's shingles are pairs of neighbouring words (a document of one word has that word as its shingle). `perms` minima over
them give band keys for candidates; of each minimum only the low `bits` bits are kept, packed into 64-bit words. The
similarity of two documents follows from the share m of equal low bits, corrected for chance: (m - 2**-bits) / (1 - 2**-bits).

Documents with all minima alike are joined without comparing. In a band's bucket a breadth-first search compares each member reached
with those not yet reached, so that a clique of n copies costs n comparisons, while the connected parts are exactly those of
all pairs; nothing is capped. Parts across bands are joined by the large-star and small-star rounds of Kiveris et al.

A bucket of more than `bucket` members is cut into parts of about that size by a hash of the id, each searched by itself. Once all parts are joined, most members of such a bucket belong to one group, and links within a group
can't change it; so only members outside the bucket's largest group are then compared, block by block, with those of other groups. So no task holds more than two blocks, and the groups are still exactly those of all pairs.

Defined results: null, empty and wordless texts are nobody's duplicate, nor are rows with a null id. Rows that repeat an id
count once (which of two different texts under one id is taken is the larger one). The smallest id of a group is kept. Empty
tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmatch.llm.common import checkpoint, chunks, mix, pick, sized, utf8, without, words


@dataclass(frozen=True)
class Params:
    perms: int = 128
    bits: int = 2
    rows_per_band: int = 4
    threshold: float = 0.6
    seed: int = 11
    #: Members of a bucket that one task searches; of larger ones each part.
    bucket: int = 50_000

    @property
    def longs(self) -> int:
        return self.perms * self.bits // 64


def minima(data: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a word, and their minima (rows by perms)."""
    h, first = words(data, at)
    n = np.diff(first)
    rows = np.flatnonzero(n)
    if not len(rows):
        return rows, np.zeros((0, p.perms), np.uint64)
    pair = np.empty(len(h), np.uint64)
    pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:])
    last = first[1:][rows] - 1
    keep = np.ones(len(h), bool)
    keep[last[n[rows] > 1]] = False  # a pair across two documents
    pair[last[n[rows] == 1]] = h[last[n[rows] == 1]]
    pair = pair[keep]
    counts = np.maximum(n[rows] - 1, 1)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rng = np.random.default_rng(p.seed)
    a, b = rng.integers(0, 1 << 63, p.perms, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, p.perms, np.uint64)
    out, x = np.empty((len(rows), p.perms), np.uint64), np.empty_like(pair)
    for j in range(p.perms):
        np.multiply(pair, a[j], out=x)
        x += b[j]
        out[:, j] = np.minimum.reduceat(x, begin)
    return rows, mix(out)


def pack(m: np.ndarray, p: Params) -> np.ndarray:
    """The low bits of the minima, in unsigned 64-bit words."""
    per = 64 // p.bits
    low = (m & np.uint64((1 << p.bits) - 1)).reshape(len(m), p.longs, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(p.bits))).sum(2, dtype=np.uint64)


def _field_mask(p: Params) -> int:
    return sum(1 << i for i in range(0, 64, p.bits))


def similarity(x: np.ndarray, y: np.ndarray, p: Params) -> np.ndarray:
    d = x ^ y
    d = reduce(np.bitwise_or, [d >> np.uint64(i) for i in range(p.bits)]) & np.uint64(_field_mask(p))
    same = 1 - np.bitwise_count(d).sum(-1) / p.perms
    return (same - 2.0**-p.bits) / (1 - 2.0**-p.bits)


def similarity_column(a: str, b: str, p: Params) -> F.Column:
    """similarity() of two array<bigint> columns, as built-in bit counts."""
    mask = _field_mask(p)
    mask -= (mask >> 63) << 64
    differing = F.lit(0)
    for i in range(p.longs):
        d = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        d = reduce(lambda s, t: s.bitwiseOR(t), [F.shiftrightunsigned(d, j) for j in range(p.bits)])
        differing = differing + F.bit_count(d.bitwiseAND(F.lit(mask)))
    return (1 - differing / p.perms - 2.0**-p.bits) / (1 - 2.0**-p.bits)


def signatures(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """id, full (hash of all minima), keys (a hash a band) and sig (packed low bits), for texts with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = p.perms // p.rows_per_band
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi, part, offsets in chunks(data, at):
                rows, m = minima(part, offsets, p)
                keys = m[:, : bands * p.rows_per_band].reshape(len(m), bands, p.rows_per_band)
                key = np.tile(salt, (len(m), 1))
                for j in range(p.rows_per_band):
                    key = mix(key * np.uint64(5) + keys[:, :, j])
                full = mix((key * (2 * np.arange(bands, dtype=np.uint64) + np.uint64(1))).sum(1, dtype=np.uint64))
                sig = pack(m, p)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(full.view(np.int64)), lists(key), lists(sig)], ["id", "full", "keys", "sig"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    return rows.mapInArrow(run, "id long, full long, keys array<bigint>, sig array<bigint>")


def bucket_edges(ids: np.ndarray, sigs: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Edges that span the connected parts of one bucket's members under similarity >= threshold."""
    left, out = np.arange(len(ids)), []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = similarity(sigs[left], sigs[x], p) >= p.threshold
            found, left = left[near], left[~near]
            out += [(int(ids[x]), int(ids[y])) for y in found]
            frontier += found.tolist()
    return out


def candidate_edges(bucketed: DataFrame, p: Params) -> DataFrame:
    """bucketed: key, id, sig, where rows of a key lie together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def edges(key: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            two = first[size == 2]
            two = two[similarity(sigs[two], sigs[two + 1], p) >= p.threshold]
            a, b = [ids[two]], [ids[two + 1]]
            for lo, n in zip(first[size > 2], size[size > 2]):
                if found := bucket_edges(ids[lo : lo + n], sigs[lo : lo + n], p):
                    x = np.array(found)
                    a.append(x[:, 0])
                    b.append(x[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, ids = (batch.column(i).to_numpy() for i in (0, 1))
            sigs = np.asarray(batch.column(2).flatten()).view(np.uint64).reshape(n, p.longs)
            if held and held[-1][0][-1] != key[0]:
                yield edges(*map(np.concatenate, zip(*held)))
                held = []
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                held.append((key[:cut], ids[:cut], sigs[:cut]))
                yield edges(*map(np.concatenate, zip(*held)))
                held = []
            held.append((key[cut:], ids[cut:], sigs[cut:]))
        if held:
            yield edges(*map(np.concatenate, zip(*held)))

    return bucketed.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's connected part, for nodes other than roots."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
        joined = both.join(lowest, F.col("a") == F.col("k"))
        if large:
            new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    pairs = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        pairs = checkpoint(star(star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)


def cross_edges(members: DataFrame, p: Params) -> DataFrame:
    """members: key, id, sig, root, of large buckets. An edge for each two groups of a bucket that a pair of members links, between members outside the bucket's largest group and all others."""
    sizes = members.groupBy("key", "root").count()
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("groups"), F.sum("count").alias("n")).where("groups > 1")
    known = members.join(sized(largest), "key")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / p.bucket).cast("bigint"))
    row = F.struct("id", "root", "sig")
    blocks = known.groupBy("key", block.alias("block")).agg(F.collect_list(row).alias("right"))
    rest = known.where("root <> main").groupBy("key", block.alias("part")).agg(F.collect_list(row).alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, ra, x), (b, rb, y) = (_unpacked(batch.column(c)[i].values, p) for c in (0, 1))
                found: dict[tuple[int, int], tuple[int, int]] = {}
                for j in range(len(a)):
                    hit = np.flatnonzero((rb != ra[j]) & (similarity(y, x[j], p) >= p.threshold))
                    for r, k in zip(*np.unique(rb[hit], return_index=True)):
                        found.setdefault((int(ra[j]), int(r)), (int(a[j]), int(b[hit[k]])))
                if found:
                    u, v = zip(*found.values())
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

    pairs = rest.join(blocks, "key").select("left", "right")
    return pairs.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "a long, b long")


def _unpacked(rows: pa.StructArray, p: Params) -> tuple[np.ndarray, ...]:
    """ids, roots, signatures."""
    return rows.field("id").to_numpy(), rows.field("root").to_numpy(), np.asarray(rows.field("sig").flatten()).view(np.uint64).reshape(len(rows), p.longs)


def groups(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """node, root for each document of a group but the kept one; and all signatures."""
    sigs = checkpoint(signatures(docs, p))
    alike = sigs.groupBy("full").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    exact = sigs.select("id", "full").join(alike.where("n > 1").select("full", "rep"), "full").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    one = sigs.join(alike.select("full", "rep"), "full").where("id = rep").select("id", "keys", "sig").dropDuplicates(["id", "keys"])
    exploded = one.select(F.explode("keys").alias("key"), "id", "sig")
    large = checkpoint(sigs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > p.bucket))
    near = lambda rows: candidate_edges(rows.repartition("key").sortWithinPartitions("key", "id"), p)
    if large.isEmpty():
        return components(near(exploded).union(exact)), sigs
    spread = exploded.join(sized(large), "key", "left")
    part = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / p.bucket).cast("bigint"))))
    edges = checkpoint(near(spread.select(part.alias("key"), "id", "sig")).union(exact))
    first = components(edges)
    members = exploded.join(sized(large.select("key")), "key", "left_semi").join(first, F.col("id") == F.col("node"), "left").select("key", "id", "sig", F.coalesce("root", "id").alias("root"))
    more = checkpoint(cross_edges(members, p))
    return (first if more.isEmpty() else components(edges.union(more))), sigs


def duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each document of a group but the kept one: doc_id, kept_doc_id, estimated similarity of the two (a group holds together by chains, so it can lie under the threshold)."""
    parts, sigs = groups(docs, p)
    s = sigs.groupBy("id").agg(F.max("sig").alias("sig"))
    pairs = parts.join(s.select(F.col("id").alias("node"), F.col("sig").alias("x")), "node").join(s.select(F.col("id").alias("root"), F.col("sig").alias("y")), "root")
    return pairs.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"), F.round(similarity_column("x", "y", p), 4).alias("similarity"))


def deduplicated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each group, with docs' columns. Rows that repeat an id leave one row (null ids aside)."""
    left = without(docs, groups(docs, p)[0].select("node"))
    ids = pick(docs, "doc_id").where("doc_id is not null")
    twice = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    names = left.columns
    key = f"_{names.index('doc_id')}"
    plain = left.toDF(*[f"_{i}" for i in range(len(names))])
    several = plain.join(twice, plain[key] == twice["doc_id"], "left_semi").dropDuplicates([key])
    return plain.join(twice, plain[key] == twice["doc_id"], "left_anti").union(several).toDF(*names)
