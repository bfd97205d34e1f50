"""Cross-entropy difference (Moore and Lewis 2010) between a target and a background n-gram model.

Tokens are folded words (letters of ASCII and Latin-1 in lower case, digits, bytes from 128; all else parts them) and an end mark. Both models share one
vocabulary, all words of target and background, and are matched: the same order, smoothing and tables. Words and bigrams are all counted, by
64-bit keys. With `vocabulary`, only so many of the most frequent words are told apart (ties by hash), and the rest are <unk>; with `bucket_bits`, bigrams
share 2**`bucket_bits` buckets. Neither is set by default.

No table of counts is gathered anywhere. Texts are cut into pieces; each sends its distinct keys with their counts to the parts of the key space, which
add them up and send the totals back to the piece, which scores its documents. What a task holds is one piece, or one part; the number of parts grows with the tokens.

P(w) = (c(w) + alpha) / (N + alpha (V + 2)); P(w|v) = (c(v,w) + mu P(w)) / (c(v) + mu). A document's score is the mean over its
tokens of target loss less background loss, in bits: the lower, the more like the target. Each document is left out of its own score: its counts of words, bigrams
and tokens are taken off the model that it was counted for, so that a score tells likeness and not membership. Only the row itself is left out: a copy of it is another document,
which counts where its own label puts it, so that copies of a target document look like the target (deduplicate first where that isn't wanted).

Defined results: texts without a word (null and empty ones too) have one token, the end mark. A document is of the target if any of its labels has quality
1 and none toxic 1; unlabelled and null-id rows and null labels are background. Repeated rows count each, and get equal scores. With no target row (or none but the document itself) the target model is
uniform. Empty tables give no rows. Texts are read whole, of any length. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmatch.llm.common import BASE, chunks, mix, pick, sized, utf8, words


@dataclass(frozen=True)
class Params:
    vocabulary: int | None = None
    bucket_bits: int | None = None
    alpha: float = 0.5
    mu: float = 50.0
    #: Distinct keys that a task holds before it hands them on.
    held: int = 1 << 20
    #: Bytes of text a piece (a longer text alone), and tokens that a part of the key space stands for.
    piece: int = 1 << 23
    part_tokens: int = 1 << 21


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target."""
    known = pick(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    chosen = known.where("doc_id is not null and q = 1 and coalesce(t, 0) <> 1").select(F.col("doc_id").alias("target_id"))
    rows = pick(docs, "doc_id", "text")
    return rows.join(sized(chosen), rows["doc_id"] == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))


#: The end mark's id where words are their own hashes, and what sets the keys of words and of buckets apart from those of bigrams.
END, WORD, BUCKET = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


def tokens(data: np.ndarray, at: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens, each row closed by the end mark, and where each row begins. vocabulary: sorted hashes; <unk> and the end mark follow it. Without it words are their hashes."""
    h, first = words(data, at)
    ids, v = h, 0 if vocabulary is None else len(vocabulary)
    if vocabulary is not None:
        place = np.minimum(np.searchsorted(vocabulary, h), max(v - 1, 0))
        ids = (np.where(vocabulary[place] == h, place, v) if v else np.zeros(len(h))).astype(np.uint64)
    return np.insert(ids, first[1:], END if vocabulary is None else np.uint64(v + 1)), first + np.arange(len(first))


def bigrams(ids: np.ndarray, first: np.ndarray, end: int, bits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each token what stands before it (the end mark, at the start), and the 64-bit key of the pair, or its bucket."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = end
    if bits is None:
        return before, mix(mix(before.astype(np.uint64) + WORD) * BASE + ids.astype(np.uint64))
    return before, (mix(before.astype(np.uint64) * np.uint64(0x1000003) ^ (ids.astype(np.uint64) << np.uint64(32))) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(parts: Iterator[tuple[np.ndarray, np.ndarray]], held: int) -> Iterator[pa.RecordBatch]:
    """parts: keys, and whether each is of the target. Sums by key, handed on whenever many are held."""
    k, t, b = (np.zeros(0, np.int64) for _ in range(3))

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(b)], ["k", "t", "b"])

    for keys, target in parts:
        new, inverse = np.unique(keys, return_inverse=True)
        here = np.bincount(inverse, target, len(new)).astype(np.int64)
        total = np.bincount(inverse, minlength=len(new))
        k, inverse = np.unique(np.concatenate([k, new]), return_inverse=True)
        t, b = (np.bincount(inverse, np.concatenate(x), len(k)).astype(np.int64) for x in ((t, here), (b, total - here)))
        if len(k) > held:
            yield give()
            k, t, b = (np.zeros(0, np.int64) for _ in range(3))
    if len(k):
        yield give()


def counts(rows: DataFrame, keys, p: Params) -> DataFrame:
    """k, t, b: how often each key of keys(bytes, offsets) -> (keys, where each row begins) is seen in target and background. rows: text, target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                data, at = utf8(batch.column(0))
                target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for lo, hi, part, offsets in chunks(data, at, 1 << 22):
                    k, first = keys(part, offsets)
                    yield k, np.repeat(target[lo:hi], np.diff(first))

        yield from _counted(parts(), p.held)

    return rows.select("text", "target").mapInArrow(run, "k long, t long, b long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


@dataclass
class Models:
    rows: DataFrame  # text, target: what is counted
    vocabulary: np.ndarray | None
    words: int
    total: tuple[int, int]  # tokens of target and background


def fit(rows: DataFrame, p: Params = Params()) -> Models:
    """rows: text, target. What both models need besides the counts by key."""

    def word_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, first = tokens(data, at, None)
        return ids.view(np.int64), first

    seen, end = counts(rows, word_keys, p), int(END.astype(np.int64))
    vocabulary = None
    if p.vocabulary is not None:
        top = seen.where(F.col("k") != end).orderBy(F.desc(F.col("t") + F.col("b")), "k").limit(p.vocabulary).select("k").toArrow()["k"].to_numpy()
        vocabulary = np.sort(top.astype(np.int64).view(np.uint64))
    n = seen.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count_if(F.col("k") != end).alias("v")).first()
    return Models(rows, vocabulary, n["v"] if vocabulary is None else len(vocabulary), (n["t"] or 0, n["b"] or 0))


def _blob(x: np.ndarray) -> bytes:
    """Whole numbers from 0, packed: all their lowest bytes, then the next, as many as the greatest needs."""
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T[:size]
    return bytes([size]) + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unblob(x: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : x[0]] = np.frombuffer(pa.decompress(x[1:], n * x[0], "zstd", asbytes=True), np.uint8).reshape(x[0], n).T
    return planes.view(np.uint64).ravel()


def _keys(vocab: np.ndarray, w: np.ndarray, first: np.ndarray, end: np.uint64, bits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece, from its distinct ids and each token's place among them: keys of the ids and then of the distinct pairs, their order, and each token's place among the pairs."""
    _, pair = bigrams(vocab[w], first, end, bits)
    pairs, of = np.unique(pair if bits is None else mix(pair.astype(np.uint64) + BUCKET), return_inverse=True)
    keys = np.concatenate([mix(vocab ^ WORD), pairs])
    return keys, np.argsort(keys, kind="stable"), of


def _within(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """How often each x (below n) is seen in its document."""
    _, at, often = np.unique(doc * n + x, return_inverse=True, return_counts=True)
    return often[at]


def score(rows: DataFrame, models: Models, p: Params = Params()) -> DataFrame:
    """rows: doc_id, text. By the counts of the models' rows; if rows are these themselves, each by the counts of all the others."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary, v, total = models.vocabulary, models.words, models.total
    end = END if vocabulary is None else np.uint64(v + 1)
    bits = max(4, (sum(total) // p.part_tokens).bit_length())
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    # of: whether a row counts for the target; null: it is only scored
    if rows is models.rows:
        every = rows.select("doc_id", "text", F.col("target").alias("of"), F.lit(True).alias("give"))
    else:
        every = rows.select("doc_id", "text", F.lit(None).cast("boolean").alias("of"), F.lit(True).alias("give")).union(models.rows.select(F.lit(None).cast(kind), "text", "target", F.lit(False)))
    schema = f"piece long, part long, n long, keys binary, t binary, b binary, docs array<{kind}>, sizes binary, role binary, vocab binary, w binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = utf8(batch.column(1))
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False).astype(bool)
            target = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            give = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            # of each row: whether it is scored, and counted for target, for background
            role = (give + 2 * (known & target) + 4 * (known & ~target)).astype(np.uint8)
            for lo, hi, part, offsets in chunks(data, at, p.piece):
                ids, first = tokens(part, offsets, vocabulary)
                size = np.diff(first)
                vocab, w, often = np.unique(ids, return_inverse=True, return_counts=True)
                rank = np.argsort(-often, kind="stable")  # frequent ones first, which packs best
                vocab, w = vocab[rank], np.argsort(rank)[w]
                keys, order, of = _keys(vocab, w, first, end, p.bucket_bits)
                here = [np.repeat(x[lo:hi], size) for x in (known & target, known & ~target)]
                t, b = (np.concatenate([np.bincount(w, x, len(vocab)), np.bincount(of, x, len(keys) - len(vocab))]).astype(np.int64)[order] for x in here)
                keys = keys[order]
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).tolist()
                filled = [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                docs = pa.ListArray.from_arrays(pa.array([0] * (len(filled) + 1) + [hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo), mask=pa.array([True] * len(filled) + [False]))
                none = [None] * len(filled)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece] * (len(filled) + 1), pa.int64()), pa.array([*(k for k, _, _ in filled), -1 - piece], pa.int64()), pa.array([*(y - x for _, x, y in filled), len(w)], pa.int64())]
                    + [pa.array([*x, None], pa.binary()) for x in ([_blob(np.diff(keys[x:y], prepend=np.uint64(0))) for _, x, y in filled], [_blob(t[x:y]) for _, x, y in filled], [_blob(b[x:y]) for _, x, y in filled])]
                    + [docs, *(pa.array([*none, x], pa.binary()) for x in (size.astype(np.int64).tobytes(), role[lo:hi].tobytes(), vocab.tobytes(), _blob(w)))],
                    names,
                )
                piece += 1

    def add(group: pa.Table) -> pa.Table:
        """The slices of one part, with totals for counts; a piece's row of documents as it is."""
        if group["docs"].null_count < len(group):
            return group
        n = group["n"].to_numpy()
        get = lambda c: group[c].to_pylist()
        keys = np.concatenate([np.cumsum(_unblob(x, k), dtype=np.uint64) for x, k in zip(get("keys"), n.tolist())])
        of = np.unique(keys, return_inverse=True)[1]
        cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
        for c in "tb":
            every = np.concatenate([_unblob(x, k) for x, k in zip(get(c), n.tolist())]).astype(np.int64)
            sums = np.bincount(of, every).astype(np.int64)[of]
            group = group.set_column(names.index(c), group.schema.field(c), pa.array([_blob(sums[x:y]) for x, y in zip(cuts, cuts[1:])], group.schema.field(c).type))
        at = names.index("keys")
        return group.set_column(at, group.schema.field("keys"), pa.nulls(len(group), group.schema.field("keys").type))

    def finish(group: pa.Table) -> pa.Table:
        part = group["part"].to_numpy()
        at, n = int(np.argmin(part)), group["n"].to_numpy()
        last = lambda c: group[c][at].as_py()
        size, vocab = np.frombuffer(last("sizes"), np.int64), np.frombuffer(last("vocab"), np.uint64)
        role = np.frombuffer(last("role"), np.uint8)
        w = _unblob(last("w"), int(n[at])).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        keys, order, of = _keys(vocab, w, first, end, p.bucket_bits)
        before, _ = bigrams(w, first, int(np.flatnonzero(vocab == end)[0]), 1)
        rows = [i for i in np.argsort(part).tolist() if i != at]
        # how often each token's word, pair and word before are in its own document; the end mark is once
        doc = np.repeat(np.arange(len(size)), size)
        own_word, own_pair = _within(doc, w, len(vocab)), _within(doc, of, len(keys) - len(vocab))
        own_before = np.empty_like(own_word)
        own_before[1:] = own_word[:-1]
        own_before[first[:-1]] = 1
        out = []
        for m, c in enumerate("tb"):
            blobs = group[c].to_pylist()
            sums = np.empty(len(keys))
            sums[order] = np.concatenate([_unblob(blobs[i], int(n[i])) for i in rows])
            word, pair = sums[: len(vocab)], sums[len(vocab) :]
            mine = (role & (2 << m) > 0).astype(np.int64)  # what is left out
            left = mine[doc]
            single = (word[w] - left * own_word + p.alpha) / (total[m] - mine * size + p.alpha * (v + 2))[doc]
            loss = -np.log2((pair[of] - left * own_pair + p.mu * single) / (word[before] - left * own_before + p.mu))
            out.append(np.add.reduceat(loss, first[:-1]) / size)
        ids = pa.concat_arrays(group["docs"].slice(at, 1).chunks).flatten()
        t, b = out
        done = pa.Table.from_arrays([ids, pa.array(size), pa.array(np.round(t, 6)), pa.array(np.round(b, 6)), pa.array(np.round(t - b, 6))], ["doc_id", "tokens", "loss_target", "loss_background", "difference"])
        return done.filter(pa.array(role & 1 > 0))

    summed = every.mapInArrow(split, schema).groupBy("part").applyInArrow(add, schema)
    return summed.groupBy("piece").applyInArrow(finish, f"doc_id {kind}, tokens long, loss_target double, loss_background double, difference double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """A row a document: doc_id, tokens, loss_target, loss_background, difference."""
    rows = with_target(docs, labels)
    return score(rows, fit(rows, p), p)
