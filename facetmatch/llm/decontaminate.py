"""Benchmark passages in documents, also with edits, by way of the CGK embedding.

Texts are folded first (letters of ASCII and Latin-1 in lower case; each run of other ASCII bytes than letters and digits is one space). An item of
n folded bytes is found in a document if some stretch of it is within floor(max_edits * n) edits (Levenshtein) of the item.

The CGK random walk (Chakraborty, Goldenberg, Koucky 2016) maps a string to twice its length of symbols: at each step it writes the current byte, and a
random bit of (step, byte) says whether it moves on. A few edits then change few positions, so that the Hamming distance bounds the
edit distance, and hashes of sampled positions collide for near strings. Each round draws a new walk and new positions.

The collision rate falls with the number of edits, so items from twice `block` bytes on are embedded block by block (of `block` to twice as many bytes): of m blocks at least one
holds no more than 1/m of the edits. There are as many rounds as the block with the lowest collision rate needs for `recall`, found by editing blocks at random to their
limit (at most `measured` blocks of each number of edits, drawn by seed; a bound on what is measured, not on rounds or items). Nothing depends on an item's length but its own exact check.

Windows are as long as the block. They are placed by pigeonhole: a block within d edits holds one of its d + 1 equal pieces
unchanged, at most d bytes from its place; so only windows around such a piece are embedded, and no other window could pass the exact check.
Windows that collide in any round are verified with the exact edit distance of the whole item. Items too short for an edit (below 1 / `max_edits` bytes) are found where
they stand exactly, as whole words.

The benchmark is read in passes of bounded size; each is broadcast to the tasks once.

Defined results: null and empty texts and items match nothing, as do items without a letter or digit and rows with a null item_id. Repeated rows are
each judged, repeated items each reported; ids are of any type. Texts and items of any length are read whole. Empty tables give no rows. Further columns are ignored, or kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from facetmatch.llm.common import checkpoint, chunks, map_rows, mix, pick, small_letters, utf8

FOLDED = np.full(256, 32, np.uint8)
FOLDED[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
FOLDED[65:91] = np.arange(97, 123)
BETWEEN = 10


@dataclass(frozen=True)
class Params:
    max_edits: float = 0.05
    samples: int = 4
    recall: float = 0.99
    block: int = 64
    #: Edited copies of each measured block, and rounds that its rate is taken from.
    trials: int = 6
    tests: int = 64
    measured: int = 512
    seed: int = 5
    #: A larger benchmark takes several passes over the documents, each of about so many items and bytes.
    items_per_pass: int = 20_000
    bytes_per_pass: int = 1 << 25


def fold(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all rows and where each begins; a newline closes each row, so that no stretch of two rows matches."""
    t = FOLDED[small_letters(data)]
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != 32) | (t[:-1] != 32)
    begins = at[:-1][np.diff(at) > 0]
    keep[begins] = t[begins] != 32
    out = t[keep]
    count = np.concatenate([[0], np.cumsum(keep)])
    return np.insert(out, count[at[1:]], BETWEEN), count[at] + np.arange(len(at))


def fold_text(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    out, _ = fold(raw, np.array([0, len(raw)]))
    return out[:-1].tobytes().strip(b" ")


def best_edits(item: bytes, text: bytes, most: int) -> int:
    """The fewest edits between item and any stretch of text, or most + 1 if above most. Columns of the table as bits (Myers 1999)."""
    n, at = len(item), {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << max(n - 1, 0)
    up, down, now, best = every, 0, n, n
    for c in text:
        same = at.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        if more & top:
            now += 1
        elif less & top:
            now -= 1
            best = min(best, now)
        more, less, same = more << 1 & every, less << 1 & every, same | down
        up, down = less | (every & ~(same | more)), more & same
    return min(best, most + 1)


def walk(x: np.ndarray, bits: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Codes of the CGK embeddings of the rows of x (padded with BETWEEN), rows by rounds. bits: rounds by steps by bytes, whether the walk
    moves on; at: rounds by samples, from 0 to 1, where the embedding is sampled, of twice each row's length n."""
    (rows, width), (rounds, steps, _) = x.shape, bits.shape
    steps = min(steps, 2 * int(n.max(initial=0)))
    flat, base = np.ascontiguousarray(np.pad(x, ((0, 0), (0, 1)), constant_values=BETWEEN)).ravel(), (np.arange(rows) * (width + 1))[:, None]
    move, lane = np.ascontiguousarray(bits.transpose(1, 0, 2)).reshape(bits.shape[1], -1), (np.arange(rounds) * 256)[None, :]
    i, out = np.zeros((rows, rounds), np.int64), np.empty((steps + 1, rows, rounds), np.uint8)
    for j in range(steps):
        c = flat[base + i]
        out[j] = c
        i += move[j][lane + c]
        np.minimum(i, width, out=i)
    code = np.zeros((rows, rounds), np.uint64)
    r, q = np.arange(rounds)[None, :], np.arange(rows)[:, None]
    for k in range(at.shape[1]):
        code = mix(code * np.uint64(3) + out[(at[:, k][None, :] * (2 * n[:, None])).astype(np.int64), q, r] + np.uint64(1))
    return code


class Index:
    """What is made of the items once, to be sent to the executors."""

    def __init__(self, items: list[tuple], p: Params = Params()):
        self.p = p
        known = [(i, fold_text(t)) for i, t in items if t]
        known = [(i, t) for i, t in known if t]
        self.ids, self.texts = [i for i, _ in known], [t for _, t in known]
        self.limits = [int(p.max_edits * len(t)) for t in self.texts]
        # blocks: item, place in it, bytes, edits
        self.item, self.offset, self.blocks, self.most = [], [], [], []
        pieces = []
        for k, (t, d) in enumerate(zip(self.texts, self.limits)):
            m = max(1, len(t) // p.block)
            cuts = np.linspace(0, len(t), m + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]) if d else ():
                inner = np.linspace(0, b - a, d // m + 2).astype(int).tolist()
                pieces += [(t[a + x : a + y], len(self.blocks), x) for x, y in zip(inner, inner[1:])]
                self.item.append(k)
                self.offset.append(a)
                self.blocks.append(t[a:b])
                self.most.append(d // m)
        self.gram = min((len(x) for x, _, _ in pieces), default=0)
        keys = np.array([hashes(np.frombuffer(x[: self.gram], np.uint8), self.gram)[0] for x, _, _ in pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of, self.place = keys[order], np.array([k for _, k, _ in pieces], np.int64)[order], np.array([a for _, _, a in pieces], np.int64)[order]
        self.sieve = sieve(self.keys)
        self.short = self._short()
        self.size = np.array([len(b) for b in self.blocks], np.int64)
        self._draw(p.tests)
        self.rounds = self._rounds()
        self._draw(self.rounds)
        self.codes = self.embed(self.blocks, self.size)

    def _short(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length of the items without an edit: the length, sorted hashes, items, sieve."""
        by: dict[int, list[int]] = {}
        for k, (t, d) in enumerate(zip(self.texts, self.limits)):
            if not d:
                by.setdefault(len(t), []).append(k)
        out = []
        for n, members in sorted(by.items()):
            keys = np.array([hashes(np.frombuffer(self.texts[k], np.uint8), n)[0] for k in members], np.uint64)
            order = np.argsort(keys, kind="stable")
            out.append((n, keys[order], np.array(members)[order], sieve(keys)))
        return out

    def _draw(self, rounds: int) -> None:
        """The walks' bits and the sampled positions of so many rounds."""
        longest = int(self.size.max(initial=1))
        self.bits = np.random.default_rng(self.p.seed).integers(0, 2, (rounds, 2 * longest, 256), np.uint8)
        self.at = np.random.default_rng(self.p.seed + 1).random((rounds, self.p.samples))

    def _rounds(self) -> int:
        """How many rounds the block needs that collides least, of all numbers of edits."""
        rng, p = np.random.default_rng(self.p.seed), self.p
        by: dict[int, list[int]] = {}
        for b, d in enumerate(self.most):
            if d:
                by.setdefault(d, []).append(b)
        rounds = 1
        for members in by.values():
            take = np.repeat(rng.permutation(members)[: p.measured], p.trials).tolist()
            n = self.size[take]
            same = self.embed([self.blocks[b] for b in take], n) == self.embed([self._edited(b, rng) for b in take], n)
            rate = (same.sum(1) + 0.5) / (p.tests + 1)
            least = lambda r: (1 - (1 - rate) ** r).reshape(-1, p.trials).mean(1).min()  # noqa: B023, E731
            while least(rounds) < p.recall:
                rounds += 1
        return rounds

    def _edited(self, b: int, rng: np.random.Generator) -> bytes:
        """The block with edits to its limit, and with what follows it, as a window would hold it."""
        t = bytearray(self.blocks[b])
        for _ in range(self.most[b]):
            j = int(rng.integers(0, max(1, len(t))))
            kind = rng.integers(0, 3)
            if kind < 2:
                del t[j : j + 1]
            if kind > 0:
                t[j:j] = bytes([int(rng.integers(97, 123))])
        return bytes(t) + bytes(rng.integers(97, 123, max(0, len(self.blocks[b]) - len(t)), np.uint8))

    def embed(self, windows: list, n: np.ndarray) -> np.ndarray:
        """Windows by rounds: the code of each window, which is read as one of n bytes."""
        out = np.empty((len(windows), len(self.bits)), np.uint64)
        for lo in range(0, len(windows), 256):
            part, m = windows[lo : lo + 256], n[lo : lo + 256]
            x = np.full((len(part), int(m.max())), BETWEEN, np.uint8)
            for i, w in enumerate(part):
                w = np.frombuffer(w, np.uint8) if isinstance(w, bytes) else w
                x[i, : min(int(m[i]), len(w))] = w[: int(m[i])]
            out[lo : lo + 256] = walk(x, self.bits, self.at, m)
        return out

    def find(self, data: np.ndarray, at: np.ndarray) -> list[tuple]:
        """(row, item's id, fewest edits) of rows of bytes."""
        text, first = fold(data, at)
        out = self._exactly(text, first)
        if not self.blocks or len(text) < self.gram:
            return out
        windows: dict[tuple[int, int], set[int]] = {}
        for pos, lo, hi in zip(*matches(hashes(text, self.gram), self.keys, self.sieve)):
            row = int(np.searchsorted(first, pos, "right")) - 1
            for j in range(lo, hi):
                windows.setdefault((row, int(self.of[j])), set()).add(pos - int(self.place[j]))
        ends = first[1:] - 1
        close: dict[tuple[int, int], list[int]] = {}

        def collide(tried: list[tuple[int, int, int]]) -> None:
            """Notes where the item of a window that collides would begin."""
            tried = [x for x in tried if first[x[0]] <= x[2] < ends[x[0]]]
            if tried:
                of = np.array([b for _, b, _ in tried])
                codes = self.embed([text[s : min(int(ends[row]), s + len(self.blocks[b]))] for row, b, s in tried], self.size[of])
                for (row, b, s), c in zip(tried, (codes == self.codes[of]).any(1).tolist()):
                    if c:
                        close.setdefault((row, self.item[b]), []).append(s - self.offset[b])

        collide([(row, b, s) for (row, b), starts in windows.items() for s in starts])
        # what an unshifted window found needs no other one
        collide(sorted({(row, b, s + o) for (row, b), starts in windows.items() if (row, self.item[b]) not in close for s in starts for o in range(-self.most[b], self.most[b] + 1) if o}))
        for (row, k), starts in close.items():
            d, t = self.limits[k], self.texts[k]
            # stretches around all these places, joined where they overlap
            areas: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(int(first[row]), s - 2 * d), min(int(ends[row]), s + 3 * d + len(t))
                if areas and a <= areas[-1][1]:
                    areas[-1][1] = max(b, areas[-1][1])
                else:
                    areas.append([a, b])
            best = d + 1
            for a, b in areas:
                best = min(best, best_edits(t, text[a:b].tobytes(), d)) if best else 0
            if best <= d:
                out.append((row, self.ids[k], best))
        return out

    def _exactly(self, text: np.ndarray, first: np.ndarray) -> list[tuple]:
        """Items without an edit, as whole words."""
        seen: set[tuple[int, int]] = set()
        edge = lambda c: c in (32, BETWEEN)
        for n, keys, items, mesh in self.short:
            for pos, lo, hi in zip(*matches(hashes(text, n), keys, mesh)):
                if (not pos or edge(text[pos - 1])) and edge(text[pos + n]):
                    raw, row = text[pos : pos + n].tobytes(), int(np.searchsorted(first, pos, "right")) - 1
                    seen |= {(row, k) for k in items[lo:hi].tolist() if self.texts[k] == raw}
        return [(row, self.ids[k], 0) for row, k in sorted(seen)]


def hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each stretch of gram bytes, by doubling: stretches of powers of two, the last two overlapping."""
    if len(x) < gram:
        return np.zeros(0, np.uint64)
    h, n = x.astype(np.uint64) + np.uint64(1), 1
    while 2 * n <= gram:
        h, n = h[:-n] * np.uint64(0x9E3779B97F4A7C15) + (h[n:] ^ (h[n:] >> np.uint64(29))), 2 * n
    if n < gram:
        h = h[: len(h) - (gram - n)] * np.uint64(0xD1B54A32D192ED03) + h[gram - n :]
    return mix(h)


def sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(44)).astype(np.int64)] = True
    return out


def matches(h: np.ndarray, keys: np.ndarray, mesh: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Where a hash is among the sorted keys, and which of them, from and to."""
    hits = np.flatnonzero(mesh[(h >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(keys, h[hits], "left"), np.searchsorted(keys, h[hits], "right")
    good = hi > lo
    return hits[good].tolist(), lo[good].tolist(), hi[good].tolist()


def passes(benchmark: DataFrame, p: Params = Params()) -> list[DataFrame]:
    """The benchmark's rows with an item, parted by hash into parts of about items_per_pass and bytes_per_pass."""
    rows = pick(benchmark, "item_id", "text").where("item_id is not null and length(text) > 0")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(-(-size["n"] // p.items_per_pass), -(-size["b"] // p.bytes_per_pass))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def index(rows: DataFrame, p: Params = Params()):
    """The index of one pass, broadcast."""
    return rows.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows.orderBy("item_id", "text").collect()], p))


def found(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each document and item in it: doc_id, item_id, edits (the fewest)."""
    kinds = [pick(docs, "doc_id").schema[0].dataType, pick(benchmark, "item_id").schema[0].dataType]
    of = to_arrow_type(kinds[1])
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, edits int"
    parts = passes(benchmark, p)
    out = docs.sparkSession.createDataFrame([], schema) if not parts else None
    for rows in parts:
        shared = index(rows, p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = utf8(batch.column(1))
                for lo, hi, part, offsets in chunks(data, at):
                    if hit := shared.value.find(part, offsets):
                        r, i, e = zip(*hit)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(r)), pa.array(i, of), pa.array(e, pa.int32())], ["doc_id", "item_id", "edits"])

        part = pick(docs, "doc_id", "text").mapInArrow(run, schema)
        if len(parts) > 1:
            part = checkpoint(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    at = docs.columns.index("text")
    parts = passes(benchmark, p)
    for rows in parts:
        shared = index(rows, p)

        def keep(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            good = np.ones(batch.num_rows, bool)
            data, offsets = utf8(batch.column(at))
            for lo, hi, part, inner in chunks(data, offsets):
                for row, _, _ in shared.value.find(part, inner):
                    good[lo + row] = False
            return batch.filter(pa.array(good))

        docs = map_rows(docs, keep)
        if len(parts) > 1:
            docs = checkpoint(docs)
            shared.destroy()
    return docs
