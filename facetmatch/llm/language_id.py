"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on windows of a bounded sample of labelled rows: of each language `train_rows` rows, by hash of the id, and of each
row `train_windows` windows, by hash from all over its text. A further class, noise, is made of the same windows with their letters shuffled, and of random letters and digits.

A text is cut into windows of `core` bytes, which are read with `margin` more bytes on either side, so that both states are warm where labels begin; one recurrence runs
forwards and one backwards, and the two states at a byte give its label. A document's probabilities are the mean over its letters (ASCII letters and bytes from 128). It is rejected if
noise is the most probable class, or if no language has `min_confidence`.

Defined results: null, empty and letterless texts have no language (null, confidence 0) and are rejected; so are texts of noise, with the confidence of the likeliest language. Spans of noise have a null language. Rows are
judged one by one, so repeated rows give repeated results and order never matters; of languages that are equally probable the first by name is taken. Texts of any length are read whole. An empty table gives no rows. Without any
labelled row there is no model: every text is without language. A row with a null id is judged like others. Further columns are ignored, or kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetmatch.llm.common import map_rows, pick, utf8

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PAD = 0


@dataclass(frozen=True)
class Params:
    hidden: int = 8
    core: int = 128
    margin: int = 32
    #: The bound on the labelled sample: rows of each language, and windows of each row.
    train_rows: int = 150
    train_windows: int = 6
    steps: int = 200
    batch: int = 160
    rate: float = 0.02
    seed: int = 7
    min_confidence: float = 0.4

    @property
    def width(self) -> int:
        return self.core + 2 * self.margin


@dataclass
class Model:
    """labels: the languages; noise is the class after them."""

    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    p: Params = Params()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(hidden: int, classes: int, seed: int) -> dict[str, np.ndarray]:
    """f* and b*: the two directions. x: by byte, what the byte adds to update, reset and candidate gate; u: from the state; n: the candidate's own bias."""
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[d + "x"] = rng.normal(0, 0.3, (256, 3 * hidden))
        w[d + "x"][:, :hidden] += 1.0  # keep the state at first
        w[d + "u"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w[d + "n"] = np.zeros(hidden)
    w["o"] = rng.normal(0, 0.3, (2 * hidden, classes))
    w["c"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in w.items()}


def step(w: dict[str, np.ndarray], d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a recurrence over a column of bytes: new state, gates, and the candidate's share of the old state."""
    k = h.shape[1]
    a, s = w[d + "x"][x], h @ w[d + "u"]
    z, r = sigmoid(a[:, :k] + s[:, :k]), sigmoid(a[:, k : 2 * k] + s[:, k : 2 * k])
    q = s[:, 2 * k :] + w[d + "n"]
    c = np.tanh(a[:, 2 * k :] + r * q)
    return c + z * (h - c), z, r, c, q


def loss_and_gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the letters of windows x (rows by bytes) with one label each, and its gradient by backpropagation through time."""
    n, t = x.shape
    k = w["fu"].shape[0]
    g = {name: np.zeros_like(v) for name, v in w.items()}
    states, tapes = {}, {}
    for d in "fb":
        h, tape, out = np.zeros((n, k), w["o"].dtype), [], np.empty((t, n, k), w["o"].dtype)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            new, z, r, c, q = step(w, d, x[:, i], h)
            tape.append((i, h, z, r, c, q))
            h = out[i] = new
        states[d], tapes[d] = out, tape
    both = np.concatenate([states["f"], states["b"]], 2)
    logits = both @ w["o"] + w["c"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    mask = LETTER[x].T
    count = max(1, int(mask.sum()))
    picked = p[:, np.arange(n), y]
    loss = float(-(np.log(picked + 1e-12) * mask).sum() / count)
    dl = p
    dl[:, np.arange(n), y] -= 1
    dl *= (mask / count)[:, :, None]
    flat = dl.reshape(-1, dl.shape[2])
    g["o"] += both.reshape(-1, 2 * k).T @ flat
    g["c"] += flat.sum(0)
    dboth = dl @ w["o"].T
    for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
        dh = np.zeros((n, k), w["o"].dtype)
        da = np.empty((t, n, 3 * k), w["o"].dtype)
        for i, h, z, r, c, q in reversed(tapes[d]):
            dh = dh + dboth[i, :, part]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            ds = np.concatenate([dz, dr, dc * r], 1)
            da[i] = np.concatenate([dz, dr, dc], 1)
            g[d + "u"] += h.T @ ds
            g[d + "n"] += (dc * r).sum(0)
            dh = dh * z + ds @ w[d + "u"].T
        at, flat = x.T.ravel(), da.reshape(-1, 3 * k)
        for j in range(3 * k):
            g[d + "x"][:, j] += np.bincount(at, flat[:, j], 256).astype(w["o"].dtype)
    return loss, g


def windows_of(text: bytes, p: Params, seed: int) -> list[bytes]:
    """Windows from all over a text, the first from its beginning: `width` bytes each, PAD where they reach over an end."""
    rng = np.random.default_rng(seed)
    room = max(0, len(text) - p.core)
    starts = {0, *rng.integers(0, room + 1, p.train_windows - 1).tolist()} if room else {0}
    padded = bytes(p.margin) + text + bytes(p.width)
    return [padded[a : a + p.width] for a in sorted(starts)]


def noise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of each window one of noise: its letters shuffled, or random ones of some alphabet in their places."""
    pools = [np.frombuffer(a, np.uint8) for a in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"abcdef")]
    out = x.copy()
    for i, row in enumerate(out):
        at = np.flatnonzero(LETTER[row])
        row[at] = rng.permutation(row[at]) if i % 2 else rng.choice(pools[i // 2 % len(pools)], len(at))
    return out


def train(windows: list[bytes], labels: list[str], p: Params = Params()) -> Model:
    """A model from labelled windows. The same rows, in whatever order, give the same model."""
    rows = sorted((l, t) for l, t in zip(labels, windows) if l is not None and t)
    rows = [(l, x) for l, t in rows if LETTER[x := np.frombuffer(t, np.uint8)].sum() >= 8]
    if not rows:
        return Model([], {}, p)
    names = sorted({l for l, _ in rows})
    x, y = np.array([t for _, t in rows]), np.array([names.index(l) for l, _ in rows])
    rng = np.random.default_rng(p.seed)
    take = rng.permutation(len(x))[: max(1, len(x) // len(names))]
    x, y = np.concatenate([x, noise(x[take], rng)]), np.concatenate([y, np.full(len(take), len(names))])
    by = [np.flatnonzero(y == c) for c in range(len(names) + 1)]
    w = initial(p.hidden, len(by), p.seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for i in range(1, p.steps + 1):
        take = np.concatenate([rng.choice(b, -(-p.batch // len(by))) for b in by])  # each class alike
        _, g = loss_and_gradient(w, x[take], y[take])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = p.rate * min(1.0, 2 * (1 - i / (p.steps + 1)))
        for k in w:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            w[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return Model(names, w, p)


def probabilities(model: Model, x: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Class probabilities at the bytes from lo to before hi of windows x (a column each): bytes by classes by rows. Gates lie apart, so that every pass is over contiguous memory."""
    w, (t, n) = model.weights, x.shape
    hi = t if hi is None else hi
    k, c = w["fu"].shape[0], w["o"].shape[1]
    logits = np.empty((hi - lo, c, n), np.float32)
    # by exp alone: the gates are 1 / (1 + exp(-x)), and tanh(x) is 1 - 2 / (1 + exp(2x))
    scale = np.repeat(np.array([-1, -1, 2], np.float32), k)
    with np.errstate(over="ignore"):
        for d in "fb":
            tables = [np.ascontiguousarray((w[d + "x"] * scale)[:, i * k : (i + 1) * k]) for i in range(3)]
            inner = [np.ascontiguousarray((w[d + "u"] * scale)[:, i * k : (i + 1) * k]) for i in range(3)]
            bias = 2 * w[d + "n"]
            h = np.zeros((n, k), np.float32)
            a, z, r, q = (np.empty((n, k), np.float32) for _ in range(4))
            out = np.ascontiguousarray((w["o"][:k] if d == "f" else w["o"][k:]).T)
            for i in range(hi) if d == "f" else range(t - 1, lo - 1, -1):
                at = x[i].astype(np.intp)
                for g, to in ((0, z), (1, r)):
                    np.matmul(h, inner[g], out=to)
                    np.take(tables[g], at, 0, out=a, mode="clip")
                    to += a
                    np.exp(to, out=to)
                    to += 1
                    np.reciprocal(to, out=to)
                np.matmul(h, inner[2], out=q)
                q += bias
                q *= r
                np.take(tables[2], at, 0, out=a, mode="clip")
                q += a
                np.exp(q, out=q)
                q += 1
                np.divide(-2, q, out=q)
                q += 1
                h -= q
                h *= z
                h += q
                if d == "f" and i >= lo:
                    np.matmul(out, h.T, out=logits[i - lo])
                elif d == "b" and i < hi:
                    logits[i - lo] += out @ h.T
    logits += w["c"][:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def judge(model: Model, column: pa.Array, rows_at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the pooled probabilities and its number of letters; for each byte of all texts its class."""
    data, at = utf8(column)
    n, c, p = len(at) - 1, len(model.labels) + 1, model.p
    sums, letters = np.zeros((n, c)), np.zeros(n, np.int64)
    if not model.labels or not len(data):
        return sums, letters, np.zeros(len(data), np.int16)
    per = -(-np.diff(at) // p.core)
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(n), per)
    start = at[doc] + (np.arange(first[-1]) - first[doc]) * p.core
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(p.margin, np.uint8), data, np.zeros(p.width, np.uint8)]), p.width)
    marks = np.zeros(len(data) + p.core, np.int16)
    place = np.arange(p.width)[:, None] - p.margin
    for lo in range(0, len(start), rows_at_once):
        s, of = start[lo : lo + rows_at_once], doc[lo : lo + rows_at_once]
        x = np.ascontiguousarray(views[s].T)
        x[(place < (at[of] - s)[None, :]) | (place >= (at[of + 1] - s)[None, :])] = PAD
        prob = probabilities(model, x, p.margin, p.margin + p.core)
        # in order, so that what reaches over a text's end is overwritten by the next text
        labels = prob.argmax(1).astype(np.int16).T
        own = place[p.margin : p.margin + p.core].T < (at[of + 1] - s)[:, None]
        marks[(s[:, None] + np.arange(p.core))[own]] = labels[own]
        letter = LETTER[x[p.margin : p.margin + p.core]].astype(np.float32)
        for j in range(c):
            sums[:, j] += np.bincount(of, np.einsum("tn,tn->n", prob[:, j], letter), n)
        letters += np.bincount(of, letter.sum(0), n).astype(np.int64)
    return sums / np.maximum(letters, 1)[:, None], letters, marks[: len(data)]


def sample(docs: DataFrame, p: Params = Params()) -> tuple[list[bytes], list[str]]:
    """The labelled windows to train on: of each language the rows with the smallest hashes of their ids. The greatest of these hashes is found first, so that no text but the sample's is cut into windows, and none leaves its task."""
    key = F.xxhash64(F.lit(p.seed), "doc_id").alias("k")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("k"))
    labelled = pick(docs, "doc_id", "text", "lang").where("lang is not null and length(text) > 0")
    tops = labelled.select("lang", key).withColumn("n", nth).where(F.col("n") <= p.train_rows).groupBy("lang").agg(F.max("k").alias("most")).collect()
    if not tops:
        return [], []
    most = F.create_map(*[F.lit(v) for r in tops for v in (r["lang"], r["most"])])
    rows = labelled.select("text", "lang", key).where(F.col("k") <= most[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = windows_of(text.encode(), p, k & (1 << 63) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([lang]), pa.array([b"".join(found)], pa.binary())], ["k", "lang", "windows"])

    top = rows.mapInArrow(cut, "k long, lang string, windows binary").orderBy("k", "lang", "windows").limit(p.train_rows * len(tops)).collect()
    every = [(r["lang"], bytes(r["windows"][lo : lo + p.width])) for r in top for lo in range(0, len(r["windows"]), p.width)]
    return [w for _, w in every], [l for l, _ in every]


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    return train(*sample(docs, p), p)


def verdicts(model: Model, column: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, whether it is accepted; and the class of each byte."""
    probs, letters, marks = judge(model, column)
    if not model.labels:
        return [None] * len(probs), np.zeros(len(probs)), np.zeros(len(probs), bool), marks
    best = probs[:, :-1].argmax(1)
    top = probs[np.arange(len(best)), best]
    spoken = (letters > 0) & (top >= probs[:, -1])
    names = [model.labels[b] if k else None for b, k in zip(best, spoken)]
    return names, np.where(letters > 0, top, 0.0), spoken & (top >= model.p.min_confidence), marks


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row a document: language, confidence, accepted, and spans that label every byte (runs of one label, from start to before end)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                names, confidence, good, marks = verdicts(model, batch.column(1))
                _, at = utf8(batch.column(1))
                if model.labels and len(marks):
                    new = np.concatenate([[True], marks[1:] != marks[:-1]])
                    new[at[:-1][at[:-1] < len(marks)]] = True
                    s = np.flatnonzero(new)
                    e = np.append(s[1:], len(marks))
                else:
                    s = e = np.zeros(0, np.int64)
                offsets = np.searchsorted(s, at)
                base = at[:-1].repeat(np.diff(offsets))
                kinds = pa.DictionaryArray.from_arrays(pa.array(marks[s].astype(np.int32)), pa.array([*model.labels, None], pa.string())).cast(pa.string())
                spans = pa.StructArray.from_arrays([pa.array(s - base, pa.int64()), pa.array(e - base, pa.int64()), kinds], ["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(np.round(confidence, 4)), pa.array(good), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                    ["doc_id", "language", "confidence", "accepted", "spans"],
                )

    kind = pick(docs, "doc_id").schema[0].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, confidence double, accepted boolean, spans array<struct<start:bigint,end:bigint,lang:string>>")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that have a language, with all their columns."""
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks = [verdicts(model, batch.column(at).slice(lo, 1000))[2] for lo in range(0, batch.num_rows, 1000)]
        return batch.filter(pa.array(np.concatenate(masks) if masks else np.zeros(0, bool)))

    return map_rows(docs, keep)
