"""Secrets, told from ordinary identifiers by two character Markov models.

Candidates are all runs of the bytes A-Z a-z 0-9 + / = _ -, of any length. Two first-order Markov models, of random strings and of
ordinary identifiers, are trained from labelled samples; the log-likelihood ratios of a run's characters are summed, so that a longer run gives more evidence and no length has to be set. A run's stretches of
greatest sum are secrets where the sum is above a threshold: what `false_rate` of the ordinary samples exceed, plus `prior`, as secrets are rare. A run whose whole sum is nearly that of its best stretch is a secret as a whole; in others
secrets are glued to something ordinary (paths, URLs, long key names), and each stretch is taken as far as the next of / = _ - on either side.

The labelled samples are made here, or given as a table (fit_table). Made are: random draws (hexadecimal, base 32, base 36, base 62, base 64, URL-safe) as secrets; words of
common syllables, joined as identifiers, paths, versions, dates, numbers, repeated characters and words in base 64 as ordinary ones. UUIDs are ordinary by their form (8-4-4-4-12 hexadecimal digits), as
their characters are those of keys. For the same reason checksums and keys in hexadecimal can't be told apart: both are found.

Defined results: null and empty texts hold no secret. Texts and runs of any length are judged whole. Rows are
judged one by one, so repeated rows repeat their results; rows with a null id keep it. Empty tables give no rows. Further columns are ignored, or kept by redacted().
"""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmatch.llm.common import chunks, map_rows, pick, utf8

ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/=_-"
CODE = np.full(256, 255, np.uint8)
CODE[list(ALPHABET.encode())] = np.arange(len(ALPHABET))
#: Whether a code is one of / = _ -
JOINT = np.array([c in "/=_-" for c in ALPHABET])
MARK = b"[SECRET]"
UUID = re.compile(rb"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")


@dataclass(frozen=True)
class Params:
    #: Lengths of the random samples, from and to before.
    shortest: int = 12
    longest: int = 65
    #: Samples of each kind; of a given table, those with the smallest hashes.
    samples: int = 4000
    false_rate: float = 0.0005
    #: Added to the threshold, in nats: about what a secret's rarity among runs weighs.
    prior: float = 4.6
    smoothing: float = 0.5
    seed: int = 3


SYLLABLES = "an ar ba be ble ca ce ch co con da de der di do ed el en er es ex fa fi fo for ga ge get ha he hi id il in ing ion is it ja ke ky la le li lo ly ma me ment mi mo na ne ni no nt of om on or ou out pa pe per pi po pre pro qu ra re ri ro sa sc se set sh si so st sta ta te ter th the ti tion to tr tra tu ty ue un up ur us va ve ver vi wa we wh wi x y za ze cion mente aux eau elle eux ier oi que tre ung keit lich sch ein ver zu heit ach pf tz bo cia ado".split()


def labelled(p: Params = Params()) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers."""
    rng = np.random.default_rng(p.seed)
    draw = lambda chars, n: "".join(np.array(list(chars))[rng.integers(0, len(chars), n)])
    pools = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-"]
    random = [draw(pools[i % len(pools)], int(rng.integers(p.shortest, p.longest))) for i in range(p.samples)]
    ordinary = []
    word = lambda: "".join(SYLLABLES[j] for j in rng.integers(0, len(SYLLABLES), rng.integers(1, 5)))
    encoded = lambda parts: base64.b64encode(" ".join(parts).capitalize().encode() if rng.random() < 0.5 else " ".join(parts).encode()).decode()
    while len(ordinary) < p.samples:
        kind, parts = int(rng.integers(0, 12)), [word() for _ in range(int(rng.integers(1, 9)))]
        ordinary.append(
            ("".join(parts), "_".join(parts), "-".join(parts), "/".join(parts), "".join(x.capitalize() for x in parts), "_".join(parts).upper(), "".join(parts).upper(),
            draw(string.digits, int(rng.integers(1, 40))), "-".join([f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", *parts, str(rng.integers(0, 1000))]),
            draw(string.ascii_letters + "-_=+/0", 1) * int(rng.integers(1, 60)), encoded(parts), encoded(parts).rstrip("="))[kind]
        )
    return random, ordinary


@dataclass
class Model:
    ratio: np.ndarray  # of log-likelihoods, from character (the last row: the start) to character
    threshold: float  # of sums
    p: Params


def _counts(texts: list[str]) -> np.ndarray:
    n = len(ALPHABET)
    c = np.zeros((n + 1, n))
    for t in texts:
        x = CODE[np.frombuffer(t.encode(), np.uint8)].astype(int)
        np.add.at(c, (np.concatenate([[n], x[:-1]]), x), 1)
    return c


def train(random: list[str], ordinary: list[str], p: Params = Params()) -> Model:
    logs = []
    for texts in (random, ordinary):
        c = _counts(texts) + p.smoothing
        logs.append(np.log(c / c.sum(1, keepdims=True)))
    model = Model(logs[0] - logs[1], np.inf, p)
    best = sorted(score(model, t) for t in ordinary)
    if best:
        model.threshold = best[min(len(best) - 1, int(len(best) * (1 - p.false_rate)))] + p.prior
    return model


def fit(p: Params = Params()) -> Model:
    return train(*labelled(p), p)


def fit_table(samples: DataFrame, p: Params = Params()) -> Model:
    """From labelled samples: text, secret. Of each kind those `samples` rows with the smallest hashes are taken; what isn't of the alphabet is left out of them, null and empty texts are no samples. Without samples of either kind nothing is a secret."""
    rows = pick(samples, "text", "secret").withColumn("text", F.regexp_replace("text", "[^A-Za-z0-9+/=_-]", "")).where("secret is not null and text <> ''")
    random, ordinary = ([r["text"] for r in rows.where(F.col("secret").cast("boolean") == kind).orderBy(F.xxhash64(F.lit(p.seed), "text"), "text").limit(p.samples).collect()] for kind in (True, False))
    return train(random, ordinary if random else [], p)


def ratios(model: Model, text: str) -> np.ndarray:
    x = CODE[np.frombuffer(text.encode(), np.uint8)].astype(int)
    return model.ratio[np.concatenate([[len(ALPHABET)], x[:-1]]), x]


def score(model: Model, text: str) -> float:
    """The greatest summed log-likelihood ratio, random to ordinary, of any stretch of one run."""
    total = np.concatenate([[0.0], np.cumsum(ratios(model, text))])
    return float((total - np.minimum.accumulate(total)).max())


def stretches(ratio: np.ndarray, joint: np.ndarray, most: float) -> list[tuple[int, int, float]]:
    """Start, end and score of the secrets within one run: stretches whose ratios sum to more than `most`, parted where the sum falls by as much, and widened to the next joint."""
    found: list[tuple[int, int, float]] = []
    total, peak, begin, end = 0.0, 0.0, 0, 0
    for i, x in enumerate([*ratio.tolist(), -np.inf]):
        total += x
        if total > peak:
            peak, end = total, i + 1
        elif total <= 0 or peak > most and total < peak - most:
            if peak > most:
                found.append((begin, end, peak / (end - begin)))
            total, peak, begin = 0.0, 0.0, i + 1
    if len(found) == 1 and ratio.sum() > max(most, 0.8 * found[0][2] * (found[0][1] - found[0][0])):
        return [(0, len(ratio), float(ratio.mean()))]
    at = np.flatnonzero(joint)
    out: list[tuple[int, int, float]] = []
    for a, b, v in found:
        while joint[a]:
            a += 1
        k, j = np.searchsorted(at, a), np.searchsorted(at, b)
        a, b = (int(at[k - 1]) + 1 if k else 0), (int(at[j]) if j < len(at) else len(ratio))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(v, out[-1][2]))
        else:
            out.append((a, b, v))
    return out


def within(model: Model, run: bytes) -> list[tuple[int, int, float]]:
    """Start, end and score of the secrets of one run."""
    ratio, joint = ratios(model, run.decode()), JOINT[CODE[np.frombuffer(run, np.uint8)]]
    for m in UUID.finditer(run):
        ratio[slice(*m.span())] = -model.threshold
        joint[slice(*m.span())] = True
    return stretches(ratio, joint, model.threshold)


def scan(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and scores (log-likelihood ratio per character) of the secrets among all bytes, in order; none reaches over the end of a row."""
    every: list[tuple[int, int, float]] = []
    size, table = len(ALPHABET), np.maximum(model.ratio, 0).ravel()
    for lo, _, part, offsets in chunks(data, at):
        code = CODE[part].astype(np.int64)
        inside = np.concatenate([[False], code != 255, [False]])
        begins, ends = inside[1:] & ~inside[:-1], ~inside[1:] & inside[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(part))]
        joined = inner[inside[inner] & inside[inner + 1]]
        begins[joined] = ends[joined] = True
        s, e = np.flatnonzero(begins), np.flatnonzero(ends)
        if not len(s):
            continue
        # sums of the positive ratios bound those of all stretches
        before = np.concatenate([[size], code[:-1]])
        before[s] = size
        bound = np.concatenate([np.take(table, before * size + code, mode="clip"), [0]])
        bound[np.flatnonzero(code == 255)] = 0
        base = int(at[lo])
        for i in np.flatnonzero(np.add.reduceat(bound, s) > model.threshold).tolist():
            a = int(s[i])
            every += [(base + a + x, base + a + y, v) for x, y, v in within(model, part[a : int(e[i])].tobytes())]
    s, e, v = (np.array(x) for x in zip(*every)) if every else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return s, e, v


def found(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row a secret: doc_id, start and end (bytes of the text), length, score (log-likelihood ratio per character, of the stretch where only that is judged), and a digest in place of the secret."""
    model = model or fit()
    kind = pick(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, at = utf8(batch.column(1))
            s, e, v = scan(model, data, at)
            if len(s):
                row = np.searchsorted(at, s, "right") - 1
                digests = [hashlib.sha256(data[a:b].tobytes()).hexdigest()[:16] for a, b in zip(s, e)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(s - at[row]), pa.array(e - at[row]), pa.array(e - s), pa.array(np.round(v, 4)), pa.array(digests)], ["doc_id", "start", "end", "length", "score", "digest"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, length long, score double, digest string")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns of docs, each secret in text replaced by [SECRET]; n_chars, if there, counts the new text where it changed."""
    model = model or fit()
    names = docs.columns
    text, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column(text))
        s, e, _ = scan(model, data, at)
        if not len(s):
            return batch
        columns = [batch.column(i) for i in range(batch.num_columns)]
        row = np.searchsorted(at, s, "right") - 1
        new: dict[int, str] = {}
        for r in np.unique(row).tolist():
            parts, last = [], int(at[r])
            for a, b in zip(s[row == r].tolist(), e[row == r].tolist()):
                parts += [data[last:a].tobytes(), MARK]
                last = b
            new[r] = b"".join([*parts, data[last : at[r + 1]].tobytes()]).decode("utf-8", "replace")
        changed = np.zeros(batch.num_rows, bool)
        changed[list(new)] = True
        columns[text] = pa.compute.replace_with_mask(columns[text], pa.array(changed), pa.array([new[r] for r in sorted(new)], columns[text].type))
        if count is not None:
            columns[count] = pa.compute.replace_with_mask(columns[count], pa.array(changed), pa.array([len(new[r]) for r in sorted(new)]).cast(columns[count].type))
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, mask)
