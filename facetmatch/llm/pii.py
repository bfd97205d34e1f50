"""Bootstrapped contextual extraction of personal identifiers.

Chunks end at blanks and at , ; | < > " = & and curly or square brackets (not at a comma between digits). Candidates are runs of neighbouring chunks that hold a digit
or @, without outer punctuation. In a chunk that no validator knows as a whole, what they know inside it is taken instead; else the whole, and, of chunks beyond `blob` bytes, also their
parts between all punctuation but . @ + - _. Each has a shape (letters a, up to three digits 9, more digits
with their number, other characters as they are) and induces lexical patterns: its shape with the word before it, with the word after it (these two are its contexts, where there is such a word),
and with its own first and last characters.

Strict validators give the seeds: e-mail addresses with a usual ending, dotted addresses of four octets, telephone numbers with a
possible area code, card numbers with a right check digit; and, as what is not personal, years, dates, versions and small numbers. Patterns and instances then score each other on their graph:
a pattern's confidence for a kind is pos / (n + `prior`), where pos sums its instances' confidences in that kind and n counts all its distinct instances, so that unknown ones weigh against it like
those of another kind; an instance's is that no pattern of it errs, 1 - prod(1 - confidence). Only patterns of at least `min_pattern` count. Shape patterns count seeds alone, so that they don't
confirm themselves, and an instance without a context pattern of its kind has it only if its shape pattern alone has `min_instance`: if at least half of all distinct values of that shape are
seeds of the kind (a check digit is right by chance in a tenth). After `rounds` rounds, instances of at least `min_instance` are given with their best kind; seeds always.

Defined results: null and empty texts have no candidates; texts and identifiers are read whole, of any length (in the graph, values, shapes and words beyond 64 characters go by a digest of the whole). Repeated rows repeat their results,
and count once in the graph, which is of distinct values; so do repeated values. Ties between kinds go to the first by name. Rows with a null id keep it. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from facetmatch.llm.common import checkpoint, pick, utf8


@dataclass(frozen=True)
class Params:
    prior: float = 1.0
    rounds: int = 3
    min_pattern: float = 0.3
    min_instance: float = 0.5
    #: A chunk beyond this many bytes, without anything known inside it, is also taken apart at all punctuation but . @ + - _.
    blob: int = 200


EDGE = re.compile(r"^[^\w+(@]+|[^\w)]+$")
EMAIL = re.compile(r"[\w.+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|org|net|edu|gov|io|de|fr|es|uk)")
PHONE = re.compile(r"(\+1[ .-]?)?(\([2-9]\d\d\) ?|[2-9]\d\d[.-])[2-9]\d\d[.-]\d{4}")
CARD = re.compile(r"(?:\d[ -]?){12,18}\d")
PLAIN = re.compile(r"(1[5-9]|20)\d\d|\d{1,4}([-/.]\d{1,2}){2}|v?\d{1,3}(\.\d{1,3}){0,2}[a-z%]?|\d{1,2}:\d\d(:\d\d)?|\d{1,3}(,\d{3})+|\d{1,5}(st|nd|rd|th)?", re.I)
#: What validators know, inside a longer text. Cards are looked for at every place, as a right check digit decides.
INSIDE = (
    re.compile(rf"(?<![\w.+-])({EMAIL.pattern})(?![\w-]|\.\w)", re.I | re.A),
    re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\w)"),
    re.compile(rf"(?<![\w+])({PHONE.pattern})(?!\w)"),
    re.compile(rf"(?<!\w)(?=({CARD.pattern})(?!\w))"),
)
WORD = re.compile(r"\w+")
PIECE = re.compile(r"[\w.@+-]+")
HARD = np.zeros(256, bool)
HARD[[*range(33), *b',;|<>"=&{}[]']] = True


def card_ok(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def seed_kind(value: str) -> str | None:
    v = value.lower()
    if EMAIL.fullmatch(v):
        return "email"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v) and all(int(x) < 256 for x in v.split(".")):
        return "ip"
    if PHONE.fullmatch(v):
        return "phone"
    if CARD.fullmatch(v) and card_ok(v):
        return "card"
    return "plain" if PLAIN.fullmatch(v) else None


def shape(value: str) -> str:
    letters = re.sub(r"[^\W\d_]+", "a", value)
    return re.sub(r"\d+", lambda m: "9" if len(m.group()) <= 3 else f"9{{{len(m.group())}}}", letters)


def brief(text: str) -> str:
    """text, or beyond 64 characters a digest of it."""
    return text if len(text) <= 64 else "#" + hashlib.md5(text.encode()).hexdigest()


def patterns(value: str, left: str, right: str) -> list[str]:
    """L and R: by context; S: by shape alone."""
    s = brief(shape(value))
    edge = lambda c: c if not c.isalnum() else "9" if c.isdigit() else "a"
    return [f"L {brief(left)} {s}"] * bool(left) + [f"R {s} {brief(right)}"] * bool(right) + [f"S {edge(value[0])} {s} {edge(value[-1])}"]


def trimmed(text: str) -> tuple[int, int]:
    """Start and end of text without outer punctuation, as EDGE has it, in time that grows with the length only."""
    first, last = re.search(r"[\w+(@]", text), re.search(r"[\w)]", text[::-1])
    return (first.start(), max(first.start(), len(text) - last.start())) if first and last else (0, 0)


def word_before(text: str, x: int) -> str:
    """The last word that ends at or before x, in lower case."""
    known = lambda c: c.isalnum() or c == "_"
    while x and not known(text[x - 1]):
        x -= 1
    end = x
    while x and known(text[x - 1]):
        x -= 1
    return text[x:end].lower()


def inside(text: str, blob: int) -> list[tuple[int, int]]:
    """Start and end of the candidates in one chunk: the whole, if a validator knows it, else what validators know inside it, else the whole, and its pieces if it is long."""
    a, b = trimmed(text)
    if seed_kind(text[a:b]):
        return [(a, b)]
    found: list[tuple[int, int]] = []
    for known in INSIDE:
        last = 0
        for m in known.finditer(text):
            x, y = m.span(1)
            if x >= last and seed_kind(text[x:y]) not in (None, "plain"):
                found.append((x, y))
                last = y
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    if out:
        return out
    if len(text[a:b].encode()) <= blob:
        return [(a, b)]
    return list(dict.fromkeys([(a, b), *((m.start() + x, m.start() + y) for m in PIECE.finditer(text) for x, y in [trimmed(m.group())] if y > x)]))


def candidates(data: np.ndarray, at: np.ndarray, blob: int) -> Iterator[tuple[int, int, int, str, str, str]]:
    """row, start and end (bytes of the row), value, and the words before and after it."""
    if not len(data):
        return
    space = HARD[data]
    digit = (data >= 48) & (data <= 57)
    space[1:-1] &= ~((data[1:-1] == 44) & digit[:-2] & digit[2:])
    marked = ((data >= 48) & (data <= 57)) | (data == 64)
    bound = np.zeros(len(data) + 1, bool)
    bound[at] = True
    first = ~space
    first[1:] &= space[:-1] | bound[1:-1]
    last = ~space
    last[:-1] &= space[1:] | bound[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.concatenate([[0], np.cumsum(marked)])
    hit = np.flatnonzero(total[e] > total[s])
    if not len(hit):
        return
    row = np.searchsorted(at, s, "right") - 1
    word = lambda i, r: re.sub(r"\W+", "", data[s[i] : e[i]].tobytes().decode("utf-8", "replace").lower()) if 0 <= i < len(s) and row[i] == r else ""
    joins = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]) | (s[hit[1:]] != e[hit[:-1]] + 1) | (data[e[hit[:-1]]] > 32)]))
    for a, b in zip(hit[joins], np.append(hit[joins[1:] - 1], hit[-1])):
        # a chunk beyond 64 bytes is no part of a number, and stands alone
        spans = _spans([data[s[i] : e[i]].tobytes().decode("utf-8", "replace") if e[i] - s[i] <= 64 else "@" for i in range(a, b + 1)], a) if a < b else [(a, a)]
        for i, j in spans:
            raw = data[s[i] : e[j]].tobytes().decode("utf-8", "replace")
            done, at_byte, r = 0, int(s[i]), int(row[i])
            for x, y in inside(raw, blob) if i == j else [trimmed(raw)]:
                value = raw[x:y]
                if value and any(c.isdigit() or c == "@" for c in value):
                    at_byte += len(raw[done:x].encode()) if x >= done else -len(raw[x:done].encode())
                    begin, done = at_byte - int(at[r]), x
                    # the words beside it in the chunk, else the chunks beside it
                    after = WORD.search(raw, y)
                    yield r, begin, begin + len(value.encode()), value, word_before(raw, x) or word(i - 1, r), after.group().lower() if after else word(j + 1, r)


def _spans(parts: list[str], at: int) -> list[tuple[int, int]]:
    """Neighbouring chunks as candidates: those that are identifiers themselves stand alone, a + begins a new one, a mark of punctuation ends one, and of the rest neighbours are one where together they have the form of one number."""
    groups: list[list[int]] = []
    alone = [seed_kind(EDGE.sub("", t)) in ("email", "ip", "card") or "@" in t for t in parts]
    for i, t in enumerate(parts):
        if not groups or alone[i] or alone[i - 1] or parts[i - 1][-1:] in (*",;:.!?",) or t.lstrip("([\"'").startswith("+"):
            groups.append([i])
        else:
            groups[-1].append(i)
    out = []
    for g in groups:
        one = len(g) > 1 and _joined(" ".join(parts[i] for i in g))
        out += [(at + g[0], at + g[-1])] if one else [(at + i, at + i) for i in g]
    return out


def _joined(text: str) -> bool:
    """Whether chunks are one number: two groups of digits at least, none longer than four, 19 digits at most, and no letters."""
    t = EDGE.sub("", text)
    return sum(c.isdigit() for c in t) <= 19 and bool(re.fullmatch(r"[+(]?\d{1,4}\)?([ .()-]+\d{1,4}\)?)+", t))


def occurrences(docs: DataFrame, p: Params = Params()) -> DataFrame:
    kind = pick(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                data, at = utf8(batch.column(1))
                found = list(candidates(data, at, p.blob))
                if found:
                    r, s, e, v, left, right = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array([brief(x.lower()) for x in v]), pa.array([seed_kind(x) for x in v], pa.string()), pa.array([patterns(*x) for x in zip(v, left, right)], pa.list_(pa.string()))],
                        ["doc_id", "start", "end", "value", "seed", "patterns"],
                    )

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, value string, seed string, patterns array<string>")


def instances(edges: DataFrame, seeds: DataFrame, p: Params) -> DataFrame:
    """value, kind, confidence. edges: value, pattern, distinct. seeds: value, kind."""
    sure = seeds.select("value", "kind", F.lit(1.0).alias("confidence"), F.lit(1.0).alias("seeded"))
    size = checkpoint(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    known, by_shape = sure, F.startswith("pattern", F.lit("S "))
    for _ in range(p.rounds):
        by = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("pos"), F.sum("seeded").alias("seeded"))
        scored = by.join(size, "pattern").select("pattern", "kind", (F.when(by_shape, F.col("seeded")).otherwise(F.col("pos")) / (F.col("n") + p.prior)).alias("c")).where(F.col("c") >= p.min_pattern)
        enough = F.max((~by_shape | (F.col("c") >= p.min_instance)).cast("int")).alias("enough")
        found = edges.join(scored, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("confidence"), enough).where("enough = 1")
        found = found.join(seeds.select("value"), "value", "left_anti")
        known = checkpoint(sure.union(found.select("value", "kind", "confidence", F.lit(0.0))))
    return known.select("value", "kind", "confidence")


def extract(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """A row an identifier in a document: doc_id, start, end (bytes of the text), kind, confidence, seed (whether a validator knew it)."""
    seen = checkpoint(occurrences(docs, p))
    seeds = seen.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct()
    edges = checkpoint(seen.select("value", F.explode("patterns").alias("pattern")).distinct())
    best = F.row_number().over(W.partitionBy("value").orderBy(F.desc("confidence"), "kind"))
    chosen = instances(edges, seeds, p).withColumn("confidence", F.round("confidence", 6)).withColumn("n", best).where((F.col("n") == 1) & (F.col("kind") != "plain") & (F.col("confidence") >= p.min_instance))
    return seen.join(chosen.select("value", "kind", "confidence"), "value").select("doc_id", "start", "end", "kind", "confidence", F.col("seed").isNotNull().alias("seed"))
