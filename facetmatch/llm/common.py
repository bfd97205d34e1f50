"""What the text operators share: column picking, checkpoints, and byte-level views of Arrow string columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmatch.session import checkpoint  # noqa: F401

#: Most rows of ids that are ever broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Just these columns, found by exact name, so that further columns (also ones that differ only in case) never clash."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[plain[f"_{names.index(c)}"].alias(c) for c in cols])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small enough; else as it is, so that the join shuffles."""
    return F.broadcast(df) if small(df) else df


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key isn't among ids, with docs' columns. Rows with a null key stay."""
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    return plain.join(sized(gone), plain[f"_{names.index(key)}"] == F.col("_gone"), "left_anti").toDF(*names)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """fn over Arrow batches of all columns, named _0, _1 ... by place; the result has df's columns and types."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out.num_rows:
                yield out

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more than rows). Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about size bytes (a longer row alone): first row, end row, bytes, offsets within them."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


#: Bytes as words see them (after small_letters): ASCII letters in lower case, digits and bytes from 128 kept, all else 0, which parts words.
FOLD = np.zeros(256, np.uint8)
FOLD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
FOLD[65:91] = np.arange(97, 123)


def small_letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals from À to Þ made small (ASCII is left to the tables)."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] <= 0x9E) & (data[at] != 0x97)]
    if len(at):
        data = data.copy()
        data[at] += 32
    return data


def words(data: np.ndarray, at: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, and at which word each row begins (one more than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    t = fold[small_letters(data)]
    inside = t != 0
    new = np.zeros(n + 1, bool)
    new[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[e + 1] - total[s]) * down[s]), np.searchsorted(s, at)
