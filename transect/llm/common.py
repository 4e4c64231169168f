"""What the corpus operators share: the session's set-up, numpy views of Arrow text, word hashes.

Words are runs of bytes outside 0x20 and 0x09-0x0D, everywhere in this subpackage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transect.session import prepare, shared_dir, table

__all__ = ["prepare", "shared_dir", "table"]

ID_SENTINEL = (1 << 63) - 1  # stands for a null id, after every other id
SLICE_BYTES = 2 << 20  # text handled at once by the numpy code

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def delete_shared(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, by Hadoop's own file system for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_few(rows: DataFrame, few: DataFrame, on: str, most: int) -> DataFrame:
    """rows joined with a table of distinct keys, which is broadcast where it has ``most`` rows at most, as its caller's sample should."""
    few = few.checkpoint()
    return rows.join(F.broadcast(few) if few.count() <= most else few, on)


MAX_BROADCAST_DOCS = 2_000_000  # hashes of 8 bytes: some 64 MB as a relation


def routed(rows: DataFrame, members: DataFrame, most: int = MAX_BROADCAST_DOCS) -> tuple[DataFrame, DataFrame | None]:
    """rows (id, key, ...) of the documents among ``members`` (id, key; a checkpointed table), and the others.

    The members' hashes are broadcast while they are ``most`` at most; a false one is among the first. Beyond that all rows are
    the first, and None the second."""
    having = members.select(F.xxhash64("id", "key").alias("_h")).distinct()
    if having.count() > most:
        return rows, None
    hashed, same = rows.withColumn("_of", F.xxhash64("id", "key")), F.col("_of") == F.col("_h")
    return tuple(hashed.join(F.broadcast(having), same, how).drop("_of") for how in ("left_semi", "left_anti"))


# ---------------------------------------------------------------- numpy over Arrow text


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets of the rows); null is empty, one long text stays whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, rows + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that ``gaps`` has as false), and for each row the number of its first word (one entry more than rows)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    gap = gaps[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    before[at[at < n]] = True
    after[at[at > 0] - 1] = True
    np.logical_not(gap, out=gap)
    starts, ends = np.flatnonzero(gap & before), np.flatnonzero(gap & after) + 1
    return starts, ends, np.searchsorted(starts, at)


_C1, _C2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; its argument is not kept."""
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the words, then of their first p bytes for each p of prefixes (0 where a word is shorter).

    Prefix sums of a polynomial hash make every span a subtraction; long texts go by blocks of words.
    """
    out = [np.zeros(len(starts), np.uint64) for _ in range(1 + len(prefixes))]
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + SLICE_BYTES, "right")))
        base = starts[k]
        block = raw[base : ends[last - 1]]
        up, down = _power_tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE[block] * up[:-1], out=sums[1:])
        s, e = starts[k:last] - base, ends[k:last] - base
        out[0][k:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        for i, p in enumerate(prefixes, 1):
            long = np.flatnonzero(e - s >= p)
            a = s[long]
            out[i][k + long] = mix((sums[a + p] - sums[a]) * down[a] + np.uint64(p * int(_C2) % 2**64))
        k = last
    return out


def doubled(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of joined windows from those of their two parts."""
    return mix(left * _STEP + (right ^ _C2) * _C1)
