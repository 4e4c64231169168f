"""Exact de-duplication in two passes over a Bloom filter.

Pass 1 sets, for every text hash, a few bits in one 64-bit word of a filter that remembers for each bit
whether one or more rows set it. Pass 2 looks every row up: only rows all of whose bits were set more than
once may be repeated, and only those rows shuffle; the rest pass straight through as groups of one.

The filter has 16 bits for each row. What is merged and broadcast at once is bounded by ``max_filter_mb``: a filter that is
larger is built and asked one range of hashes after the other, so its bits grow with the rows and no unique row shuffles for
want of them. The rows are then written by range once, and each pass reads its own (10^10 rows are 128 ranges).
Groups are summed before the shuffle; the join back is one that adaptive execution splits when a group is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_shared, prepare, shared_dir

MAX_FILTER_MB = 256
_SEGMENTS = 64


def normalised(text: Column) -> Column:
    """Each run of 0x20, 0x09-0x0D as one space; null as empty."""
    text = F.coalesce(text, F.lit(""))
    for gap in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def _cells(hashes: np.ndarray, log_words: int, log_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of each hash, after the bits that are its range, and its bits in that word."""
    one, low = np.uint64(1), np.uint64(63)
    bits = np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= one << ((hashes >> np.uint64(shift)) & low)
    return ((hashes << np.uint64(log_ranges)) >> np.uint64(64 - log_words)).astype(np.int64), bits


def _partial(hashes: np.ndarray, log_words: int, log_ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each touched word: the bits set by any row, and those set by more than one."""
    cell, bits = _cells(hashes, log_words, log_ranges)
    order = np.argsort(cell, kind="stable")
    cell, bits = cell[order], bits[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    once = np.bitwise_or.reduceat(bits, first)
    sizes = np.diff(np.r_[first, len(cell)])
    twice = np.zeros(len(first), np.uint64)
    many = np.flatnonzero(sizes > 1)
    if len(many):
        member = np.flatnonzero(np.repeat(sizes > 1, sizes))
        group = np.repeat(np.arange(len(many)), sizes[many])
        planes = (bits[member][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        counts = np.zeros((len(many), 64), np.int32)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        counts[:] = np.add.reduceat(planes.astype(np.int32), starts, axis=0)
        twice[many] = ((counts > 1).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return cell[first], once, twice


def _build(log_words: int, log_ranges: int, chunk: int = 1 << 17):
    per_segment = max(1, (1 << log_words) // _SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cell, once, twice = _partial(np.concatenate(held).view(np.uint64), log_words, log_ranges)
            held.clear()
            cuts = np.flatnonzero(np.diff(cell // per_segment)) + 1
            parts = zip(np.split(cell, cuts), np.split(once, cuts), np.split(twice, cuts), strict=True)
            rows = [(int(c[0] // per_segment), (c % per_segment).astype(np.uint32).tobytes() + o.tobytes() + t.tobytes()) for c, o, t in parts]
            return pa.RecordBatch.from_pydict({"segment": pa.array([r[0] for r in rows], pa.int32()), "cells": pa.array([r[1] for r in rows], pa.binary())})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= chunk:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    return run


def _merge(log_words: int):
    per_segment = max(1, (1 << log_words) // _SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                once, twice = segments.setdefault(segment, (np.zeros(per_segment, np.uint64), np.zeros(per_segment, np.uint64)))
                n = len(blob) // 20
                cell = np.frombuffer(blob, np.uint32, n)
                o, t = np.frombuffer(blob, np.uint64, n, 4 * n) if n % 2 == 0 else np.frombuffer(blob[4 * n : 12 * n], np.uint64), np.frombuffer(blob[12 * n :], np.uint64)
                twice[cell] |= t | (once[cell] & o)
                once[cell] |= o
        for segment, (_, twice) in segments.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": pa.array([twice.tobytes()], pa.binary())})

    return run


def filter_size(rows: int, max_filter_mb: float = MAX_FILTER_MB) -> tuple[int, int]:
    """(log2 of the words of a range's filter, log2 of the number of ranges) for so many rows, at 16 bits each."""
    whole = max(6, int(np.ceil(np.log2(max(rows, 1) * 16 / 64 + 1))))
    at_once = max(6, int(np.log2(max_filter_mb * (1 << 20) / 8)))
    return min(whole, at_once), max(0, whole - at_once)


def repeat_filter(hashes: DataFrame, log_words: int, log_ranges: int) -> np.ndarray:
    """The words of the filter for a DataFrame with one column of 64-bit hashes of one range: bits that more than one row set."""
    cells = hashes.mapInArrow(_build(log_words, log_ranges), "segment int, cells binary")
    merged = cells.repartition(min(_SEGMENTS, int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "segment").mapInArrow(_merge(log_words), "segment int, twice binary")
    words = np.zeros(1 << log_words, np.uint64)
    per_segment = max(1, (1 << log_words) // _SEGMENTS)
    for row in merged.toLocalIterator():  # max_filter_mb at most, whatever the input
        words[row.segment * per_segment : (row.segment + 1) * per_segment] = np.frombuffer(row.twice, np.uint64)
    return words


def _looked_up(words, log_ranges: int):
    @F.pandas_udf("boolean")
    def look_up(h: pd.Series) -> pd.Series:
        table = words.value
        cell, bits = _cells(h.to_numpy(np.int64).view(np.uint64), len(table).bit_length() - 1, log_ranges)
        return pd.Series((table[cell] & bits) == bits)

    return look_up


def maybe_repeated(rows: DataFrame, column: str, count: int, max_filter_mb: float = MAX_FILTER_MB, name: str = "maybe") -> DataFrame:
    """rows with a boolean column ``name``: false only where a row's hash (``column``, a long) occurs once in rows.

    Where the filter takes several ranges, rows are written by range to the shared folder, those of each are checkpointed, and its
    filter is dropped before the next.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    log_words, log_ranges = filter_size(count, max_filter_mb)
    parts, folder = [], f"{shared_dir(spark)}/ranges-{uuid.uuid4()}"
    if log_ranges:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.withColumn("_range", F.shiftrightunsigned(F.col(column), 64 - log_ranges).cast("int"))
        ranged.repartition(n, "_range", F.pmod(F.col(column), F.lit(max(1, n >> log_ranges)))).write.partitionBy("_range").parquet(folder)
        ranged = spark.read.parquet(folder)
    for r in range(1 << log_ranges):
        own = ranged.filter(F.col("_range") == r).select(*rows.columns) if log_ranges else rows
        words = context.broadcast(repeat_filter(own.select(column), log_words, log_ranges))
        marked = own.withColumn(name, _looked_up(words, log_ranges)(column))
        if log_ranges:
            marked = marked.checkpoint()
            words.destroy()
        parts.append(marked)
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    if log_ranges:
        delete_shared(spark, folder)
    return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256): what de-duplication needs of each row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"))


def exact_groups(rows: DataFrame, max_filter_mb: float = MAX_FILTER_MB) -> DataFrame:
    """rows (doc_id, text_sha256, and more) with keep_id, group_size and kept.

    Of rows with one digest, the one with the smallest doc_id is kept (a null id comes last; of repeated rows with
    that id, one). Columns of these names that rows had before are replaced. An empty table gives an empty table.
    """
    prepare(rows.sparkSession)
    body = F.struct("*")
    keyed = rows.select(body.alias("row")).select("row", F.col("row.doc_id").alias("id"), F.col("row.text_sha256").alias("sha"))
    keyed = keyed.withColumn("h", F.xxhash64("sha"))
    flagged = maybe_repeated(keyed, "h", rows.count(), max_filter_mb)
    lone = flagged.filter(~F.col("maybe")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # repeated rows are told apart by a number, which the checkpoint fixes
    several = flagged.filter("maybe").select("row", "sha", F.struct(F.col("id").isNull(), "id", F.monotonically_increasing_id()).alias("place")).checkpoint()
    # checkpointed, so that both sides of the join are exchanges, which adaptive execution can split
    groups = several.groupBy(F.col("sha").alias("of")).agg(F.min("place").alias("best"), F.count("*").alias("group_size")).checkpoint()
    joined = several.join(groups, F.col("sha") == F.col("of")).select("row", F.col("best.id").alias("keep_id"), "group_size", (F.col("place") == F.col("best")).alias("kept"))
    new = ("keep_id", "group_size", "kept")
    return lone.unionByName(joined).select(*[F.col(f"row.`{c}`") for c in rows.columns if c.lower() not in new], *new)


def first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_mb: float = MAX_FILTER_MB) -> DataFrame:
    """The rows of docs that stay, with the columns of docs and no other."""
    keyed = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"))
    return exact_groups(keyed, max_filter_mb).filter("kept").select("doc.*")
