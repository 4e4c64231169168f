"""Token ids in binary files: one zstandard frame for each document, with a dictionary that all of them share.

A file set is a folder with two tables that Spark writes, so it can be on any store:

``dictionary``  one row: the zstandard dictionary, trained on serialized id arrays, and its SHA-256.
``blocks``      shards in ascending doc_id order, cut into blocks of some thousand documents. A block has the SHA-256 of
                its dictionary, the width of an id in bytes, the first and last doc_id, the index (ids of its documents,
                offsets of their frames, numbers of tokens, all little-endian), its first token within the shard, and the
                frames themselves, each of them the ids of one document.

A document is read by the doc_id range of its block (parquet statistics skip the others), its offset, and the dictionary.
Parquet's own compression is off: frames don't compress twice.

Shards are ranges of doc_id, from approximate percentiles; equal ids stay in one shard, in the order of their texts'
hashes; null ids come first, counted in each block, so that any number can be an id. Shard k is partition k. A row of a
repeated id is a document of its own; all rows of one id share a shard. The dictionary is trained on ``SAMPLE`` documents
at most, chosen by a hash. Null and empty texts are the end id alone; an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .encoders import UnitEncoder

END_ID = 2
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 800, 16 << 10, 64 << 10
LEVEL = 3
_BLOCK_BYTES, _BLOCK_DOCS = 8 << 20, 4096
_BLOCK_SCHEMA = "shard int, block int, dictionary_sha256 string, width int, nulls int, first_id long, last_id long, first_token long, n_tokens long, ids binary, offsets binary, lengths binary, frames binary"


def _serialized(ids: bytes, end_id: int, width: int) -> bytes:
    return (np.append(np.frombuffer(ids, np.uint32), np.uint32(end_id))).astype(np.uint16 if width == 2 else np.uint32).tobytes()


def id_width(path: str, byte_level: bool) -> int:
    return 2 if UnitEncoder.of(path, byte_level).tokenizer.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, byte_level: bool = True, end_id: int = END_ID, text: str = "text") -> bytes:
    """Of at most SAMPLE documents, each with its first SAMPLE_BYTES of ids. Too few ids to train on are the dictionary themselves."""
    total = docs.count()
    width = id_width(path, byte_level)
    spot = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("sample")) / F.lit(2.0**64) + 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(path, byte_level)
        for batch in batches:
            ids = [_serialized(encoder.encode(t or ""), end_id, width)[:SAMPLE_BYTES] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    chosen = docs.select(F.col(text).alias("text")).filter(spot < F.lit(SAMPLE / max(total, 1)))
    samples = sorted({bytes(r.ids) for r in chosen.mapInArrow(run, "ids binary").limit(2 * SAMPLE).collect()})
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    if not data:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    own = _dictionary(data)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False)


def _compress(path: str, byte_level: bool, end_id: int, dictionary, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = UnitEncoder.of(path, byte_level), id_width(path, byte_level)
        press = _compressor(dictionary.value)
        for batch in batches:
            ids, frames, sizes = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), [], []  # nulls in the first shard
            for found in encoder.encode_all([t or "" for t in batch.column(2).to_pylist()]):
                plain = _serialized(found, end_id, width)
                sizes.append(len(plain) // width)
                frames.append(press.compress(plain))
            shard = np.searchsorted(bounds, ids, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["shard", "id", "key", "n", "frame"])

    return run


def _blocks(sha: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, token = None, 0, 0
        ids: list[int | None] = []  # nulls first
        sizes: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, token, held
            n = sum(sizes)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.uint64)
            nulls = ids.count(None)
            known = ids[nulls:] or [None]
            row = {
                "shard": pa.array([now], pa.int32()), "block": pa.array([block], pa.int32()), "dictionary_sha256": [sha], "width": pa.array([width], pa.int32()), "nulls": pa.array([nulls], pa.int32()),
                "first_id": pa.array([known[0]], pa.int64()), "last_id": pa.array([known[-1]], pa.int64()), "first_token": pa.array([token], pa.int64()), "n_tokens": pa.array([n], pa.int64()),
                "ids": [np.array([i or 0 for i in ids], np.int64).tobytes()], "offsets": [offsets.tobytes()], "lengths": [np.array(sizes, np.uint32).tobytes()], "frames": pa.array([b"".join(frames)], pa.binary()),
            }
            block, token, held = block + 1, token + n, 0
            ids.clear(), sizes.clear(), frames.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for shard, i, n, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if ids and (shard != now or held >= _BLOCK_BYTES or len(ids) >= _BLOCK_DOCS):
                    yield flush()
                if shard != now:
                    now, block, token = shard, 0, 0
                ids.append(i)
                sizes.append(n)
                frames.append(frame)
                held += len(frame)
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, byte_level: bool = True, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts (null: empty), appends end_id to each, and writes the file set described above."""
    spark = docs.sparkSession
    prepare(spark)
    data = train_dictionary(docs, path, byte_level, end_id, text)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("id", [k / shards for k in range(1, shards)], 100 * shards).alias("bounds")).first().bounds if shards > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))
    shared = spark.sparkContext.broadcast(data)
    frames = rows.mapInArrow(_compress(path, byte_level, end_id, shared, bounds), "shard int, id long, key long, n long, frame binary")
    dealt = frames.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "key")
    dealt.mapInArrow(_blocks(sha, id_width(path, byte_level)), _BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")


def _read_dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dictionary_sha256:
        raise ValueError(f"{folder}: the dictionary isn't the one that its hash names")
    return row.dictionary_sha256, data


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are little-endian unsigned 32-bit numbers."""
    prepare(spark)
    sha, data = _read_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    sums = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())  # one row for each shard
    before, total = {}, 0
    for shard, n in sums:
        before[shard] = total
        total += n
    shared = spark.sparkContext.broadcast((data, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, before = shared.value
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data) if data else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError(f"a block was written with dictionary {row['dictionary_sha256']}, not {sha}")
                ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
                at, frames = np.frombuffer(row["offsets"], np.uint64).tolist(), row["frames"]
                start = before[row["shard"]] + row["first_token"] + np.cumsum(sizes) - sizes
                kind = np.uint16 if row["width"] == 2 else np.uint32
                for a in range(0, len(ids), 512):
                    blobs = [np.frombuffer(expand.decompress(frames[at[k] : at[k + 1]]), kind).astype(np.uint32).tobytes() for k in range(a, min(a + 512, len(ids)))]
                    b = a + len(blobs)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], mask=np.arange(a, b) < row["nulls"]), pa.array(start[a:b]), pa.array(sizes[a:b]), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    needed = blocks.select("shard", "dictionary_sha256", "width", "nulls", "first_token", "ids", "offsets", "lengths", "frames")
    return needed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of all documents with one doc_id: of the files, one block and of that one frame is decompressed."""
    sha, data = _read_dictionary(spark, folder)
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data) if data else None)
    blocks = spark.read.parquet(f"{folder}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    out = []
    for row in blocks.orderBy("shard", "block").toLocalIterator():
        if row.dictionary_sha256 != sha:
            raise ValueError(f"a block was written with dictionary {row.dictionary_sha256}, not {sha}")
        at, kind = np.frombuffer(row.offsets, np.uint64).tolist(), np.uint16 if row.width == 2 else np.uint32
        found = np.flatnonzero(np.frombuffer(row.ids, np.int64) == doc_id)
        for k in found[found >= row.nulls].tolist():
            out.append(np.frombuffer(expand.decompress(bytes(row.frames[at[k] : at[k + 1]])), kind).tolist())
    return out
