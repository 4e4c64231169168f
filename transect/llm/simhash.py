"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its word shingles have it.
Two fingerprints within 3 bits of each other have a variant in common that lies within half the radius of each,
so every distinct fingerprint emits variants, equal variants meet in one bucket, and colliding pairs are verified.

Half of three is one or two. All fingerprints emit themselves and their 64 one-bit variants, which meets every
pair at distance 1 or 2. At distance 3 the two have different parity: the even one flips two of the three bits and
the odd one the third. Two of any three bits lie in the same half of the word, so it is enough that even
fingerprints also emit the 992 two-bit variants whose bits share a half. No pair within 3 bits is lost.

The bucket of a variant is a linear function of its bits. A bucket can therefore list the variants that fall in it
from the fingerprint alone, and a fingerprint is sent once, as 8 bytes, to each bucket that gets one of its variants.
The number of buckets grows with the distinct fingerprints, so a bucket stays bounded; copies share a fingerprint
and are one row here, so a large group of copies is no hot key. In a bucket, a group of colliding variants is linked
to one of its members (all such links are within the radius), never to all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare
from .graph import components

RADIUS = 3
SHINGLE = 3
SEED = 42
_LEAST_BUCKETS, _BUCKET_VARIANTS = 64, 4 << 20
_PAIRS = 8 << 20  # of fingerprint and bucket, sorted at once

# ---------------------------------------------------------------- fingerprints

_LANES = np.zeros(256, np.uint64)  # byte j of entry b is bit j of b
for _j in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_j)) & np.uint64(1)) << np.uint64(8 * _j)


def _shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z, and 0x20 with 0x09-0x0D
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per row of sizes (how many of the hashes are its own): the bits set in over half."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    blocks = -(-sizes // 255)  # lanes of 8 bits hold sums to 255
    row_of = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(row_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(sizes) - sizes)[row_of] + nth * 255
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(len(begin), 64)
    counts = np.add.reduceat(sums.astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprint_texts(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    out, held, sizes, size = [], [], [], 0
    for text in texts:
        found = _shingle_hashes(text or b"", shingle)
        held.append(np.array(found, np.uint64))
        sizes.append(len(found))
        size += len(found)
        if size > 200_000:
            out.append(_majority(np.concatenate(held), np.array(sizes)))
            held, sizes, size = [], [], 0
    if sizes:
        out.append(_majority(np.concatenate(held), np.array(sizes)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): text_key is xxhash64 of the text, fp the fingerprint as a signed long. Null or wordless texts have fingerprint 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_texts(batch.column(2).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


# ---------------------------------------------------------------- the ball

_ONE = np.uint64(1)


def _masks() -> tuple[np.ndarray, np.ndarray]:
    near = np.r_[np.uint64(0), _ONE << np.arange(64, dtype=np.uint64)]
    i, j = np.triu_indices(32, 1)
    pairs = np.concatenate([(_ONE << (i + h).astype(np.uint64)) | (_ONE << (j + h).astype(np.uint64)) for h in (0, 32)])
    return near, pairs


class _Ball:
    """Variants by bucket: bucket(fp ^ mask) = bucket(fp) ^ bucket(mask)."""

    def __init__(self, log_buckets: int):
        columns = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log_buckets)
        self.by_byte = np.zeros((8, 256), np.int64)
        for byte in range(8):
            for bit in range(8):
                self.by_byte[byte] ^= np.where(np.arange(256) >> bit & 1, int(columns[8 * byte + bit]), 0)
        near, pairs = _masks()
        self.near, self.pairs = self._grouped(near), self._grouped(pairs)
        #: what a fingerprint's own bucket is to be combined with, for odd fingerprints and for even ones: 65 and 1,057 at most
        self.of_odd = np.array(sorted(self.near), np.int64)
        self.of_even = np.array(sorted({*self.near, *self.pairs}), np.int64)

    def bucket(self, fps: np.ndarray) -> np.ndarray:
        octets = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(fps), np.int64)
        for byte in range(8):
            out ^= self.by_byte[byte][octets[:, byte]]
        return out

    def _grouped(self, masks: np.ndarray) -> dict[int, np.ndarray]:
        at = self.bucket(masks)
        return {int(v): masks[at == v] for v in np.unique(at)}


_NONE = np.empty(0, np.uint64)


def _by_bucket(bucket: np.ndarray, log_buckets: int) -> np.ndarray:
    """The order of the buckets, by 16 bits at a time, which numpy sorts in linear time."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    for shift in range(16, log_buckets, 16):
        order = order[np.argsort((bucket[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def scattered(fps: np.ndarray, ball: _Ball, log_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, where each begins and the last ends, fingerprints): every fingerprint once in each bucket that gets a variant of it.

    The work is the number of such pairs, 561 a fingerprint at most on average, whatever the number of buckets.
    """
    home, odd = ball.bucket(fps), (np.bitwise_count(fps) & 1).astype(bool)
    for own, place, masks in ((fps[odd], home[odd], ball.of_odd), (fps[~odd], home[~odd], ball.of_even)):
        step = max(1, _PAIRS // len(masks))
        for k in range(0, len(own), step):
            bucket = (place[k : k + step, None] ^ masks).ravel().astype(np.int32)
            order = _by_bucket(bucket, log_buckets)
            bucket = bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield bucket[first], np.r_[first, len(bucket)], own[k : k + step][order // len(masks)]


def _scatter(log_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _Ball(log_buckets)
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held).view(np.uint64)
            held.clear()
            for buckets, cuts, own in scattered(fps, ball, log_buckets):
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(buckets), blobs], ["bucket", "fps"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= 1 << 17:
                yield from flush()
        if sum(map(len, held)):
            yield from flush()

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for the nodes of edges (a, b) but the roots: a star for each component, its smallest node as root."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        root = root[root]
        if np.array_equal(root, was):
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def _bucket_links(fps: np.ndarray, bucket: int, ball: _Ball) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that this bucket proves to be within the radius."""
    group, odd = ball.bucket(fps) ^ bucket, (np.bitwise_count(fps) & 1).astype(bool)
    order = np.argsort(group, kind="stable")
    fps, group, odd = fps[order], group[order], odd[order]
    variants, owners, firsts = [], [], []
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for first, last in zip(cuts, np.r_[cuts[1:], len(fps)], strict=True):
        g = int(group[first])
        for masks, own, near in ((ball.near.get(g, _NONE), fps[first:last], True), (ball.pairs.get(g, _NONE), fps[first:last][~odd[first:last]], False)):
            if len(masks) and len(own):
                variants.append((own[:, None] ^ masks).ravel())
                owners.append(np.repeat(own, len(masks)))
                firsts.append(np.full(len(own) * len(masks), near))
    if not variants:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    variant, owner, near = np.concatenate(variants), np.concatenate(owners), np.concatenate(firsts)
    order = np.argsort(variant)
    variant = variant[order]
    new = np.r_[True, variant[1:] != variant[:-1]]
    shared = ~(new & np.r_[new[1:], True])  # not alone
    member = order[shared]
    start = np.flatnonzero(new[shared])
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    owner, near = owner[member], near[member]
    hub = np.minimum.reduceat(np.where(near, owner, np.uint64(2**64 - 1)), start)
    some = np.bitwise_or.reduceat(near, start)  # two-bit variants alone may be 4 bits apart: those at 2 meet elsewhere
    sizes = np.diff(np.r_[start, len(owner)])
    hub, some = np.repeat(hub, sizes), np.repeat(some, sizes)
    true = some & (hub != owner) & (np.bitwise_count(hub ^ owner) <= RADIUS)
    return forest(hub[true], owner[true])


def _link(log_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball, held = _Ball(log_buckets), {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(np.frombuffer(blob, np.uint64))
        for bucket in sorted(held):
            root, node = _bucket_links(np.unique(np.concatenate(held.pop(bucket))), bucket, ball)
            if len(root):
                yield pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), pa.array(node.view(np.int64))], ["a", "b"])

    return run


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints of fps (one long column) into the components of its links."""
    count = fps.count()
    log_buckets = max(_LEAST_BUCKETS, -(-count * 561 // _BUCKET_VARIANTS)).bit_length() - 1
    tasks = min(1 << log_buckets, max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << log_buckets) // 4))
    sent = fps.mapInArrow(_scatter(log_buckets), "bucket int, fps binary").repartition(tasks, "bucket")
    return sent.mapInArrow(_link(log_buckets), "a long, b long")


# ---------------------------------------------------------------- documents


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, component_id), one row for each row of docs.

    component_id is the smallest doc_id that links reach, through any chain. A row without an id is linked like any
    other, and gets the smallest id of its component, or null where no row of it has one. Repeated rows are repeated;
    null, empty and wordless texts share the fingerprint zero; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    marked = fingerprints(docs, doc_id, text, shingle).checkpoint()
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    # signed order differs from the order of the bits, but any root will do
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # checkpointed, so that both sides of the join are exchanges, which adaptive execution can split where a component is large
    ids = joined.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id")).checkpoint()
    named = joined.join(ids, F.col("root") == F.col("of")).select(F.col("fp").alias("f"), "component_id")
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component; rows without an id only where none has one.

    Rows equal in doc_id and text stay or go together.
    """
    verdict = near_duplicates(docs, doc_id, text, shingle)
    kept = verdict.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    return rows.join(kept.hint("shuffle_hash"), same, "left_semi").select("doc.*")
