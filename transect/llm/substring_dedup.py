"""Removal of passages that an earlier document has, by level-wise doubling.

To find repeated windows of 13 words, windows of 7 words are looked at first, and those repeated at that length alone are
extended to 13 (a window of 13 is two overlapping windows of 7); for windows of 26 or 52 words the same goes on from 13,
and ``repeat_levels`` goes on until no candidate survives. Of every level only the candidates of the level before are hashed
and shuffled.

At a level below the last, a window is represented by one of its parts: the part with the smallest hash, which equal windows
have in common and consecutive windows mostly share. A run of such windows is one entry, filed in a bucket by the hash of
its part; the bucket says which entries several documents have, and those go on. At the last level the hashes of the whole
windows of what is left meet in buckets, and those that a document with a smaller id has are removed. The number of
buckets grows with the rows, so a bucket stays bounded. The texts are shuffled once, by document; every level and the
removal read them from there.

Hashes travel as packed arrays, 32 bits of a bucket's own at the levels below the last, where a false one costs a candidate,
and 64 bits at the last: two different windows are taken for equal with a chance of about 2^-64 for each pair of candidates
in one bucket.

Before each shuffle a task settles what it can: entries that several of its documents have go on at once and are sent for
the other tasks once; at the last level, of equal windows in one task, all but the smallest doc_id's are repeats already and
only that document's are sent. So a passage that a third of all rows has reaches its bucket a few times per task and not
once per row.

A document is doc_id and text: rows equal in both count as one, and are not each other's source. A null id comes
after all others (beside 2^63-1: neither is the other's source). Null and empty texts have no words and lose none; repeated
rows are repeated; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID_SENTINEL, MAX_BROADCAST_DOCS, doubled, hash_words, prepare, routed, text_slices, word_spans

WORDS = 13
_FIRST_WORDS = 7  # at most, at the first level
_LEAST_BUCKETS, _BUCKET_ROWS = 32, 8192
_FLUSH = 1_500_000  # windows


def level_lengths(size: int) -> list[int]:
    """Of the windows of the levels, the last being ``size``: each is twice the one before, or one less."""
    out = [size]
    while out[0] > _FIRST_WORDS or len(out) == 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, from windows of half the size, overlapping where size is odd."""
    if size == 1:
        return words
    half = -(-size // 2)
    part = _windows(words, half)
    step = size - half
    return doubled(part[: len(part) - step], part[step:]) if len(part) > step else np.empty(0, np.uint64)


def chain(words: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each window of the last length, by level: the hash of the part that stands for it there; at the last level its own."""
    levels = [_windows(words, lengths[0])]
    for short, long in zip(lengths, lengths[1:], strict=False):
        own, step = levels[-1], long - short
        n = len(own) - step
        if n <= 0:
            return [np.empty(0, np.uint64)] * len(lengths)
        least = own[:n].copy()
        if len(levels) == 1:
            for k in range(1, step + 1):
                np.minimum(least, own[k : k + n], out=least)
            levels = [least]
        else:
            at = np.arange(n)
            for k in range(1, step + 1):
                less = np.flatnonzero(own[k : k + n] < least)
                least[less], at[less] = own[less + k], less + k
            levels = [x[at] for x in levels]
        levels.append(doubled(own[:n], own[step:]))
    return levels


_PRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob; all but the last two (random bits) are compressed."""
    plain = [np.ascontiguousarray(a).tobytes() for a in arrays]
    bodies = [_PRESS.compress(b) for b in plain[:-2]] + plain[-2:]
    return np.array([len(b) for b in bodies], np.uint32).tobytes() + b"".join(bodies)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.uint32, len(kinds))
    ends = 4 * len(kinds) + np.cumsum(sizes.astype(np.int64))
    bodies = [blob[e - s : e] for e, s in zip(ends, sizes, strict=True)]
    return [np.frombuffer(_EXPAND.decompress(b) if i < len(kinds) - 2 else b, k) for i, (b, k) in enumerate(zip(bodies, kinds, strict=True))]


# ids and keys of documents, runs of each, first window and number of windows of each run; then hashes of runs and of those
# known to be shared, or hashes of runs and of windows
_KINDS = (np.int64, np.int32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where mask is set."""
    first = np.flatnonzero(mask)
    return first, np.diff(np.r_[first, len(mask)])


def _spread(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _spans(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of one document as (doc, first, windows); sorted by (doc, at) on entry."""
    if not len(doc):
        return doc, at, at
    first, size = _runs(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
    return doc[first], at[first], size


def _by_document(ids: np.ndarray, keys: np.ndarray, first: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """One row for each document: its spans as pairs of numbers. Spans of a document stand together."""
    f, n = _runs(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]) if len(ids) else (np.empty(0, np.int64), np.empty(0, np.int64))
    spans = np.stack([first, windows], axis=1).astype(np.uint32)
    blobs = [spans[a : a + k].tobytes() for a, k in zip(f, n, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([-1] * len(f), pa.int32()), pa.array(ids[f], pa.int64()), pa.array(keys[f], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "id", "key", "blob"])


def _filed(bucket: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, its entries, where their documents begin among them, entries of each document), for the buckets that have entries."""
    by = np.argsort(bucket, kind="stable")
    begin, size = _runs(np.r_[True, bucket[by][1:] != bucket[by][:-1]])
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        own = by[b : b + n]
        yield int(bucket[own[0]]), own, *_runs(np.r_[True, doc[own][1:] != doc[own][:-1]])


_ROW = "bucket int, id long, key int, blob binary"


def _rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(buckets))
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "id", "key", "blob"])


def _candidates(lengths: list[int], level: int, flush):
    """Windows of the last length, whole or only those in the spans of the level before, by the hashes of a level and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held, ids, keys, docs, windows = lengths[-1], [], [], [], 0, 0
        for batch in batches:
            all_ids, all_keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            spans = batch.column(4) if level else None
            for a, b, raw, offsets in text_slices(batch.column(3)):
                starts, ends, at = word_spans(raw, offsets)
                found = chain(hash_words(raw, starts, ends)[0], lengths)
                row = np.repeat(np.arange(b - a), np.diff(at))
                n = len(found[-1])
                asked = row[:n] == row[size - 1 :] if n else np.empty(0, bool)
                if level:
                    edge = np.zeros(n + 1, np.int64)
                    for k, own in enumerate(spans.slice(a, b - a).to_pylist()):
                        pairs = np.frombuffer(b"".join(own), np.uint32).reshape(-1, 2).astype(np.int64)
                        np.add.at(edge, at[k] + pairs[:, 0], 1)
                        np.add.at(edge, at[k] + pairs[:, 0] + pairs[:, 1], -1)
                    asked &= np.cumsum(edge[:-1]) > 0
                inside = np.flatnonzero(asked)
                held.append((found[level][inside] if level < len(lengths) - 1 else found[level - 1][inside], found[-1][inside], (row[inside] + docs).astype(np.int32), (inside - at[row[inside]]).astype(np.uint32)))
                ids.append(all_ids[a:b])
                keys.append(all_keys[a:b])
                docs, windows = docs + b - a, windows + len(inside)
                if windows >= _FLUSH:
                    yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)), np.concatenate(ids), np.concatenate(keys))
                    held, ids, keys, docs, windows = [], [], [], 0, 0
        if windows:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)), np.concatenate(ids), np.concatenate(keys))

    return run


def _send_parts(buckets: int):
    """Below the last level: runs of windows by the part that stands for them."""

    def flush(part: np.ndarray, _, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, count = _runs(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
        part, doc, at = part[first], doc[first], at[first]
        order = np.argsort(part, kind="stable")
        start, size = _runs(np.r_[True, part[order][1:] != part[order][:-1]])
        many = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
        settled = np.sort(order[np.repeat(many, size)])
        yield _by_document(ids[doc[settled]], keys[doc[settled]], at[settled], count[settled])
        shared = part[order[start[many]]]
        alone = np.ones(len(part), bool)
        alone[settled] = False
        part, doc, at, count = part[alone], doc[alone], at[alone], count[alone]
        empty = (np.empty(0, np.int64), np.empty(0, np.int32), *[np.empty(0, np.uint32)] * 4)
        out = {}
        if len(part):
            for b, own, f, n in _filed((part >> np.uint64(32)).astype(np.int64) % buckets, doc):
                d = doc[own[f]]
                out[b] = (ids[d], keys[d], n.astype(np.uint32), at[own], count[own].astype(np.uint32), part[own].astype(np.uint32))
        known = {}
        if len(shared):
            for b, own, _, _ in _filed((shared >> np.uint64(32)).astype(np.int64) % buckets, np.zeros(len(shared))):
                known[b] = shared[own].astype(np.uint32)
        both = sorted({*out, *known})
        yield _rows(both, [_pack(*out.get(b, empty), known.get(b, np.empty(0, np.uint32))) for b in both])

    return flush


def _shared_parts(blobs: list[bytes]) -> pa.RecordBatch:
    """The entries of one bucket that several documents have."""
    parts = [_unpack(b, _KINDS) for b in blobs]
    doc = np.repeat(np.arange(sum(len(p[0]) for p in parts)), np.concatenate([p[2] for p in parts]))
    ids, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    part, known = np.concatenate([p[5] for p in parts]), np.unique(np.concatenate([p[6] for p in parts]))
    many = np.zeros(len(part), bool)
    if len(part):
        order = np.argsort(part, kind="stable")
        start, size = _runs(np.r_[True, part[order][1:] != part[order][:-1]])
        many[order] = np.repeat(np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start), size)
        if len(known):
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            many |= known[at] == part
    live = np.flatnonzero(many)
    at, count = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    return _by_document(ids[doc[live]], keys[doc[live]], at[live], count[live])


def _send_windows(buckets: int):
    """At the last level: windows by their own hash, in runs by the part that stood for them."""

    def flush(part: np.ndarray, own: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        # of equal windows, those of the smallest id go on and the others are repeats already
        order = np.argsort(own)
        new = np.r_[True, own[order][1:] != own[order][:-1]]
        shared = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if len(shared):
            start, size = _runs(new[shared])
            whose = ids[doc[order[shared]]]
            settled = np.sort(order[shared][whose > np.repeat(np.minimum.reduceat(whose, start), size)])
            d, a, n = _spans(doc[settled], at[settled])
            yield _by_document(ids[d], keys[d], a, n)
            go = np.ones(len(own), bool)
            go[settled] = False
            part, own, doc, at = part[go], own[go], doc[go], at[go]
        if not len(own):
            return
        first, count = _runs(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
        part, whose = part[first], doc[first]
        buckets_, blobs = [], []
        for b, r, f, n in _filed((part >> np.uint64(32)).astype(np.int64) % buckets, whose):
            d = whose[r[f]]
            each = np.repeat(first[r], count[r]) + _spread(count[r])
            buckets_.append(b)
            blobs.append(_pack(ids[d], keys[d], n.astype(np.uint32), at[first[r]], count[r].astype(np.uint32), part[r].astype(np.uint32), own[each].astype(np.uint32)))
        yield _rows(buckets_, blobs)

    return flush


def _repeated_windows(blobs: list[bytes]) -> pa.RecordBatch:
    """What a smaller id has too, of one bucket."""
    parts = [_unpack(b, _KINDS) for b in blobs]
    ids, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    run_doc = np.repeat(np.arange(len(ids)), np.concatenate([p[2] for p in parts]))
    count = np.concatenate([p[4] for p in parts]).astype(np.int64)
    doc = np.repeat(run_doc, count)
    place = np.repeat(np.concatenate([p[3] for p in parts]).astype(np.int64), count) + _spread(count)
    full = (np.repeat(np.concatenate([p[5] for p in parts]).astype(np.uint64), count) << np.uint64(32)) | np.concatenate([p[6] for p in parts])
    order = np.argsort(full, kind="stable")
    start, size = _runs(np.r_[True, full[order][1:] != full[order][:-1]])
    whose = ids[doc[order]]
    later = order[whose > np.repeat(np.minimum.reduceat(whose, start), size)]
    doc, place = doc[later], place[later]
    by = np.lexsort((place, doc))
    doc, first, windows = _spans(doc[by], place[by])
    return _by_document(ids[doc], keys[doc], first, windows)


def _settle(meet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            bucket, blobs = batch.column(0).to_numpy(), batch.column(3)
            done = np.flatnonzero(bucket < 0)  # what a task has settled by itself
            if len(done):
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(done)), batch.column(2).take(pa.array(done)), blobs.take(pa.array(done))], ["id", "key", "blob"])
            for k in np.flatnonzero(bucket >= 0).tolist():
                held.setdefault(int(bucket[k]), []).append(blobs[k].as_py())
        for bucket in sorted(held):
            yield meet(held.pop(bucket)).select(["id", "key", "blob"])

    return run


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(none, id, key, text): none: whether the id is null, and id then stands for it; key a hash of the text, which tells documents
    of one id apart. All are expressions of their own, so that every branch of a plan has them alike and shares one exchange."""
    own = F.col(doc_id).cast("long")
    return docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(ID_SENTINEL)).alias("id"), F.hash(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _with_spans(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """rows joined with their document's spans by a join that deals both out by document; the dealt-out rows are the same each time."""
    named = spans.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans")
    return rows.join(named.hint("shuffle_hash"), (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")), how).select("none", "id", "key", "text", "spans")


def repeated_spans(rows: DataFrame, count: int, size: int = WORDS, max_broadcast: int = MAX_BROADCAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(spans, rows that may have some, the others or None). spans: (id, key, spans): per document, the (first window, windows) pairs, as arrays of unsigned 32-bit numbers, of the windows
    of ``size`` words (2 or more) that a document with a smaller id has too; rows as of ``_prepared``, about ``count`` of them."""
    lengths = level_lengths(size)
    buckets = 1 << (max(_LEAST_BUCKETS, count // _BUCKET_ROWS) - 1).bit_length()
    tasks = max(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets), buckets // 4)
    spans, others = None, None
    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        asked = rows if spans is None else _with_spans(rows, spans, "inner")
        sent = asked.mapInArrow(_candidates(lengths, level, (_send_windows if last else _send_parts)(buckets)), _ROW)
        # what a task has settled by itself is dealt out by document
        to = F.pmod(F.when(F.col("bucket") < 0, F.hash("id", "key")).otherwise(F.col("bucket")), F.lit(tasks))
        dealt = sent.repartitionById(tasks, to)
        found = dealt.mapInArrow(_settle(_repeated_windows if last else _shared_parts), "id long, key int, blob binary")
        spans = found.groupBy("id", "key").agg(F.collect_list("blob").alias("spans"))
        if not level:
            spans = spans.checkpoint()
            rows, others = routed(rows, spans, max_broadcast)
    return spans, rows, others


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = pa.array(batch.column(1).to_numpy(), mask=batch.column(0).to_numpy(zero_copy_only=False)), batch.column(4).to_pylist()
            texts = batch.column(3).cast(pa.large_binary()).to_pylist()
            out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            for text, own in zip(texts, spans, strict=True):
                words = (text or b"").split()
                removed = 0
                if own:
                    at = np.frombuffer(b"".join(own), np.uint32).reshape(-1, 2).astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 0] + at[:, 1] + size - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    removed = int(len(words) - stays.sum())
                    out["n_words"].append(len(words))
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                else:
                    out["n_words"].append(len(words))
                out["n_removed"].append(removed)
                out["kept"].append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary())], list(out))

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, max_broadcast: int = MAX_BROADCAST_DOCS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row for each row of docs; kept: the words left, joined by one space."""
    prepare(docs.sparkSession)
    rows = _prepared(docs, doc_id, text)
    spans, taken, others = repeated_spans(rows, docs.count(), size, max_broadcast)
    joined = _with_spans(taken, spans, "left")
    if others is not None:
        joined = joined.union(others.select("none", "id", "key", "text", F.lit(None).cast("array<binary>").alias("spans")))
    return joined.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.decode("kept", "UTF-8"))


def repeat_levels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """(doc_id, first, words): for each word position that starts a window of ``size`` words which an earlier document
    has too, the longest doubled length at which that still holds.

    Each level joins the candidates of the last with themselves one length further on, keeps windows that two documents
    have, and ends when none is left; its table is checkpointed.
    """
    prepare(docs.sparkSession)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(ID_SENTINEL).to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in text_slices(batch.column(1), 1 << 18):
                starts, ends, at = word_spans(raw, offsets)
                own = _windows(hash_words(raw, starts, ends)[0], size)
                row = np.repeat(np.arange(b - a), np.diff(at))
                inside = np.flatnonzero(row[: len(own)] == row[size - 1 :]) if len(own) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][row[inside]]), pa.array(inside - at[row[inside]]), pa.array(own[inside].view(np.int64))], ["id", "first", "h"])

    def shared(level: DataFrame) -> DataFrame:
        least = level.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
        return level.join(least, "h").select("id", "first", "h", "least").checkpoint()

    level, length, levels = shared(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(seen, "id long, first long, h long").distinct()), size, []
    while not level.isEmpty():
        levels.append(level.filter("id > least").select("id", "first", F.lit(length).alias("words")))
        tail = level.select(F.col("id").alias("i"), (F.col("first") - length).alias("f"), F.col("h").alias("g"))
        level = shared(level.join(tail, (F.col("id") == F.col("i")) & (F.col("first") == F.col("f"))).select("id", "first", F.xxhash64("h", "g").alias("h")))
        length *= 2
    if not levels:
        return level.select(F.col("id").alias("doc_id"), "first", F.lit(size).alias("words"))
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    return found.groupBy("id", "first").agg(F.max("words").alias("words")).select(F.nullif("id", F.lit(ID_SENTINEL)).alias("doc_id"), "first", "words")
