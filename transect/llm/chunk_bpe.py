"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks, so that a passage is cut alike wherever it stands; no chunk is longer
than ``_MOST_CHUNK`` bytes. Spark counts the chunks of all documents by their digests. Every chunk that occurs twice or
more is encoded once, by the document of the smallest id that has it, and its ids are joined by digest with the documents
that have it; each of these takes them as they are and encodes only what lies between.

Cuts fall anywhere, so joins are repaired: of a chunk only its core, from its first white space to its last, is
shared, and the text between two cores is encoded together with the word before and the word after. The re-encoded
ids must begin and end with the ids that the cores have for those words; if they don't, both sides are widened by
more words, in the end to the whole text.

Only documents that have shared chunks are shuffled by document: their hashes, broadcast while they are ``MAX_BROADCAST_DOCS``
at most, let the others pass straight through. Beyond that all texts are shuffled, with the same result.
What meets in one row is the shared chunks of one document. Null texts are empty, and have no ids; repeated rows are
repeated; a chunk that a document has several times is shared too; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID_SENTINEL, MAX_BROADCAST_DOCS, mix, prepare, routed, text_slices
from .encoders import UnitEncoder

_CUT_BITS, _LEAST_CHUNK, _MOST_CHUNK, _WINDOW = 10, 256, 8192, 32
_GEAR = mix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)


def _cuts(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """For each row: where its chunks begin and end, in bytes of raw."""
    rolled = _GEAR[raw]
    step = 1
    while step < _WINDOW:  # the hash of a window of 2n from those of its halves
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = longer, 2 * step
    marks = np.flatnonzero((rolled >> np.uint32(32 - _CUT_BITS)) == 0) + 1
    marks = marks[marks < len(raw)]
    marks = marks[(raw[marks] & 0xC0) != 0x80]  # between characters
    bounds = np.searchsorted(marks, at).tolist()
    marks, at = marks.tolist(), at.tolist()
    for row in range(len(at) - 1):
        cuts, end = [at[row]], at[row + 1]
        for m in (*marks[bounds[row] : bounds[row + 1]], end):
            while m - cuts[-1] > _MOST_CHUNK:  # no mark for long
                cut = cuts[-1] + _MOST_CHUNK
                while (raw[cut] & 0xC0) == 0x80:
                    cut -= 1
                cuts.append(cut)
            if m == end or (m - cuts[-1] >= _LEAST_CHUNK and end - m >= _LEAST_CHUNK):
                cuts.append(m)
        yield row, cuts


def _cores(data: bytes, cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Of each chunk, the part between its first white space and its last: what a join can't change."""
    for a, b in zip(cuts, cuts[1:], strict=False):
        first = min((p for p in (data.find(b" ", a, b), data.find(b"\n", a, b)) if p >= 0), default=-1)
        last = max(data.rfind(b" ", a, b), data.rfind(b"\n", a, b))
        if 0 <= first < last:
            yield first + 1, last + 1


def _digest(core: bytes) -> bytes:
    return xxhash.xxh3_128_digest(core)


_DOC = "id long, key int"  # a document: its id (a null one as ID_SENTINEL), and a hash of its text


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and digest of its cores, with how often it has it."""
    for batch in batches:
        for first, _, raw, at in text_slices(batch.column(2)):
            data = raw.tobytes()
            rows, found, times = [], [], []
            for row, cuts in _cuts(raw, at):
                own = Counter(_digest(data[a:b]) for a, b in _cores(data, cuts))
                rows += [first + row] * len(own)
                found += own
                times += own.values()
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(found, pa.binary()), pa.array(times, pa.int32())], ["id", "key", "digest", "n"])


def _packed(encoder: UnitEncoder, ids: bytes) -> bytes:
    return np.frombuffer(ids, np.uint32).astype(_kind(encoder)).tobytes()


def _kind(encoder: UnitEncoder) -> type:
    return np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32


def _encode_once(path: str):
    """(digest, ids) of the cores that a document (text, and a list of digests) encodes for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(path, False)
        for batch in batches:
            asked = batch.column(1)
            for first, last, raw, at in text_slices(batch.column(0)):
                data, out = raw.tobytes(), {}
                wanted = asked.slice(first, last - first).to_pylist()
                for row, cuts in _cuts(raw, at):
                    left = set(wanted[row])
                    for a, b in _cores(data, cuts):
                        if (d := _digest(data[a:b])) in left:
                            left.discard(d)
                            out[d] = data[a:b].decode()
                ids = [_packed(encoder, i) for i in encoder.encode_all(list(out.values()))]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(ids, pa.binary())], ["digest", "ids"])

    return run


def with_chunks(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST_DOCS) -> DataFrame:
    """(doc_id, text, chunks), one row for each row of docs: chunks are the document's shared ones, each its digest (16 bytes)
    and its ids; null for documents without."""
    own = F.col(doc_id).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(ID_SENTINEL)).alias("id"), F.hash(F.col(text)).alias("key"), F.col(text).alias("text"))
    occurrences = rows.select("id", "key", "text").mapInArrow(_occurrences, f"{_DOC}, digest binary, n int").checkpoint()
    shared = occurrences.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("id", "key")).alias("who")).filter("n > 1").select("digest", "who").checkpoint()
    named = lambda df: df.select(F.col("id").alias("i"), F.col("key").alias("k"), "chunks")
    same = (F.col("id") == F.col("i")) & (F.col("key") == F.col("k"))
    # both sides of the joins by digest are exchanges, which adaptive execution can split where a chunk is hot
    having = occurrences.join(shared.select("digest"), "digest").select("id", "key").distinct().checkpoint()
    taken, others = routed(rows, having, max_broadcast)
    encoders = named(shared.groupBy("who").agg(F.collect_list("digest").alias("chunks")).select("who.id", "who.key", "chunks"))
    encoding, _ = routed(rows, shared.select("who.id", "who.key"), max_broadcast)
    coded = encoding.join(encoders.hint("shuffle_hash"), same).select("text", "chunks").mapInArrow(_encode_once(path), "digest binary, ids binary").groupBy("digest").agg(F.first("ids").alias("ids")).checkpoint()
    lists = occurrences.select("id", "key", "digest").join(coded, "digest").groupBy("id", "key").agg(F.collect_list(F.concat("digest", "ids")).alias("chunks"))
    joined = taken.join(named(lists).hint("shuffle_hash"), same, "left").select("doc_id", "text", "chunks")
    if others is None:
        return joined
    return others.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("chunks")).union(joined)


def _last_words(data: bytes, a: int, b: int, n: int) -> int:
    """Where the last n words of data[a:b] begin; its last byte is white space."""
    at = b - 1
    for _ in range(n):
        at = max(data.rfind(b" ", a, at), data.rfind(b"\n", a, at))
        if at < a:
            return a
    return at + 1


def _first_words(data: bytes, a: int, b: int, n: int) -> int:
    """Where the first n words of data[a:b] end."""
    at = a - 1
    for _ in range(n):
        at = min((p for p in (data.find(b" ", at + 1, b), data.find(b"\n", at + 1, b)) if p >= 0), default=b)
        if at >= b:
            return b
    return at + 1


def join_ids(data: bytes, start: int, end: int, cores: list[tuple[int, int, bytes]], encode) -> bytes:
    """The ids of data[start:end] from the known ids of some cores in it, in order, and encodings of what lies between."""
    if not cores:
        return encode(data[start:end].decode())
    bounds = [(start, start, b""), *cores, (end, end, b"")]
    out = []
    for k, ((la, lb, left), (ra, rb, right)) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if k:
            out.append(left)
        words = 1
        while True:
            a, b = _last_words(data, la, lb, words) if lb > la else lb, _first_words(data, ra, rb, words) if rb > ra else ra
            before, after = encode(data[a:lb].decode()), encode(data[ra:b].decode())
            whole = encode(data[a:b].decode())
            middle = len(whole) - len(after)
            if middle >= len(before) and whole.startswith(before) and left.endswith(before) and whole.endswith(after) and right.startswith(after):
                out.append(whole[len(before) : middle])
                break
            if a == la and b == rb:  # the cores themselves don't agree with the text around them
                return encode(data[start:end].decode())
            words *= 2
    return b"".join(out)


def _encode(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(path, False)
        kind = _kind(encoder)
        for batch in batches:
            for first, last, raw, at in text_slices(batch.column(1)):
                data = raw.tobytes()
                chunks = batch.column(2).slice(first, last - first).to_pylist()
                plain = [k for k, c in enumerate(chunks) if not c]
                ids: list[bytes] = [b""] * len(chunks)
                for k, found in zip(plain, encoder.encode_all([data[at[k] : at[k + 1]].decode() for k in plain]), strict=True):
                    ids[k] = found
                for row, cuts in _cuts(raw, at) if len(plain) < len(chunks) else ():
                    if chunks[row]:
                        known = {c[:16]: c[16:] for c in chunks[row]}
                        cores = [(a, b, np.frombuffer(found, kind).astype(np.uint32).tobytes()) for a, b in _cores(data, cuts) if (found := known.get(_digest(data[a:b]))) is not None]
                        ids[row] = join_ids(data, cuts[0], cuts[-1], cores, encoder.encode)
                columns = {"doc_id": batch.column(0).slice(first, last - first), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["text"] = pa.array(_decoded(encoder.tokenizer, ids), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _decoded(tokenizer, blobs: list[bytes]) -> list[str]:
    return [tokenizer.decode(np.frombuffer(b, np.uint32).tolist(), skip_special_tokens=False) for b in blobs]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False, max_broadcast: int = MAX_BROADCAST_DOCS) -> DataFrame:
    """(doc_id, ids), one row for each row of docs: ids as little-endian unsigned 32-bit numbers; with ``decoded``, also
    their decoding, as ``decode`` gives it, by the same Python worker.

    For vocabularies that drop white space between pieces; path is that of a tokenizers file.
    """
    prepare(docs.sparkSession)
    rows = with_chunks(docs, path, doc_id, text, max_broadcast)
    return rows.mapInArrow(_encode(path, decoded), "doc_id long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the library's decoding of ids, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = UnitEncoder.of(path, False).tokenizer
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_decoded(tokenizer, part.column(1).to_pylist()), pa.string())], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, text string")


def summary(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs."""
    both = encode(docs, path, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
