from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from transect.llm import chunk_bpe
from transect.llm.encoders import UnitEncoder, load

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts, path=PATH):
    return [np.array(e.ids, np.uint32).tobytes() for e in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_awkward_rows(spark):
    texts = [r[1] for r in awkward_rows()]
    ids = plain(texts)
    decoded = load(PATH).decode_batch([np.frombuffer(i, np.uint32).tolist() for i in ids], skip_special_tokens=False)
    want = sorted((str(r[0]), i, d) for r, i, d in zip(awkward_rows(), ids, decoded, strict=True))
    for found in (chunk_bpe.decode(chunk_bpe.encode(awkward(spark), PATH), PATH), chunk_bpe.encode(awkward(spark), PATH, decoded=True)):
        assert sorted((str(r.doc_id), bytes(r.ids), r.text) for r in found.collect()) == want


@pytest.mark.parametrize("max_broadcast", [1_000_000, 10])
def test_driver_documents(spark, small, max_broadcast):
    """With the documents that have shared chunks broadcast, and with too many of them."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows]), strict=True))
    assert {r.doc_id: bytes(r.ids) for r in chunk_bpe.encode(docs, PATH, max_broadcast=max_broadcast).collect()} == want


def test_every_chunk_that_occurs_twice_is_shared(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    own = {}
    for r in docs.collect():
        data = (r.text or "").encode()
        raw = np.frombuffer(data, np.uint8)
        cuts = next(iter(chunk_bpe._cuts(raw, np.array([0, len(raw)]))))[1]
        own[r.doc_id] = [data[a:b] for a, b in chunk_bpe._cores(data, cuts)]
    times = Counter(c for cs in own.values() for c in cs)
    want = {d: {c for c in cs if times[c] > 1} for d, cs in own.items()}
    library = dict(zip(times, plain([c.decode() for c in times]), strict=True))
    found = {r.doc_id: {bytes(c[:16]): bytes(c[16:]) for c in r.chunks or []} for r in chunk_bpe.with_chunks(docs, PATH).collect()}
    assert found == {d: {chunk_bpe._digest(c): np.frombuffer(library[c], np.uint32).astype(np.uint16).tobytes() for c in cs} for d, cs in want.items()}
    assert sum(map(len, want.values())) > 40


def test_chunks_have_a_greatest_length():
    for text in ("ab cd ef gh " * 50_000, "x" * 100_000, "é" * 60_000, "one sentence that comes again and again. " * 3_000):
        data = np.frombuffer(text.encode(), np.uint8)
        for _, cuts in chunk_bpe._cuts(data, np.array([0, len(data)])):
            assert cuts[0] == 0 and cuts[-1] == len(data)
            assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= chunk_bpe._MOST_CHUNK
            assert all((data[c] & 0xC0) != 0x80 for c in cuts[:-1])


def test_long_periodic_texts(spark):
    texts = ["ab cd ef gh " * 30_000, "x " + "ab cd ef gh " * 20_000, "x" * 50_000, "é " * 30_000 + "tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [bytes(r.ids) for r in chunk_bpe.encode(docs, PATH).orderBy("doc_id").collect()] == plain(texts)


def test_joins_are_widened_until_they_agree():
    """A core whose ids don't agree with its surroundings isn't used."""
    encode = UnitEncoder(PATH, False).encode
    data = b"one two three four five six seven eight"
    right = encode("three four ")
    assert chunk_bpe.join_ids(data, 0, len(data), [(8, 19, right)], encode) == encode(data.decode())
    assert chunk_bpe.join_ids(data, 0, len(data), [(8, 19, encode("wrong ids "))], encode) == encode(data.decode())


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_encode_as_the_library_does(name, byte_level):
    path = public_tokenizers.path(name)
    texts = [r[1] or "" for r in awkward_rows()] + ["a  b", " a", "a ", "a \nb", "a\n b", "\n\n", "a\n", "\na b\n", "it's  we'll", "x\ty z", "a b", "<|endoftext|> <|endoftext|>b c<|endoftext|>"]
    encoder = UnitEncoder(path, byte_level)
    assert [encoder.encode(t) for t in texts] == plain(texts, path)


def test_empty_table(spark):
    assert chunk_bpe.encode(empty(spark), PATH).count() == 0
