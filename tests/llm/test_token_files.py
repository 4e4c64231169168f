import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, awkward_rows, empty
from tests.llm.test_chunk_bpe import plain
from transect.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, tmp_path):
    folder = f"{tmp_path}/tokens"
    token_files.write_tokens(awkward(spark), folder, PATH)
    found = token_files.read_tokens(spark, folder).collect()
    rows = awkward_rows()
    want = [(r[0], i + np.uint32(2).tobytes()) for r, i in zip(rows, plain([r[1] for r in rows], PATH), strict=True)]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in found) == sorted((str(d), i) for d, i in want)
    found.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found]).tolist()[:-1]]
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    for d in (0, 3, 25, 10_000):
        assert sorted(np.array(x, np.uint32).tobytes() for x in token_files.read_document(spark, folder, d)) == sorted(i for e, i in want if e == d)


def test_driver_documents(spark, smallest, tmp_path):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    token_files.write_tokens(docs, f"{tmp_path}/t", PATH)
    found = {r.doc_id: (r.start, r.n_tokens, r.crc) for r in token_files.read_tokens(spark, f"{tmp_path}/t").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()}
    want, start = {}, 0
    rows = sorted(docs.select("doc_id", "text").collect())
    for r, ids in zip(rows, plain([r.text for r in rows], PATH), strict=True):
        ids += np.uint32(2).tobytes()
        want[r.doc_id] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert found == want


def test_wrong_dictionary_is_refused(spark, smallest, tmp_path):
    docs = spark.read.parquet(f"{smallest}/documents.parquet").limit(20)
    token_files.write_tokens(docs, f"{tmp_path}/a", PATH)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "dictionary_sha256 string, dictionary binary").write.mode("overwrite").parquet(f"{tmp_path}/a/dictionary")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.read_tokens(spark, f"{tmp_path}/a")


def test_any_number_is_an_id(spark, tmp_path):
    rows = [(-(1 << 63), "least"), ((1 << 63) - 1, "greatest"), (0, "zero"), (None, "none"), (None, None)]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/n", PATH)
    found = token_files.read_tokens(spark, f"{tmp_path}/n").orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, -(1 << 63), 0, (1 << 63) - 1]
    assert [len(token_files.read_document(spark, f"{tmp_path}/n", d)) for d in (-(1 << 63), 0, (1 << 63) - 1, 5)] == [1, 1, 1, 0]


def test_empty_table(spark, tmp_path):
    token_files.write_tokens(empty(spark), f"{tmp_path}/e", PATH)
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0
