"""The registered corpus queries as they are, on the smallest tables: against their SQL, the library, or plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tests.llm.test_chunk_bpe import plain
from tests.llm.test_html_blocks import article
from tests.llm.test_pipeline import plain_score
from tests.llm.test_simhash import expected
from transect.llm import quality_rules, queries, toxicity
from transect.llm.encoders import load


@pytest.fixture(scope="module")
def documents(spark, smallest):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{smallest}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, smallest, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{smallest}/{table}.parquet'")
    df = queries.queries()[name](spark, smallest)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda v: f"{v:.12g}" if isinstance(v, float) else v
    want = Counter(tuple(show(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cursor.fetchall())
    assert Counter(tuple(show(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_op1(spark, smallest, documents):
    usable = queries.remainder(4) != 2
    docs, labels = spark.read.parquet(f"{smallest}/documents.parquet"), spark.read.parquet(f"{smallest}/labels.parquet")
    model = toxicity.train(docs, labels, usable=usable)
    found = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op1_toxicity(spark, smallest).collect()}
    assert len(found) == len(documents)
    for d, text in documents:
        held_out, score, predicted = found[d]
        assert held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and predicted == int(score >= 0.3)
        assert score == pytest.approx(plain_score(model, text), abs=1e-9)


def test_op2(spark, smallest, documents):
    start = 0
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, smallest).collect()}
    for (d, _), ids in zip(documents, plain([t for _, t in documents], public_tokenizers.path("byte_bpe_50k.json")), strict=True):
        ids += np.uint32(2).tobytes()
        assert found[d] == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_op3(spark, smallest, documents):
    found = [(str(r.doc_id), int(r.fingerprint, 16), str(r.component_id)) for r in queries.op3_simhash(spark, smallest).collect()]
    assert sorted(found) == expected(documents)


def test_op4(spark, smallest):
    pages = {r.page_id: r for r in spark.read.parquet(f"{smallest}/pages.parquet").collect()}
    found = queries.op4_html_blocks(spark, smallest).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in found)
    assert [r.page_id for r in found if r.text != article(pages[r.page_id].html)] == []


def test_op5(spark, smallest, documents):
    tokenizer = load(queries.WORD_BPE)
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_chunk_bpe(spark, smallest).collect()}
    for (d, _), ids in zip(documents, plain([t for _, t in documents]), strict=True):
        text = tokenizer.decode(np.frombuffer(ids, np.uint32).tolist(), skip_special_tokens=False)
        assert found[d] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op6(spark, smallest, documents):
    docs, labels = spark.read.parquet(f"{smallest}/documents.parquet"), spark.read.parquet(f"{smallest}/labels.parquet")
    model = quality_rules.train(docs, labels, usable=queries.remainder(3) != 1)
    found = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op6_quality(spark, smallest).collect()}
    rows = np.array([plain_statistics(t) for _, t in documents])
    for (d, _), score in zip(documents, model.score_rows(rows), strict=True):
        assert found[d][0] == (zlib.crc32(str(d).encode()) % 3 == 1) and found[d][2] == int(found[d][1] >= 0.5)
        assert found[d][1] == pytest.approx(score, abs=1e-9)


def plain_statistics(text):
    import regex

    text = text or ""
    n, words, lines = max(len(text), 1), re.findall("[^\x20\x09-\x0d]+", text), text.split("\n")
    share = lambda pattern: len(regex.findall(pattern, text)) / n
    return [
        np.log1p(len(text)), len(text) / max(len(words), 1), len(set(words)) / max(len(words), 1), len(set(lines)) / len(lines), len(text) / len(lines),
        share(r"[^\p{L}\p{N}\s]") if text.isascii() else len(regex.findall(r"[^\p{L}\p{N} \t\n\x0b\f\r]", text)) / n, share(r"\p{Lu}"), share(r"\p{N}"),
        *[text.count(c) / n for c in "|!.,"],
    ]


def test_op10(spark, smallest, documents):
    found = {r.doc_id: r for r in queries.op10_merkle(spark, smallest).collect()}
    leaves = lambda f: set(re.findall("[0-9A-Fa-f]{8}", f[64:].replace("/", " ").replace(".", " ")))
    like = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    down = documents[::-1]
    for (d, text), (e, other) in zip(down, [*down[1:], down[0]], strict=True):
        text, other, r = text or "", other or "", found[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(leaves(r.fingerprint), leaves(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(like(leaves(r.fingerprint), leaves(found[e].fingerprint)))
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
