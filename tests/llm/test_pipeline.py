"""Every stage of the pipeline, and the chain, against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, awkward_rows, empty, key
from tests.llm.test_chunk_bpe import PATH, plain
from tests.llm.test_exact_dedup import brute as brute_groups
from tests.llm.test_mixing import brute_counts
from tests.llm.test_simhash import brute_components, brute_fingerprint
from transect.llm import toxicity
from transect.llm.common import hash_words
from transect.llm.encoders import load
from transect.llm.queries import remainder

TOXIC = "you stupid idiot, trash and vermin"


def rows_of_test():
    """The awkward rows, and more that labels call toxic."""
    rows = awkward_rows()
    for k in range(200, 240):
        words = f"number {k * 7919 % 1000} of {k * 31 % 97} plain notes".split()
        if k % 2:
            words.insert(k % 4, TOXIC)
        rows.append((k, " ".join(words), "en", f"src{k % 3}", 10, None, None, None))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows_of_test(), awkward(spark).schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 1 if TOXIC in (r[1] or "") else 0) for r in rows_of_test() if r[0] is not None] + [(None, 1, 1), (201, 1, None), (99_999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    empty(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain_score(model, text):
    """One text, word by word: hashes of words and beginnings, those that occur twice again, and a sum of weights."""
    raw = bytes(toxicity._LOWER[np.frombuffer((text or "").encode(), np.uint8)])
    found, begun = set(), Counter()
    space, top = 1 << toxicity._LOG_SPACE, np.uint64(64 - toxicity._LOG_SPACE)
    for word in raw.split():
        one = np.frombuffer(word, np.uint8)
        whole, *parts = (int(h[0]) for h in hash_words(one, np.array([0]), np.array([len(word)]), toxicity._PREFIXES))
        found.add(whole >> int(top))
        for p, h in zip(toxicity._PREFIXES, parts, strict=True):
            if len(word) >= p:
                begun[p, h >> int(top)] += 1
    for (_, feature), n in begun.items():
        found.add(feature)
        for k in toxicity._TIMES:
            if n >= k:
                found.add(int(toxicity.mix(np.array([feature + (k << 32)], np.uint64))[0]) >> int(top))
    assert all(f < space for f in found)
    own = {int(model.column[f]) for f in found} - {-1}
    return 1 / (1 + np.exp(-np.clip(sum(model.weights[w] for w in own) + model.bias, -30, 30)))


def plain_toxic(spark, folder, rows):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels, usable=remainder(4) != 2)
    return [r for r in rows if plain_score(model, r[1]) < 0.3]


def plain_first(rows):
    """Of equal texts the smallest doc_id, of repeated ones of it one."""
    best = {}
    for r in rows:
        text = re.sub("[\x20\x09-\x0d]+", " ", r[1] or "")
        if text not in best or (r[0] is not None and (best[text][0] is None or r[0] < best[text][0])):
            best[text] = r
    return list(best.values())


def plain_one_of_each(rows):
    groups = brute_components([brute_fingerprint(r[1]) for r in rows])
    least = {}
    for r, c in zip(rows, groups, strict=True):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    return [r for r, c in zip(rows, groups, strict=True) if r[0] == least.get(c)]


def plain_tokens(rows):
    ids = plain([r[1] for r in rows])
    texts = load(PATH).decode_batch([np.frombuffer(i, np.uint32).tolist() for i in ids], skip_special_tokens=False)
    return [(r[0], len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for r, i, t in zip(rows, ids, texts, strict=True)]


def same(found, want):
    return sorted(map(tuple, found), key=key) == sorted(want, key=key)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_toxicity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found, want = stage("toxicity")(spark, docs, folder), plain_toxic(spark, folder, rows_of_test())
    assert found.columns == docs.columns and same(found.collect(), want)
    assert 0 < sum(TOXIC in (r[1] or "") for r in rows_of_test()) > 5 * sum(TOXIC in (r[1] or "") for r in want)
    assert sum(TOXIC not in (r[1] or "") for r in rows_of_test()) == sum(TOXIC not in (r[1] or "") for r in want)


def test_exact_dedup(spark, folder):
    found, want = stage("exact dedup")(spark, awkward(spark), folder), plain_first(awkward_rows())
    assert found.columns == awkward(spark).columns
    digest = lambda r: (r[0], re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""))  # noqa: E731  (of texts that differ in white space, of one id, any row stays)
    assert same(map(digest, found.collect()), map(digest, want))
    assert len(want) == sum(r[3] for r in brute_groups(awkward_rows()))


def test_near_dedup(spark, folder):
    found = stage("SimHash near-dedup")(spark, awkward(spark), folder)
    assert found.columns == awkward(spark).columns and same(found.collect(), plain_one_of_each(awkward_rows()))


def test_mixing(spark, folder):
    docs = awkward(spark)
    found = stage("mixing")(spark, docs, folder)
    assert found.columns == docs.columns
    got = found.collect()
    assert Counter((r.doc_id, r.source) for r in got) == brute_counts([(r[0], r[3]) for r in awkward_rows()])
    assert {tuple(r) for r in got} <= set(awkward_rows())


def test_bpe(spark, folder):
    assert same(stage("BPE")(spark, awkward(spark), folder).collect(), plain_tokens(awkward_rows()))


def test_the_chain(spark, folder):
    rows = plain_one_of_each(plain_first(plain_toxic(spark, folder, rows_of_test())))
    times = brute_counts([(r[0], r[3]) for r in rows])
    assert len({(r[0], r[3]) for r in rows}) == len(rows)  # so that counts say which row is repeated
    want = plain_tokens([r for r in rows for _ in range(times[r[0], r[3]])])
    assert same(corpus_pipeline.run(spark, folder).collect(), want)


def test_empty_tables(spark, nothing):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty(spark), nothing).count() == 0, name
    assert corpus_pipeline.run(spark, nothing).count() == 0
