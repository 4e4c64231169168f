import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from tests.llm.helpers import awkward, awkward_rows, empty
from transect.llm import lexical_search

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def plain(docs, items, k=10):
    """(doc_id, text) and (item_id, text): every document scored for every item."""
    found = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    found = [f for f in found if f[2]]
    n, total, df = len(found), sum(f[2] for f in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, tf, length in found:
            m = 25 + (75 * length * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, r in Counter(terms(text)).items() if tf[t])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "one two words"), (2, "alpha BETA beta beta, x10 été"), (3, None), (4, ""), (5, "nothing-known zzzz"), (5, "extra tail end THE"), (None, "日本 ниже straße Σίσυφος ΣΑΣ"), (7, "alpha " * 50 + "gamma")]


@pytest.mark.parametrize("block_terms", [1, 12, 1 << 18])
def test_awkward_rows(spark, block_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_search.search(awkward(spark), items, block_terms=block_terms)
    assert shown(got) == plain([(r[0], r[1]) for r in awkward_rows()], ITEMS)


def test_many_equal_documents(spark):
    """More documents of one score than places, over many partitions: the smallest ids get them."""
    rng = random.Random(5)
    docs = [(k, "common phrase of copies") for k in rng.sample(range(10_000), 300)] + [(20_000 + k, f"common word{k % 9} filler{k}") for k in range(300)]
    items = [(k, f"phrase common word{k} filler{k} filler{k + 1}") for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    for k in (1, 3, 10):
        assert shown(lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"), k=k)) == plain(docs, items, k)


def test_random_vocabularies(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 200)))) for k in range(900)]
    items = [(k, " ".join(rng.choices(words, weights, k=30))) for k in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert shown(lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_pruning_is_safe_and_prunes():
    """Against all bounds: pruned terms add up to less than the threshold, and with one more of them would not."""
    rng = np.random.default_rng(3)
    block = lexical_search.Block(list(range(20)), [rng.integers(0, 60, 25).astype(np.uint64) for _ in range(20)])
    most = rng.integers(0, 1000, len(block.hashes))
    plan = lexical_search.Plan(block, most // 2, most)
    at, gone, repeats = plan.pruned
    assert len(gone)
    for item in range(20):
        own = slice(at[item], at[item + 1])
        assert (repeats[own] * most[gone[own]]).sum() == plan.rest[item] < max(plan.threshold[item], 1)
        kept = [r * most[t] for t in range(len(block.hashes)) for e in range(plan.essential[0][t], plan.essential[0][t + 1]) if plan.essential[1][e] == item for r in [plan.essential[2][e]]]
        assert not kept or plan.rest[item] + min(kept) >= plan.threshold[item]


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(empty(spark), items).count() == 0
    assert lexical_search.search(awkward(spark), items.limit(0)).count() == 0
