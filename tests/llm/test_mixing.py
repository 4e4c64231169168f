import hashlib
import math
from collections import Counter

import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from transect.llm import mixing


def brute_counts(rows, seed=mixing.SEED):
    """Counts of (doc_id, source), by inversion of the Poisson distribution in plain Python."""
    sizes = Counter(s for _, s in rows)
    out = Counter()
    for d, s in rows:
        rate = len(rows) / (len(sizes) * sizes[s])
        parts = math.ceil(rate / mixing.PART)
        key = "null" if d is None else str(d)
        n = 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}|{key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            mean, k = rate / parts, 0
            p = total = math.exp(-mean)
            while u > total:
                k += 1
                p *= mean / k
                total += p
            n += k
        out[d, s] += n
    return +out


@pytest.mark.parametrize("max_broadcast_mb", [64, 0])
def test_against_inversion_in_python(spark, max_broadcast_mb):
    rows = [(r[0], r[3]) for r in awkward_rows()]
    found = Counter((r.doc_id, r.source) for r in mixing.mix_sources(awkward(spark), max_broadcast_mb=max_broadcast_mb).collect())
    assert found == brute_counts(rows)


def test_texts_are_shuffled_once(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_names_of_before_are_replaced(spark):
    out = mixing.mix_sources(awkward(spark))
    assert sorted(out.columns) == sorted({*awkward(spark).columns, "rate", "copies", "copy", "shuffle_key"})
    assert all(1 <= r.copy <= r.copies for r in out.collect())


def test_shares_meet_the_weights(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'b' WHEN id % 1000 = 9 THEN 'rare' ELSE 'c' END AS source")
    weights = {"hot": 1.0, "b": 1.0, "c": 1.0, "rare": 1.0}
    got = Counter(r.source for r in mixing.mix_sources(docs, weights).collect())
    assert all(abs(got[s] - 7_500) < 5 * math.sqrt(7_500) for s in weights)
    assert set(r.source for r in mixing.mix_sources(docs, {"b": 1.0}).collect()) == {"b"}


def test_the_order_is_random_and_repeatable(spark):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "'s' AS source")
    a, b = ([r.doc_id for r in mixing.mix_sources(docs.repartition(n)).collect()] for n in (2, 5))
    assert a == b
    mean = sum(x < y for x, y in zip(a, a[1:], strict=False)) / len(a)
    assert 0.45 < mean < 0.55


def test_empty_table(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
