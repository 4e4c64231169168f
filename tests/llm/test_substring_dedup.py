import re

import pytest

from tests.llm.helpers import awkward, awkward_rows, empty, key
from transect.llm import substring_dedup as sd


def brute(rows, size=13):
    last = 1 << 63
    texts = [(last if r[0] is None else r[0], re.findall("[^\x20\x09-\x0d]+", r[1] or ""), r[0]) for r in rows]
    least = {}
    for d, words, _ in texts:
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            least[w] = min(d, least.get(w, d))
    out = []
    for d, words, own in texts:
        gone = {i + k for i in range(len(words) - size + 1) if least[tuple(words[i : i + size])] < d for k in range(size)}
        out.append((own, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=key)


@pytest.mark.parametrize("size", [13, 2, 5, 8, 26, 30, 52])
def test_against_brute_force(spark, size):
    found = sd.remove_repeats(awkward(spark), size=size)
    assert sorted(map(tuple, found.collect()), key=key) == brute(awkward_rows(), size)


@pytest.mark.parametrize(("flush", "size"), [(1, 13), (3_000, 13), (1, 26), (3_000, 52)])
def test_driver_documents_in_small_chunks(spark, smallest, flush, size, monkeypatch):
    monkeypatch.setattr(sd, "_FLUSH", flush)
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text").repartition(5)
    assert sorted(map(tuple, sd.remove_repeats(docs, size=size).collect()), key=key) == brute([tuple(r) for r in docs.collect()], size)


def test_with_too_many_candidates_to_broadcast(spark):
    assert sorted(map(tuple, sd.remove_repeats(awkward(spark), max_broadcast=1).collect()), key=key) == brute(awkward_rows())


def test_levels():
    assert [sd.level_lengths(n) for n in (2, 5, 8, 13, 26, 52)] == [[1, 2], [3, 5], [4, 8], [7, 13], [7, 13, 26], [7, 13, 26, 52]]


def test_texts_are_shuffled_once(spark, smallest):
    found = sd.remove_repeats(spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("ReusedExchange" in line and "text#" in line for line in plan.split("\n")) == 1


def test_levels_end_at_the_longest_repeat(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(60))), (2, "x " + " ".join(f"w{k}" for k in range(5, 45)) + " y"), (3, "nothing of the kind")]
    found = {(r.doc_id, r.first): r.words for r in sd.repeat_levels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(2, 1 + k): 26 if k + 26 <= 40 else 13 for k in range(28)}
    assert found == want


def test_empty_table(spark):
    assert sd.remove_repeats(empty(spark)).count() == 0
    assert sd.repeat_levels(empty(spark)).count() == 0
