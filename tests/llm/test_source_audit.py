from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, empty
from transect.llm import source_audit

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows, k, least):
    """(text, lang, source) rows; every pair and term, one after the other."""
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [t for t in regex.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER))) if t]
        groups.add((lang or "", source or ""))
        found[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for a, s in groups if a == lang)
        whole = sum((found[lang, s] for s in sources), Counter())
        v = len(kept)

        def p(counts, kept=kept, v=v):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(found[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(ps[s][t], q[t]), t.encode(), t) for t in kept if found[lang, s][t] > 0 and ps[s][t] > q[t])[:k]
            out += [(lang, s, part, item, -value, rank) for part, got in (("pair", pairs), ("term", terms)) for rank, (value, _, item) in enumerate(got, 1)]
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least", [1, 3, 10, 1000])
def test_awkward_rows(spark, least):
    df = awkward(spark).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "en").otherwise(""))
    assert shown(source_audit.audit(df, least_docs=least)) == plain([(r.text, r.lang, r.source) for r in df.collect()], 10, least)


def test_many_ties_and_a_hot_source(spark):
    """Equal values over many buckets, one source with most rows, sources without terms, k larger and smaller than what there is."""
    rows = [(" ".join(f"t{chr(97 + (i * j) % 26)}{chr(97 + j % 7)}" for j in range(i % 40)), "xx", "hot" if i % 3 else f"s{i % 11}") for i in range(400)]
    rows += [("..., 12 34", "xx", "wordless"), (None, "xx", "silent"), ("alone", "yy", "only")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for k in (1, 10, 500):
        assert shown(source_audit.audit(df, k=k, least_docs=2)) == plain(rows, k, 2)


def test_empty(spark):
    df = source_audit.audit(empty(spark))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and df.count() == 0


def test_large_counts_are_exact(spark):
    counts = [0, 8_999_999_999, 9_000_000_000, 123_456_789_012_345]
    df = spark.createDataFrame([(c, 987_654_321_098_765_432, 5) for c in counts], "c long, n long, v long")
    got = [r.p for r in df.select("c", source_audit.probability("c", "n", "v").alias("p")).orderBy("c").collect()]
    assert got == [1 + 1_000_000_000 * (c + 2) // (987_654_321_098_765_432 + 10) for c in counts]
