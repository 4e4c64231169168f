import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, awkward_rows, empty, key
from transect.llm import exact_dedup


def brute(rows):
    groups = {}
    for row in rows:
        sha = hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", row[1] or "").encode()).hexdigest()
        groups.setdefault(sha, []).append(row)
    out = []
    for sha, group in groups.items():
        ids = [r[0] for r in group]
        least = min((i for i in ids if i is not None), default=None)
        first = ids.index(least)
        out += [(r[0], least, len(group), k == first, sha) for k, r in enumerate(group)]
    return sorted(out, key=key)


def test_against_brute_force(spark):
    found = exact_dedup.exact_groups(exact_dedup.digests(awkward(spark))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect()), key=key) == brute(awkward_rows())


def test_a_filter_of_several_ranges_changes_nothing(spark):
    assert exact_dedup.filter_size(10_000, 1 / 1024) == (7, 5)
    small = 64 * 8 / (1 << 20)  # 64 words at once, 256 rows' worth
    docs = awkward(spark).union(awkward(spark)).union(awkward(spark)).union(awkward(spark))
    assert exact_dedup.filter_size(docs.count(), small)[1] >= 1
    found = exact_dedup.exact_groups(exact_dedup.digests(docs), small).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect()), key=key) == brute(awkward_rows() * 4)


@pytest.mark.parametrize("max_filter_mb", [256, 1 / 128])
def test_filter_passes_most_unique_rows(spark, max_filter_mb):
    """With a filter of one range, and of eight ranges of 8 KB."""
    hashes = spark.range(20_000).select(F.xxhash64(F.col("id") % 19_000).alias("h"))
    assert exact_dedup.filter_size(20_000, max_filter_mb)[1] == (0 if max_filter_mb == 256 else 3)
    flagged = exact_dedup.maybe_repeated(hashes, "h", 20_000, max_filter_mb)
    assert flagged.count() == 20_000
    flagged = flagged.filter("maybe")
    assert 2_000 <= flagged.count() <= 2_600
    assert flagged.groupBy("h").count().filter("count = 2").count() == 1_000


def test_first_copies_keep_the_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(awkward_rows()) if r[3])


def test_empty_table(spark):
    assert exact_dedup.exact_groups(exact_dedup.digests(empty(spark))).count() == 0
    assert exact_dedup.first_copies(empty(spark)).count() == 0
