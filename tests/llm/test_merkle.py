import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.helpers import awkward, awkward_rows, empty
from transect.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_root(text):
    return sha(",".join(sha(",".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def expected(rows):
    """By distinct (doc_id, text): n_chars, the edited text's digest, and the roots of both."""
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = {}
    for k, (d, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        out[d, t] = (len(t), sha(edited), brute_root(t), brute_root(edited))
    return out


def checked(df, rows, want):
    found = df.collect()
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint[:64], r.edited_fingerprint[:64]) for r in found) == sorted((str(d), *want[d, t or ""]) for d, t in rows)
    return found


def test_awkward_rows(spark):
    # two texts under one id follow each other in the order of their hashes, which isn't repeated here
    rows = [r[:2] for r in awkward_rows() if r[0] not in (3, None)] + [(None, "no id")]
    docs = awkward(spark).filter("doc_id <> 3").unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), True)
    found = checked(merkle.compared_with_edits(docs), rows, expected(rows))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_ties_of_ids_have_a_row_each(spark):
    assert merkle.compared_with_edits(awkward(spark)).count() == len(awkward_rows())


def test_driver_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = checked(merkle.compared_with_edits(docs), rows, expected(rows))
    texts = dict(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for fs in by_text.values() for f in fs}) == len(by_text)
    long = [r for r in found if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_one_row_follows_itself(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = merkle.compared_with_edits(one).first()
    assert r.edited_sha256 == sha("abcabc")
    assert r.near_next == 1.0


def test_branches_locate_edits(spark):
    a = "one\ntwo\nthree\n\nfour\nfive\n\nsix"
    pairs = [(a, a), (a, a.replace("five", "5")), (a, a + "\nseven"), (a, "one\ntwo\nthree"), (a, "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(merkle.differing_sections(F.col("a"), F.col("b")).alias("s"), merkle.differing_paragraphs(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.s for r in rows] == [[], [1], [2], [1, 2], [0, 1, 2]]
    assert [(x.section, x.paragraphs) for x in rows[1].p] == [(1, [1])]
    assert [(x.section, x.paragraphs) for x in rows[2].p] == [(2, [1])]


def test_insertions_are_located(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    pairs = [("new\n\n" + a, [0], [(0, [0])]), (a.replace("three", "new\nthree"), [1], [(1, [0])]), ("three\nfour\n\none\ntwo\n\nfive", [0, 1], None), (a.replace("one", "1").replace("five", "5"), [0, 2], [(0, [0]), (2, [0])]), (a + "\n\nfive", [3], [(3, [0])])]
    df = spark.createDataFrame([(a, b) for b, *_ in pairs], "a string, b string")
    rows = df.select(merkle.differing_sections(F.col("a"), F.col("b")).alias("s"), merkle.differing_paragraphs(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.s for r in rows] == [s for _, s, _ in pairs]
    assert all(p is None or [(x.section, x.paragraphs) for x in r.p] == p for r, (_, _, p) in zip(rows, pairs, strict=True))


def test_clauses_of_short_and_plain_texts(spark):
    rng = random.Random(2)
    plain = " ".join("".join(rng.choice("abcdefghi") for _ in range(6)) for _ in range(40))
    wide = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(200))
    texts = ["A short line.", "abc abc def ghi", plain, wide, "a" * 99, plain[:60], wide[:20]]
    pairs = [(t, t[: len(t) - len(t) // 2] + "~" * (len(t) // 2), t[:50] + "ab" + t[50:]) for t in texts]
    tree = lambda c: merkle.leaves(merkle.leaf_tree(F.col(c)))
    rows = spark.createDataFrame(pairs, "a string, b string, c string").select(merkle.likeness(tree("a"), tree("b")).alias("half"), merkle.likeness(tree("a"), tree("c")).alias("more"), F.size(tree("a")).alias("n")).collect()
    assert all(r.half > 0 for r in rows)
    assert all(r.n >= len(t) / 32 for r, t in zip(rows, texts, strict=True))
    assert rows[3].more > 0.8


def test_no_python_in_the_plan(spark, smallest):
    df = merkle.compared_with_edits(spark.read.parquet(f"{smallest}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_are_shuffled_once(spark, small):
    df = merkle.compared_with_edits(spark.read.parquet(f"{small}/documents.parquet"))
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    assert merkle.compared_with_edits(empty(spark)).count() == 0
    assert merkle.trees(empty(spark)).count() == 0


def test_any_number_is_an_id(spark):
    rows = [(-(1 << 63), "the least number has this text"), (None, "the least number has this text"), ((1 << 63) - 1, "the greatest one"), (0, "zero")]
    found = merkle.compared_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(r[0]) for r in rows)
