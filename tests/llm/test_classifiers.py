import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, empty
from transect.llm import quality_rules, queries, toxicity

MEDIUM = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    scored = query(spark, MEDIUM).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()
    score, predicted, truth = (np.array(x, float) for x in zip(*rows, strict=True))
    assert ((score >= 0) & (score <= 1)).all()
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(len(score))
    ones = truth == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())
    return auc, (predicted[ones]).mean(), (predicted[~ones]).mean()


def test_toxicity_on_held_out_rows(spark):
    auc, found, wrong = held_out(spark, queries.op1_toxicity, "toxic")
    assert auc > 0.95
    assert found > 0.8
    assert wrong < 0.05


def test_quality_on_held_out_rows(spark):
    auc, found, wrong = held_out(spark, queries.op6_quality, "quality")
    assert auc > 0.98
    assert found > 0.98
    assert wrong < 0.1


def test_risk_is_kept_from_going_negative():
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.random((50, 400)) < 0.5, rng.random((60, 400)) < 0.5
    weights, bias = toxicity.nn_pu(positive.astype(np.uint8), unlabelled.astype(np.uint8), 0.3)
    z = lambda x: x @ weights + bias
    negative = np.logaddexp(0, z(unlabelled)).mean() - 0.3 * np.logaddexp(0, z(positive)).mean()
    assert negative > -0.2


def test_rules_compile_to_what_they_say(spark):
    docs = awkward(spark)
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", F.when(F.length("text") > 100, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    model = quality_rules.train(docs, labels)
    assert model.rules
    stats = quality_rules.statistics(F.col("text"))
    x = np.array([[r[n] for n in quality_rules.NAMES] for r in docs.select(*[stats[n].cast("double").alias(n) for n in quality_rules.NAMES]).collect()])
    got = sorted(r.score for r in quality_rules.score(docs, model).collect())
    assert np.allclose(got, np.sort(model.score_rows(x)))


@pytest.mark.parametrize("value", [None, 0, 1])
def test_one_class_or_no_label(spark, value):
    docs = awkward(spark)
    labels = docs.select("doc_id", F.lit(value).cast("int").alias("toxic"), F.lit(value).cast("int").alias("quality"))
    for scored in (toxicity.score(docs, toxicity.train(docs, labels)), quality_rules.score(docs, quality_rules.train(docs, labels))):
        rows = scored.collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 for r in rows)


def test_empty_table(spark):
    none = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality_rules.score(none, quality_rules.train(none, labels)).count() == 0
    assert toxicity.reject_toxic(none, labels).count() == 0


def test_rejecting_keeps_columns_and_clean_rows(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
