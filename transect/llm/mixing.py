"""Mixing sources to target weights by Poisson replication.

A source's target rate is (target weight x all rows / its rows): the mean number of copies of its documents.
Each document inverts the Poisson distribution of that mean at a uniform number hashed from seed and doc_id, so
the count is the same on every run and machine. Means above ``PART`` are split into equal parts, each with a
hashed number of its own, as a sum of Poisson numbers is one. Documents are exploded by their counts, and the
copies are dealt out by a hash and sorted by it: one uniformly random order over all partitions, without ranges
to sample or rows to gather.

The per-source table (a row of under 1 KB for each source) is broadcast while it takes ``MAX_BROADCAST_MB`` at most, so that texts
are shuffled once, by the order of the copies. Beyond that, counts are drawn for pairs of doc_id and source alone, joined
by source (pairs are small, and adaptive execution splits a hot source), and go to the documents by doc_id.
Repeated rows of one doc_id get equal counts; a null source is a source of its own; null ids hash as the text "null";
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

SEED = 17
PART = 16.0
MAX_BROADCAST_MB = 64
TERMS = 80  # P(X > 80) is below 1e-28 at mean 16
_FRESH = ("rate", "copies", "copy", "shuffle_key")


def uniform(*what: Column) -> Column:
    """52 bits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *what)), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate, parts, cdf): without weights, all sources weigh the same."""
    counts = docs.groupBy(F.col(source).alias("of")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    if weights is None:
        rate = F.col("total").cast("double") / (F.col("sources").cast("double") * F.col("n"))
    else:
        whole = float(sum(weights.values()))
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("of")] if weights else F.lit(None), F.lit(0.0))
        rate = share / F.lit(whole or 1.0) * F.col("total") / F.col("n")
    rated = counts.crossJoin(F.broadcast(total)).select("of", rate.alias("rate"))  # total is one row
    rated = rated.withColumn("parts", F.ceil(F.col("rate") / F.lit(PART)).cast("int")).withColumn("mean", F.col("rate") / F.greatest("parts", F.lit(1)))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda acc, k: F.struct((acc.p * F.col("mean") / k).alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * F.col("mean") / k)).alias("cdf")),
        lambda acc: acc.cdf,
    )
    return rated.select("of", "rate", "parts", grown.alias("cdf"))


def _drawn(key: Column, seed: int) -> Column:
    """The copies of a row with its source's parts and cdf."""
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter(F.col("cdf"), lambda c: uniform(F.lit(seed), key, j) > c)),
    )
    return F.when(F.col("parts") > 0, drawn).otherwise(0)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", max_broadcast_mb: float = MAX_BROADCAST_MB) -> DataFrame:
    """docs repeated by their Poisson counts in one random order, with rate, copies, copy (from 1) and shuffle_key.

    Columns of these names that docs had before are replaced.
    """
    prepare(docs.sparkSession)
    rated = rates(docs, source, weights).checkpoint()
    mb = rated.agg(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 8 * (TERMS + 8))).first()[0] or 0
    key = F.coalesce(F.col(f"doc.`{doc_id}`").cast("string"), F.lit("null"))
    rows, of = docs.select(F.struct("*").alias("doc")), F.col(f"doc.`{source}`")
    if mb <= max_broadcast_mb * (1 << 20):
        dealt = rows.join(F.broadcast(rated), of.eqNullSafe(F.col("of"))).withColumn("copies", _drawn(key, seed))
    else:
        pairs = rows.select(key.alias("_key"), of.alias("_source")).distinct().join(rated.hint("merge"), F.col("_source").eqNullSafe(F.col("of")))
        counted = pairs.select("_key", "_source", "rate", _drawn(F.col("_key"), seed).alias("copies")).filter("copies > 0")
        dealt = rows.join(counted.hint("merge"), (key == F.col("_key")) & of.eqNullSafe(F.col("_source")))
    dealt = dealt.filter("copies > 0").select("doc", "rate", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = dealt.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), key, "copy")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in _FRESH], *_FRESH)


ORACLE_SQL = f"""
WITH n AS (SELECT source AS of, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, count(*) AS sources FROM n),
r AS (SELECT of, total::DOUBLE / (sources::DOUBLE * n) AS rate FROM n, t),
p AS (SELECT *, ceil(rate / {PART})::INT AS parts, rate / greatest(ceil(rate / {PART})::INT, 1) AS mean FROM r),
c AS (SELECT of, rate, parts, k, sum(exp(-mean + CASE WHEN k = 0 THEN 0 ELSE k * ln(mean) - lgamma(k + 1) END)) OVER (PARTITION BY of ORDER BY k) AS cdf
      FROM p, range(0, {TERMS + 1}) AS q(k)),
u AS (SELECT d.doc_id, d.source, p.rate, p.parts, j,
             ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.of, range(1, p.parts + 1) AS q(j)),
k AS (SELECT u.doc_id, u.rate, count(*) FILTER (WHERE u.u > c.cdf)::INT AS copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.of GROUP BY u.doc_id, u.rate)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k.rate, k.copies, i::INT AS copy,
       md5('{SEED}|order|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i) AS shuffle_key
FROM documents d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id, range(1, k.copies + 1) AS q(i)
"""
