"""Which terms mark a source among the documents of its language, and how far the sources of a language are from each other.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that are in at least
``least_docs`` of its documents. A group (lang, source) gives a kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), the language
likewise q; f(p, q) = floor((p - q)^2 / (p + q)), all in integers.

Terms of a group: its counts are put in buckets, and a bucket's greatest p and least q bound f for all terms in it, since f grows
as they part. The buckets of greatest bound are evaluated first, twice as many in each round, and a group is done when the bounds
left are strictly below its k-th value; ties with it are still evaluated.

Pairs of groups: a term that neither has adds the same value for all such terms, and one that only one of them has adds a value
of its count alone, so only the terms that both have are met, by a join of the postings on the term. With 0 marking the p of no
occurrence, and sums over a group's own postings worked out by equal p,

    sum f(p, p') = sum over common terms of (f(p, p') - f(p, 0') - f(0, p') + f(0, 0'))
                 + sum over own terms of f(p, 0') + the same of the other + (V - own - other's) f(0, 0').

Null text, lang and source are ''. A row is a document, whatever its doc_id. A group without terms has counts of 0; a language without
kept terms gives pairs of value 0 and no terms. Columns other than the three are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, with_few

MAX_BROADCAST_ROWS = 1_000_000  # rows of two names and a few numbers
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP = ["lang", "source"]


def ascii_lower(text: Column) -> Column:
    """A-Z alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def apart(p: str, q: str) -> Column:
    """f of two columns of whole numbers up to 10^9 + 1."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def probability(count: str, n: str, v: str) -> Column:
    """p of a count; exact for counts beyond those whose 10^9-fold is a long."""
    return F.expr(
        f"CASE WHEN {count} < 9000000000 THEN 1 + 1000000000 * ({count} + 2) div ({n} + 2 * {v})"
        f" ELSE 1 + CAST(CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0)) div CAST({n} + 2 * {v} AS DECIMAL(20, 0)) AS BIGINT) END"
    )


def postings(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, source, term, c, lc, first): counts of kept terms in a group and in the language; ``first`` is 1 in one row of each term."""
    terms = F.sort_array(F.split(ascii_lower(F.col("text")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"))
    # outer, or else a filter on the array's size comes before, and it is worked out twice
    each = docs.select("lang", "source", terms.alias("terms")).select("lang", "source", "terms", F.posexplode_outer("terms").alias("i", "term")).filter("term <> ''")
    # equal terms of a document stand together, so the first of them counts it
    new = F.when((F.col("i") == 0) | (F.get("terms", F.col("i") - 1) != F.col("term")), 1).otherwise(0)
    counts = each.groupBy(*_GROUP, "term").agg(F.count("*").alias("c"), F.sum(new).alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    told = counts.withColumn("lc", F.sum("c").over(of_term)).withColumn("ld", F.sum("docs").over(of_term))
    first = (F.col("source") == F.min("source").over(of_term)).cast("int")
    return told.withColumn("first", first).filter(F.col("ld") >= least_docs).select(*_GROUP, "term", "c", "lc", "first")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, own, v, p0): of all groups that occur, their sum of counts and number of terms; those kept by the language; p of no occurrence."""
    own = kept.groupBy(*_GROUP).agg(F.sum("c").alias("n"), F.count("*").alias("own"), F.sum("first").alias("firsts"))
    of_lang = Window.partitionBy("lang")  # a row for each source
    groups = docs.select(*_GROUP).distinct().join(own, _GROUP, "left").fillna(0, ["n", "own", "firsts"])
    groups = groups.withColumn("v", F.sum("firsts").over(of_lang)).withColumn("ln", F.sum("n").over(of_lang)).drop("firsts")
    return groups.withColumn("zero", F.lit(0).cast("long")).withColumn("p0", F.when(F.col("v") > 0, probability("zero", "n", "v"))).drop("zero")


def weighed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings with p, q and p0."""
    named = groups.select(*[F.col(c).alias(f"g_{c}") for c in _GROUP], "n", "v", "ln", "p0")
    few = named.select(F.struct("g_lang", "g_source").alias("group"), "n", "v", "ln", "p0")
    told = with_few(kept.withColumn("group", F.struct(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"))), few, "group", MAX_BROADCAST_ROWS)
    return told.select(*_GROUP, "term", "c", probability("c", "n", "v").alias("p"), probability("lc", "ln", "v").alias("q"), "p0")


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, in both directions."""
    mine = rows.select("lang", "term", F.col("source").alias("s1"), F.col("p").alias("p1"), F.col("p0").alias("z1"))
    other = rows.select(F.col("lang").alias("lang2"), F.col("term").alias("term2"), F.col("source").alias("s2"), F.col("p").alias("p2"), F.col("p0").alias("z2"))
    met = mine.join(other, (F.col("lang") == F.col("lang2")) & (F.col("term") == F.col("term2")) & (F.col("s1") < F.col("s2")))
    common = met.groupBy("lang", "s1", "s2").agg(F.sum(apart("p1", "p2") - apart("p1", "z2") - apart("z1", "p2") + apart("z1", "z2")).alias("value"))

    few = groups.select(F.col("lang").alias("lang2"), F.col("source").alias("s2"), F.col("p0").alias("z2"), F.col("own").alias("own2")).checkpoint()
    few = F.broadcast(few) if few.count() <= MAX_BROADCAST_ROWS else few
    in_order = [F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")]
    equal = rows.groupBy("lang", F.col("source").alias("s1"), F.col("p").alias("p1")).agg(F.count("*").alias("times"))
    others = (F.col("lang") == F.col("lang2")) & (F.col("s1") != F.col("s2"))
    alone = equal.join(few, others).groupBy("lang", "s1", "s2").agg(F.sum(F.col("times") * apart("p1", "z2")).alias("value")).select("lang", *in_order, "value")

    whole = groups.select("lang", F.col("source").alias("s1"), F.col("p0").alias("z1"), F.col("own").alias("own1"), "v")
    neither = whole.join(few, (F.col("lang") == F.col("lang2")) & (F.col("s1") < F.col("s2")))
    neither = neither.select("lang", "s1", "s2", F.coalesce((F.col("v") - F.col("own1") - F.col("own2")) * apart("z1", "z2"), F.lit(0)).cast("long").alias("value"))
    total = common.unionByName(alone).unionByName(neither).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))
    return total.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def marking_terms(rows: DataFrame, k: int = 10) -> DataFrame:
    """(lang, source, item, value): of each group, the k terms of greatest f among those with p > q; equal ones by the term."""
    rows = rows.withColumn("bucket", F.floor(F.log2("c") * 4).cast("int"))
    bounds = rows.groupBy(*_GROUP, "bucket").agg(F.max("p").alias("most"), F.min("q").alias("least")).filter("most > least")
    down = Window.partitionBy(*_GROUP).orderBy(F.col("bound").desc(), "bucket")  # some hundred buckets
    left = bounds.withColumn("bound", apart("most", "least")).withColumn("nth", F.row_number().over(down)).select(F.struct(*_GROUP, "bucket").alias("key"), "bound", "nth").checkpoint()
    best, done, step = None, 0, 4
    keyed = rows.filter("p > q").select(F.struct(*_GROUP, "bucket").alias("key"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    first = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    while True:
        found = with_few(keyed, left.filter(F.col("nth") <= done + step).select("key"), "key", MAX_BROADCAST_ROWS).select("key.lang", "key.source", "item", "value")
        found = found if best is None else best.unionByName(found)
        best = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank").checkpoint()
        kth = best.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.when(F.count("*") >= k, F.min("value")).alias("kth"))
        rest = left.filter(F.col("nth") > done + step).join(kth, (F.col("key.lang") == F.col("l")) & (F.col("key.source") == F.col("s")), "left")
        left = rest.filter("kth IS NULL OR bound >= kth").select("key", "bound", "nth").checkpoint()
        if left.isEmpty():
            return best
        done, step = done + step, step * 2


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", k: int = 10, least_docs: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all) and ``term`` (to rank k), by descending value, then item."""
    prepare(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    kept = postings(docs, least_docs).checkpoint()
    groups = group_sizes(docs, kept).checkpoint()
    rows = weighed(kept, groups)
    parts = pair_values(rows, groups).withColumn("part", F.lit("pair")).unionByName(marking_terms(rows, k).withColumn("part", F.lit("term")))
    nth = F.row_number().over(Window.partitionBy(*_GROUP, "part").orderBy(F.col("value").desc(), "item"))  # sources of a language, or k
    return parts.select("lang", "source", "part", "item", "value", nth.alias("rank"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(lc)::BIGINT AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(c)::BIGINT AS n FROM c GROUP BY lang, source),
g AS (SELECT o.lang, o.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN s ON o.lang = s.lang AND o.source = s.source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (n + 2 * v) AS p, 1 + 1000000000 * (lc + 2) // (ln + 2 * v) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM x WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
