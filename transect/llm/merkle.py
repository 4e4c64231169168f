"""Merkle fingerprints of documents, in DataFrame expressions alone.

A text is split into sections at blank lines, these into paragraphs at line ends, and these into clauses after spaces
that follow a character other than a-s and after certain characters, also of scripts without spaces: such cuts depend on
the text near them alone. Where none comes within 32 characters (4 for a paragraph's first clause), one is made there, so
that a short or plain text has leaves in its unchanged part too. Leaves are 32-bit hashes of clauses; a paragraph's node is its SHA-256, a section's that of its paragraphs' nodes, the root that
of the sections' nodes. A fingerprint is the root and the leaves in order, with '.' before each paragraph and '/'
before each section, so equal texts have equal fingerprints and different ones differ in the root.

Roots test equality; ``differing_sections`` and ``differing_paragraphs`` follow the branches that differ, which are
aligned by value: what comes after an inserted one is not different. The
likeness of two fingerprints is the Dice coefficient of their sets of leaves.

Documents are doc_id and text: rows equal in both are one document, and each of them gets its result. A null id comes
before all others, a null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

_WIDE = "".join(rf"\u{a:04x}-\u{a + 0x7F:04x}" for a in range(0x3000, 0xD400, 0x400))
_CUT = rf"(?:(?<=[^a-sA-S] )|(?<=[jkqvxzJKQVXZ257])|(?<=[\u0e00-\uffff&&[\u0e00-\u0e0f{_WIDE}]])|\z)"
_CLAUSE = rf"(?s)\A\z|\A.{{1,4}}?{_CUT}|\A.{{4}}|.{{1,32}}?{_CUT}|.{{32}}"


def sections(text: Column) -> Column:
    return F.split(text, "\n\n")


def _nodes(text: Column) -> Column:
    """Nodes of the paragraphs, by section."""
    return F.transform(sections(text), lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def section_nodes(text: Column) -> Column:
    return F.transform(_nodes(text), lambda ps: F.sha2(F.array_join(ps, ","), 256))


def root(text: Column) -> Column:
    return F.sha2(F.array_join(section_nodes(text), ","), 256)


def leaf_tree(text: Column) -> Column:
    """Leaves by section, paragraph and clause."""
    return F.transform(sections(text), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(_CLAUSE), F.lit(0)), lambda c: F.hash(c))))


def leaves(tree: Column) -> Column:
    return F.flatten(F.flatten(tree))


def fingerprint(root_node: Column, tree: Column) -> Column:
    def paragraph(p: Column) -> Column:
        return F.concat(F.lit("."), F.array_join(F.transform(p, lambda leaf: F.lpad(F.hex(leaf.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))

    return F.concat(root_node, F.array_join(F.transform(tree, lambda s: F.concat(F.lit("/"), F.array_join(F.transform(s, paragraph), ""))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of leaves."""
    return F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def _with(value: Column, f) -> Column:
    """f of the value, worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _some(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _differing(a: Column, b: Column) -> Column:
    """(x, y): numbers of the nodes of a that b lacks or has less often, beside those of b that a has less often, in order;
    null where there are fewer. Where both have the same nodes in another order, the numbers at which they differ."""

    def told(x: Column) -> Column:  # each with the number of its equals before it
        return F.transform(x, lambda v, i: F.concat_ws("|", v, F.size(F.filter(F.slice(x, F.lit(1), i), lambda w: w == v))))

    def alone(x: Column, y: Column) -> Column:
        return _some(F.transform(x, lambda v, i: F.when(~F.array_contains(y, v), i)))

    def beside(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: F.struct(p.alias("x"), q.alias("y")))

    def pairs(s: Column) -> Column:
        moved = F.zip_with(s["a"], s["b"], lambda p, q: p.eqNullSafe(q))
        moved = _some(F.transform(moved, lambda same, i: F.when(~same, i)))
        found = beside(alone(s["a"], s["b"]), alone(s["b"], s["a"]))
        return F.when(F.size(found) > 0, found).otherwise(beside(moved, moved))

    return _with(F.struct(a.alias("a"), b.alias("b")), lambda s: _with(F.struct(told(s["a"]).alias("a"), told(s["b"]).alias("b")), pairs))


def _numbers(pairs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.coalesce(p["x"], p["y"]))))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of a that differ or that b lacks; of b, for those that it has more."""
    return _numbers(_differing(section_nodes(a), section_nodes(b)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraphs) for the sections that differ."""
    x, y = _nodes(a), _nodes(b)
    none = F.expr("cast(array() AS array<string>)")
    part = lambda nodes, i: F.coalesce(F.get(nodes, i), none)
    return F.transform(_differing(section_nodes(a), section_nodes(b)), lambda p: F.struct(F.coalesce(p["x"], p["y"]).alias("section"), _numbers(_differing(part(x, p["x"]), part(y, p["y"]))).alias("paragraphs")))


def trees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint), one row for each row of docs."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return body.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(root(F.col("text")), leaf_tree(F.col("text"))).alias("fingerprint"))


def successors(keys: DataFrame) -> DataFrame:
    """keys (id, key, ...) with next_id and next_key: those of the next row by descending (id, key); after the last, of the first.

    Rows are dealt out by range and numbered within their partitions; of each partition only its first row meets the others'.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = [F.col("id").desc_nulls_last(), F.col("key").desc()]
    part = keys.repartitionByRange(n, *down).withColumn("part", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy("part").orderBy(*down)
    inner = part.withColumn("next", F.lead(F.struct("id", "key")).over(own))
    firsts = part.groupBy("part").agg(F.max_by(F.struct("id", "key"), F.struct(F.col("id").isNotNull().alias("has"), "id", "key")).alias("head"))
    line = Window.orderBy("part")  # one row for each partition
    heads = firsts.select(F.col("part").alias("of"), F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("head"))
    joined = inner.join(F.broadcast(heads), F.col("part") == F.col("of"))
    return joined.withColumn("after", F.coalesce("next", "head")).select(*keys.columns, F.col("after.id").alias("next_id"), F.col("after.key").alias("next_key"))


def compared_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text: the last half (rounded down) of its characters replaced by the first as many, or all,
    of the next document by descending doc_id; after the last comes the first.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of docs.
    """
    prepare(docs.sparkSession)
    own = F.col(doc_id).cast("long")
    # a null id stands lowest, and its rows have keys of their own
    told = docs.select(F.coalesce(own, F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), own.isNull().alias("none"))
    told = told.withColumn("key", F.xxhash64("text", "none"))
    body = told.select("id", "text", "key")
    counted = told.select("id", "key", "none", F.length("text").alias("n")).groupBy("id", "key", "none", "n").agg(F.count("*").alias("times")).checkpoint()
    repeated = not counted.filter("times > 1").isEmpty()
    if repeated:
        body = body.dropDuplicates(["id", "key", "text"])
    asked = successors(counted.select("id", "key", "none", "n")).select("none", F.col("next_id").alias("of"), F.col("next_key").alias("of_key"), F.col("id").alias("for"), F.col("key").alias("for_key"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    # both joins read the same columns of body by the same key, so its texts are shuffled once
    given = body.join(asked.hint("shuffle_hash"), (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key"))).select("for", "for_key", "none", "half", F.substring("text", 1, F.col("half")).alias("head"), leaves(leaf_tree(F.col("text"))).alias("next_leaves"))
    both = body.join(given.hint("shuffle_hash"), (F.col("id") == F.col("for")) & (F.col("key") == F.col("for_key")))
    both = both.select("id", "key", "none", "text", "next_leaves", F.length("text").cast("long").alias("n_chars"), F.concat(F.substring("text", 1, F.length("text") - F.col("half")), "head").alias("edited"))
    both = both.withColumn("tree", leaf_tree(F.col("text"))).withColumn("edited_tree", leaf_tree(F.col("edited")))
    out = both.select(
        "id",
        "key",
        "none",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(root(F.col("text")), F.col("tree")).alias("fingerprint"),
        fingerprint(root(F.col("edited")), F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(leaves(F.col("tree")), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(leaves(F.col("tree")), F.col("next_leaves")).alias("near_next"),
    )
    if repeated:
        times = counted.filter("times > 1").select(F.col("id").alias("r"), F.col("key").alias("k"), "times")
        out = out.join(times, (F.col("id") == F.col("r")) & (F.col("key") == F.col("k")), "left").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    named = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), *named)
