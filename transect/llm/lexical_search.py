"""Ranked lexical search: for each item, the k documents of highest score, exactly.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A term adds to a document's score
w * ((10^9 tf) div (1000 tf + 8 m)), its impact, for each time that it occurs in the item (w, m: ``weight`` and ``length_part``).

A threshold-seeded join. The k-th impact of a term over all documents, times the term's repeats in an item, bounds the item's
k-th score from below; the greatest of these is the item's threshold. An item's terms are put by descending bound (greatest impact
times repeats), and the suffix whose bounds add up to less than the threshold is pruned: documents that have none of the terms before it
can't be among the k. Documents with one of them are candidates. What a candidate has of those terms, with the bounds of
the pruned ones, must reach the threshold too, which rises with the best scores that a task has seen; then it is rescored exactly.

How it is spread: texts are read once for a block of items (``BLOCK_TERMS`` terms; one longer item is a block of its own), and of each
document only the terms of the block's items are kept, as numbers and counts in one row, checkpointed. The block's terms, impacts and
lists of items are broadcast, so what is broadcast and held is bounded by the block, not by the documents or items. Of impacts and of
scores, tasks give k for each term or item at most, which windows then rank. Terms are told apart by 64-bit hashes.

Null texts have no terms. Rows are documents and items, whatever their ids; a null doc_id comes after all others of its score, and equal
ids of equal scores get neighbouring ranks. Items without terms, or whose terms no document has, give no rows. Empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, prepare, text_slices, word_spans

K = 10
BLOCK_TERMS = 1 << 18
_EXPANDED = 1 << 20  # pairs of a posting and an item at once

_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def weight(n_docs: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having + 1)))


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // n_terms


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of all terms, and for each row the number of its first term)."""
    for first, last, raw, at in text_slices(column):
        raw = _LOWER[raw]
        starts, ends, of_row = word_spans(raw, at, _GAPS)
        yield first, last, hash_words(raw, starts, ends)[0], of_row


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then starts[1], ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Block:
    """Items of one block: entries (item, term, repeats), by item. Terms are numbers in ``hashes``, which are sorted."""

    def __init__(self, ids: list, hashes: list[np.ndarray]):
        self.ids = ids
        self.hashes, number = np.unique(np.concatenate(hashes), return_inverse=True)
        item = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        key, self.repeats = np.unique(item * len(self.hashes) + number, return_counts=True)
        self.item, self.term = key // len(self.hashes), key % len(self.hashes)


class Plan:
    """Thresholds, and lists of the items that a term is essential for and of the pruned terms of an item; kth, most: a term's
    k-th impact (0 without one) and its greatest."""

    def __init__(self, block: Block, kth: np.ndarray, most: np.ndarray):
        item, term, repeats, n, t = block.item, block.term, block.repeats, len(block.ids), len(block.hashes)
        self.threshold = np.zeros(n, np.int64)
        np.maximum.at(self.threshold, item, repeats * kth[term])
        bound = repeats * most[term]
        order = np.lexsort((term, bound, item))  # ascending, so a suffix of the descending order is a prefix here
        so_far = np.cumsum(bound[order])
        first = np.searchsorted(item[order], np.arange(n))
        so_far -= (np.r_[0, so_far][first])[item[order]]
        pruned = np.empty(len(item), bool)
        pruned[order] = so_far < self.threshold[item[order]]
        self.rest = np.bincount(item[pruned], bound[pruned], n).astype(np.int64)
        kept = np.flatnonzero(~pruned)
        kept = kept[np.argsort(term[kept], kind="stable")]
        self.essential = np.searchsorted(term[kept], np.arange(t + 1)), item[kept], repeats[kept]
        gone = np.flatnonzero(pruned)  # by item
        self.pruned = np.searchsorted(item[gone], np.arange(n + 1)), term[gone], repeats[gone]


def forward_rows(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents (doc_id, text) that have terms: all their terms' number, and those among ``hashes`` with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(hashes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for first, last, found, at in term_hashes(batch.column(1)):
                row = np.repeat(np.arange(last - first), np.diff(at))
                number = np.minimum(np.searchsorted(table, found), len(table) - 1)
                hit = table[number] == found
                key, tf = np.unique(row[hit] * len(table) + number[hit], return_counts=True)
                offsets = np.searchsorted(key // len(table), np.arange(last - first + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (key % len(table), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(at)), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>").filter("n > 0")


def _postings(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of the postings of forward rows, by row and term."""
    lists = batch.column(2)
    row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)
    m = length_part(batch.column(1).to_numpy(), n_docs, n_terms)
    return row, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


def _best(group: np.ndarray, value: np.ndarray, k: int, *ties: np.ndarray) -> np.ndarray:
    """Places of the k of greatest value in each group, ties by ascending arrays, the last one foremost."""
    order = np.lexsort((*ties, -value, group))
    ordered = group[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def term_impacts(forward: DataFrame, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, kth, most) of terms that documents have: the k-th impact (0 if there is none) and the greatest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, impacts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            _, term, impact = _postings(batch, weights.value, n_docs, n_terms)
            terms, impacts = np.r_[terms, term], np.r_[impacts, impact]
            kept = _best(terms, impacts, k)
            terms, impacts = terms[kept], impacts[kept]
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(impacts)], ["term", "impact"])

    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.col("impact").desc()))
    first = forward.mapInArrow(run, "term int, impact long").withColumn("nth", nth).filter(F.col("nth") <= k)
    return first.groupBy("term").agg(F.when(F.count("*") >= k, F.min("impact")).otherwise(0).alias("kth"), F.max("impact").alias("most"))


def _candidates(plan: Plan, threshold: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score) of the documents that may reach the items' thresholds, rescored."""
    at, items, repeats = plan.essential
    counts = at[term + 1] - at[term]
    entry = _spread(at[term], counts)
    n = len(threshold)
    pair, place = np.unique(np.repeat(row, counts) * n + items[entry], return_inverse=True)
    part = np.zeros(len(pair), np.int64)
    np.add.at(part, place, np.repeat(impact, counts) * repeats[entry])
    item = pair % n
    may = part + plan.rest[item] >= threshold[item]
    pair, item, part = pair[may], item[may], part[may]
    at, terms, repeats = plan.pruned
    counts = at[item + 1] - at[item]
    entry, place = _spread(at[item], counts), np.repeat(np.arange(len(pair)), counts)
    width = len(plan.essential[0])
    keys, asked = row * width + term, np.repeat(pair // n, counts) * width + terms[entry]
    found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[found] == asked if len(keys) else np.zeros(0, bool)
    np.add.at(part, place[hit], impact[found[hit]] * repeats[entry[hit]])
    return pair // n, item, part


def ranked(forward: DataFrame, plan, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item (its number in the block) in each task; more than k of an item over all tasks."""
    kind = forward.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = plan.value
        threshold, n = asked.threshold.copy(), len(asked.threshold)
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]  # item, score, doc_id, no doc_id
        for batch in batches:
            row, term, impact = _postings(batch, weights.value, n_docs, n_terms)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy()
            at = asked.essential[0]
            work = np.cumsum(at[term + 1] - at[term])
            first = 0
            while first < len(row):  # whole rows, some _EXPANDED pairs of a posting and an item
                last = int(np.searchsorted(work, (work[first - 1] if first else 0) + _EXPANDED, "right"))
                last = max(int(np.searchsorted(row, row[min(last, len(row) - 1)])) if last < len(row) else len(row), int(np.searchsorted(row, row[first], "right")))
                of, item, score = _candidates(asked, threshold, row[first:last], term[first:last], impact[first:last])
                some = score > 0
                best = [np.r_[a, b[some]] for a, b in zip(best, (item, score, ids[of], none[of]), strict=True)]
                kept = _best(best[0], best[1], k, best[2], best[3])
                best = [a[kept] for a in best]
                kth = np.searchsorted(best[0], np.arange(n)) + k - 1
                full = np.flatnonzero(kth < len(best[0]))
                full = full[best[0][kth[full]] == full]
                threshold[full] = np.maximum(threshold[full], best[1][kth[full]])
                first = last
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[2], mask=best[3]).cast(batch_type), pa.array(best[1])], ["item", "doc_id", "score"])

    batch_type = {"int": pa.int32(), "bigint": pa.int64()}[kind]
    return forward.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[Block]:
    """Items (item_id, text) that have terms, in blocks; a block is held at a time."""
    ids, hashes, size = [], [], 0
    for r in items.filter("text <> ''").toLocalIterator():
        found = next(term_hashes(pa.array([r.text])))[2]
        if size and size + len(found) > block_terms:
            yield Block(ids, hashes)
            ids, hashes, size = [], [], 0
        if len(found):
            ids, hashes, size = [*ids, r.item_id], [*hashes, found], size + len(found)
    if size:
        yield Block(ids, hashes)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, equal ones by ascending doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    context = spark.sparkContext
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for block in _blocks(items, block_terms):
        forward = forward_rows(docs, block.hashes).checkpoint()
        n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weights, kth, most = (np.zeros(len(block.hashes), np.int64) for _ in range(3))
        for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a block's terms
            weights[r.term] = weight(n_docs, r.df)
        shared = context.broadcast(weights)
        for r in term_impacts(forward, shared, n_docs, n_terms, k).collect():  # a block's terms
            kth[r.term], most[r.term] = r.kth, r.most
        plan = context.broadcast(Plan(block, kth, most))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        found = ranked(forward, plan, shared, n_docs, n_terms, k).withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: a block's items
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS repeats FROM i GROUP BY i, item_id, term),
a AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, n_docs),
s AS (SELECT i, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), a GROUP BY i, item_id, r, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
