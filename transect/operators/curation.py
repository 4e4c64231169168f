"""From scanned annotations to a clean corpus: de-duplication, names, leak guard, counters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transect.functions import geometry as g
from transect.operators.ordering import percentiles
from transect.session import prepare


def first_seen(images: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """Of images with one content hash, the first in emission order: source, split, path. Summed before the shuffle, so copies are no hot key."""
    rest = [c for c in images.columns if c != content and c not in order]
    first = images.groupBy(content).agg(F.min(F.struct(*order, *rest)).alias("_first"), F.count("*").alias("copies"))
    return first.select(content, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)], "copies")


def with_unique_names(images: DataFrame, stem: str, content: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """images with ``name``: the stem, and where an earlier image (of the same ``within``) has it too, the first 8 digits of the content hash after it.

    The first of a stem is found by sums before the shuffle, and joined back; ``order`` tells images of one stem apart. Images without a stem have no name."""
    keys = [*within, stem]
    first = images.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    later = F.concat_ws("_", F.col(stem), F.substring(content, 1, 8))
    named = images.join(first, same).withColumn("name", F.when(F.struct(*order).eqNullSafe(F.col("_first")) | F.col(stem).isNull(), F.col(stem)).otherwise(later))
    return named.drop("_first", *[f"_{c}" for c in keys])


def collapse_augmentations(files: DataFrame, by: Sequence[str], base: str, path: str) -> DataFrame:
    """One file for each base name, the first by path, and how many there were."""
    return files.groupBy(*by, base).agg(F.min(path).alias(path), F.count("*").alias("n_files"))


def without_leaks(train: DataFrame, held_out: DataFrame, content: str) -> DataFrame:
    """Training rows whose content isn't in the held-out set."""
    return train.join(held_out.select(content).distinct(), content, "left_anti")


def containing(texts: DataFrame, passages: DataFrame, text: str, width: int = 8, most_chars: int = 2_000_000) -> DataFrame:
    """(md5): of the texts that have a whole passage verbatim in them, at any place. Empty passages are none.

    Passages of ``most_chars`` characters together make one automaton, which each task builds and runs over its texts once, whatever their
    number and lengths; no row is made for a word, and nothing is joined. Of more passages, the long ones are found by anchors: a
    passage's words but its first and last, which may be parts of longer ones, are words of any text that has it, so the first
    ``width`` of them, hashed, join the hashed word windows of texts, and pairs that meet are verified on the texts. Those with too
    few words for that go by automata, in blocks of ``most_chars``.
    """
    told = passages.select(F.col(text).alias("_passage")).filter("_passage <> ''").distinct()
    own = texts.select(F.md5(text).alias("md5"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    if (told.agg(F.sum(F.length("_passage"))).first()[0] or 0) <= most_chars:
        return _with_any(own, told, most_chars).distinct()
    words = lambda c: F.split(c, r"\s+")
    told = told.withColumn("_words", words(F.col("_passage"))).withColumn("_long", F.size("_words") >= width + 2)
    anchors = told.filter("_long").select("_passage", F.xxhash64(F.slice("_words", 2, width)).alias("_anchor"))
    cut = own.select("md5", words(F.col("_text")).alias("_words")).filter(F.size("_words") >= width + 2)
    windows = cut.select("md5", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("_words") - width + 1), lambda k: F.xxhash64(F.slice("_words", k, width)))).alias("_window"))
    met = windows.join(anchors, F.col("_window") == F.col("_anchor")).select("md5", "_passage").distinct()
    long = own.join(met, "md5").filter(F.contains("_text", "_passage")).select("md5")
    return long.union(_with_any(own, told.filter("NOT _long").select("_passage"), most_chars)).distinct()


def _with_any(own: DataFrame, passages: DataFrame, most_chars: int) -> DataFrame:
    """(md5) of rows (md5, _text) whose text has any of the passages, by one automaton for each block of them."""
    prepare(own.sparkSession)
    out = own.select("md5").limit(0)
    for block in _blocks(passages, most_chars):
        shared = own.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for passage in shared.value:
                automaton.add_word(passage)
            automaton.make_automaton()
            for batch in batches:
                hit = pa.array([next(automaton.iter(t), None) is not None for t in batch.column(1).to_pylist()], pa.bool_())
                yield batch.select(["md5"]).filter(hit)

        out = out.union(own.mapInArrow(run, "md5 string"))
    return out


def _blocks(passages: DataFrame, most_chars: int) -> Iterator[list[str]]:
    """Passages in blocks of ``most_chars`` characters, or of one longer passage; a block is held at a time."""
    block, size = [], 0
    for r in passages.toLocalIterator():
        if block and size + len(r._passage) > most_chars:
            yield block
            block, size = [], 0
        block.append(r._passage)
        size += len(r._passage)
    if block:
        yield block


def frame_counts(frames: DataFrame, boxes: DataFrame, key: str = "frame") -> DataFrame:
    """frames with n_boxes; frames without boxes, the confirmed negatives, have 0."""
    return frames.join(boxes.groupBy(key).agg(F.count("*").alias("n_boxes")), key, "left").fillna(0, "n_boxes")


def source_counters(counted: DataFrame) -> DataFrame:
    """(source, images, boxes, backgrounds), and a row ALL."""
    out = counted.rollup("source").agg(F.grouping("source").alias("_all"), F.count("*").alias("images"), F.sum("n_boxes").alias("boxes"), F.count_if(F.col("n_boxes") == 0).alias("backgrounds"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("source")).alias("source"), "images", "boxes", "backgrounds")


def normalization_counters(files: DataFrame) -> DataFrame:
    """files (source, content, base, path, n_boxes, missing, reoriented) -> (source, images, boxes, backgrounds, missing, augmented, dup_skipped, reoriented), and a row ALL.

    What happens to a file, in this order: missing images are left out; of the augmentations (equal source and base) the
    first by path stays; of equal contents, over all sources, the first by source and path.
    """
    present = files.filter("NOT missing")
    collapsed = present.groupBy("source", "base").agg(F.min(F.struct("path", "content", "n_boxes", "reoriented")).alias("_f")).select("source", "_f.*")
    seen = first_seen(collapsed, "content", ["source", "path"]).groupBy("source").agg(F.count("*").alias("images"), F.sum("n_boxes").alias("boxes"), F.count_if(F.col("n_boxes") == 0).alias("backgrounds"), F.count_if("reoriented").alias("reoriented"))
    steps = files.groupBy("source").agg(F.count_if("missing").alias("missing"), F.count_if(~F.col("missing")).alias("_present"))
    kept = collapsed.groupBy("source").agg(F.count("*").alias("_collapsed"))
    rows = steps.join(kept, "source", "left").join(seen, "source", "left").fillna(0)
    rows = rows.withColumn("augmented", F.col("_present") - F.col("_collapsed")).withColumn("dup_skipped", F.col("_collapsed") - F.col("images"))
    names = ("images", "boxes", "backgrounds", "missing", "augmented", "dup_skipped", "reoriented")
    out = rows.rollup("source").agg(F.grouping("source").alias("_all"), *[F.sum(n).alias(n) for n in names])
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("source")).alias("source"), *names)


def kept_rows(manifest: DataFrame, split: str, sources: Sequence[str]) -> DataFrame:
    """Rows of a split manifest (source, split, kept, ...) that a set is made of."""
    return manifest.filter((F.col("kept") == 1) & (F.col("split") == split) & F.col("source").isin(*sources))


def sources_by_median(scale: DataFrame, median: str = "p50") -> DataFrame:
    """Rows of ``box_scale`` but ALL, with ``place``: smallest median first, equal ones by name. One row for each source."""
    return scale.filter("source <> 'ALL'").withColumn("place", F.row_number().over(Window.orderBy(median, "source")))


def box_scale(frames: DataFrame, boxes: DataFrame, percentages: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(source, images, background, boxes, p5, ...): exact percentiles of box sizes in pixels, with a row ALL.

    Sources without boxes have no row of their own, but count in ALL. boxes: frame, w, h (pixels).
    """
    per_frame = frame_counts(frames, boxes)
    counts = source_counters(per_frame)
    sized = boxes.join(frames.select("frame", "source"), "frame").withColumn("size", g.sqrt_area(F.col("w"), F.col("h"), F.lit(1.0), F.lit(1.0)))
    shares = percentiles(sized, "source", "size", percentages).withColumnRenamed("values", "_p")
    shares = shares.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("source")).alias("of"), "_p")
    named = [F.col("_p")[k].alias(f"p{round(100 * p)}") for k, p in enumerate(percentages)]
    return counts.join(shares, F.col("source").eqNullSafe(F.col("of"))).select("source", "images", F.col("backgrounds").alias("background"), "boxes", *named)


def split_crosstab(rows: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(source, frames and boxes of each split)."""
    return rows.groupBy("source").agg(*[x for s in splits for x in (F.count_if(F.col("split") == s).alias(f"{s}_frames"), F.coalesce(F.sum(F.when(F.col("split") == s, F.col("boxes"))), F.lit(0)).alias(f"{s}_boxes"))])


def tier_boxes(boxes: DataFrame, tier: Column) -> DataFrame:
    """Every box in the tier ``all``, certain ones in ``certain`` too."""
    return boxes.withColumn("tier", F.explode(F.when(tier == "certain", F.array(F.lit("all"), F.lit("certain"))).otherwise(F.array(F.lit("all")))))
